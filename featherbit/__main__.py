"""Command line: python -m featherbit COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class TrainTest(argparse.Action):
    """One or two files: to train on, and to test on."""

    def __call__(self, parser, namespace, values, option_string=None) -> None:
        if len(values) > 2:
            parser.error(f"{option_string}: a train file and at most one test file")
        setattr(namespace, self.dest, values)


def report(epoch: int, train: float, test: float | None, seconds: float) -> None:
    print(json.dumps({"epoch": epoch, "test": test, "train": train, "seconds": round(seconds, 3)}))


def iteration(number: int, objective: float, seconds: float) -> None:
    print(json.dumps({"iteration": number, "objective": objective, "seconds": round(seconds, 3)}))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="featherbit")
    groups = top.add_subparsers(dest="group", required=True)

    def command(group: argparse._SubParsersAction, name: str) -> argparse.ArgumentParser:
        p = group.add_parser(name)
        p.set_defaults(what=name)
        return p

    process = groups.add_parser("process").add_subparsers(required=True)
    for name, many in (("snli", "inputs"), ("imdb", "dirs")):
        p = command(process, name)
        p.add_argument(f"--{many}", nargs="+", required=True)
        p.add_argument("--train-test-ratio", type=float)
        p.add_argument("--triplets" if name == "snli" else "--samples", nargs="+")
        p.add_argument("--sentences", nargs="+")
        p.add_argument("--max", type=int)
        p.add_argument("--seed", type=int, default=0)
    p = command(groups.add_parser("load").add_subparsers(required=True), "words")
    for o in ("--cache", "--name", "--file"):
        p.add_argument(o, required=True)
    create = groups.add_parser("create").add_subparsers(required=True)
    p = command(create, "clusters")
    for o in ("--cache", "--name", "--words"):
        p.add_argument(o, required=True)
    p.add_argument("--algorithm", nargs="+", required=True)
    p.add_argument("--filter")
    p = command(create, "modeler")
    for o in ("--cache", "--name"):
        p.add_argument(o, required=True)
    texts = p.add_mutually_exclusive_group(required=True)
    texts.add_argument("--sentences", nargs="+")
    texts.add_argument("--samples", nargs="+")
    for o, kind, default in (("--max-df", float, 1.0), ("--min-df", float, 0.0), ("--max-len", int, 20), ("--min-len", int, 2), ("--ngrams", int, 1), ("--cgrams", int, 0)):
        p.add_argument(o, type=kind, default=default)
    p.add_argument("--compress", nargs=3, metavar=("HIDDEN", "ITERATIONS", "EPS"))
    p.add_argument("--supervision", type=float, default=0.0)
    for name in ("classifier", "encoder"):
        p = command(create, name)
        for o in ("--cache", "--name", "--modeler"):
            p.add_argument(o, required=True)
        p.add_argument("--samples" if name == "classifier" else "--triplets", nargs="+", required=True, action=TrainTest)
        for o, kind, default in (("--clauses", int, 64), ("--state", int, 8), ("--target", int, 32), ("--active", float, 0.85), ("--evaluate-every", int, 1), ("--iterations", int, 5), ("--seed", int, 0)):
            p.add_argument(o, type=kind, default=default)
        p.add_argument("--specificity", type=float, nargs=2, default=(2.0, 50.0))
        p.add_argument("--boost", action="store_true")
        if name == "encoder":
            for o, kind, default in (("--hidden", int, 64), ("--margin", float, 0.1), ("--alpha", float, 0.25)):
                p.add_argument(o, type=kind, default=default)
    p = command(groups.add_parser("explore").add_subparsers(required=True), "imdb")
    p.set_defaults(what="explore")
    for o in ("--cache", "--cfg"):
        p.add_argument(o, required=True)
    p.add_argument("--dirs", nargs="+", required=True)
    p.add_argument("--max", type=int)
    return top


def settings(a: argparse.Namespace):
    from .operators.tsetlin import Settings

    more = {"margin": a.margin, "alpha": a.alpha} if a.what == "encoder" else {}
    return Settings(a.clauses, a.state, a.target, *a.specificity, a.active, a.boost, a.iterations, a.evaluate_every, a.seed, **more)


def process(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import preparation, ranking
    from .sources import readers

    if a.what == "snli":
        pairs = preparation.usable_pairs(readers.labelled_pairs(spark, *a.inputs), a.max)
        rows, cols, outs, text = preparation.triplets_of(pairs), ["anchor", "positive", "negative"], a.triplets, None
    else:
        all_rows = readers.reviews(spark, *a.dirs).where("text is not null").withColumnRenamed("path", "sample_id")
        both = preparation.balanced_samples(all_rows.select("sample_id", "label", "text"), seed=a.seed, most=a.max)
        rows = all_rows.join(both.select(F.explode(F.array("positive_id", "negative_id")).alias("sample_id")), "sample_id").select("label", "text")
        cols, outs, text = ["label", "text"], a.samples, ["text"]
    parts = [p for p in ranking.train_test(rows, a.seed, cols, a.train_test_ratio) if p is not None]
    for path, part in zip(outs or [], parts, strict=False):
        readers.write_fields(part, path, *cols)
    for path, part in zip(a.sentences or [], parts, strict=False):
        readers.write_fields(preparation.sentences_of(part, *(text or cols)), path, "text")


def explore(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import explore as search
    from .operators import preparation, ranking, tsetlin
    from .operators.tokenizer import Params
    from .plans import pipelines
    from .sources import readers
    from .sources.registry import Registry

    with open(a.cfg, encoding="utf-8") as f:
        cfg = json.load(f)  # {"modeler": {option: [values]}, "classifier": {...}}
    reg = Registry(spark, a.cache)
    rows = readers.reviews(spark, *a.dirs).withColumn("doc_id", F.xxhash64("path"))
    both = preparation.balanced_samples(rows.select(F.col("doc_id").alias("sample_id"), "label", "text"), most=a.max)
    rows = rows.join(both.select(F.explode(F.array("positive_id", "negative_id")).alias("doc_id")), "doc_id").select("doc_id", F.col("label").cast("string").alias("label"), "text")
    train, test = ranking.train_test(rows, 0, ["doc_id"], 0.95)
    for m, c in search.paired(search.draws(cfg["modeler"]), search.draws(cfg["classifier"], valid=search.fits)):
        names = search.name_of(m), search.name_of(m | c)
        if not reg.exists("modeler", names[0]):
            more = {k: m[k] for k in ("hidden", "iterations", "eps") if k in m}  # of the compressor
            pipelines.create_modeler(reg, names[0], Params(**{k: v for k, v in m.items() if k not in more}), train, **more)
        if not reg.exists("classifier", names[1]):
            pipelines.create_classifier(reg, names[1], names[0], train, tsetlin.Settings(**c))
        said = pipelines.classify(reg, names[1], test).withColumnRenamed("label", "said").join(test, "doc_id")
        score = said.agg(F.avg((F.col("said") == F.col("label")).cast("double"))).first()[0]
        print(json.dumps({"name": names[1], "modeler": m, "classifier": c, "score": score}))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("featherbit").getOrCreate()
    from .operators.tokenizer import Params
    from .plans import pipelines
    from .sources import readers
    from .sources.registry import Registry

    if a.group == "process":
        process(spark, a)
    elif a.group == "explore":
        explore(spark, a)
    elif a.group == "load":
        pipelines.load_words(Registry(spark, a.cache), a.name, readers.word_vectors(spark, a.file))
    elif a.what == "clusters":
        only = readers.lines(spark, a.filter).select(F.col("text").alias("word")) if a.filter else None
        numbers = [float(x) if "." in x else int(x) for x in a.algorithm[1:]]
        pipelines.create_clusters(Registry(spark, a.cache), a.name, a.words, a.algorithm[0], *numbers, only=only)
    elif a.what == "modeler":
        params = Params(a.max_df, a.min_df, a.max_len, a.min_len, a.ngrams, a.cgrams)
        more = dict(zip(("hidden", "iterations", "eps"), (int(a.compress[0]), int(a.compress[1]), float(a.compress[2])), strict=True)) if a.compress else {}
        rows = readers.lines(spark, *a.sentences) if a.sentences else readers.samples(spark, *a.samples, numeric=False).withColumn("doc_id", F.monotonically_increasing_id())
        if a.supervision and not (a.compress and a.samples):
            parser().error("--supervision needs --compress and --samples")
        pipelines.create_modeler(Registry(spark, a.cache), a.name, params, rows, **more, supervision=a.supervision, report=iteration)
    elif a.what == "classifier":
        parts = [readers.samples(spark, x, numeric=False).withColumn("doc_id", F.monotonically_increasing_id()) for x in a.samples]
        pipelines.create_classifier(Registry(spark, a.cache), a.name, a.modeler, parts[0], settings(a), test=parts[1] if len(parts) > 1 else None, report=report)
    else:
        parts = [readers.triplets(spark, x) for x in a.triplets]
        pipelines.create_encoder(Registry(spark, a.cache), a.name, a.modeler, parts[0], a.hidden, settings(a), test=parts[1] if len(parts) > 1 else None, report=report)


if __name__ == "__main__":
    main()
