"""Whole runs over saved models: fit and apply feature models, classifiers, encoders and clusterings by name."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.planning import cut
from ..operators import clustering, corex, preparation, tsetlin
from ..operators.tokenizer import Params, Vocabulary, fingerprints
from ..sources.registry import Registry


def opened(reg: Registry | str) -> Registry:
    """A registry, or the one in that folder of the active session."""
    return reg if isinstance(reg, Registry) else Registry(SparkSession.active(), reg)


def load_words(reg: Registry | str, name: str, vectors: DataFrame) -> None:
    """vectors(line, word, vec). A word met several times keeps its first line; ids are line numbers."""
    reg = opened(reg)
    first = vectors.where("word <> ''").groupBy("word").agg(F.min_by(F.struct("line", "vec"), "line").alias("x"))
    rows = cut(first.select(F.col("x.line").alias("id"), "word", F.col("x.vec").alias("vec")))
    dims = rows.select(F.size("vec").alias("n")).first()
    reg.insert("words", name, {"n": rows.count(), "dims": dims["n"] if dims else 0}, words=rows)


def create_clusters(reg: Registry | str, name: str, words: str, algorithm: str, *args: float, only: DataFrame | None = None) -> None:
    reg = opened(reg)
    if reg.exists("clusters", name):
        raise ValueError(f"clusters {name} exists already")
    vectors = reg.table("words", words, "words") if reg.params("words", words) else None
    vectors = clustering.filter_words(vectors, only) if only is not None else vectors
    found = clustering.create(clustering.unit_rows(vectors, "id", "vec"), algorithm, *args)
    reg.insert("clusters", name, {"words": words, "algorithm": algorithm, "args": list(args)}, clusters=found)


def create_modeler(reg: Registry | str, name: str, params: Params, docs: DataFrame, text: str = "text", key: str = "doc_id", hidden: int | None = None, iterations: int | None = None, eps: float | None = None, supervision: float = 0.0, report: Callable[[int, float, float], None] | None = None) -> Vocabulary:
    """With hidden, iterations and eps a compressor is fitted on the fingerprints and saved under the same name; with
    ``supervision`` the column ``label`` of docs counts as features of that weight. ``report`` gets each iteration, its objective
    and its seconds."""
    reg = opened(reg)
    given = [x is not None for x in (hidden, iterations, eps)]
    if any(given) and not all(given):
        raise ValueError("hidden, iterations and eps are needed together")
    if reg.exists("modeler", name):
        raise ValueError(f"modeler {name} exists already")
    v = Vocabulary(params).train(docs, key, text).finalize()
    if all(given):
        prints, classes = fingerprints(docs, v, key, text), 0
        if supervision:
            dictionary = cut(preparation.label_dictionary(docs, key))
            classes = dictionary.count()
            labelled = preparation.with_label_ids(docs.where("label is not null"), dictionary).select(key, "label_id")
            prints = prints.join(labelled, key)
        began = [time.monotonic()]

        def each(iteration: int, objective: float) -> None:
            if report:
                report(iteration, objective, time.monotonic() - began[0])
            began[0] = time.monotonic()

        c = corex.fit(cut(prints), v.size(), hidden, iterations, eps, each=each, classes=classes, supervision=supervision)
        reg.save_compressor(name, c, v.size(), iterations=iterations, eps=eps)
    reg.save_vocabulary(name, v, features=v.size(), hidden=hidden if all(given) else v.size(), compressed=all(given))
    return v


def model(reg: Registry | str, name: str, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): features, or the hidden bits of a modeler with a compressor."""
    reg = opened(reg)
    v = reg.load_vocabulary(name)
    rows = fingerprints(docs, v, key, text)
    if not reg.params("modeler", name).get("compressed"):
        return rows
    return corex.compress(rows, reg.load_compressor(name), v.size(), key).withColumnRenamed("code", "ids")


def width(reg: Registry | str, name: str) -> int:
    """Bits that ``model`` gives."""
    reg = opened(reg)
    p = reg.params("modeler", name)
    return p["hidden"] if p.get("compressed") else reg.load_vocabulary(name).size()


Report = Callable[[int, float, float | None, float], bool | None]


def _scored(score: Callable, train: DataFrame, test: DataFrame | None, report: Report | None, each: Callable | None) -> Callable | None:
    """``each`` of the training: ``report`` gets the epoch, the scores on train and test (None without one) and the seconds of
    training since the last report; False stops."""
    if report is None:
        return each

    began = [time.monotonic()]

    def both(epoch: int, m: tsetlin.Machine) -> bool:
        took = time.monotonic() - began[0]
        go = report(epoch, score(train, m), None if test is None else score(test, m), took) is not False
        began[0] = time.monotonic()
        return (each is None or each(epoch, m) is not False) and go

    return both


def create_classifier(reg: Registry | str, name: str, modeler: str, samples: DataFrame, settings: tsetlin.Settings, each: Callable | None = None, test: DataFrame | None = None, report: Report | None = None) -> tsetlin.Machine:
    """samples and test(doc_id, label, text). Only samples are learnt; a label that only test has is an error."""
    reg = opened(reg)
    if reg.exists("classifier", name):
        raise ValueError(f"classifier {name} exists already")
    dictionary = cut(preparation.label_dictionary(samples, "doc_id"))
    labels = [r["label"] for r in dictionary.orderBy("label_id").collect()]  # one row per class

    def prepared(part: DataFrame) -> DataFrame:
        known = preparation.with_label_ids(part, dictionary)
        return cut(model(reg, modeler, part).join(known.select("doc_id", "label_id"), "doc_id").select("ids", "label_id"))

    rows, held = prepared(samples), None if test is None else prepared(test)
    m = tsetlin.train_classifier(rows, width(reg, modeler), len(labels), settings, _scored(tsetlin.accuracy, rows, held, report, each))
    reg.save_machine("classifier", name, m, modeler=modeler, labels=[str(x) for x in labels])
    return m


def classify(reg: Registry | str, name: str, docs: DataFrame) -> DataFrame:
    reg = opened(reg)
    m, p = reg.load_machine("classifier", name)
    return tsetlin.classify(model(reg, p["modeler"], docs), m, p["labels"])


def create_encoder(reg: Registry | str, name: str, modeler: str, triplets: DataFrame, hidden: int, settings: tsetlin.Settings, each: Callable | None = None, test: DataFrame | None = None, report: Report | None = None) -> tsetlin.Machine:
    """triplets and test(anchor, positive, negative). Only triplets are learnt. Every distinct sentence is modelled once."""
    reg = opened(reg)
    if reg.exists("encoder", name):
        raise ValueError(f"encoder {name} exists already")

    def prepared(part: DataFrame) -> DataFrame:
        sentences = preparation.sentences_of(part, "anchor", "positive", "negative")
        prints, rows = cut(model(reg, modeler, sentences, "text", "text")), part
        for c, short in (("anchor", "a"), ("positive", "p"), ("negative", "n")):
            rows = rows.join(prints.select(F.col("text").alias(c), F.col("ids").alias(short)), c)
        return cut(rows.select("a", "p", "n"))

    rows, held = prepared(triplets), None if test is None else prepared(test)
    m = tsetlin.train_encoder(rows, width(reg, modeler), hidden, settings, _scored(tsetlin.triplet_score, rows, held, report, each))
    reg.save_machine("encoder", name, m, modeler=modeler, hidden=hidden)
    return m


def encode(reg: Registry | str, name: str, docs: DataFrame) -> DataFrame:
    reg = opened(reg)
    m, p = reg.load_machine("encoder", name)
    return tsetlin.encode(model(reg, p["modeler"], docs), m)
