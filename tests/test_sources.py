import json

import pytest
from pyspark.sql import functions as F

from featherbit.__main__ import main
from featherbit.operators import corex
from featherbit.operators.tokenizer import Params, Vocabulary, fingerprints
from featherbit.operators.tsetlin import Settings
from featherbit.plans import pipelines
from featherbit.sources import readers
from featherbit.sources.registry import Registry
from featherbit.streaming.vocabulary import train_stream, vocabulary_of


def test_text_formats(spark, tmp_path):
    (tmp_path / "v.txt").write_text("The, 1 2.5\nfox -1 0\n")
    assert [(r["word"], r["vec"]) for r in readers.word_vectors(spark, str(tmp_path / "v.txt")).collect()] == [("the", [1.0, 2.5]), ("fox", [-1.0, 0.0])]
    (tmp_path / "w.txt").write_text("a 1 2\nb 1\n")
    with pytest.raises(Exception, match="not 2 numbers"):
        readers.word_vectors(spark, str(tmp_path / "w.txt")).collect()
    (tmp_path / "nli.txt").write_text('h1\th2\th3\th4\th5\th6\th7\th8\nneutral\t_\t_\t_\t_\tsay "a\tb\trest\n-\t_\t_\t_\t_\tc\td\trest\n')
    assert sorted(map(tuple, readers.labelled_pairs(spark, str(tmp_path / "nli.txt")).collect())) == [("-", "c", "d"), ("neutral", 'say "a', "b")]
    for side in ("pos", "neg"):
        (tmp_path / "r" / side).mkdir(parents=True)
        (tmp_path / "r" / side / "1.txt").write_text(f"good\n\t{side}")
    assert sorted((r["label"], r["text"]) for r in readers.reviews(spark, str(tmp_path / "r")).collect()) == [(0, "goodneg"), (1, "goodpos")]
    (tmp_path / "s.txt").write_text("12\ta\tb\n")
    assert [tuple(r) for r in readers.samples(spark, str(tmp_path / "s.txt")).collect()] == [(12, "a\tb")]
    (tmp_path / "bad.txt").write_text("x\ta\n")
    with pytest.raises(Exception, match="no numeric label"):
        readers.samples(spark, str(tmp_path / "bad.txt")).collect()
    t = spark.createDataFrame([("a", "p", "n"), ("b", "q", "m")], "anchor string, positive string, negative string")
    readers.write_fields(t, str(tmp_path / "t"), "anchor", "positive", "negative")
    assert sorted(readers.triplets(spark, str(tmp_path / "t")).collect()) == sorted(t.collect())
    assert readers.lines(spark, str(tmp_path / "v.txt")).count() == 2


def test_saved_models(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "reg"))
    docs = spark.createDataFrame([(i, ("red apple pie", "blue ocean wave")[i % 2] + f" word{i % 3}", ("food", "sea")[i % 2]) for i in range(40)], "doc_id long, text string, label string")
    half = Vocabulary(Params()).train(docs.where("doc_id < 20"))
    reg.save_vocabulary("half", half)
    again = reg.load_vocabulary("half").train(docs.where("doc_id >= 20"))
    assert sorted(again.df.collect()) == sorted(Vocabulary(Params()).train(docs).df.collect())
    with pytest.raises(ValueError):
        reg.save_vocabulary("half", half)
    v = pipelines.create_modeler(reg, "m", Params(), docs)
    assert sorted(reg.load_vocabulary("m").df.collect()) == sorted(v.df.collect()) and reg.names("modeler") == ["half", "m"]
    pipelines.create_classifier(reg, "c", "m", docs, Settings(clauses=10, target=5, specificity_high=5.0, iterations=5))
    said = pipelines.classify(reg, "c", docs).withColumnRenamed("label", "said").join(docs, "doc_id")
    assert said.agg(F.avg((F.col("said") == F.col("label")).cast("double"))).first()[0] > 0.9
    t = spark.createDataFrame([("red apple", "apple pie", "blue wave"), ("blue ocean", "ocean wave", "red pie")] * 5, "anchor string, positive string, negative string")
    pipelines.create_encoder(reg, "e", "m", t, 8, Settings(clauses=4, target=2, iterations=1))
    assert pipelines.encode(reg, "e", docs).count() == 40
    words = spark.createDataFrame([(0, "a", [1.0, 0.0]), (3, "a", [0.0, -1.0]), (1, "b", [0.9, 0.1]), (2, "c", [0.0, 1.0]), (4, "", [1.0, 1.0])], "line long, word string, vec array<float>")
    pipelines.load_words(reg.root, "w", words)  # a folder will do
    assert reg.params("words", "w") == {"n": 3, "dims": 2}
    assert sorted((r["id"], r["word"], r["vec"][0]) for r in reg.table("words", "w", "words").collect())[0] == (0, "a", 1.0)
    pipelines.create_clusters(reg, "k", "w", "k-medoids", 2, 1)
    assert reg.table("clusters", "k", "clusters").count() == 3
    with pytest.raises(KeyError):
        reg.params("words", "none")


def test_compressed_modeler(spark, tmp_path):
    texts = [("red apple pie", "blue ocean wave")[i % 2] + f" word{i % 3}" for i in range(40)]
    (tmp_path / "s.txt").write_text("".join(f"{i % 2}\t{t}\n" for i, t in enumerate(texts)))
    main(["create", "modeler", "--cache", str(tmp_path / "reg"), "--name", "m", "--samples", str(tmp_path / "s.txt"), "--compress", "4", "6", "0.0001"])
    reg = Registry(spark, str(tmp_path / "reg"))
    docs = spark.createDataFrame([(i, t, ("food", "sea")[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, label string")
    v, c = reg.load_vocabulary("m"), reg.load_compressor("m")
    assert reg.names("compressor") == ["m"] and c.hidden == 4 == pipelines.width(reg, "m") and c.on.shape == (2, 4, v.size())
    got = sorted(map(tuple, pipelines.model(reg, "m", docs).collect()))
    assert got == sorted(map(tuple, corex.compress(fingerprints(docs, v), c, v.size()).collect())) and len({tuple(x) for _, x in got}) > 1
    pipelines.create_classifier(reg, "c", "m", docs, Settings(clauses=10, target=5, specificity_high=5.0, iterations=3))
    assert reg.load_machine("classifier", "c")[0].bits == 4 and pipelines.classify(reg, "c", docs).count() == 40
    with pytest.raises(ValueError, match="needed together"):
        pipelines.create_modeler(reg, "n", Params(), docs, hidden=4)


def test_supervised_compressor(spark, tmp_path):
    """Labels count while fitting only; without labels the option is an error."""
    docs = spark.createDataFrame([(i, ("red apple pie", "blue ocean wave")[i % 2] + f" word{i % 3}", ("food", "sea")[i % 2]) for i in range(40)], "doc_id long, text string, label string")
    reg, said = Registry(spark, str(tmp_path / "reg")), []
    v = pipelines.create_modeler(reg, "m", Params(), docs, hidden=4, iterations=4, eps=1e-4, supervision=0.5, report=lambda *x: said.append(x))
    assert reg.load_compressor("m").on.shape == (2, 4, v.size()) and [x[0] for x in said] == list(range(1, len(said) + 1)) and all(x[2] >= 0 for x in said)
    assert pipelines.model(reg, "m", docs.drop("label")).count() == 40
    with pytest.raises(ValueError, match="number of classes"):
        corex.fit(docs, 3, 2, supervision=0.5)


def test_every_command(spark, tmp_path, capsys):
    """One run through all commands: process, load, create, explore."""
    at = lambda x: str(tmp_path / x)
    nli = [("entailment", "a dog runs", "an animal moves"), ("neutral", "a dog runs", "the dog is brown"), ("contradiction", "a dog runs", "a cat sleeps"), ("-", "x", "y")]
    (tmp_path / "nli.txt").write_text("h\n" + "".join("\t".join([x, "_", "_", "_", "_", a, b, "r"]) + "\n" for x, a, b in nli * 2))
    main(["process", "snli", "--inputs", at("nli.txt"), "--triplets", at("t"), at("u"), "--sentences", at("ts"), at("us"), "--train-test-ratio", "0.5"])
    assert readers.triplets(spark, at("t")).count() == 1 and readers.triplets(spark, at("u")).count() == 1
    for i in range(12):
        for side, text in (("pos", "a fine bright film"), ("neg", "a dull weak film")):
            (tmp_path / "r" / side).mkdir(parents=True, exist_ok=True)
            (tmp_path / "r" / side / f"{i}.txt").write_text(f"{text} number {i}")
    main(["process", "imdb", "--dirs", at("r"), "--samples", at("s"), at("z"), "--sentences", at("ss"), at("zs"), "--train-test-ratio", "0.75", "--max", "10"])
    assert readers.samples(spark, at("s")).count() == 15 and readers.lines(spark, at("zs")).count() == 5
    (tmp_path / "v.txt").write_text("dog 1 0 0\ncat 0.9 0.1 0\nrun 0 1 0\nwalk 0.1 0.9 0\ndog 0 0 1\n")
    (tmp_path / "f.txt").write_text("dog\ncat\nrun\n")
    cache = ["--cache", at("reg")]
    main(["load", "words", *cache, "--name", "w", "--file", at("v.txt")])
    main(["create", "clusters", *cache, "--name", "k", "--words", "w", "--algorithm", "k-medoids", "2", "1"])
    main(["create", "clusters", *cache, "--name", "d", "--words", "w", "--algorithm", "dbscan", "2", "0.8", "2", "--filter", at("f.txt")])
    reg = Registry(spark, at("reg"))
    assert {r["id"]: r["word"] for r in reg.table("words", "w", "words").collect()} == {0: "dog", 1: "cat", 2: "run", 3: "walk"}
    found = {r["i"]: r["cluster"] for r in reg.table("clusters", "k", "clusters").collect()}
    assert found[0] == found[1] != found[2] == found[3] and {r["i"] for r in reg.table("clusters", "d", "clusters").collect()} == {0, 1}
    main(["create", "modeler", *cache, "--name", "m", "--sentences", at("ts"), at("ss")])
    main(["create", "modeler", *cache, "--name", "n", "--samples", at("s"), "--compress", "4", "3", "0.0001", "--supervision", "0.25"])
    learn = ["--modeler", "m", "--clauses", "10", "--target", "5", "--specificity", "2", "5", "--iterations", "2"]
    capsys.readouterr()
    main(["create", "classifier", *cache, "--name", "c", *learn, "--samples", at("s"), at("z")])
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["epoch"] for x in said] == [1, 2] and all(x["seconds"] > 0 for x in said)
    main(["create", "encoder", *cache, "--name", "e", *learn, "--hidden", "8", "--triplets", at("t")])
    (tmp_path / "cfg.json").write_text(json.dumps({"modeler": {"ngrams": [1]}, "classifier": {"clauses": [8], "target": [4], "iterations": [1]}}))
    main(["explore", "imdb", *cache, "--cfg", at("cfg.json"), "--dirs", at("r")])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["score"] >= 0


def test_second_file_is_the_test_set(spark, tmp_path, capsys):
    put = lambda name, rows: (tmp_path / name).write_text("".join("\t".join(r) + "\n" for r in rows)) and str(tmp_path / name)
    rows = [("food", "red apple pie"), ("sea", "blue ocean wave")] * 10
    train, test, odd = put("train", rows), put("test", [(rows[1][0], rows[0][1]), *rows[:3]]), put("odd", [*rows[:2], ("sky", "red apple")])
    reg, cache = Registry(spark, str(tmp_path / "reg")), ["--cache", str(tmp_path / "reg")]
    main(["create", "modeler", *cache, "--name", "m", "--samples", train])
    learn = ["--modeler", "m", "--clauses", "10", "--target", "5", "--specificity", "2", "5", "--iterations", "4", "--evaluate-every", "2"]
    main(["create", "classifier", *cache, "--name", "c", *learn, "--samples", train, test])
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["epoch"] for x in said] == [2, 4] and said[-1]["train"] == 1.0 and said[-1]["test"] == 0.75
    main(["create", "classifier", *cache, "--name", "alone", *learn, "--samples", train])
    assert (reg.load_machine("classifier", "c")[0].states == reg.load_machine("classifier", "alone")[0].states).all()
    with pytest.raises(Exception, match="unknown label: sky"):
        main(["create", "classifier", *cache, "--name", "d", *learn, "--samples", train, odd])
    assert reg.names("classifier") == ["alone", "c"]
    t = put("t", [("red apple", "apple pie", "blue wave"), ("blue ocean", "ocean wave", "red pie")] * 5)
    capsys.readouterr()
    main(["create", "encoder", *cache, "--name", "e", *learn, "--hidden", "8", "--triplets", t, put("u", [("red", "red", "red")])])
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["epoch"] for x in said] == [2, 4] and said[-1]["test"] == 0.0 and 0 <= said[-1]["train"] <= 1
    with pytest.raises(SystemExit):
        main(["create", "encoder", *cache, "--name", "f", *learn, "--triplets", t, t, t])


def test_stream_counts_like_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta w{'abc'[i % 3]}") for i in range(12)], "doc_id long, text string")
    for part in range(3):
        docs.where(F.col("doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    train_stream(stream, Params(), str(tmp_path / "out")).awaitTermination()
    v, once = vocabulary_of(spark, Params(), str(tmp_path / "out")), Vocabulary(Params()).train(docs)
    assert v.n_docs == 12 and sorted(v.df.collect()) == sorted(once.df.collect())
