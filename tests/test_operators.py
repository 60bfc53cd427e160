import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featherbit.functions import scalars as S
from featherbit.operators import bits, clustering, corex, explore, preparation, ranking, similarity, tsetlin


def test_sets(spark):
    a, b = [0, 3, 64, 99], [3, 5, 64]
    df = spark.createDataFrame([(1, a, b), (2, [], [])], "k long, a array<int>, b array<int>")
    got = {r["k"]: r for r in df.select("k", S.hamming(F.col("a"), F.col("b")).alias("h"), S.jaccard(F.col("a"), F.col("b")).alias("j"), F.size(S.with_complement(F.col("a"), 100)).alias("n")).collect()}
    assert (got[1]["h"], got[1]["j"], got[1]["n"]) == (3, 2 / 5, 100) and (got[2]["h"], got[2]["j"], got[2]["n"]) == (0, 1.0, 100)
    x = bits.to_words(bits.dense([np.array(a)], 100))
    assert x.shape == (1, 2) and x[0, 0] == 9 and x[0, 1] == 1 | 1 << 35
    for flipped, twice in ((False, 1), (True, 2)):
        p = {r["k"]: r["words"] for r in bits.pack(df, "k", "a", 100, flipped).collect()}
        q = {r["k"]: r["words"] for r in bits.pack(df, "k", "b", 100, flipped).collect()}
        assert sum(bin((u ^ w) & (2**64 - 1)).count("1") for u, w in zip(p[1], q[1], strict=True)) == 3 * twice


def test_scalars(spark):
    df = spark.createDataFrame([(" 'Hello,  WORLD!' -- it's a\tb\n", [3.0, 4.0]), (None, [0.0, 0.0])], "t string, v array<float>")
    r = df.select(S.split_words(F.col("t")).alias("w"), S.split_words(F.col("t"), 2).alias("two"), S.glue_lines(F.col("t")).alias("g"), S.normalised(F.col("v")).alias("u")).collect()
    assert r[0]["w"] == ["hello", "world", "", "it's", "a", "b"] and r[0]["two"] == ["hello", "world"] and r[0]["g"] == " 'Hello,  WORLD!' -- it's ab" and r[1]["w"] is None
    assert r[0]["u"] == pytest.approx([0.6, 0.8]) and r[1]["u"] == [0.0, 0.0]


@pytest.mark.parametrize(("n", "ratio", "kept"), [(103, 0.9, 92), (10, 0.0, 0), (10, 1.0, 10), (0, 0.5, 0)])
def test_split_sizes(spark, n, ratio, kept):
    train, test = ranking.train_test(spark.range(n), 1, ["id"], ratio)
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert len(a) == kept and a | b == set(range(n)) and not a & b


def test_ranks(spark):
    got = ranking.ranked(spark.range(500), 3, ["id"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 501))


def test_triplets_and_samples(spark):
    pairs = spark.createDataFrame([("entailment", "a", "x"), ("entailment", "a", "x"), ("neutral", "a", "y"), ("contradiction", "a", "y"), ("-", "a", "z"), ("entailment", "b", "x"), (None, "a", "q"), ("neutral", None, "q")], "label string, a string, b string")
    assert sorted(map(tuple, preparation.triplets_of(pairs).collect())) == [("a", "x", "y"), ("a", "x", "y")]
    s = spark.createDataFrame([(i, int(i % 3 == 0), "t") for i in range(10)], "sample_id long, label int, text string")
    got = preparation.balanced_samples(s).collect()
    assert len(got) == 4 and all(r["positive_id"] % 3 == 0 and r["negative_id"] % 3 for r in got)
    d = preparation.label_dictionary(spark.createDataFrame([(2, "b"), (1, "c"), (3, "b"), (4, None)], "k long, label string"), "k")
    assert {r["label"]: r["label_id"] for r in d.collect()} == {"c": 0, "b": 1}
    with pytest.raises(Exception, match="unknown label"):
        preparation.with_label_ids(spark.createDataFrame([("z",)], "label string"), d).collect()


def test_blocks_do_not_matter(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    right = rows.select(F.col("i").alias("j"), "v")
    s = np.round(x @ x.T, 9)
    want = {i: [j for j in np.lexsort((np.arange(60), -s[i])) if j != i][:4] for i in range(60)}
    for block in (7, 4000):
        got = similarity.top_k(rows, right, 4, itself=False, block=block).toPandas().sort_values("rank")
        assert got.groupby("i")["j"].apply(list).to_dict() == want
        near = similarity.neighbourhoods(rows, 0.3, block)
        assert {(r["i"], r["j"]) for r in near.collect()} == set(zip(*np.nonzero(s >= 0.3), strict=True))


def brute_dbscan(s, min_pts, eps):
    near = s >= eps
    core = near.sum(1) >= min_pts
    label, n = np.full(len(s), -1), 0
    for i in range(len(s)):
        if core[i] and label[i] < 0:
            n += 1
            todo = [i]
            while todo:
                k = todo.pop()
                if label[k] < 0:
                    label[k] = n
                    todo += [j for j in np.flatnonzero(near[k]) if core[j] and label[j] < 0]
    for i in np.flatnonzero(~core):
        c = [label[j] for j in np.flatnonzero(near[i]) if core[j]]
        label[i] = min(c) if c else -1
    return label


def test_dbscan_and_medoids(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.25 * rng.standard_normal((15, 6)) for c in np.eye(6)[:4]] + [rng.standard_normal((8, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    near = similarity.neighbourhoods(rows, 0.8)
    labels = clustering.dbscan_labels(near, 4).toPandas().set_index("i")["cluster"].sort_index().to_numpy()
    assert (labels == brute_dbscan(np.round(x @ x.T, 9), 4, 0.8)).all()
    soft = clustering.create(rows, "dbscan", 4, 0.8, 2).toPandas()
    assert (soft[soft["rank"] == 1]["sim"] == 1).all() or -1 in labels
    got = clustering.create(rows, "k-medoids", 4, 1).toPandas()
    assert sorted(got["i"]) == list(range(len(x)))
    assert clustering.create(rows, "k-medoids", 500, 1).count() == len(x)
    for bad in (("dbscan", 0, 0.5, 1), ("dbscan", 2, 1.0, 1), ("k-medoids", 2, 0), ("other",)):
        with pytest.raises(ValueError):
            clustering.create(rows, *bad)
    assert clustering.early_stop([1.0] * 9, 0.1) is None and clustering.early_stop([1.0] * 10, 0.1) == 10


def separable(spark, n=300):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        y = i % 2
        ids = sorted(set(rng.choice(6, 3, replace=False) + 6 * y) | set(12 + rng.choice(8, 2)))
        rows.append((i, [int(x) for x in ids], y))
    return spark.createDataFrame(rows, "doc_id long, ids array<int>, label_id int").repartition(2)


def test_classifier_learns_and_repeats(spark):
    rows = separable(spark)
    s = tsetlin.Settings(clauses=20, target=8, specificity_high=8.0, iterations=6)
    m = tsetlin.train_classifier(rows, 20, 2, s)
    got = tsetlin.classify(rows, m, ["0", "1"]).join(rows, "doc_id").toPandas()
    assert (got["label"].astype(int) == got["label_id"]).mean() > 0.9
    calls = []
    tsetlin.train_classifier(rows, 20, 2, s, lambda e, _: calls.append(e) or False)
    assert calls == [1]


def test_training_does_not_depend_on_partitions(spark):
    """Labels hang on two features at once, with a tenth of them wrong; 4 and 256 partitions give one and the same model."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        ids = np.flatnonzero(rng.random(16) < 0.5)
        y = int((0 in ids) != (1 in ids)) if rng.random() > 0.1 else int(rng.integers(2))
        rows.append((i, [int(x) for x in ids], y))
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, label_id int")
    s = tsetlin.Settings(clauses=20, target=10, specificity_high=6.0, iterations=6, shards=2)
    few, many = (tsetlin.train_classifier(df.repartition(n), 16, 2, s) for n in (4, 256))
    assert (few.states == many.states).all()
    assert tsetlin.accuracy(df, few) > 0.8


def test_medoids_of_ids_over_64_bits(spark):
    rng = np.random.default_rng(6)
    ids = [-(2**63), 2**63 - 1, *(int(x) for x in rng.integers(-(2**62), 2**62, 198))]
    x = rng.standard_normal((200, 8))
    rows = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in zip(ids, x, strict=True)], "i long, v array<double>")
    got = clustering.create(rows, "k-medoids", 4, 1).toPandas()
    assert sorted(got["i"]) == sorted(ids) and got["cluster"].nunique() == 4
    assert len(set(clustering.seeds(rows, 60))) == 60
    assert clustering.create(rows.limit(0), "k-medoids", 4, 1).count() == 0
    with pytest.raises(RuntimeError, match="still change"):
        clustering.k_medoids(rows, 20, rounds=1)


def test_encoder_and_compressor(spark):
    rows = separable(spark, 240).toPandas()
    a, b = rows[rows.label_id == 0]["ids"].tolist(), rows[rows.label_id == 1]["ids"].tolist()
    t = spark.createDataFrame([(i, *( (a[i], a[-i - 1], b[i]) if i % 2 else (b[i], b[-i - 1], a[i]))) for i in range(100)], "doc_id long, a array<int>, p array<int>, n array<int>")
    m = tsetlin.train_encoder(t, 20, 8, tsetlin.Settings(clauses=8, target=4, specificity_high=6.0, iterations=4, alpha=0.5, shards=2))
    codes = {c: {r["doc_id"]: set(r["code"]) for r in tsetlin.encode(t, m, ids=c).collect()} for c in "apn"}
    score = np.mean([len(codes["a"][i] ^ codes["p"][i]) < len(codes["a"][i] ^ codes["n"][i]) for i in range(100)])
    assert score > 0.6
    frame = spark.createDataFrame(rows[["doc_id", "ids", "label_id"]])
    model = corex.fit(frame, 20, 4, iterations=12)
    assert len(model.history) > 3 and model.history[-1] >= model.history[0]
    out = corex.compress(frame, model, 20).join(frame, "doc_id").toPandas()
    x = np.array([[h in c for h in range(4)] for c in out["code"]])
    assert max(abs(np.corrcoef(x[:, h], out["label_id"])[0, 1]) for h in range(4) if 0 < x[:, h].sum() < len(x)) > 0.5


def test_search():
    grid = {"clauses": [4, 8], "target": [2, 4, 8]}
    one = explore.draws(grid, 1, 100, explore.fits)
    assert one == explore.draws(grid, 1, 100, explore.fits) and all(g["target"] <= g["clauses"] / 2 for g in one) and len({explore.name_of(g) for g in one}) == len(one) == 3
    ran = []
    best = explore.search(grid, lambda g: ran.append(g) or g["target"], {explore.name_of(one[0]): 99.0}, 1)
    assert best[0][2] == 99.0 and len(ran) == 2
    assert explore.paired([{"a": 1}, {"a": 2}], [{"b": 1}]) == [({"a": 1}, {"b": 1})]


def test_words_to_clusters(spark):
    words = spark.createDataFrame([(1, "dog"), (2, "cat"), (3, "sky")], "id long, word string")
    found = spark.createDataFrame([(1, 0, 1.0, 1), (1, 1, 0.5, 2), (2, 0, 0.9, 1)], "i long, cluster long, sim double, rank int")
    tokens = spark.createDataFrame([(7, 0, "dog"), (7, 1, "sky"), (8, 0, "cat"), (8, 1, "none"), (9, 0, None)], "doc_id long, pos int, word string")
    got = lambda n: sorted(map(tuple, clustering.words_to_clusters(tokens, words, found, n).collect()))
    assert got(1) == [(7, 0, 0, 1.0), (8, 0, 0, 0.9)] and got(2) == [(7, 0, 0, 1.0), (7, 0, 1, 0.5), (8, 0, 0, 0.9)]


def test_weighted_choice(spark):
    w = spark.createDataFrame([(i, float(i % 4)) for i in range(100)], "i long, w double")
    c = np.cumsum([i % 4 for i in range(100)]) / sum(i % 4 for i in range(100))
    for r in (0.0, 0.3, 0.777, 1.0):
        assert clustering.choose(w, r).first()["i"] == int(np.flatnonzero(c >= r - 1e-12)[0])
    assert pd.DataFrame(clustering.choose(w.where("w < 0"), 0.5).collect()).empty
