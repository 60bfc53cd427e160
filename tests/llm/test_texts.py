import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherbit.llm import bpe, copies, groups, overlap, packing, subjects, terms

MARK = re.compile(r"<[^>]*>|&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);")


def key(t):
    return re.sub(r"[\W_]+", "", MARK.sub(" ", t)).lower()


def test_copies(spark):
    sheet = "Story: it runs | Acting : so so;\nSound:loud"
    other = "sound: LOUD!\n;STORY: it runs|acting: so<br /> so"
    texts = [None, "", " .. ", "A b-c", "a <b>B</b>&nbsp;C!!", "a b", sheet, other, "Story: it runs", "it runs story:", "x" * 50_000, "X" * 50_000 + ".", "abc", "cab", "ab<br<br /> />c", "12", "1-2 \u212a", "12k"]
    rows = [("t", i + 1, t, "clash", 1.0) for i, t in enumerate(texts)] + [("t", 900 + i, "Hot, text", "c", 2.0) for i in range(40)] + [("u", 1, "Hot text", "c", 2.0), ("t", None, "a b", "c", 2.0)]
    df = spark.createDataFrame(rows, "kind string, id long, text string, plain string, n double")
    got = {(r["first_id"], r["copy_id"]) for r in copies.copy_pairs(df, sheets=True).where("kind = 't'").collect()}
    assert got == {(4, 5), (4, 13), (7, 8), (11, 12), (4, 15), (17, 18)} | {(900, 900 + i) for i in range(1, 40)}
    assert copies.copy_pairs(df, sheets=False).where("first_id = 7").count() == 0
    sizes = {(r["kind"], r["first_id"]): r["copies"] for r in copies.collapse(df, sheets=True).collect()}
    assert sizes[("t", 900)] == 40 and sizes[("u", 1)] == 1 and sizes[("t", 6)] == 1 and sum(sizes.values()) == len(rows) - 4
    assert copies.copy_pairs(df.limit(0)).count() == 0


def test_term_counts(spark):
    texts = [None, "", "Ab ab x naïve a1b2", "ab " * 3000, "ABCDEFGHIJKLMNOPQRSTUVWX tail"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    lim = spark.createDataFrame([("s", 0.3, 0.45), ("z", 0.0, 1.0)], "name string, min_df double, max_df double")
    got = {r["term"]: (r["occurrences"], r["docs"], r["mark"]) for r in terms.marked_terms(df, lim, "s").collect()}
    assert got == {"ab": (3002, 2, "common"), "na": (1, 1, "rare"), "ve": (1, 1, "rare"), "tail": (1, 1, "rare")}
    assert terms.marked_terms(df.limit(0), lim, "s").count() == 0
    assert {r["mark"] for r in terms.marked_terms(df, lim, "none").collect()} == {None}


def brute_groups(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, t in rows:
        for e in ([("a", a)] if a is not None else []) + ([("k", key(t))] if t and key(t) else []):
            x, y = find(("r", i)), find(e)
            parent[x] = y
    least = {}
    for i, a, _ in rows:
        if a is not None:
            r = find(("r", i))
            least[r] = min(a, least.get(r, a))
    return {i: least.get(find(("r", i))) for i, _, _ in rows}


def test_related_groups_and_splits(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(60)]), rng.choice([None, "", "!", "Hot One", "hot one.", *[f"text {j}" for j in range(150)]])) for i in range(400)]
    rows += [(1000 + i, 2000 + i, f"chain {i // 2}") for i in range(30)] + [(1100 + i, 2001 + i, f"chain {i // 2}") for i in range(1, 29)] + [(5000, None, "alone"), (5001, None, "alone")]
    df = spark.createDataFrame([(*r, "s", "clash") for r in rows], "id long, author long, anchor string, source string, k string")
    got = groups.related_groups(df, ("source",))
    assert {r["id"]: r["group_id"] for r in got.collect()} == brute_groups(rows)
    assert "k" not in got.columns and got.where("id in (5000, 5001)").select("unit").distinct().count() == 1
    split = groups.split_rows(got, "source").toPandas()
    assert len(split) == len(rows) and (split.groupby("unit")["split"].nunique() == 1).all()
    assert groups.related_groups(df.limit(0)).count() == 0 and groups.split_rows(groups.related_groups(df.limit(0), ("source",)), "source").count() == 0


def test_hot_nodes_do_not_matter(spark, monkeypatch):
    """Edges of hot nodes joined by broadcast give the same labels."""
    rng = random.Random(3)
    edges = spark.createDataFrame(sorted({(rng.randrange(60), rng.randrange(50)) for _ in range(90)}), "a long, k long")
    plain = sorted(map(tuple, groups.entity_labels(edges).collect()))
    monkeypatch.setattr(groups, "_hot", lambda e, by, total: list(range(0, 60, 2)))
    assert sorted(map(tuple, groups.entity_labels(edges).collect())) == plain


def test_chunks_of_a_batch():
    """Chunks are sets: a changed word leaves all others' cuts; lengths add up to the words."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    w = np.sort(rng.integers(-(2**62), 2**62, 40))
    sets = [w, np.sort(np.r_[w[:20], w[21:], 12345]), w[:1]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 1]), *[pa.array([x.tolist() for x in sets])] * 3], names=["c", "held", "a", "p", "n"])
    owner, digest, kind, size = overlap._chunks(batch, 4, 2)
    for k in range(6):
        assert [size[(owner == i) & (kind == k)].sum() for i in range(3)] == [40, 40, 1]
        mine, other = (set(digest[(owner == i) & (kind == k)]) for i in range(2))
        assert len(mine - other) <= 3 and len(mine & other) >= 3  # the word taken out touches two, the one put in a third
    assert len(set(digest[(owner == 0) & (kind == 0)]) & set(digest[(owner == 0) & (kind == 1)])) == 0
    lens, sketch = overlap._sketches(batch)
    assert lens.tolist() == [[40] * 3, [40] * 3, [1] * 3] and bin(int(sketch[2, 0]) & (2**64 - 1)).count("1") == 1
    assert len(overlap._chunks(batch.slice(0, 0), 4, 2)[0]) == 0


def test_split_shares(spark):
    rng = np.random.default_rng(0)
    sizes = np.r_[3000, rng.integers(1, 6, 2500)]
    rows = [(f"u{u}", f"s{u % 7}") for u, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "unit string, source string")
    got = groups.assign_splits(df, "source").groupBy("split").agg(F.sum("size").alias("n")).collect()
    share = {r["split"]: r["n"] / len(rows) for r in got}
    assert all(abs(share[s] - p) < 0.002 for s, p in groups.SHARES.items())


def test_large_groups_are_stratified(spark):
    """Sources whose rows lie mostly in large groups reach every split in their share, groups of two sources included."""
    rng = np.random.default_rng(3)
    rows = [(f"a{u}", "a") for u in range(40) for _ in range(60)] + [(f"c{u}", "ac"[i % 2]) for u in range(30) for i in range(50)]
    rows += [(f"u{u}", "bd"[u % 2]) for u in range(2000) for _ in range(rng.integers(1, 5))]
    df = spark.createDataFrame(rows, "unit string, source string")
    got = groups.split_rows(df, "source").toPandas()
    assert len(got) == len(rows) and (got.groupby("unit")["split"].nunique() == 1).all()
    for s, p in groups.SHARES.items():
        assert abs((got["split"] == s).mean() - p) < 0.004
        per = got.groupby("source")["split"].apply(lambda x, s=s: (x == s).mean())
        assert all(abs(per[x] - p) < 0.03 for x in "ac") and all(abs(per[x] - p) < 0.01 for x in "bd")


def words(t):
    return set(re.findall(r"[^\W_]+", t.lower())) if t else set()


@pytest.mark.parametrize(("hot", "most"), [(0.02, 16_384), (0.9, 3)])
def test_overlapping_pairs(spark, hot, most):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    base = [[" ".join(rng.sample(vocab, rng.randint(1, 12))) for _ in range(3)] for _ in range(25)] + [["Same start of all", "boiler plate text here", " ".join(rng.sample(vocab, 6))] for _ in range(10)]
    rows = []
    for i in range(300):
        f = list(rng.choice(base))
        for k in range(3):
            w = f[k].split()
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                rng.shuffle(w)
            f[k] = rng.choice([" ".join(w), " ".join(w).upper() + "!", None, ""]) if rng.random() < 0.1 else " ".join(w)
        rows.append((i, *f, rng.choice(["train", " TRAIN", "Test ", "validation", "dev", None]), "s", 1))
    df = spark.createDataFrame(rows, "id long, anchor string, positive string, negative string, split string, source string, held int")
    side = lambda s: {"train": 1, "test": 2, "validation": 2}.get((s or "").strip().lower())
    near = lambda x, y: all(a and b and len(words(a) & words(b)) >= 0.7 * len(words(a) | words(b)) - 1e-9 for a, b in zip(x[1:4], y[1:4], strict=True))
    want = {(x[0], y[0]) for x in rows if side(x[4]) == 1 for y in rows if side(y[4]) == 2 and near(x, y)}
    assert want and {tuple(r) for r in overlap.overlapping_pairs(df, hot=hot, most=most).collect()} == want
    counts = {r["id"]: (r["pairs"], r["by_chunks"]) for r in overlap.overlap_counts(df).collect()}
    assert {i: n for i, (n, _) in counts.items()} == {i: sum(e == i for _, e in want) for i in {e for _, e in want}}
    assert all(c <= n for n, c in counts.values()) and sum(c for _, c in counts.values()) > 0.7 * len(want)
    assert overlap.overlapping_pairs(df.limit(0)).count() == 0
    parts = {r["id"]: r for r in overlap.chunk_overlap(df).collect()}
    copies_of = {x[0] for x in rows if side(x[4]) == 2 and any(side(y[4]) == 1 and [*x[1:4]] == [*y[1:4]] for y in rows) and any(words(t) for t in x[1:4])}
    assert all(parts[i]["shared"] == parts[i]["n_words"] for i in copies_of)


def test_encoding(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.BYTE_BPE)
    t.encode_special_tokens = True
    rng = random.Random(0)
    texts = [None, "", " ", "it's  they'LL\n\n\tend", "<|endoftext|>", "a" * 3000, "ab" * 2000, "日本語" * 50, "🙂‍↔️ naïve", "x = 1;\r\n" * 30]
    texts += ["".join(rng.choice("abcdeinrst ") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(texts)], "doc_id long, text string, ids array<int>")
    out = bpe.encode(df)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(out).collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.limit(0)).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(0)
    sizes = [None, 0, 1, 64, 65, 200, *(int(x) for x in rng.integers(1, 60, 400)), *[33] * 300]
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)], "doc_id long, n_tokens int, slot int")
    got = packing.pack(df, 64, 20).toPandas()
    real = got[got.container_id.notna()].sort_values(["container_id", "place"])
    assert got[got.container_id.isna()].doc_id.sort_values().tolist() == [0, 1]
    assert real.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in enumerate(sizes) if n}
    for _, c in real.groupby("container_id"):
        assert c.n_tokens.sum() <= 64 and c.place.tolist() == list(range(len(c))) and c.start.tolist() == np.r_[0, np.cumsum(c.n_tokens)[:-1]].tolist()
    assert real[real.doc_id == 5].n_tokens.tolist().count(64) == 3 and (real[real.doc_id == 4].n_tokens.sort_values().tolist() == [1, 64])
    assert sorted(set(real.container_id)) == list(range(real.container_id.nunique()))
    assert packing.pack(df.limit(0), 64).count() == 0 and packing.pack(df.limit(2), 64).count() == 2


def test_bucket_bounds_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(0)
    for _ in range(20):
        x = np.unique(rng.integers(1, 60, 9))
        c = rng.integers(1, 9, len(x))
        pad = lambda b: sum(n * (min(y for y in b if y >= v) - v) for v, n in zip(x, c, strict=True))  # noqa: B023, E731
        for k in (1, 2, 3):
            best = min(pad((*s, x[-1])) for s in combinations(x[:-1], min(k, len(x)) - 1))
            assert pad(packing.bucket_bounds(x, c, k)) == best


def test_few_ratings_do_not_vanish(spark):
    """A dozen ratings, fewer terms than pass any threshold: every subject is still given, mostly rightly."""
    rng = random.Random(4)
    nouns = {"law": ["judge", "court", "appeal", "jury"], "food": ["bread", "soup", "oven", "dough"], "sport": ["goal", "coach", "league", "medal"]}
    frames = ["without the {} there is no {} says the other", "first came the {} and then the {} was lost", "what counts is the {} and never the {} alone"]
    docs, truth = [], {}
    for i in range(240):
        truth[i] = sorted(nouns)[i % 3]
        docs.append((i, ". ".join(rng.choice(frames).format(*rng.sample(nouns[truth[i]], 2)) for _ in range(4)) + "."))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(0, 240, 20)], "doc_id long, subject string")
    rows, fitted = subjects.fit(df, labels, sorted(nouns), depth=2)
    got = [(r["doc_id"], r["subject"]) for r in subjects.assigned(rows, fitted).where("4 * about >= sentences").collect()]
    assert {s for _, s in got} == set(nouns) and sum(truth[i] == s for i, s in got) >= 0.9 * max(len(truth), len(got))


def test_subjects(spark):
    rng = random.Random(0)
    nouns = {"law": ["judge", "court", "appeal", "verdict", "jury"], "food": ["bread", "soup", "oven", "spice", "dough"], "sport": ["goal", "coach", "league", "medal", "relay"], "music": ["chord", "piano", "choir", "tempo", "scale"]}
    filler = ["the weather stays grey over the old harbour today", "nobody came to watch the parade this time", "she holds court by the bar all evening long"]
    topic = ["without the {} there is no {} says the other", "first came the {} and then the {} was lost", "what counts is the {} and never the {} alone"]
    docs, labels, truth = [], [], {}
    for i in range(900):
        have = rng.sample(sorted(nouns), rng.choice([0, 1, 1, 2]))
        s = [rng.choice(topic).format(rng.choice(nouns[h]), rng.choice(nouns[h])) for h in have for _ in range(4)] + [rng.choice(filler) for _ in range(3)]
        rng.shuffle(s)
        docs.append((i, ". ".join(s) + ".", "x"))
        truth[i] = set(have)
        if i % 4 == 0:
            labels.append((i, rng.choice(have) if have else None))
    docs += [(9000, None, "x"), (9001, "", "x"), (9002, "x = {1}\n...", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, terms string")
    lab = spark.createDataFrame([*labels, *labels[:9], (77777, "law"), (None, "law"), (3, "unheard of")], "doc_id long, subject string")
    rows, fitted = subjects.fit(df, lab, sorted(nouns), depth=2)
    got = {}
    for r in subjects.assigned(rows, fitted).where("4 * about >= sentences").collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(got.get(i, set()) == t for i, t in truth.items()) >= 0.95 * len(truth) and not set(got) & {9000, 9001, 9002}
    assert subjects.leaf_report(rows, fitted).agg(F.sum("docs")).first()[0] == len(docs)
    for d, x in ((df.limit(0), lab), (df, lab.limit(0))):
        assert subjects.assigned(*subjects.fit(d, x, ["food", "law"], depth=1)).count() == 0
    assert math.isclose(sum(len(s) for s in subjects.sentences("One two three. No. a = b c d\nFour five six!")), 6)
