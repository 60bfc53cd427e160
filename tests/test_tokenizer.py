import re

import pytest

from featherbit.operators import tokenizer as T

PANGRAMS = [
    "The quick brown fox jumped over the lazy dog. A1 dog!",
    "Pack my box with five dozen liquor jugs",
    "How vexingly quick daft zebras jump; Café naïve",
    "",
    None,
    "ABCDEFGHIJKLMNOPQRSTUVWX tail don't x Kelvin aaaa",
]


def brute_features(words, p):
    out = []
    for i, w in enumerate(words):
        if p.cgrams and len(w) > p.cgrams:
            for s in range(len(w) - p.cgrams + 1):
                out += [w[s : s + n] for n in range(max(1, p.min_len), p.cgrams + 1)]
        out += [" ".join(words[i - k : i + 1]) for k in range(min(i, p.ngrams - 1), -1, -1)]
    return out


def brute_words(t, p):
    return [w.lower() for w in re.findall("[A-Za-z]+", t or "") if p.min_len <= len(w) <= p.max_len]


@pytest.mark.parametrize("p", [T.Params(1, 0, 20, 2, 3, 3), T.Params(1, 0, 20, 3, 2, 3), T.Params(1, 0, 20, 4, 1, 3), T.Params(1, 0, 20, 1, 1, 2), T.Params(1, 0, 20, 2, 1, 0), T.Params(0.7, 0.2, 20, 2, 2, 3)])
def test_against_brute_force(spark, p):
    docs = spark.createDataFrame(list(enumerate(PANGRAMS)), "doc_id long, text string")
    words = [brute_words(t, p) for t in PANGRAMS]
    df = {}
    for ws in words:
        for f in set(brute_features(ws, p)):
            df[f] = df.get(f, 0) + 1
    v = T.Vocabulary(p).train(docs).finalize()
    kept = sorted((f for f, n in df.items() if p.min_df <= n / len(PANGRAMS) <= p.max_df), key=lambda f: (-df[f], f))
    assert {r["token"]: (r["df"], r["id"]) for r in v.df.collect()} == {f: (df[f], i) for i, f in enumerate(kept)}
    ids = {f: i for i, f in enumerate(kept)}
    known = [[f for f in brute_features([w for w in ws if w in ids], p) if f in ids] for ws in words]
    for prints in (T.fingerprints(docs, v), T.joined_fingerprints(docs, v)):
        assert {r["doc_id"]: r["ids"] for r in prints.collect()} == {i: sorted({ids[f] for f in k}) for i, k in enumerate(known)}
    for parsed in (T.parse(docs, v), T.joined_parse(docs, v)):
        assert {r["doc_id"]: r["tokens"] for r in parsed.collect()} == dict(enumerate(known))


def test_training_in_parts_is_training_at_once(spark):
    p = T.Params(1, 0, 20, 2, 2, 3)
    docs = spark.createDataFrame(list(enumerate(PANGRAMS)), "doc_id long, text string")
    once = T.Vocabulary(p).train(docs)
    parts = T.Vocabulary(p).train(docs.where("doc_id < 2")).train(docs.where("doc_id >= 2"))
    assert parts.n_docs == once.n_docs and sorted(parts.df.collect()) == sorted(once.df.collect())
    with pytest.raises(ValueError):
        once.finalize().train(docs)
    with pytest.raises(ValueError):
        T.fingerprints(docs, once)


@pytest.mark.parametrize("bad", [{"min_df": 0.5, "max_df": 0.1}, {"max_df": 1.5}, {"min_len": 0}, {"min_len": 5, "max_len": 4}, {"ngrams": 0}, {"cgrams": -1}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        T.Params(**bad)
