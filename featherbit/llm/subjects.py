"""Problem 9: the subjects each document is about, in any language, and the shares of the subjects.

1. One pass counts in how many documents each word stands; those in at least ``LEAST`` documents and a share of ``FLOOR`` of
   all are the terms. There are at most (distinct words of an average document) / ``FLOOR`` of them, whatever the corpus. A
   second pass turns every text into the term ids of its sentences; only these are kept.
2. Bisecting k-means on the normalised tf-idf vectors of the documents: every leaf of a level is split at once. A document's
   leaf follows from the centroids on its way down, so a pass needs no state but those. Only sums per (leaf, term) move.
3. Leaves are labelled: by the rated documents they hold, and by discriminative terms. Every document has a mixture of
   subjects from its leaves; summed over all documents that gives, with the weight ``blend``, each term its first association with the
   subjects, together with the rated documents themselves (at most ``RATED``, by hash). A term is discriminative if the subjects it stands with
   are far from evenly spread (relative entropy); what stands in all subjects alike, as the language itself or the frame of a
   sentence, is none and says nothing. Where hardly any term passes (few ratings), the best tenth of the terms is taken. The
   association is then estimated anew from all sentences, each term from the others of its sentence; the rated documents stay
   in it with the weight ``keep``, so it can't drift away from them or die out.
4. Assignment by leaf mixtures, sentence by sentence, since a document may be about several subjects in turn: terms of the
   sentence, times the mixture of subjects of the document's leaves to a small power. Passing mentions and figures of speech
   are told apart by all words of a sentence: against those of rated documents that are about nothing, and what goes with them.
5. A document has the subjects of at least ``share`` of its sentences.

Everything but the rated documents covers all rows. To the driver come term counts, sums per leaf and term, and sums per
subject and term, all bounded by the number of terms times leaves or subjects.

Defined results: null, empty and wordless texts have no subject; sentences of fewer than three words and lines of program code
don't count; ratings without document are ignored, repeated ones count once; without any rating nothing is assigned; lang and
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FLOOR, LEAST, RATED = 0.0005, 5, 200_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARKUP = regex.compile(C.MARKUP)
_ENDS = regex.compile(r"[.!?…]+(?=\s|$)|[\n\r]+")
_CODE = regex.compile(r"[={}]")


def sentences(text: str) -> list[list[str]]:
    """The distinct words of each sentence, in order."""
    out = []
    for s in _ENDS.split(_MARKUP.sub(" ", text)):
        if not _CODE.search(s):
            w = _WORD.findall(s.lower())
            if len(w) >= 3:
                out.append(list(dict.fromkeys(w)))
    return out


def vocabulary(docs: DataFrame, key: str, text: str) -> tuple[list[str], np.ndarray, int]:
    """Terms, their document counts, and the number of documents with a text."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            c: Counter = Counter()
            for t in f["t"]:
                c[""] += 1
                c.update({w for s in sentences(t) for w in s})
            yield pd.DataFrame({"term": list(c.keys()), "n": np.fromiter(c.values(), dtype=np.int64, count=len(c))})

    counts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = C.cut(counts)
    whole = counts.where("term = ''").first()
    total = whole["n"] if whole else 0
    kept = counts.where((F.col("term") != "") & (F.col("n") >= max(LEAST, FLOOR * total))).orderBy(F.desc("n"), "term").collect()
    return [r["term"] for r in kept], np.array([r["n"] for r in kept], dtype=np.float64), total


def encoded(docs: DataFrame, ratings: DataFrame, names: list[str], terms: list[str], key: str, text: str) -> DataFrame:
    """(key, votes ARRAY<INT>, terms ARRAY<INT>, lens ARRAY<INT>), cut: votes are 0 for none and 1.. for the subjects."""
    of = {w: i for i, w in enumerate(terms)}

    def ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            flat, lens = [], []
            for t in f["t"]:
                s = [[of[w] for w in x if w in of] for x in sentences(t)] if t else []
                flat.append(np.array([i for x in s for i in x], dtype=np.int32))
                lens.append(np.array([len(x) for x in s], dtype=np.int32))
            yield pd.DataFrame({key: f[key], "terms": flat, "lens": lens})

    number = F.coalesce(*[F.when(F.col("subject") == n, i + 1) for i, n in enumerate(names)], F.when(F.col("subject").isNull(), 0))
    votes = ratings.select(key, number.alias("v")).where(F.col("v").isNotNull() & F.col(key).isNotNull()).distinct()
    votes = votes.orderBy(F.xxhash64(key, "v")).limit(RATED).groupBy(key).agg(F.array_sort(F.collect_list("v")).alias("votes"))
    kind = docs.schema[key].dataType.simpleString()
    flat = docs.select(key, F.col(text).alias("t")).mapInPandas(ids, f"{key} {kind}, terms array<int>, lens array<int>")
    return C.cut(flat.join(votes, key, "left"))


class Flat:
    """Documents of a batch as flat arrays. Sentences without terms are kept: they count among a document's sentences."""

    def __init__(self, f: pd.DataFrame) -> None:
        self.n = len(f)
        self.terms = np.concatenate([np.asarray(x, dtype=np.int64) for x in f["terms"]] or [np.zeros(0, np.int64)])
        lens = np.concatenate([np.asarray(x, dtype=np.int64) for x in f["lens"]] or [np.zeros(0, np.int64)])
        self.sent_of = np.repeat(np.arange(len(lens)), lens)  # sentence of each term
        self.doc_of = np.repeat(np.arange(self.n), np.array([len(x) for x in f["lens"]], dtype=np.int64))  # document of each sentence
        self.sents = len(lens)

    def by_sentence(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.sent_of, weights=c, minlength=self.sents) for c in x.T], axis=1) if x.ndim == 2 else np.bincount(self.sent_of, weights=x, minlength=self.sents)

    def vectors(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, terms and weights of the normalised vectors."""
        v = len(idf)
        k, n = np.unique(self.doc_of[self.sent_of] * v + self.terms, return_counts=True)
        d, t = k // v, k % v
        w = np.sqrt(n) * idf[t]
        norm = np.sqrt(np.bincount(d, weights=w * w, minlength=self.n))
        return d, t, w / np.maximum(norm[d], 1e-12)


def _batches(frames: Iterator[pd.DataFrame], size: int = 1000) -> Iterator[pd.DataFrame]:
    for f in frames:
        for at in range(0, len(f), size):
            yield f.iloc[at : at + size]


def _summed(rows: DataFrame, shape: tuple[int, int], work: Callable[[pd.DataFrame, np.ndarray], None]) -> np.ndarray:
    """Sum over all documents of what ``work`` adds to a matrix: each task sends its non-zero cells once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for f in _batches(frames):
            work(f, total)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "x": total[i, j]})

    got = rows.mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(shape)
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["x"].to_numpy()
    return out


def _down(d: np.ndarray, t: np.ndarray, w: np.ndarray, n: int, levels: list[np.ndarray]) -> np.ndarray:
    """The node of each document after following the centroids of the levels."""
    node = np.zeros(n, dtype=np.int64)
    for c in levels:
        s = [np.bincount(d, weights=w * c[2 * node[d] + side, t], minlength=n) for side in (0, 1)]
        node = 2 * node + (s[1] > s[0])
    return node


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def bisect(rows: DataFrame, idf: np.ndarray, depth: int = 5, rounds: int = 1) -> list[np.ndarray]:
    """Centroids of each level: row 2 * node + side. Spherical 2-means in all nodes of a level at once, started by the side
    of a random direction through the node's mean."""
    v, rng, levels = len(idf), np.random.default_rng(5), []

    def root(f: pd.DataFrame, total: np.ndarray) -> None:
        x = Flat(f)
        _, t, w = x.vectors(idf)
        total[0, :v] += np.bincount(t, weights=w, minlength=v)
        total[0, v] += x.n

    sums = _summed(rows, (1, v + 1), root)
    for level in range(depth):
        direction = rng.choice([-1.0, 1.0], v)
        middle = sums[:, :v] @ direction / np.maximum(sums[:, v], 1)
        now: np.ndarray | None = None
        for _ in range(rounds + 1):

            def assign(f: pd.DataFrame, total: np.ndarray, now: np.ndarray | None = now) -> None:
                x = Flat(f)
                d, t, w = x.vectors(idf)
                node = _down(d, t, w, x.n, levels)
                if now is None:
                    node = 2 * node + (np.bincount(d, weights=w * direction[t], minlength=x.n) > middle[node])
                else:
                    node = _down(d, t, w, x.n, [*levels, now])
                np.add.at(total, (node[d], t), w)
                total[:, v] += np.bincount(node, minlength=len(total))

            sums = _summed(rows, (2 ** (level + 1), v + 1), assign)
            now = _unit(sums[:, :v])
        levels.append(now)
    return levels


class Model:
    """What says which subject: per term and subject a log ratio, zero for terms that don't discriminate, and per term how
    much it speaks for a sentence about nothing. A term discriminates if its relative entropy is over ``least`` of the most
    there can be, or it is among the best tenth (at least 50) of the terms."""

    def __init__(self, counts: np.ndarray, about: np.ndarray, nothing: np.ndarray, least: float) -> None:
        k = counts.shape[1]
        n = counts.sum(0)
        s = counts / np.maximum(n, 1) * max(n.mean(), 1) + 1.0
        s /= s.sum(1, keepdims=True)
        self.association, self.entropy = s, (s * np.log(s * k)).sum(1)
        self.least = 0.337 * np.log(k)  # a third of all that can be known
        few = min(len(s) - 1, max(50, len(s) // 10))
        self.feature = self.entropy > min(least * np.log(k), np.sort(self.entropy)[::-1][few])
        self.ratio = np.where(self.feature[:, None], np.log(s * k), 0.0)
        a, b = nothing + 3.0, about + 3.0
        self.nothing = np.clip(np.log(a / a.sum()) - np.log(b / b.sum()), -2, 2)

    def judge(self, x: Flat, prior: np.ndarray | None, margin: float = 1.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per sentence: scores, numbers of discriminative terms, the case for nothing, whether it is about something; and ratios per term."""
        ratio = self.ratio[x.terms]
        score = x.by_sentence(ratio)
        many = x.by_sentence(self.feature[x.terms].astype(float))
        nothing = x.by_sentence(self.nothing[x.terms])
        about = (many > 0) & (nothing < margin) & (score.max(1, initial=0) > self.least)
        return score + (prior[x.doc_of] if prior is not None else 0), many, nothing, about, ratio


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _mixture(x: Flat, idf: np.ndarray, levels: list[np.ndarray], leaf_subjects: np.ndarray) -> np.ndarray:
    """(documents, subjects): the subjects of a document's leaves, nearer leaves weighing more."""
    d, t, w = x.vectors(idf)
    near = np.stack([np.bincount(d, weights=w * c[t], minlength=x.n) for c in levels[-1]], axis=1)
    return _soft(near / 0.1) @ leaf_subjects


class Fitted:
    """The fitted parts, for documents of any batch."""

    def __init__(self, names: list[str], terms: list[str], idf: np.ndarray, levels: list[np.ndarray], leaf_subjects: np.ndarray, model: Model, power: float) -> None:
        self.names, self.terms, self.idf, self.levels, self.leaf_subjects, self.model, self.power = names, terms, idf, levels, leaf_subjects, model, power

    def prior(self, x: Flat) -> np.ndarray:
        """Log of the subjects' mixture over a document's leaves, nearer leaves weighing more, to a small power."""
        mix = _mixture(x, self.idf, self.levels, self.leaf_subjects)
        return self.power * np.log(mix * mix.shape[1])

    def shares(self, x: Flat) -> tuple[np.ndarray, np.ndarray]:
        """(documents, subjects) sentences about each subject, and sentences of each document."""
        score, _, _, about, _ = self.model.judge(x, self.prior(x))
        k = len(self.names)
        cell = x.doc_of[about] * k + score[about].argmax(1)
        return np.bincount(cell, minlength=x.n * k).reshape(x.n, k), np.bincount(x.doc_of, minlength=x.n)


def fit(docs: DataFrame, ratings: DataFrame, names: list[str], key: str = "doc_id", text: str = "text", rounds: int = 3, power: float = 0.25, depth: int = 5, keep: float = 3.0, blend: float = 0.25) -> tuple[DataFrame, Fitted | None]:
    """The encoded documents and the fitted model; None without terms, subjects or ratings."""
    C.ship(docs.sparkSession)
    terms, n, total = vocabulary(docs, key, text)
    rows = encoded(docs, ratings, names, terms, key, text)
    k, v = len(names), len(terms)
    if not (k and v):
        return rows, None
    idf = np.log(max(total, 2) / n) + 1e-6
    levels = bisect(rows, idf, depth)
    leaves = 2**depth

    def rated(f: pd.DataFrame, out: np.ndarray) -> None:  # terms and leaves of rated documents by vote
        f = f[f["votes"].notna()]
        x = Flat(f)
        if not x.n:
            return
        node = _down(*x.vectors(idf), x.n, levels)
        for i, votes in enumerate(f["votes"]):
            mine = x.terms[x.doc_of[x.sent_of] == i]
            for c in votes:
                np.add.at(out, (mine, c), 1)
                out[v + node[i], c] += 1

    seen = _summed(rows.where("votes is not null"), (v + leaves, k + 1), rated)
    if not seen.any():
        return rows, None
    votes = seen[v:]
    base = votes.sum(0) / votes.sum()
    leaf = ((votes + 2 * base) / (votes.sum(1, keepdims=True) + 2))[:, 1:] / np.maximum(base[1:], 1e-6)
    leaf = (leaf + 1e-3) / (leaf + 1e-3).sum(1, keepdims=True)
    given, silent = seen[:v, 1:], seen[:v, 0]

    def mixed(f: pd.DataFrame, out: np.ndarray) -> None:
        x = Flat(f)
        mix = _mixture(x, idf, levels, leaf)[x.doc_of[x.sent_of]]
        for c in range(k):
            out[:, c] += np.bincount(x.terms, weights=mix[:, c], minlength=v)

    by_leaf = _summed(rows, (v, k), mixed)
    start = blend * by_leaf * (given.sum() / max(by_leaf.sum(), 1e-12)) + given
    fitted = Fitted(names, terms, idf, levels, leaf, Model(start, given.sum(1), silent, 0.337), power)
    for _ in range(rounds):

        def judged(f: pd.DataFrame, out: np.ndarray, fitted: Fitted = fitted) -> None:
            x, m = Flat(f), fitted.model
            score, many, nothing, about, ratio = m.judge(x, fitted.prior(x))
            s = x.sent_of
            others = (many[s] - m.feature[x.terms]) > 0
            told = about[s]
            fine = others & told
            post = _soft(score[s[fine]] - ratio[fine])
            for c in range(k):
                out[:, c] += np.bincount(x.terms[fine], weights=post[:, c], minlength=v)
            out[:, k] += np.bincount(x.terms[told], minlength=v)
            none = np.array([hasattr(y, "__len__") and 0 in y for y in f["votes"]])
            sure = (nothing > 1.5) | ((many == 0) & (none[x.doc_of] | (nothing > 0)))
            out[:, k + 1] += np.bincount(x.terms[sure[s]], minlength=v)

        got = _summed(rows, (v, k + 2), judged)
        fitted = Fitted(names, terms, idf, levels, leaf, Model(got[:, :k] + keep * given, got[:, k] + keep * given.sum(1), got[:, k + 1] + keep * silent, 0.29), power)
    return rows, fitted


def assigned(rows: DataFrame, fitted: Fitted | None, key: str = "doc_id") -> DataFrame:
    """(key, subject, about, sentences): sentences about each subject that a document has any of."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, subject string, about bigint, sentences bigint"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(fitted.names, dtype=object)
        for f in _batches(frames):
            n, whole = fitted.shares(Flat(f))
            i, j = np.nonzero(n)
            yield pd.DataFrame({key: f[key].to_numpy()[i], "subject": names[j], "about": n[i, j], "sentences": whole[i]})

    return rows.mapInPandas(run, schema)


def leaf_report(rows: DataFrame, fitted: Fitted | None, terms: int = 8) -> DataFrame:
    """(leaf, docs, subject, terms): size, label and most discriminative terms of each leaf that holds documents."""
    spark = rows.sparkSession
    schema = "leaf int, docs bigint, subject string, terms array<string>"
    if fitted is None:
        return spark.createDataFrame([], schema)
    v, leaves = len(fitted.terms), len(fitted.levels[-1])

    def count(f: pd.DataFrame, out: np.ndarray) -> None:
        x = Flat(f)
        d, t, w = x.vectors(fitted.idf)
        node = _down(d, t, w, x.n, fitted.levels)
        np.add.at(out, (node[d], t), 1)
        out[:, v] += np.bincount(node, minlength=leaves)

    got = _summed(rows, (leaves, v + 1), count)
    share = (got[:, :v] + 0.5) / (got[:, v:] + 1)
    rest = (got[:, :v].sum(0) - got[:, :v] + 0.5) / (got[:, v].sum() - got[:, v:] + 1)
    typical = np.log(share / rest) * share
    out = []
    for i in np.flatnonzero(got[:, v]):
        best = sorted(range(v), key=lambda t: (-round(typical[i, t], 9), t))[:terms]
        out.append((int(i), int(got[i, v]), fitted.names[int(fitted.leaf_subjects[i].argmax())], [fitted.terms[t] for t in best]))
    return spark.createDataFrame(out, schema)
