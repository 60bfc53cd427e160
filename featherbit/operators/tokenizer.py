"""Words, character-grams and word n-grams; vocabularies pruned by document frequency; fingerprints.

Training and inference differ on purpose: in inference, unknown words are taken out before n-grams are formed, so an n-gram
bridges over them. Words, character-grams and n-grams share one space of strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planning import computed, cut, ship

#: A vocabulary up to this size is sent to the workers, which then need no shuffle at all; a larger one is joined.
SHIPPED_TOKENS = 500_000


@dataclass(frozen=True)
class Params:
    """Bounds on relative document frequency and word length, and the reach of n-grams and character-grams."""

    max_df: float = 1.0
    min_df: float = 0.0
    max_len: int = 20
    min_len: int = 2
    ngrams: int = 1
    cgrams: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.min_df <= self.max_df <= 1:
            raise ValueError("0 <= min_df <= max_df <= 1 must hold")
        if self.min_len < 1 or self.max_len < self.min_len:
            raise ValueError("1 <= min_len <= max_len must hold")
        if self.ngrams < 1 or self.cgrams < 0:
            raise ValueError("ngrams must be 1 or more, cgrams 0 or more")


def words(text: Column, p: Params) -> Column:
    """Maximal runs of ASCII letters of allowed length, cut out first and lower-cased then; others are dropped whole."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))
    return F.transform(F.filter(runs, lambda w: F.length(w).between(p.min_len, p.max_len)), F.lower)


def _chars(w: str, p: Params) -> str:
    """SQL for the character-grams of the word ``w``: of every full window all prefixes of allowed length."""
    least = max(1, p.min_len)
    if not p.cgrams or least > p.cgrams:
        return "cast(array() as array<string>)"
    return f"if(length({w}) > {p.cgrams}, flatten(transform(sequence(1, length({w}) - {p.cgrams} + 1), s -> transform(sequence({least}, {p.cgrams}), n -> substring({w}, s, n)))), cast(array() as array<string>))"


def _grams(ws: str, i: str, p: Params) -> str:
    """SQL for the n-grams that end at word ``i``, longest first, the word itself last."""
    return f"transform(sequence(least({i}, {p.ngrams - 1}), 0, -1), k -> array_join(slice({ws}, {i} - k + 1, k + 1), ' '))"


def char_grams(ws: str, p: Params) -> Column:
    return F.expr(f"flatten(transform({ws}, w -> {_chars('w', p)}))")


def word_ngrams(ws: str, p: Params) -> Column:
    return F.expr(f"flatten(transform({ws}, (w, i) -> {_grams(ws, 'i', p)}))")


def features(ws: str, p: Params) -> Column:
    """Of every word its character-grams, then the n-grams that end with it."""
    return F.expr(f"flatten(transform({ws}, (w, i) -> concat({_chars('w', p)}, {_grams(ws, 'i', p)})))")


def with_words(docs: DataFrame, p: Params, key: str, text: str) -> DataFrame:
    return computed(docs.select(key, F.col(text).alias("_t")), "ws", words(F.col("_t"), p)).select(key, "ws")


def _counts(docs: DataFrame, p: Params, key: str, text: str) -> DataFrame:
    """(token, df), with the number of documents as the df of the empty token."""
    found = computed(with_words(docs, p, key, text), "fs", F.concat(F.array(F.lit("")), F.array_distinct(features("ws", p))))
    return found.select(F.explode("fs").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def document_frequency(docs: DataFrame, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, df): distinct features per document before the shuffle, then partial and final counts."""
    return _counts(docs, p, key, text).where("token <> ''")


class Vocabulary:
    """A vocabulary in training or finalised: parameters, document count and (token, df[, id])."""

    def __init__(self, params: Params, n_docs: int = 0, df: DataFrame | None = None, finalized: bool = False) -> None:
        self.params, self.n_docs, self.df, self.finalized = params, n_docs, df, finalized

    def train(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Vocabulary:
        """Adds documents; may be called again until finalised. Counts are merged, so the order of batches doesn't matter."""
        if self.finalized:
            raise ValueError("the vocabulary is finalised")
        counts = cut(_counts(docs, self.params, key, text))  # documents and tokens in one scan
        whole, new = counts.where("token = ''").first(), counts.where("token <> ''")
        merged = new if self.df is None else self.df.select("token", "df").unionByName(new).groupBy("token").agg(F.sum("df").alias("df"))
        return Vocabulary(self.params, self.n_docs + (whole["df"] if whole else 0), merged)

    def pruned(self) -> DataFrame:
        share = F.col("df") / F.lit(float(max(1, self.n_docs)))
        return self.df.where(share.between(self.params.min_df, self.params.max_df))

    def finalize(self) -> Vocabulary:
        """Prunes, both bounds kept, and numbers the rest from 0 by falling df, then token.

        Numbering is by blocks of one df: blocks are offset by a running sum over distinct df values, of which there are at
        most as many as documents and in practice few thousands; within a block tokens are ranked by themselves.
        """
        if self.finalized:
            raise ValueError("the vocabulary is finalised already")
        kept = cut(self.pruned())
        sizes = kept.groupBy("df").agg(F.count("*").alias("n"))
        before = Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("df", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        rank = F.row_number().over(Window.partitionBy("df").orderBy("token")) - 1
        ids = kept.withColumn("r", rank).join(offsets, "df").select("token", "df", (F.col("before") + F.col("r")).cast("int").alias("id"))
        return Vocabulary(self.params, self.n_docs, cut(ids), True)

    def size(self) -> int:
        return self.df.count()


def _joined(each: DataFrame, vocabulary: Vocabulary, cols: list[str], how: str, share: float = 0.01) -> DataFrame:
    """each(token, ...) joined to the vocabulary's ``cols``. Tokens in over a hundredth of the documents are broadcast and their
    rows stay where they are: there are at most 100 times as many as features in an average document."""
    hot = vocabulary.df.where(F.col("df") >= max(1000.0, share * vocabulary.n_docs)).select(*cols)
    cold = vocabulary.df.where(F.col("df") < max(1000.0, share * vocabulary.n_docs)).select(*cols)
    light = each.join(F.broadcast(hot.select("token")), "token", "left_anti").join(cold, "token", how)
    return light.unionByName(each.join(F.broadcast(hot), "token", how))


def _known_features(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str) -> DataFrame:
    """(key, fs): the inference features of every document by joins; documents without any known word have none."""
    p = vocabulary.params
    base = with_words(docs, p, key, text)
    each = base.select(key, F.posexplode("ws").alias("pos", "token"))
    known = _joined(each, vocabulary, ["token"], "left_semi")
    ordered = known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("ws"))
    return computed(ordered, "fs", features("ws", p)).select(key, "fs")


def joined_fingerprints(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): for vocabularies of any size."""
    found = computed(_known_features(docs, vocabulary, key, text), "one", F.array_distinct("fs")).select(key, F.explode("one").alias("token"))
    ids = _joined(found, vocabulary, ["token", "id"], "inner").groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return docs.select(key).join(ids, key, "left").select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def joined_parse(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): known features in order, with repeats."""
    each = _known_features(docs, vocabulary, key, text).select(key, F.posexplode("fs").alias("pos", "token"))
    known = _joined(each, vocabulary, ["token"], "left_semi")
    lists = known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    return docs.select(key).join(lists, key, "left").select(key, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def _shipped_ids(vocabulary: Vocabulary) -> dict[str, int] | None:
    rows = vocabulary.df.select("token", "id").limit(SHIPPED_TOKENS + 1).toPandas()
    return dict(zip(rows["token"], rows["id"].tolist(), strict=True)) if len(rows) <= SHIPPED_TOKENS else None


def known_features(ws: list[str], ids: dict[str, int], p: Params) -> Iterator[int]:
    """Ids of the known features of a document's words, in order, with repeats."""
    ws = [w for w in ws if w in ids]
    least = max(1, p.min_len)
    for i, w in enumerate(ws):
        if p.cgrams and len(w) > p.cgrams:
            for s in range(len(w) - p.cgrams + 1):
                for n in range(least, p.cgrams + 1):
                    g = ids.get(w[s : s + n])
                    if g is not None:
                        yield g
        for k in range(min(i, p.ngrams - 1), -1, -1):
            g = ids.get(" ".join(ws[i - k : i + 1]))
            if g is not None:
                yield g


def _mapped(docs: DataFrame, vocabulary: Vocabulary, ids: dict[str, int], key: str, text: str, distinct: bool) -> DataFrame:
    ship(docs.sparkSession)
    held, p, kind = docs.sparkSession.sparkContext.broadcast(ids), vocabulary.params, docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            out, ends = [], [0]
            for ws in batch.column(1).to_pylist():
                got = known_features(ws, known, p)
                got = sorted(set(got)) if distinct else list(got)
                out += got
                ends.append(len(out))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(out, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return with_words(docs, p, key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def fingerprints(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids ARRAY<INT>): sorted ids of the known features; a document without any is a row with an empty array."""
    if not vocabulary.finalized:
        raise ValueError("finalise the vocabulary first")
    ids = _shipped_ids(vocabulary)
    return joined_fingerprints(docs, vocabulary, key, text) if ids is None else _mapped(docs, vocabulary, ids, key, text, True)


def parse(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens ARRAY<STRING>): known features in order, with repeats; unknown ones are left out."""
    if not vocabulary.finalized:
        raise ValueError("finalise the vocabulary first")
    ids = _shipped_ids(vocabulary)
    if ids is None:
        return joined_parse(docs, vocabulary, key, text)
    names = [t for t, _ in sorted(ids.items(), key=lambda x: x[1])]
    sequence = _mapped(docs, vocabulary, ids, key, text, False)
    held = sequence.sparkSession.sparkContext.broadcast(np.array(names, dtype=object))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.array(held.value.tolist(), pa.string())
        for batch in batches:
            lists = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(lists.offsets, of.take(lists.values))], names=[key, "tokens"])

    return sequence.mapInArrow(run, f"{key} {kind}, tokens array<string>")


def strings_of(prints: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """(key, id, token): fingerprints as strings again."""
    return prints.select(key, F.explode("ids").alias("id")).join(vocabulary.df.select("id", "token"), "id").select(key, "id", "token")
