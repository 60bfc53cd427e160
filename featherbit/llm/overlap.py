"""Problem 2: the same or nearly the same record in several splits.

1. Content-defined chunks. A record is normalised to the sets of words of its three fields, each set in two fixed orders (by two
   hashes), so neither case, marks nor word order matter. A rolling hash with a window of one word cuts each order after the
   words that it says (one in ``divisor``), so a changed word moves no cut but its own. Digests of the chunks are joined across
   splits, and the lengths of the chunks that a train and a held-out record share are summed, per field, into the share of the
   record that the other holds too (``chunk_pairs``).
2. A chunk that very many records have joins them all, so digests that would give over ``most`` pairs are left to
   ``rare_word_pairs``. Nor can chunks promise every pair: if each of a field's chunks has a changed word, none is shared. On the
   largest test table chunks lead to all 5,899 pairs of different records (0.935 with a quarter of ``most``); rare words make the
   result whole whatever the data: two sets with a similarity of t share a word of their rarest n - ceil(t n) + 1 words, so the
   digest of such a word of ``positive`` together with one of ``negative`` is shared by every true pair, and still rare. Where both
   words are common (each in over 2 % of the records, as with boilerplate) a rare word of ``anchor`` is added on both sides.
3. All candidates are checked exactly on their word sets. In both steps a 64-bit sketch of each field's words bounds the
   difference and drops most wrong candidates inside the join.

Exact copies (same word sets in all three fields) are one class from the start and joined once; members are added at the end.
``chunk_overlap`` reports, per held-out record, how much of it stands in chunks, in the text's own order, that train has too.

Defined results: null fields and fields without words match nothing; splits other than the three named take no part; repeated
rows with one id count once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FIELDS = ("anchor", "positive", "negative")
BUCKETS = 1 << 16
EVALUATION = ("validation", "test")
DIVISOR, MOST, ORDERS = 4, 16_384, 2
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def split_name(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.lower(F.regexp_replace("split", r"\s+", "")))


def _word_sets(records: DataFrame) -> DataFrame:
    """(id, held, a, p, n): sorted hashes of the distinct words of each field; held is 1 for train and 2 for the others."""
    side = F.when(F.col("split") == "train", 1).when(F.col("split").isin(*EVALUATION), 2)
    rows = split_name(records.select("id", "split", *FIELDS)).withColumn("held", side).where("held is not null and " + " and ".join(f"{c} is not null" for c in FIELDS))
    for c in FIELDS:
        rows = C.computed(rows, f"_{c}", F.array_sort(F.array_distinct(F.transform(C.words(F.col(c)), lambda w: F.xxhash64(w)))))
    sets = rows.select("id", "held", *[F.col(f"_{c}").alias(c[0]) for c in FIELDS])
    return sets.where("size(a) > 0 and size(p) > 0 and size(n) > 0")


def _heads(classes: DataFrame, side: int, freq: object, total: int, threshold: float, hot: float) -> DataFrame:
    """(digest, c, lens, sa, sp, sn) of the classes that have a row on that side."""

    def head(words: np.ndarray, field: int) -> tuple[np.ndarray, np.ndarray]:
        f = freq.value[field][words & (BUCKETS - 1)]
        order = np.lexsort((words, f))[: len(words) - math.ceil(threshold * len(words) - 1e-9) + 1]
        return words[order], f[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(50.0, hot * total)
        odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64).astype(np.int64)
        bit = np.int64(1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = [(batch.column(k).values.to_numpy(), batch.column(k).offsets.to_numpy()) for k in (1, 2, 3)]
            digests, owner, sketch = [], [], np.zeros((len(ids), 3), dtype=np.int64)
            lens = np.zeros(len(ids), dtype=np.int64)
            for i in range(len(ids)):
                w = [v[o[i] : o[i + 1]] for v, o in lists]
                for k in range(3):
                    sketch[i, k] = np.bitwise_or.reduce(bit << ((w[k] >> 20) & 63))
                    lens[i] |= len(w[k]) << (20 * k)
                (p, fp), (n, fn) = head(w[1], 1), head(w[2], 2)
                two = (p * odd[1])[:, None] ^ ((n * odd[2])[:, None] >> 7).T
                common = np.minimum(fp[:, None], fn[None, :]) > limit
                got = two[~common]
                if common.any():
                    a, _ = head(w[0], 0)
                    got = np.concatenate([got, ((two[common] * odd[0])[:, None] ^ (a * odd[1])[None, :]).ravel()])
                digests.append(np.unique(got))
                owner.append(np.full(len(digests[-1]), i))
            if not digests:
                continue
            d, at = np.concatenate(digests), np.concatenate(owner)
            for s in range(0, len(d), 50_000):
                k = at[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[s : s + 50_000], ids[k], lens[k], *sketch[k].T)], names=["digest", "c", "lens", "sa", "sp", "sn"])

    of = classes.where(f"(held & {side}) > 0").select("c", "a", "p", "n")
    return of.mapInArrow(run, "digest long, c long, lens long, sa long, sp long, sn long")


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = x.view(np.uint64) * _ODD[k % 4]
    x = (x ^ (x >> np.uint64(29))) * _ODD[(k + 1) % 4]
    return x ^ (x >> np.uint64(32))


def _chunks(batch: pa.RecordBatch, divisor: int, orders: int) -> tuple[np.ndarray, ...]:
    """Owner (row of the batch), digest, field and order (3 * order + field) and length of every chunk of a batch (c, held, a, p, n)."""
    out = []
    for field in range(3):
        col = batch.column(2 + field)
        w, off = col.values.to_numpy(), col.offsets.to_numpy()
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        w = w[off[0] : off[-1]]
        for order in range(orders):
            x = _mixed(w, 2 * order)
            at = np.lexsort((x, row))
            x, r = x[at], row[at]
            ends = (x >> np.uint64(20)) % np.uint64(divisor) == 0
            first = np.flatnonzero(np.r_[True, ends[:-1] | (r[1:] != r[:-1])]) if len(x) else np.zeros(0, dtype=int)
            digest = np.add.reduceat(_mixed(x, 1), first) if len(first) else x
            digest = _mixed(digest + np.uint64(3 * order + field + 1), 3).view(np.int64)
            out.append((r[first], digest, np.full(len(first), 3 * order + field), np.diff(np.r_[first, len(x)])))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _sketches(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words (rows, 3), and 64-bit sketches (rows, 3) of the fields of (c, held, a, p, n)."""
    lens, sketch = np.zeros((len(batch), 3), dtype=np.int32), np.zeros((len(batch), 3), dtype=np.int64)
    for field in range(3):
        col = batch.column(2 + field)
        w, off = col.values.to_numpy(), col.offsets.to_numpy()
        lens[:, field] = np.diff(off)
        if len(batch):  # every set has a word
            sketch[:, field] = np.bitwise_or.reduceat(np.int64(1) << ((w[off[0] : off[-1]] >> 20) & 63), off[:-1] - off[0])
    return lens, sketch


_ROW = "digest long, c long, held int, kind int, size int, la int, lp int, ln int, sa long, sp long, sn long"


def chunk_pairs(classes: DataFrame, total: int, threshold: float = 0.7, divisor: int = DIVISOR, most: int = MOST, orders: int = ORDERS) -> DataFrame:
    """classes(c, held, a, p, n) to (ct, ce, fa, fp, fn): train and held-out classes that share a chunk, and per field the share
    of the longer record's words in shared chunks (the better of both orders); pairs that sketches rule out are left out.

    Digests are dealt out by hash, rows of one digest follow one another, and no more than ``most`` of them are held at once: a
    digest with more rows would give more pairs than that. What stands in over a hundredth of the classes doesn't even get there.
    """
    spark = classes.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            n += np.bincount(_chunks(batch, divisor, orders)[1] & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["b", "n"])

    rows = classes.select("c", "held", "a", "p", "n")
    full = rows.mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).where(F.col("n") > max(2 * most, 2 * total // 100))
    hot = np.zeros(BUCKETS, dtype=bool)
    hot[[r["b"] for r in full.collect()]] = True  # a table of fixed size
    held_hot = spark.sparkContext.broadcast(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, digest, kind, size = _chunks(batch, divisor, orders)
            keep = ~held_hot.value[digest & (BUCKETS - 1)]
            owner, digest, kind, size = owner[keep], digest[keep], kind[keep], size[keep]
            lens, sketch = _sketches(batch)
            c, held = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in range(0, len(digest), 50_000):
                o = owner[s : s + 50_000]
                cols = [digest[s : s + 50_000], c[o], held[o].astype(np.int32), kind[s : s + 50_000].astype(np.int32), size[s : s + 50_000].astype(np.int32), *lens[o].T, *sketch[o].T]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[x.split()[0] for x in _ROW.split(", ")])

    slack = (1 - threshold) / (1 + threshold) + 1e-9

    def pairs(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Of rows sorted by digest."""
        first = np.flatnonzero(np.r_[True, x["digest"][1:] != x["digest"][:-1]])
        t, e = np.flatnonzero(x["held"] & 1), np.flatnonzero(x["held"] & 2)
        group = np.cumsum(np.isin(np.arange(len(x["digest"])), first)) - 1
        nt, ne = np.bincount(group[t], minlength=len(first)), np.bincount(group[e], minlength=len(first))
        fine = (nt > 0) & (ne > 0) & (nt * ne <= most)
        t = t[fine[group[t]]]
        start = np.searchsorted(group[e], np.arange(len(first)))
        n = ne[group[t]]
        ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = np.repeat(t, n), e[np.repeat(start[group[t]], n) + ramp] if len(t) else np.zeros(0, dtype=int)
        near = x["c"][i] != x["c"][j] if len(i) else np.zeros(0, dtype=bool)
        for f in "apn":
            near &= np.bitwise_count((x[f"s{f}"][i] ^ x[f"s{f}"][j]).view(np.uint64)) <= (x[f"l{f}"][i] + x[f"l{f}"][j]) * slack
        i, j = i[near], j[near]
        lens = np.stack([x[f"l{f}"] for f in "apn"])
        part = x["size"][i] / np.maximum(lens[x["kind"][i] % 3, i], lens[x["kind"][i] % 3, j])
        return pa.RecordBatch.from_arrays([pa.array(y) for y in (x["c"][i], x["c"][j], x["kind"][i], part)], names=["ct", "ce", "kind", "part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, left, dead = [x.split()[0] for x in _ROW.split(", ")], None, None
        for batch in batches:
            x = {n: batch.column(n).to_numpy() for n in names}
            if left is not None:
                x = {n: np.concatenate([left[n], x[n]]) for n in names}
            if not len(x["digest"]):
                continue
            last = x["digest"][-1]
            begin = int(np.searchsorted(x["digest"], last))
            if dead is not None and x["digest"][0] == dead:  # rows of a digest that is over the limit already
                skip = int(np.searchsorted(x["digest"], dead, side="right"))
                x, begin = {n: v[skip:] for n, v in x.items()}, max(0, begin - skip)
            if begin:
                yield pairs({n: v[:begin] for n, v in x.items()})
            left = {n: v[begin:] for n, v in x.items()}
            if len(left["digest"]) > most + 1:
                left, dead = None, last
        if left is not None and len(left["digest"]):
            yield pairs(left)

    dealt = rows.mapInArrow(cut, _ROW).repartition("digest").sortWithinPartitions("digest")
    met = dealt.mapInArrow(join, "ct long, ce long, kind int, part double")
    sums = met.groupBy("ct", "ce", "kind").agg(F.sum("part").alias("part"))
    best = [F.coalesce(F.max(F.when(F.col("kind") % 3 == k, F.col("part"))), F.lit(0.0)).alias(f"f{c}") for k, c in enumerate("apn")]
    return sums.groupBy("ct", "ce").agg(*best)


def rare_word_pairs(classes: DataFrame, total: int, threshold: float = 0.7, hot: float = 0.02) -> DataFrame:
    """classes(c, held, a, p, n) to (ct, ce), candidates among which are all pairs of different classes, whatever they share."""
    spark = classes.sparkSession
    freq = np.zeros((3, BUCKETS), dtype=np.int64)
    for k, c in enumerate("apn"):  # three tables of fixed size
        for r in classes.select(F.explode(c).alias("w")).groupBy((F.col("w").bitwiseAND(BUCKETS - 1)).alias("b")).count().collect():
            freq[k, r["b"]] = r["count"]
    table = spark.sparkContext.broadcast(freq)
    left = _heads(classes, 1, table, total, threshold, hot).toDF("digest", "ct", "lt", "ta", "tp", "tn")
    right = _heads(classes, 2, table, total, threshold, hot).toDF("digest", "ce", "le", "ea", "ep", "en")
    near = F.col("ct") != F.col("ce")
    slack = (1 - threshold) / (1 + threshold) + 1e-9
    for k, c in enumerate("apn"):
        size = sum((F.shiftright(x, 20 * k).bitwiseAND((1 << 20) - 1) for x in ("lt", "le")), F.lit(0))
        near = near & (F.bit_count(F.col(f"t{c}").bitwiseXOR(F.col(f"e{c}"))) <= size * slack)
    return left.join(right, "digest").where(near).select("ct", "ce").distinct()


def record_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, n_rows, held, a, p, n) of the distinct records, and (c, id, held) of their members, both cut."""
    sets = _word_sets(records)
    keyed = C.cut(sets.withColumn("h", F.md5(F.concat_ws("|", *[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in "apn"]))))
    classes = C.cut(keyed.groupBy("h").agg(F.min("id").alias("c"), F.count("*").alias("n_rows"), F.bit_or("held").alias("held"), *[F.first(c).alias(c) for c in "apn"]))
    members = C.cut(C.heavy_join(keyed.select("h", "id", "held"), classes.select("h", "c", "n_rows"), "h", "n_rows").select("c", "id", "held"))
    return classes, members


def class_pairs(classes: DataFrame, threshold: float = 0.7, hot: float = 0.02, divisor: int = DIVISOR, most: int = MOST) -> DataFrame:
    """(ct, ce, by_chunks) of all classes with train rows and classes with held-out rows that match, a class with itself included."""
    total = classes.count()
    by_chunks = C.cut(chunk_pairs(classes, total, threshold, divisor, most).select("ct", "ce"))
    rest = rare_word_pairs(classes, total, threshold, hot).join(by_chunks, ["ct", "ce"], "left_anti")
    found = by_chunks.withColumn("by_chunks", F.lit(True)).unionByName(rest.withColumn("by_chunks", F.lit(False)))
    sides = [classes.select(F.col("c").alias(f"c{s}"), *[F.col(x).alias(f"{s}{x}") for x in "apn"]) for s in "te"]
    both = found.join(sides[0], "ct").join(sides[1], "ce")
    for c in "apn":
        shared = F.size(F.array_intersect(f"t{c}", f"e{c}"))
        both = both.where(shared >= threshold * (F.size(f"t{c}") + F.size(f"e{c}") - shared) - 1e-9)
    itself = classes.where("held = 3").select(F.col("c").alias("ct"), F.col("c").alias("ce"), F.lit(True).alias("by_chunks"))
    return C.cut(both.select("ct", "ce", "by_chunks").unionByName(itself))


def overlapping_pairs(records: DataFrame, threshold: float = 0.7, hot: float = 0.02, divisor: int = DIVISOR, most: int = MOST) -> DataFrame:
    """records(id, anchor, positive, negative, split), one row per id, to (train_id, other_id)."""
    C.ship(records.sparkSession)
    classes, members = record_classes(records)
    pairs = class_pairs(classes, threshold, hot, divisor, most)
    t = members.where("held = 1").select(F.col("c").alias("ct"), F.col("id").alias("train_id"))
    e = members.where("held = 2").select(F.col("c").alias("ce"), F.col("id").alias("other_id"))
    return pairs.join(t, "ct").join(e, "ce").select("train_id", "other_id")


def overlap_counts(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, pairs, by_chunks) of the held-out records that overlap train: numbers of train rows, counted by the sizes of their
    classes, so no class is expanded into pairs; by_chunks are those met through shared chunks."""
    C.ship(records.sparkSession)
    classes, members = record_classes(records)
    sizes = members.where("held = 1").groupBy(F.col("c").alias("ct")).agg(F.count("*").alias("n"))
    per = class_pairs(classes, threshold).join(sizes, "ct").groupBy(F.col("ce").alias("c")).agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col("by_chunks"), F.col("n")).otherwise(0)).alias("by_chunks"))
    held = members.where("held = 2")
    n = held.groupBy("c").agg(F.count("*").alias("rows"))
    return C.heavy_join(held.select("c", "id"), C.cut(per.join(n, "c")), "c", "rows").select("id", "pairs", "by_chunks")


def chunk_overlap(records: DataFrame, divisor: int = 4) -> DataFrame:
    """(id, split, source, n_words, shared): words of each validation and test record in chunks that train has in the same field."""
    rows = split_name(records.select("id", "split", "source", *FIELDS)).where(F.col("split").isin("train", *EVALUATION))
    fields = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("t")) for c in FIELDS])
    each = rows.select("id", "split", "source", F.explode(fields).alias("x")).select("id", "split", "source", "x.f", C.words(F.col("x.t")).alias("_w"))
    # a word ends a chunk if the hash of its last four letters says so: the window of the rolling hash, which ends with the word
    window = lambda v: F.conv(F.substring(F.md5(F.substring(v, -4, 4)), 1, 4), 16, 10).cast("int")
    each = C.computed(each.where("size(_w) > 0").withColumnRenamed("_w", "w"), "h", F.transform("w", window))
    each = C.computed(each, "s", F.expr(f"filter(sequence(0, size(w)), i -> i = 0 or i = size(w) or h[i - 1] % {divisor} = 0)"))
    chunks = each.select("id", "split", "source", "f", F.explode(F.expr("transform(slice(s, 1, size(s) - 1), (a, k) -> struct(slice(w, a + 1, s[k + 1] - a) as c, s[k + 1] - a as n))")).alias("x"))
    chunks = C.cut(chunks.select("id", "split", "source", F.xxhash64("f", "x.c").alias("digest"), F.col("x.n").alias("n")))
    train = chunks.where("split = 'train'").select("digest").distinct().withColumn("held", F.lit(1))
    other = chunks.where("split <> 'train'")
    # digests are counted per record, so a hot chunk is one row per record and not one per pair
    met = other.join(train, "digest", "left")
    return met.groupBy("id", "split", "source").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("held") == 1, F.col("n")).otherwise(0)).alias("shared"))
