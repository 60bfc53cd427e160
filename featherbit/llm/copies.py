"""Problem 4: records that differ only in blanks, case, punctuation, markup or the order of a sheet's segments.

Progressive partition refinement. Every record starts in one class per table; each step splits the classes by a key that
costs more than the one before and only looks at classes that still hold several records:

1. letter histogram: how often each of eight letters stands in the lower-cased text without its markup. No key is built for
   it, nothing is matched but single letters; blanks, punctuation and the order of segments can't change it, so no copy is lost.
2. the exact key (for a sheet the sorted keys of its segments) as a 256-bit digest, of records in classes of several.

Classes of one record leave after step 1 without their key ever being built. The texts are written once, as a compressed
table; each use reads the columns it needs. Hot classes are handled by ``heavy_join``: the few classes with over
half a per cent of all rows are broadcast, their rows stay where they are.

A tag reaches from ``<`` to the next ``>``, whatever stands between: of ``<br<br /> />`` the end `` />`` is left as punctuation.

Defined results: null text and text with an empty key are left out; rows with a null id are left out; repeated rows with
one id count once; ties need no rule, since the first record is the smallest id; very long texts are read whole; empty
tables give an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed values of the task: the names a sheet's segments may have.
SHEET_NAMES = ("story", "acting", "pacing", "sound", "ending", "verdict")
HISTOGRAM = "etaoinsr"


def sheet_key(plain: Column, names: tuple[str, ...] = SHEET_NAMES) -> Column:
    """Canonical key: of a sheet the sorted keys of its segments, of any other text its key."""
    segments = F.filter(F.split(plain, r"[|;\n\r]+"), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    named = F.forall(segments, lambda s: s.rlike(rf"(?i)^\s*(?:{'|'.join(names)})\s*:"))
    ordered = F.array_join(F.sort_array(F.transform(segments, C.key_of)), "|")
    if not names:
        return F.concat(F.lit("t:"), C.key_of(plain))
    return F.when((F.size(segments) >= 2) & named, F.concat(F.lit("s:"), ordered)).otherwise(F.concat(F.lit("t:"), C.key_of(plain)))


def _split(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows alone in their class of ``key``, and those of classes of several."""
    sizes = C.cut(rows.groupBy(key).agg(F.count("*").alias("n")))
    alone = rows.join(sizes.where("n = 1").select(key), key, "left_semi")
    return alone, C.heavy_join(rows, sizes.where("n > 1"), key, "n").drop("n", key)


def _refined(records: DataFrame, sheets: bool) -> tuple[DataFrame, DataFrame]:
    """(kind, id) of the records found to be alone, and (kind, id, first_id, copies) of those of classes of several."""
    present = records.select("kind", "id", "text").where(F.col("text").isNotNull() & F.col("id").isNotNull())
    plain = C.computed(present, "plain", C.unmarked(F.col("text"))).select("kind", "id", "plain")
    low = C.computed(plain, "_l", F.lower("plain"))
    counts = [F.length("_l") - F.length(F.replace(F.col("_l"), F.lit(x))) for x in HISTOGRAM]
    rows = C.stored(low.select("kind", "id", "plain", F.xxhash64("kind", *counts).alias("histogram")))
    single, several = _split(rows, "histogram")
    single = single.where(F.col("plain").rlike(C.WORD)).select("kind", "id")
    keyed = C.computed(several, "_k", sheet_key(F.col("plain"), SHEET_NAMES if sheets else ())).where("_k <> 't:'")
    digest = F.sha2(F.concat_ws("\x1f", "kind", "_k"), 256)
    keyed = C.cut(keyed.select("kind", "id", digest.alias("key")))
    groups = C.cut(keyed.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")))
    return single, C.heavy_join(keyed, groups, "key", "copies").select("kind", "id", "first_id", "copies")


def copy_classes(records: DataFrame, sheets: bool = False) -> DataFrame:
    """records(kind, id, text), one row per id, to (kind, id, first_id, copies) for every record with a non-empty key."""
    alone, several = _refined(records, sheets)
    return several.unionByName(alone.select("kind", "id", F.col("id").alias("first_id"), F.lit(1).cast("bigint").alias("copies")))


def copy_pairs(records: DataFrame, sheets: bool = False) -> DataFrame:
    """One row (kind, first_id, copy_id) per record that is not the first of its copies; single records are not read again."""
    _, several = _refined(records, sheets)
    return several.where("id <> first_id").select("kind", "first_id", F.col("id").alias("copy_id"))


def collapse(records: DataFrame, sheets: bool = False) -> DataFrame:
    """One row (kind, first_id, copies) per distinct record."""
    return copy_classes(records, sheets).where("id = first_id").select("kind", "first_id", "copies")
