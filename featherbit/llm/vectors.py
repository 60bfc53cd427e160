"""Usable vectors, one row per distinct direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SENT = 500_000


def usable(df: DataFrame, key: str, vec: str, dims: int = 64) -> DataFrame:
    """(id, v ARRAY<FLOAT>) of the rows whose vector has all its numbers, all finite, and isn't zero. One row per id.

    Rows with a null id, a null, short or long vector, a null or infinite number in it, or length 0 are unusable.
    """
    v = F.col(vec)
    fine = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull() & fine).select(F.col(key).alias("id"), v.cast("array<float>").alias("v"), *(["loaded_at"] if "loaded_at" in df.columns else []))
    return C.once(rows, "id", ["v"])


def distinct(rows: DataFrame, few: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(c, v) of every distinct direction; (id, c, n) of the rows of directions with copies, and (c, n, few) of these directions;
    and the number of all directions.

    Rows whose unit vectors agree as floats are copies: c is their smallest id, n their number, few the ``few`` smallest. A group
    of copies that holds a third of all rows is so one vector to all that follows. Vectors are stored once; what groups copies
    reads ids and hashes only, and copies are left out by a broadcast of the fewer of them and the rest, if that is not too large.
    """
    norm = F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    unit = C.computed(rows, "_n", F.sqrt(norm)).select("id", "v", F.transform("v", lambda x: (x / F.col("_n")).cast("float")).alias("u"))
    hashed = C.stored(unit.select("id", "v", F.xxhash64("u").alias("h"), F.hash("u").alias("g")))
    keyed = hashed.select("id", F.concat_ws("_", "h", "g").alias("k"))
    groups = C.cut(keyed.groupBy("k").agg(F.min("id").alias("c"), F.count("*").alias("n")).where("n > 1"))
    members = C.cut(C.heavy_join(keyed, groups, "k", "n").select("id", "c", "n"))
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("id"))).where(F.col("r") <= few)
    least = C.cut(first.groupBy("c").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("id")).alias("few")))
    over, total = members.where("id <> c").select("id"), hashed.count()
    dropped = over.count()
    left = total - dropped
    if not dropped:
        dirs = hashed
    elif dropped > SENT >= left:
        dirs = hashed.join(F.broadcast(keyed.groupBy("k").agg(F.min("id").alias("id")).select("id")), "id", "left_semi")
    else:
        dirs = hashed.join(F.broadcast(over) if dropped <= SENT else over, "id", "left_anti")
    return dirs.select(F.col("id").alias("c"), "v"), members, least, left


def directions(rows: DataFrame, few: int = 1) -> tuple[DataFrame, DataFrame]:
    """(c, v, n, few) of every distinct direction and (id, c) of every row, both cut."""
    dirs, members, groups, _ = distinct(rows, few)
    every = dirs.select(F.col("c").alias("id"), "c").join(groups.select("c"), "c", "left_anti").select("id", "c").unionByName(members.select("id", "c"))
    full = dirs.join(groups, "c", "left").select("c", "v", F.coalesce("n", F.lit(1)).cast("bigint").alias("n"), F.coalesce("few", F.array("c")).alias("few"))
    return C.cut(full), C.cut(every)
