"""Exact ranks, splits and limits in a hashed order, without sorting the whole in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planning import cut

PREFIX = 3  # hex digits: 4,096 parts


def shuffle_key(seed: int, *keys: str) -> Column:
    """Where a row stands in the shuffled order of a seed: a hash that other engines have too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def ranked(df: DataFrame, seed: int, keys: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row in the shuffled order, per group of ``by``.

    Parts of the hash are counted first; a row's rank is the size of the parts before plus its rank within its own.
    """
    by = by or []
    rows = df.withColumn("_h", shuffle_key(seed, *keys)).withColumn("_p", F.substring("_h", 1, PREFIX))
    sizes = rows.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_p").orderBy("_h", *keys)
    return rows.withColumn("_r", F.row_number().over(inside)).join(offsets, [*by, "_p"]).withColumn(name, (F.col("_before") + F.col("_r")).cast("bigint")).drop("_h", "_p", "_n", "_r", "_before")


def first_rows(df: DataFrame, seed: int, keys: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """Just the first ``n`` rows of the shuffled order, and the others. Only the part at the border is ranked."""
    rows = df.withColumn("_h", shuffle_key(seed, *keys)).withColumn("_p", F.substring("_h", 1, PREFIX))
    part, left = "", n
    for r in rows.groupBy("_p").count().orderBy("_p").collect():  # 4,096 rows at most
        part = r["_p"]
        if r["count"] > left:
            break
        left -= r["count"]
        part = "g"  # after all hex digits
    border = rows.where(F.col("_p") == part).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h", *keys)))
    low = rows.where(F.col("_p") < part).withColumn("_r", F.lit(0)).unionByName(border.where(F.col("_r") <= left))
    high = rows.where(F.col("_p") > part).withColumn("_r", F.lit(0)).unionByName(border.where(F.col("_r") > left))
    return low.drop("_h", "_p", "_r"), high.drop("_h", "_p", "_r")


def train_test(df: DataFrame, seed: int, keys: list[str], ratio: float | None) -> tuple[DataFrame, DataFrame | None]:
    """The first floor(N * ratio) rows in the shuffled order, and the rest; without a ratio all rows and none."""
    if ratio is None:
        return df, None
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must lie in [0, 1]")
    df = cut(df)
    return first_rows(df, seed, keys, int(df.count() * ratio))
