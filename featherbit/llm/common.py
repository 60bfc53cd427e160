"""What the corpus operators share: checkpoints, repeated rows, words and keys of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.planning import computed, cut, ship, stored  # noqa: F401

WORD = r"[\p{L}\p{N}]+"
MARKUP = r"<[^>]*>|&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str, cols: list[str], newest: str | None = "loaded_at") -> DataFrame:
    """One row per id: of repeated rows the one loaded last. Rows without id can't be reported and are left out.

    Partial aggregation merges repeats before the shuffle, so a heavily repeated id is one row per map task.
    """
    kept = df.where(F.col(key).isNotNull())
    order = F.col(newest) if newest and newest in df.columns else F.lit(0)
    order = F.struct(order.isNotNull(), order, *[F.col(c).cast("string") for c in cols if dict(df.dtypes)[c] in ("string", "bigint", "int", "timestamp")])
    rows = kept.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_row"))
    return rows.select(key, *[F.col(f"_row.{c}").alias(c) for c in cols])


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased; null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1)), F.lower)


def unmarked(text: Column) -> Column:
    """Tags and character references become blanks; texts without either are not searched."""
    return F.when(text.contains("<") | text.contains("&"), F.regexp_replace(text, MARKUP, " ")).otherwise(text)


def key_of(plain: Column) -> Column:
    """The key of a text whose markup is gone already: its words joined without anything between."""
    return F.lower(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", ""))


def heavy_join(rows: DataFrame, groups: DataFrame, on: str, size: str, share: int = 200) -> DataFrame:
    """Inner join of rows to one row per group, safe when a few groups hold most rows.

    Groups with over 1/share of all grouped rows number fewer than ``share``: a proven bound, so they are broadcast and
    their rows never move. All others are shuffled; none of them is larger than 1/share of the whole.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_heavy = F.col(size) > F.lit(max(total / share, 1000.0))
    heavy = groups.where(is_heavy)
    light = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(groups.where(~is_heavy), on)
    return light.unionByName(rows.join(F.broadcast(heavy), on).select(*light.columns))
