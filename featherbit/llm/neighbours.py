"""Problem 5: the k most similar vectors of every vector.

All pairs of distinct directions are compared in blocks (see ``pairs``): exact, vectors on disk once and never shuffled. A task
keeps the k best it meets for each vector; once a dense tile has shown k good ones, only better ones are looked at. The lists
of the tasks are joined by vector. Similarities are in double precision, rounded to 9 decimals.

Until round 2 this was multi-index hashing over 128 learned bits within a radius of 31. Its work per query grew nearly with
the number of vectors too, cost more from a few thousand vectors on and missed pairs whose codes differ by more.

Ties go to the smaller id. Unusable vectors (see ``vectors.usable``) take no part; vectors of equal direction are compared
once and listed by id, whatever k; k larger than the number of vectors gives all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import pairs
from . import vectors as V

BLOCK = pairs.BLOCK


def unit_rows(v: list | np.ndarray) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in v])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(rows: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """rows(id, v) usable, one per id, to (id, other, similarity, rank): up to k others with at least ``least``."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    C.ship(rows.sparkSession)
    dirs, members, groups, total = V.distinct(rows, k + 1)
    met = pairs.meet(pairs.blocks(dirs, total, BLOCK), lambda: pairs.Nearest(least, k), "c bigint, o bigint, s double")
    by = Window.partitionBy("c").orderBy(F.desc("s"), "o")
    near = met.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select("c", "o", "s")
    few = groups.select(F.col("c").alias("o"), "few")
    own_few = groups.select("c", F.explode("few").alias("other"), F.lit(1.0).alias("s"))
    options = near.join(few, "o", "left").select("c", F.explode(F.coalesce("few", F.array("o"))).alias("other"), "s").unionByName(own_few)
    by = Window.partitionBy("c").orderBy(F.desc("s"), "other")
    best = options.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    # one list of k + 1 per direction: a row itself may stand in it
    lists = C.cut(best.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("r", "other", "s"))).alias("l")).join(groups.select("c", "n"), "c", "left"))
    alone = lists.where("n is null").select(F.col("c").alias("id"), "l")
    copied = C.heavy_join(members.select("id", "c"), lists.where("n is not null"), "c", "n").select("id", F.filter("l", lambda x: x["other"] != F.col("id")).alias("l"))
    each = alone.unionByName(copied)
    return each.select("id", F.posexplode(F.slice("l", 1, k)).alias("rank", "x")).select("id", F.col("x.other").alias("other"), F.col("x.s").alias("similarity"), (F.col("rank") + 1).alias("rank"))
