"""Similarities of all rows with all rows, in blocks: top-k, neighbourhoods, nearest and furthest centres.

Both sides are cut into blocks by hash and each pair of blocks is compared in one task, by matrix products of 2,000 rows at a
time, so no task holds more than two blocks and nothing is broadcast. Blocks grow with the rows up to ``MOST``, since each row is
sent once per block of the other side. Only what is kept leaves a task: k rows per row and block pair, or the pairs over the
threshold. Neighbourhoods are symmetric: a pair of blocks is met once and gives both directions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planning import ship

BLOCK, MOST, ROWS = 4000, 40_000, 2000


_EMPTY = pd.DataFrame({"i": pd.Series(dtype="int64"), "j": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in v])


def _blocks(n: int, block: int) -> int:
    """Into how many blocks n rows go: of ``block`` rows, with many rows of up to ``MOST``."""
    return 1 + n // max(block, min(MOST, n // 32))


def _by_blocks(left: DataFrame, right: DataFrame, keep: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], block: int) -> DataFrame:
    """left(i, v), right(j, v) to (i, j, sim) of the cells that ``keep`` names in each block of similarities."""
    ship(left.sparkSession)
    nl, nr = (_blocks(df.count(), block) for df in (left, right))
    side = lambda df, key, own, n_own, other, n_other: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint"))))
    right = right.select("j", F.col("v").alias("w"))  # a name of its own: both sides may be one relation
    a, b = side(left.select("i", "v"), "i", "bi", nl, "bj", nr), side(right, "j", "bj", nr, "bi", nl)

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [_EMPTY]
        if len(x) and len(y):
            y = y.sort_values("j")
            ids, other, m = x["i"].to_numpy(), y["j"].to_numpy(), _matrix(y["w"]).T
            for at in range(0, len(x), ROWS):
                s = np.round(_matrix(x["v"].iloc[at : at + ROWS]) @ m, 9)
                r, c = keep(s)
                out.append(pd.DataFrame({"i": ids[at + r], "j": other[c], "sim": s[r, c]}))
        return pd.concat(out[1:] or out)

    return a.groupBy("bi", "bj").cogroup(b.groupBy("bi", "bj")).applyInPandas(product, "i bigint, j bigint, sim double")


def top_k(left: DataFrame, right: DataFrame, k: int, itself: bool = True, block: int = BLOCK) -> DataFrame:
    """(i, j, sim, rank): the k most similar j of each i; ties to the smaller j. k over the rows of ``right`` gives all."""
    spare = k + (0 if itself else 1)

    def keep(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.argsort(-s, axis=1, kind="stable")[:, :spare]
        return np.repeat(np.arange(len(s)), c.shape[1]), c.ravel()

    met = _by_blocks(left, right, keep, block)
    met = met if itself else met.where("i <> j")
    by = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def neighbourhoods(rows: DataFrame, eps: float, block: int = BLOCK) -> DataFrame:
    """rows(i, v) to (i, j, sim) of all pairs with at least ``eps``, each point with itself included."""
    ship(rows.sparkSession)
    n = _blocks(rows.count(), block)
    at = rows.select("i", "v").withColumn("own", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = at.select("i", "v", "own", F.least("own", "b").alias("p"), F.greatest("own", "b").alias("q"))

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        p, q = int(f["p"].iloc[0]), int(f["q"].iloc[0])
        x, y = f[f["own"] == p], f[f["own"] == q]
        out = [_EMPTY]
        if len(x) and len(y):
            ids, other, m = x["i"].to_numpy(), y["i"].to_numpy(), _matrix(y["v"]).T
            for k in range(0, len(x), ROWS):
                s = np.round(_matrix(x["v"].iloc[k : k + ROWS]) @ m, 9)
                r, c = np.nonzero(s >= eps)
                i, j, sim = ids[k + r], other[c], s[r, c]
                out.append(pd.DataFrame({"i": i, "j": j, "sim": sim}))
                if p != q:
                    out.append(pd.DataFrame({"i": j, "j": i, "sim": sim}))
        return pd.concat(out[1:] or out)

    return at.groupBy("p", "q").applyInPandas(meet, "i bigint, j bigint, sim double")


def extremes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, nearest, nearest_sim, furthest, furthest_sim) over ``right``; ties to the smaller j."""

    def keep(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.arange(len(s))
        return np.r_[r, r], np.r_[s.argmax(1), s.argmin(1)]

    met = _by_blocks(left, right, keep, BLOCK)
    return met.groupBy("i").agg(
        F.min_by("j", F.struct(-F.col("sim"), "j")).alias("nearest"), F.max("sim").alias("nearest_sim"),
        F.min_by("j", F.struct("sim", "j")).alias("furthest"), F.min("sim").alias("furthest_sim"),
    )
