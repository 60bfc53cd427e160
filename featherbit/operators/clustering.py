"""k-medoids and DBSCAN over unit vectors, and soft assignment. Rows are (i BIGINT, v ARRAY<DOUBLE>), already normalised."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planning import cut, numbered, ship
from ..functions.scalars import dot, normalised
from .similarity import extremes, neighbourhoods, top_k


def unit_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("i"), normalised(F.col(vec)).alias("v"))


def assign(rows: DataFrame, medoids: DataFrame) -> DataFrame:
    """rows, medoids(cluster, v) to (i, cluster, sim): the most similar medoid, ties to the smaller cluster."""
    best = extremes(rows, medoids.select(F.col("cluster").cast("bigint").alias("j"), "v"))
    return best.select("i", F.col("nearest").alias("cluster"), F.col("nearest_sim").alias("sim"))


def update(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, i, total): the member with the greatest total similarity to its cluster, ties to the smaller i.

    The total is the product with the sum of the cluster's vectors: linear in the rows instead of quadratic per cluster.
    """
    members = rows.join(assigned.select("i", "cluster"), "i")
    parts = members.select("cluster", F.posexplode("v").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("s"))
    total = F.round(dot(F.col("v"), F.col("s")), 9)
    scored = members.join(sums, "cluster").select("cluster", "i", total.alias("total"))
    return scored.groupBy("cluster").agg(F.min_by("i", F.struct(-F.col("total"), "i")).alias("i"), F.max("total").alias("total"))


def choose(weights: DataFrame, r: float) -> DataFrame:
    """weights(i, w) to the first i whose cumulative share reaches r.

    The sums of 1,024 ranges of i come first, then only the range that r falls into is summed row by row. Ids may lie anywhere
    in 64 bits: ranges are told apart in floating point, which keeps their order.
    """
    edge = weights.agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.sum("w").alias("all")).first()
    if not edge["all"]:
        return weights.select("i").limit(0)
    step = (edge["hi"] - edge["lo"]) / 1024 + 1
    part = weights.withColumn("p", F.floor((F.col("i").cast("double") - F.lit(float(edge["lo"]))) / F.lit(step)))
    at, chosen = 0.0, None
    for p in part.groupBy("p").agg(F.sum("w").alias("w")).orderBy("p").collect():
        chosen = p["p"]
        if (at + p["w"]) / edge["all"] >= r:
            break
        at += p["w"]
    run = F.sum("w").over(Window.partitionBy("p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(at)
    inside = part.where(F.col("p") == chosen).withColumn("c", run / F.lit(edge["all"]))
    return inside.agg(F.coalesce(F.min(F.when(F.col("c") >= r, F.col("i"))), F.max("i")).alias("i"))


def seeds(rows: DataFrame, k: int, seed: int = 0, rounds: int = 8) -> list[int]:
    """First uniform, then in proportion to 1 minus the greatest similarity to those chosen; never one chosen before.

    Up to rounds + 1 seeds are drawn one by one; more are drawn several per round from the weights of its start (a weighted
    sample without replacement: the least of -log(u) / w, u by hash), so any k takes ``rounds`` passes.
    """
    rng = np.random.default_rng(seed)
    ship(rows.sparkSession)
    chosen = [choose(rows.select("i", F.lit(1.0).alias("w")), rng.random()).first()["i"]]
    nearest, per = rows.select("i", "v", F.lit(-1.0).alias("near")), math.ceil((k - 1) / rounds)
    fresh = chosen
    while len(chosen) < k:
        new = np.stack([np.asarray(r["v"], dtype=np.float64) for r in rows.where(F.col("i").isin(fresh)).select("v").collect()])  # at most `per` rows

        def update(frames: Iterator[pd.DataFrame], new: np.ndarray = new) -> Iterator[pd.DataFrame]:
            for f in frames:
                s = (np.stack(f["v"].to_numpy()) @ new.T).max(1) if len(f) else np.zeros(0)
                yield f.assign(near=np.maximum(f["near"].to_numpy(), np.round(s, 9)))

        nearest = cut(nearest.mapInPandas(update, "i bigint, v array<double>, near double"))
        weight = F.when(F.col("i").isin(chosen), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("near")))
        left = nearest.select("i", weight.alias("w")).where("w > 0")
        if per <= 1:
            pick = choose(left, rng.random()).first()
            fresh = [] if pick is None or pick["i"] is None else [pick["i"]]
        else:
            u = (F.pmod(F.xxhash64("i", F.lit(int(rng.integers(1 << 62)))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            fresh = [r["i"] for r in left.orderBy(-F.log(u) / F.col("w"), "i").limit(min(per, k - len(chosen))).collect()]
        if not fresh:
            break
        chosen = chosen + fresh
    return chosen


def _medoids(rows: DataFrame, ids: list[int]) -> DataFrame:
    """(cluster, v) of the rows with these ids, numbered as listed: a table of one row per cluster."""
    number = rows.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "i bigint, cluster bigint")
    return cut(rows.join(F.broadcast(number), "i").select("cluster", "v"))


def k_medoids(rows: DataFrame, k: int, n_closest: int = 1, seed: int = 0, rounds: int = 200, start: list[int] | None = None) -> DataFrame:
    """(i, cluster, sim, rank): the n_closest clusters of each row. k over the rows means one per row.

    Ends when no row changes its cluster, and raises if that isn't so after ``rounds``. A cluster that lost all members takes the
    row least similar to its own medoid. ``start`` names the first medoids instead of drawing them.
    """
    if k < 1 or n_closest < 1:
        raise ValueError("k and n_closest must be 1 or more")
    rows = cut(rows)
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "i bigint, cluster bigint, sim double, rank int")
    ids = start or seeds(rows, min(k, rows.count()), seed)
    before = None
    for _ in range(rounds):
        medoids = _medoids(rows, ids)
        now = cut(assign(rows, medoids))
        if before is not None and now.join(before.select("i", F.col("cluster").alias("was")), "i").where("cluster <> was").isEmpty():
            return top_k(rows, medoids.select(F.col("cluster").alias("j"), "v"), n_closest).withColumnRenamed("j", "cluster")
        before = now
        best = {r["cluster"]: r["i"] for r in update(rows, now).collect()}  # k rows
        empty = [c for c in range(len(ids)) if c not in best]
        far = [r["i"] for r in now.orderBy("sim", "i").limit(len(empty) + len(ids)).collect() if r["i"] not in best.values()] if empty else []
        ids = [best.get(c) if c in best else far.pop(0) if far else ids[c] for c in range(len(ids))]
    raise RuntimeError(f"clusters still change after {rounds} rounds")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(i, j) in both directions, each node with itself, to (i, label): the smallest node of the component."""
    edges = cut(edges.select("i", "j").distinct())
    labels = cut(edges.groupBy("i").agg(F.min("j").alias("label")))
    for _ in range(max_rounds):
        met = edges.join(labels.select(F.col("i").alias("j"), "label"), "j").groupBy("i").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("i").alias("near"), F.col("label").alias("far"))
        moved = cut(labels.join(met, "i").join(jump, "near", "left").select("i", "label", F.least("label", "near", "far").alias("new")))
        if moved.where("new <> label").isEmpty():
            return labels
        labels = moved.select("i", F.col("new").alias("label"))
    raise RuntimeError("labels did not settle")


def _checked(min_pts: int, eps: float, n_closest: int) -> None:
    if min_pts < 1 or n_closest < 1 or not 0 < eps < 1:
        raise ValueError("min_pts and n_closest must be 1 or more, eps between 0 and 1")


def dbscan_labels(near: DataFrame, min_pts: int) -> DataFrame:
    """near(i, j, sim), each point with itself, to (i, cluster): from 1 by lowest core index, -1 for noise."""
    core = cut(near.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= min_pts).select("i"))
    linked = near.join(core, "i").join(core.select(F.col("i").alias("j")), "j").select("i", "j")
    labels = components(linked)
    number = numbered(labels.select("label").distinct(), "label", "cluster").withColumn("cluster", F.col("cluster") + 1)
    cores = cut(labels.join(number, "label").select("i", "cluster"))
    reached = near.join(cores.select(F.col("i").alias("j"), "cluster"), "j").groupBy("i").agg(F.min("cluster").alias("cluster"))
    points = near.select("i").distinct()
    own = points.join(cores, "i", "left").join(reached.withColumnRenamed("cluster", "border"), "i", "left")
    return own.select("i", F.coalesce("cluster", "border", F.lit(-1)).cast("int").alias("cluster"))


def soft_clusters(near: DataFrame, labels: DataFrame, n_closest: int) -> DataFrame:
    """(i, cluster, sim, rank): the own cluster first with similarity 1, then others by their most similar member."""
    own = labels.where("cluster > 0").select("i", "cluster", F.lit(1.0).alias("sim"), F.lit(True).alias("own"))
    others = near.join(labels.where("cluster > 0").select(F.col("i").alias("j"), "cluster"), "j").groupBy("i", "cluster").agg(F.max("sim").alias("sim"))
    others = others.join(own.select("i", "cluster"), ["i", "cluster"], "left_anti").withColumn("own", F.lit(False))
    by = Window.partitionBy("i").orderBy(F.desc("own"), F.desc("sim"), "cluster")
    return own.unionByName(others).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n_closest).drop("own")


def dbscan(rows: DataFrame, min_pts: int, eps: float, n_closest: int = 1) -> DataFrame:
    """(i, cluster, sim, rank); noise near no cluster has no row."""
    _checked(min_pts, eps, n_closest)
    near = cut(neighbourhoods(rows, eps))
    return soft_clusters(near, cut(dbscan_labels(near, min_pts)), n_closest)


#: Algorithms by name; each takes the rows and its own arguments.
ALGORITHMS = {"k-medoids": k_medoids, "dbscan": dbscan}


def create(rows: DataFrame, algorithm: str, *args: float) -> DataFrame:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return ALGORITHMS[algorithm](rows, *args)


def filter_words(vectors: DataFrame, words: DataFrame, word: str = "word") -> DataFrame:
    """Only the vectors of the listed words."""
    return vectors.join(words.select(word).distinct(), word, "left_semi")


def words_to_clusters(tokens: DataFrame, words: DataFrame, clusters: DataFrame, n_closest: int = 1) -> DataFrame:
    """tokens(word, ...), words(id, word), clusters(i, cluster, sim, rank) to the tokens' other columns with cluster and sim: each
    known word is replaced by its ``n_closest`` clusters; words without vector or cluster are left out."""
    of = words.select("word", F.col("id").alias("i")).join(clusters.where(F.col("rank") <= n_closest).select("i", "cluster", "sim"), "i")
    return tokens.join(of.select("word", "cluster", "sim"), "word").drop("word")


def early_stop(values: list[float], eps: float, least: int = 10) -> int | None:
    """After how many values the mean of the last five differs by under eps from that of the five before."""
    for n in range(least, len(values) + 1):
        if math.fabs(np.mean(values[n - 5 : n]) - np.mean(values[n - 10 : n - 5])) < eps:
            return n
    return None


def early_stops(df: DataFrame, group: str, order: list[str], value: str, eps: float) -> DataFrame:
    """(group, n): the same for a series per group; null where it never stops."""
    w = Window.partitionBy(group).orderBy(*order)
    mean = lambda a, b: F.avg(value).over(w.rowsBetween(a, b))
    steps = df.select(group, F.row_number().over(w).alias("n"), F.abs(mean(-4, 0) - mean(-9, -5)).alias("d"))
    return steps.groupBy(group).agg(F.min(F.when((F.col("n") >= 10) & (F.col("d") < eps), F.col("n"))).cast("bigint").alias("n"))


