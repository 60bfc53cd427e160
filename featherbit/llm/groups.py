"""Problem 3: splits that keep related records together.

Iterative minimum-label propagation over the bipartite graph of authors and anchor keys. Its edges are the distinct
(author, key) pairs, so a hot anchor or author is reduced before anything is shuffled, and every round moves minima only,
combined in each map task first. Each round ends with a pointer jump (an author takes the label of its label), so chains
shorten geometrically. Then groups are assigned to splits: the groups with over a thousandth of all rows (fewer than a
thousand) one by one on the driver, the largest first, each where the rows per split and stratum deviate least from the wanted
shares; all others by their place on a running sum within their stratum, cut where the splits have what the stratum lacks.

Defined results: null authors and empty or null anchors join nothing; group_id is the smallest author of the group; a
group without any author has a null group_id and is split as a unit of its own; repeated rows count once; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _hot(edges: DataFrame, by: str, total: int, share: int = 200) -> list[int]:
    """The nodes with over 1/share of all edges: fewer than ``share``."""
    return [r[by] for r in edges.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > max(total / share, 1000.0)).select(by).collect()]


def _over(edges: DataFrame, values: DataFrame, by: str, hot: list[int]) -> DataFrame:
    """edges joined to one value per node. Edges of hot nodes stay where they are: the values of those few are broadcast."""
    if not hot:
        return edges.join(values, by)
    is_hot = F.col(by).isin(hot)
    light = edges.where(~is_hot).join(values, by)
    return light.unionByName(edges.where(is_hot).join(F.broadcast(values.where(is_hot)), by).select(*light.columns))


def entity_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a BIGINT, k BIGINT), distinct and cut, to (a, label): label is the smallest a of the connected component.

    Raises if the labels still move after ``max_rounds``: with the pointer jump a component of diameter 2^30 would be needed.
    """
    total = edges.count()
    hot_a, hot_k = _hot(edges, "a", total), _hot(edges, "k", total)
    labels = C.cut(edges.groupBy("a").agg(F.min("a").alias("label")))
    for _ in range(max_rounds):
        by_key = _over(edges, labels, "a", hot_a).groupBy("k").agg(F.min("label").alias("kl"))
        by_author = _over(edges, by_key, "k", hot_k).groupBy("a").agg(F.min("kl").alias("al"))
        jump = labels.select(F.col("a").alias("j"), F.col("label").alias("jl"))
        met = labels.join(by_author, "a").select("a", "label", F.least("label", "al").alias("new"))
        moved = C.cut(met.join(jump, F.col("new") == F.col("j"), "left").select("a", "label", F.least("new", F.coalesce("jl", "new")).alias("new")))
        if moved.where("new <> label").isEmpty():
            return moved.select("a", F.col("new").alias("label"))
        labels = moved.select("a", F.col("new").alias("label"))
    raise RuntimeError("labels did not settle")


def related_groups(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """records(id, author, anchor) to (id, author, group_id, unit) and the columns to keep; unit names the group, never null.

    The key is carried as a 64-bit hash through the rounds; two keys share a hash with a chance of n^2 / 2^65.
    """
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(True)
    own = records.where(F.col("id").isNotNull()).select("id", "author", "anchor", kept.alias("keep"))
    key = F.col("key")
    rows = C.computed(own, "key", C.key_of(C.unmarked(F.col("anchor"))))
    rows = C.cut(rows.select("id", "author", "keep", F.when(key != "", F.xxhash64(key)).alias("k")))
    edges = C.cut(rows.where("author is not null and k is not null").select(F.col("author").alias("a"), "k").distinct())
    labels = entity_labels(edges)
    by_key = _over(edges, labels, "a", _hot(edges, "a", edges.count())).groupBy("k").agg(F.min("label").alias("group_id"))
    # rows with a key take the group of the key; the others that of their author, who is a group alone if without any key
    keyed, bare = rows.where("k is not null"), rows.where("k is null and author is not null")
    by_key = C.cut(keyed.groupBy("k").agg(F.count("*").alias("n")).join(by_key, "k", "left"))
    by_author = bare.groupBy(F.col("author").alias("a")).agg(F.count("*").alias("n")).join(labels, "a", "left")
    by_author = C.cut(by_author.select("a", "n", F.coalesce("label", "a").alias("group_id")))
    parts = [
        C.heavy_join(keyed, by_key, "k", "n"),
        C.heavy_join(bare.withColumn("a", F.col("author")), by_author, "a", "n"),
        rows.where("k is null and author is null").withColumn("group_id", F.lit(None).cast("bigint")),
    ]
    every = parts[0].select("id", "author", "keep", "k", "group_id")
    for p in parts[1:]:
        every = every.unionByName(p.select("id", "author", "keep", "k", "group_id"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    unit = F.when(F.col("group_id").isNotNull(), name("a", "group_id")).when(F.col("k").isNotNull(), name("k", "k")).otherwise(name("r", "id"))
    return every.select("id", "author", "group_id", unit.alias("unit"), *(["keep.*"] if keep else []))


def _place(units: list[tuple[str, np.ndarray]], share: np.ndarray, whole: np.ndarray) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """units of (name, rows per stratum), whole rows per stratum, to (name, split, rows) and the rows placed (splits x strata).

    The largest first, each where deviation grows least: that from the rows wanted in the end, per split and stratum and per
    split, which nothing takes back once there are too many; and, at a tenth, that from the wanted shares of what is placed yet.
    """
    want, have, met, out = np.outer(share, whole), np.zeros((len(share), len(whole))), np.zeros(len(whole)), []
    for name, rows in sorted(units, key=lambda u: (-u[1].sum(), u[0])):
        met = met + rows
        costs = []
        for s in range(len(share)):
            new = have.copy()
            new[s] += rows
            end = np.abs(new - want).sum() + np.abs(new.sum(1) - want.sum(1)).sum()
            costs.append((round(end + 0.1 * np.abs(new - np.outer(share, met)).sum(), 6), -share[s], s))
        s = min(costs)[2]
        have[s] += rows
        out.append((name, s, int(rows.sum())))
    return out, have


def _spread(lacks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of the ``sizes`` rows of each stratum go to each split (strata x splits), where ``lacks`` are wanted. A split that
    has too many of a stratum gets none of it; what others miss through that is made up in other strata, so that the splits'
    totals come right (proportional fitting)."""
    total = np.maximum(lacks.sum(0), 0)
    total *= sizes.sum() / max(total.sum(), 1e-12)
    x = np.maximum(lacks, 1e-6 * sizes[:, None])
    for _ in range(200):
        x = x * (total / np.maximum(x.sum(0), 1e-12))
        x = x * (sizes / np.maximum(x.sum(1), 1e-12))[:, None]
    return x


def _by_running_sum(units: DataFrame, need: dict[str, dict[str, float]], buckets: int) -> DataFrame:
    """units(unit, st, size) to (unit, st, split, size): in each stratum units stand in hash order, and the running sum of their
    sizes is cut so that the splits get what they need of it. A bucket of the hash is the unit of the sort, not a stratum."""
    spark = units.sparkSession
    units = units.withColumn("b", F.pmod(F.xxhash64("unit"), F.lit(buckets)))
    sums = units.groupBy("st", "b").agg(F.sum("size").alias("n")).orderBy("st", "b").collect()  # at most 65 x buckets rows
    run: dict[str, int] = {}
    starts = []
    for r in sums:
        starts.append((r["st"], r["b"], run.get(r["st"], 0)))
        run[r["st"]] = run.get(r["st"], 0) + r["n"]
    names = list(next(iter(need.values()), {}))
    cuts, carry = [], dict.fromkeys(names, 0.0)
    for st, n in sorted(run.items()):  # what rounding to whole rows took from a split is carried on to the next stratum
        at, left = 0.0, max(1e-9, sum(need[st].values()))
        for s in names:
            carry[s] += need[st][s] / left * n
            upto = at + round(carry[s])
            carry[s] -= round(carry[s])
            cuts.append((st, s, at, float(upto) if s != names[-1] else float("inf")))
            at = float(upto)
    if not starts:
        return spark.createDataFrame([], "unit string, st string, split string, size bigint")
    w = Window.partitionBy("st", "b").orderBy(F.xxhash64("unit", F.lit(7)), "unit").rowsBetween(Window.unboundedPreceding, 0)
    known = F.broadcast(spark.createDataFrame(starts, "st string, b bigint, start bigint"))
    at = units.join(known, ["st", "b"]).withColumn("mid", F.col("start") + F.sum("size").over(w) - F.col("size") / 2)
    cut = F.broadcast(spark.createDataFrame(cuts, "cst string, split string, lo double, hi double"))  # 65 x splits rows
    inside = (F.col("st") == F.col("cst")) & (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi"))
    return at.join(cut, inside).select("unit", "st", "split", "size")


def assign_splits(grouped: DataFrame, stratum: str, shares: dict[str, float] | None = None, buckets: int = 256) -> DataFrame:
    """grouped(unit, stratum, ...) to (unit, split, size): whole units, shares of rows as near as may be, strata spread evenly.

    A large unit counts with its rows in every stratum; the stratum of a small one is its commonest (ties: the greatest name).
    Strata beyond the 64 largest share one. One small unit in eight is kept back, to make up in each stratum for what whole units
    left uneven; one in 64 is placed last, over all strata at once, so that the splits' totals come right.
    """
    shares = shares or SHARES
    name = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    cells = C.cut(grouped.groupBy("unit", name.alias("st")).agg(F.count("*").alias("n")))
    top = [r["st"] for r in cells.groupBy("st").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "st").limit(64).collect()]
    cells = cells.withColumn("st", F.when(F.col("st").isin(top), F.col("st")).otherwise("~")) if top else cells
    units = C.cut(cells.groupBy("unit").agg(F.sum("n").alias("size"), F.max_by("st", F.struct("n", "st")).alias("st")))
    total = units.agg(F.sum("size")).first()[0] or 0
    small = units.where(F.col("size") <= total / 1000)
    of_large = cells.join(F.broadcast(units.where(F.col("size") > total / 1000).select("unit")), "unit")  # fewer than a thousand units
    strata = {st: k for k, st in enumerate([*top, "~"])}
    splits, share = list(shares), np.array(list(shares.values()), dtype=float)
    large: dict[str, np.ndarray] = {}
    for r in of_large.groupBy("unit", "st").agg(F.sum("n").alias("n")).collect():  # at most 65 rows of each
        large.setdefault(r["unit"], np.zeros(len(strata)))[strata[r["st"]]] += r["n"]
    h = F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(64))
    turn = F.when(h >= 8, 0).when(h > 0, 1).otherwise(2)
    sizes = np.zeros((3, len(strata)))
    for r in small.groupBy("st", turn.alias("turn")).agg(F.sum("size").alias("n")).collect():
        sizes[r["turn"], strata[r["st"]]] = r["n"]
    whole = sum(large.values(), np.zeros(len(strata))) + sizes.sum(0)
    placed, have = _place(list(large.items()), share / share.sum(), whole)
    out, lacks = [], np.outer(whole, share / share.sum()) - have.T
    for t in range(2):
        lacks = _spread(lacks, sizes[t:].sum(0))
        need = {st: dict(zip(splits, lacks[k].tolist(), strict=True)) for st, k in strata.items()}
        out.append(C.cut(_by_running_sum(small.where(turn == t), need, buckets)))
        for r in out[-1].groupBy("st", "split").agg(F.sum("size").alias("n")).collect():
            lacks[strata[r["st"]], splits.index(r["split"])] -= r["n"]
    need = {"": dict(zip(splits, np.maximum(lacks.sum(0), 0).tolist(), strict=True))}
    rest = _by_running_sum(small.where(turn == 2).withColumn("st", F.lit("")), need, buckets)
    fixed = grouped.sparkSession.createDataFrame([(u, splits[s], n) for u, s, n in placed], "unit string, split string, size bigint")
    return out[0].unionByName(out[1]).unionByName(rest).drop("st").unionByName(fixed)


def split_rows(grouped: DataFrame, stratum: str, shares: dict[str, float] | None = None) -> DataFrame:
    """grouped with a column ``split``; a unit with most of the rows is broadcast, not shuffled."""
    return C.heavy_join(grouped, C.cut(assign_splits(grouped, stratum, shares)), "unit", "size").drop("size")
