"""Problem 1: clusters of mutually similar vectors, described by size and most typical members.

1. Approximate nearest-neighbour graph by neighbour descent. The start is a forest: in each of ``trees`` passes every vector
   goes to the nearest of some pivots (drawn by hash, so they lie densest where the vectors do and a hot region falls into
   many cells), and a cell's vectors are compared with one another. Then descent rounds: the neighbours of each vector,
   forward and backward, are compared with one another, and everybody keeps the ``k`` best met so far; pairs of two old
   neighbours are not tried again. Rounds end when hardly any list changes. Similarities are in double precision throughout.
2. Links are the edges with at least ``least``. Modularity-based community detection on them: from labels spread over two
   steps, vectors move to the neighbouring community with the greatest gain in modularity, half of them (by hash) per round;
   then communities move as a whole, level by level, as long as modularity rises.
3. Lists of ``k`` hold neither all links of a dense region nor, being approximate, surely those they could. So an exact pass
   compares all directions in pairs of blocks (``whole``), leaving out only what the triangle inequality rules out, and gives
   the links between clusters, one per pair of them, and each vector's weighted degree over all links in its community.
4. In the report the cluster that a community is part of is found by joining communities over their borders (minimum labels
   over the contracted graph), first those of the lists, then all. Communities are described by size and by their members of
   highest internal weighted degree. Modularity itself sees the links of the lists only.

The rows of p1_found are connectivity by definition and need none of this: ``cluster_members`` makes one exact pass over all
pairs (see ``pairs``), which moves no vectors. What its tasks find is joined in one task that holds 16 bytes per linked direction.

Cells over four times their intended size are split by random planes through their pivot, so near vectors mostly stay together
whatever the number of vectors; what is still over eight times the size (vectors all alike) is split by hash, differently in
each tree. No task holds an unbounded group; descent connects the parts. Neighbours taken backward are limited to ``k`` by hash, as the method has it: a vector's own list
is kept whole, and what one round misses the next may find. Copies of one direction are one vector (see ``vectors``).

Defined results: unusable vectors take no part; a cluster of copies only counts with all its rows; ties in typicality go to the
smaller id; an empty table, or one without links, gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import groups, pairs
from . import vectors as V
from .neighbours import unit_rows

CELL, PIVOTS = 700, 1024
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 16, 1024, 16384
LIST = "array<struct<d: double, o: bigint>>"


def _best(df: DataFrame, k: int, parts: int = 1) -> DataFrame:
    """(c, l) with several lists per c to one list of the k nearest each. With ``parts`` lists are joined within each part p
    first, so that a vector which stands in very many lists (a hub) never has them all in one place."""
    for by in (["c", "p"], ["c"]) if parts > 1 else (["c"],):
        every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("l"))))
        df = df.groupBy(*by).agg(F.slice(every, 1, k).alias("l"))
    return df.select("c", "l")


def _lists(a: np.ndarray, o: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    """The k most similar distinct o of each a, as sorted lists of (distance, o)."""
    d = np.round(1.0 - s, 9)
    order = np.lexsort((o, d, a))
    a, o, d = a[order], o[order], d[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1]) | (d[1:] != d[:-1])
    a, o, d = a[fresh], o[fresh], d[fresh]
    top = np.arange(len(a)) - np.searchsorted(a, a) < k
    a, o, d = a[top], o[top], d[top]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=int)
    pairs = [{"d": x, "o": y} for x, y in zip(d.tolist(), o.tolist(), strict=True)]
    ends = np.r_[first[1:], len(a)]
    return pd.DataFrame({"c": a[first].astype("int64"), "l": [pairs[i:j] for i, j in zip(first, ends, strict=True)]})


def forest(dirs: DataFrame, total: int, k: int, trees: int) -> DataFrame:
    """(c, l): the nearest vectors met in any cell."""
    spark = dirs.sparkSession
    n = int(min(PIVOTS, max(1, total // CELL)))
    drawn = []
    for t in range(trees):  # trees * 1,024 vectors at most
        drawn.append(unit_rows([r["v"] for r in dirs.orderBy(F.xxhash64("c", F.lit(t)), "c").limit(n).select("v").collect()]))
    pivots = np.stack(drawn).astype(np.float32)

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = unit_rows(f["v"]).astype(np.float32)
            for t in range(trees):
                yield pd.DataFrame({"c": f["c"], "v": f["v"], "t": t, "cell": (x @ pivots[t].T).argmax(1)})

    at = dirs.select("c", "v").mapInPandas(cells, "c bigint, v array<float>, t int, cell int")
    sizes = at.groupBy("t", "cell").agg(F.count("*").alias("n"))
    depth = F.when(F.col("n") > 4 * CELL, F.ceil(F.log2(F.col("n") / (2 * CELL)))).otherwise(0)
    deep = F.broadcast(sizes.select("t", "cell", F.least(depth, F.lit(30)).cast("int").alias("depth")))  # trees * 1,024 rows at most
    planes = np.random.default_rng(11).standard_normal((trees, pivots.shape[2], 30)).astype(np.float32)

    def halves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            part = np.zeros(len(f), dtype=np.int64)
            rows = np.flatnonzero(f["depth"].to_numpy())
            if len(rows):
                t, cell, d = (f[x].to_numpy()[rows] for x in ("t", "cell", "depth"))
                off = unit_rows(f["v"].iloc[rows]).astype(np.float32) - pivots[t, cell]
                bits = np.einsum("ij,ijk->ik", off, planes[t]) > 0
                part[rows] = (bits & (np.arange(30)[None, :] < d[:, None])) @ (1 << np.arange(30, dtype=np.int64))
            yield f.drop(columns="depth").assign(part=part)

    at = at.join(deep, ["t", "cell"]).mapInPandas(halves, "c bigint, v array<float>, t int, cell int, part bigint")
    left = at.groupBy("t", "cell", "part").agg(F.count("*").alias("n")).where(F.col("n") > 8 * CELL)  # vectors / 5,600 * trees rows at most
    at = at.join(left, ["t", "cell", "part"], "left").withColumn("piece", F.pmod(F.xxhash64("c", "t"), F.ceil(F.coalesce("n", F.lit(1)) / (4 * CELL)))).drop("n")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        x, ids = unit_rows(f["v"]), f["c"].to_numpy()
        take = min(k, len(ids) - 1)
        if take < 1:
            return pd.DataFrame({"c": pd.Series(dtype="int64"), "l": pd.Series(dtype="object")})
        s = x @ x.T
        np.fill_diagonal(s, -2)
        near = np.argpartition(-s, take - 1, axis=1)[:, :take]
        a = np.repeat(ids, take)
        return _lists(a, ids[near].ravel(), np.take_along_axis(s, near, 1).ravel(), k)

    return _best(at.groupBy("t", "cell", "part", "piece").applyInPandas(compare, f"c bigint, l {LIST}"), k)


def descend(dirs: DataFrame, graph: DataFrame, old: DataFrame | None, total: int, k: int) -> DataFrame:
    """One round: (c, l) after everybody's neighbours have met."""
    edges = graph.select("c", F.explode("l").alias("x")).select(F.col("c").alias("u"), F.col("x.o").alias("w"))
    if old is None:
        edges = edges.withColumn("new", F.lit(True))
    else:
        before = old.select(F.col("c").alias("u"), F.explode("l").alias("x")).select("u", F.col("x.o").alias("w"), F.lit(1).alias("had"))
        edges = edges.join(before, ["u", "w"], "left").select("u", "w", F.col("had").isNull().alias("new"))
    edges = C.cut(edges)
    back = Window.partitionBy("w").orderBy(F.desc("new"), F.xxhash64("u", "w"))
    backward = edges.withColumn("r", F.row_number().over(back)).where(F.col("r") <= k).select(F.col("w").alias("u"), F.col("u").alias("w"), "new")
    around = edges.unionByName(backward).groupBy("u", "w").agg(F.max("new").alias("new"))
    full = around.join(dirs.select(F.col("c").alias("w"), "v"), "w")
    blocks = max(1, total // 400)
    parts = int(np.ceil(np.sqrt(blocks)))
    full = full.withColumn("b", F.pmod(F.xxhash64("u"), F.lit(blocks)))

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["u", "w"], kind="stable", ignore_index=True)
        x, w, new, u = unit_rows(f["v"]), f["w"].to_numpy(), f["new"].to_numpy(bool), f["u"].to_numpy()
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        n = np.diff(np.r_[first, len(u)])
        out = []
        for g in range(0, len(first), 64):  # 64 vectors' surroundings at once, padded to one width
            s0, m0 = first[g : g + 64], n[g : g + 64]
            at = np.minimum(s0[:, None] + np.arange(m0.max())[None, :], len(u) - 1)
            real = np.arange(m0.max())[None, :] < m0[:, None]
            s = np.matmul(x[at], x[at].transpose(0, 2, 1))
            tried = real[:, :, None] & real[:, None, :] & (new[at][:, :, None] | new[at][:, None, :])
            s[~tried] = -2
            np.einsum("gii->gi", s)[:] = -2
            take = min(k, s.shape[2])
            near = np.argpartition(-s, take - 1, axis=2)[:, :, :take]
            v = np.take_along_axis(s, near, 2)
            a = np.broadcast_to(w[at][:, :, None], v.shape)
            o = np.take_along_axis(np.broadcast_to(w[at][:, None, :], s.shape), near, 2)
            fine = v > 0
            out.append((a[fine], o[fine], v[fine]))
        a, o, s = (np.concatenate(y) for y in zip(*out, strict=True))
        return _lists(a, o, s, k).assign(p=int(f["b"].iloc[0]) % parts)

    met = full.groupBy("b").applyInPandas(meet, f"c bigint, l {LIST}, p int")
    return _best(graph.withColumn("p", F.lit(0)).unionByName(met), k, parts)


def neighbour_graph(dirs: DataFrame, k: int = 12, trees: int = 8, rounds: int = 5, settled: float = 0.005) -> DataFrame:
    """(c, l): neighbour lists, cut."""
    total = dirs.count()
    if total < 2:
        return dirs.sparkSession.createDataFrame([], f"c bigint, l {LIST}")
    graph, old = C.cut(forest(dirs, total, k, trees)), None
    for _ in range(rounds):
        better = C.cut(descend(dirs, graph, old, total, k))
        was = graph.select("c", F.col("l.o").alias("was"))
        changed = better.join(was, "c", "left").agg(F.sum(F.size(F.array_except("l.o", F.coalesce("was", F.array().cast("array<bigint>")))))).first()[0] or 0
        graph, old = better, graph
        if changed < settled * k * total:
            break
    return graph


def _moved(both: DataFrame, state: DataFrame, whole: float, rounds: int) -> DataFrame:
    """both(c, o, w) in both directions and without loops, state(c, k, m) of degrees and labels, to the labels after moves: in
    each round half of the vertices, by hash, go to the neighbouring community with the greatest gain in modularity."""
    for r in range(rounds):
        totals = state.groupBy("m").agg(F.sum("k").alias("tot"))
        to = both.join(state.select(F.col("c").alias("o"), "m"), "o").groupBy("c", "m").agg(F.sum("w").alias("w"))
        mine = state.select("c", "k", F.col("m").alias("own"))
        options = to.join(mine, "c").join(totals, "m")
        inside = F.when(F.col("m") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * (F.col("tot") - inside) / whole, 9)
        best = options.withColumn("gain", gain).groupBy("c").agg(F.max(F.struct("gain", -F.col("m"))).alias("x"), F.max(F.when(F.col("m") == F.col("own"), F.col("gain"))).alias("stay"))
        turn = F.pmod(F.xxhash64("c", F.lit(r)), F.lit(2)) == 0
        better = turn & (F.col("x.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-9)
        moved = C.cut(state.join(best, "c", "left").select("c", "k", "m", F.when(better, -F.col("x.col2")).otherwise(F.col("m")).alias("to")))
        steps = moved.where("m <> to").count()
        state = moved.select("c", "k", F.col("to").alias("m"))
        if not steps and r:
            break
    return state


def communities(links: DataFrame, rounds: int = 6, levels: int = 1, least_gain: float = 1e-3) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """links(a, b, w), each once, to (c, m), the community of every linked vector by modularity, and (level, number of
    communities, modularity) of every level.

    The first level begins with labels spread over two steps. Each further one takes the communities as vertices, with their
    inner weight as loops, and begins with each alone; levels end when modularity rises by less than ``least_gain``. The number
    of a community is some vertex of it.
    """
    both = C.cut(links.select(F.col("a").alias("c"), F.col("b").alias("o"), "w").unionByName(links.select(F.col("b").alias("c"), F.col("a").alias("o"), "w")))
    degree = C.cut(both.groupBy("c").agg(F.sum("w").alias("k"), F.least(F.min("o"), F.first("c")).alias("m")))
    whole = degree.agg(F.sum("k")).first()[0] or 0.0
    if not whole:
        return degree.select("c", "m"), []
    near = both.join(degree.select(F.col("c").alias("o"), "m"), "o").groupBy("c").agg(F.min("m").alias("mm"))
    state = C.cut(degree.join(near, "c").select("c", "k", F.least("m", "mm").alias("m")))
    loops, found, said = None, None, []
    for level in range(1, levels + 1):
        state = _moved(both, state, whole, rounds)
        side = lambda x: state.select(F.col("c").alias(x), F.col("m").alias(f"m{x}"))  # noqa: E731, B023
        joined = C.cut(both.join(side("c"), "c").join(side("o"), "o").groupBy("mc", "mo").agg(F.sum("w").alias("w")))
        own = joined.where("mc = mo").select(F.col("mc").alias("c"), F.col("w").alias("inner"))
        if loops is not None:  # of the vertices, on to their communities
            own = own.unionByName(loops.join(state, "c").select(F.col("m").alias("c"), "inner"))
        own = C.cut(own.groupBy("c").agg(F.sum("inner").alias("inner")))
        merged = C.cut(state.groupBy(F.col("m").alias("c")).agg(F.sum("k").alias("k")))
        q = merged.join(own, "c", "left").agg(F.sum(F.coalesce("inner", F.lit(0.0)) / whole - (F.col("k") / whole) * (F.col("k") / whole)), F.count("*")).first()
        if said and q[0] < said[-1][2] + least_gain:
            break
        said.append((level, q[1], float(q[0])))
        if found is None:
            found = state.select("c", "m")
        else:
            found = found.select("c", F.col("m").alias("v")).join(state.select(F.col("c").alias("v"), "m"), "v").select("c", "m")
        both, loops = joined.where("mc <> mo").select(F.col("mc").alias("c"), F.col("mo").alias("o"), "w"), own
        state = merged.select("c", "k", F.col("c").alias("m"))
    return C.cut(found), said


def whole(dirs: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """dirs(c, v), found(c, n, m, label) to (a, b, w), of all pairs with at least ``least``: the labels a < b that a link joins,
    with w null, and sums w by the vector a of its links inside its community m, with b null. Copies n count as often.

    Blocks are cells around pivots, large ones split by hash. A vector meets a block unless its angle to the block's pivot is
    further from those of the block's vectors than linked vectors can be apart.
    """
    total = dirs.count()
    most = min(MOST_BLOCK, max(LEAST_BLOCK, total // BLOCKS))
    drawn = dirs.orderBy(F.xxhash64("c", F.lit(-1)), "c").limit(min(PIVOTS, max(1, total // most))).select("v").collect()
    if not drawn:
        return dirs.sparkSession.createDataFrame([], "a bigint, b bigint, w double")
    pivots, reach = unit_rows([r["v"] for r in drawn]), float(np.arccos(np.clip(least, -1, 1))) + 1e-6
    angles = lambda v: np.arccos(np.clip(unit_rows(v) @ pivots.T, -1, 1))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = angles(f["v"])
            yield f.assign(cell=x.argmin(1), angle=x.min(1))

    at = C.cut(dirs.select("c", "v").join(found.select("c", "n", "m", "label"), "c").mapInPandas(cells, "c bigint, v array<float>, n bigint, m bigint, label bigint, cell int, angle double"))
    parts = F.broadcast(at.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts")))  # 1,024 rows at most
    at = C.cut(at.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts"))).drop("parts"))
    blocks = at.groupBy("cell", "part").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi")).orderBy("cell", "part").collect()  # vectors / most + 1,024 rows at most
    number = {(r["cell"], r["part"]): i for i, r in enumerate(blocks)}
    cell = np.array([r["cell"] for r in blocks])
    lo, hi = np.array([r["lo"] for r in blocks]) - reach, np.array([r["hi"] for r in blocks]) + reach

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = np.array([number[x] for x in zip(f["cell"], f["part"], strict=True)], dtype=int)
            x = angles(f["v"])[:, cell]
            meets = (x >= lo) & (x <= hi)
            f = f[["c", "v", "n", "m", "label"]].assign(own=own)
            for j in range(len(lo)):
                if (go := meets[:, j] | (own == j)).any():
                    yield f[go].assign(p=np.minimum(own[go], j), q=np.maximum(own[go], j))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        p, q = int(f["p"].iloc[0]), int(f["q"].iloc[0])
        left, right = f[f["own"] == p], f[f["own"] == q]
        across, inside = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(len(left)), np.zeros(len(right))]
        if len(left) and len(right):
            x, y = unit_rows(left["v"]), unit_rows(right["v"])
            (c, n, m, t), (d, k, o, u) = (z[["c", "n", "m", "label"]].to_numpy(dtype=np.int64).T for z in (left, right))
            for g in range(0, len(x), 512):
                s = x[g : g + 512] @ y.T
                i, j = np.nonzero(s >= least - 1e-8)
                w, i = np.round(s[i, j], 9), i + g
                real = (w >= least) & ((c[i] < d[j]) | (p != q))
                i, j, w = i[real], j[real], w[real]
                same = m[i] == o[j]
                inside[0] += np.bincount(i[same], w[same] * k[j[same]], len(x))
                inside[1] += np.bincount(j[same], w[same] * n[i[same]], len(y))
                i, j = i[t[i] != u[j]], j[t[i] != u[j]]
                across.append(np.unique(np.stack([np.minimum(t[i], u[j]), np.maximum(t[i], u[j])], 1), axis=0))
        pairs = np.unique(np.concatenate(across), axis=0)
        ids, sums = np.concatenate([left["c"], right["c"]]), np.concatenate(inside)
        ids, sums = ids[sums > 0], sums[sums > 0]
        return pd.DataFrame({
            "a": pd.Series(np.r_[pairs[:, 0], ids], dtype="int64"),
            "b": pd.array([*pairs[:, 1].tolist(), *[None] * len(ids)], dtype="Int64"),
            "w": pd.array([*[None] * len(pairs), *sums.tolist()], dtype="Float64"),
        })

    sent = at.mapInPandas(send, "c bigint, v array<float>, n bigint, m bigint, label bigint, own int, p int, q int")
    return C.cut(sent.groupBy("p", "q").applyInPandas(compare, "a bigint, b bigint, w double"))


def _joined(found: DataFrame, label: str, across: DataFrame) -> DataFrame:
    """found with ``label`` replaced by the smallest one that pairs across(a, b) of labels connect it with."""
    touching = C.cut(across.select(F.explode(F.array("a", "b")).alias("a"), F.xxhash64("a", "b").alias("k")))
    joined = groups.entity_labels(touching).select(F.col("a").alias(label), F.col("label").alias("_to"))
    return found.join(joined, label, "left").select("c", "n", "m", F.coalesce("_to", label).alias("label"))


def similar_links(dirs: DataFrame, least: float, k: int, trees: int) -> DataFrame:
    """(a, b, w), a < b: links of the neighbour lists, cut."""
    edges = neighbour_graph(dirs, k, trees).select("c", F.explode("l").alias("x")).where(F.col("x.d") <= 1 - least)
    return C.cut(edges.select(F.least("c", "x.o").alias("a"), F.greatest("c", "x.o").alias("b"), F.round(1 - F.col("x.d"), 9).alias("w")).distinct())


def similarity_clusters(rows: DataFrame, least: float = 0.8, k: int = 12, trees: int = 8, levels: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(id, v) usable. Gives (id, c) of all, (c, w) of links inside communities, and (c, n, m, cluster, size) of every direction."""
    C.ship(rows.sparkSession)
    dirs, members = V.directions(rows)
    links = similar_links(dirs, least, k, trees)
    found = C.cut(dirs.select("c", "n").join(communities(links, levels=levels)[0], "c", "left").select("c", "n", F.coalesce("m", "c").alias("m")))
    side = lambda x: found.select(F.col("c").alias(x), F.col("m").alias(f"m{x}"))
    across = links.join(side("a"), "a").join(side("b"), "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
    named = C.cut(_joined(found, "m", across))
    rest = whole(dirs, named, least)
    named = _joined(named, "label", rest.where("b is not null").select("a", "b").distinct())
    inner = rest.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("w").alias("w"))
    firsts = named.groupBy("label").agg(F.min("c").alias("cluster"), F.sum("n").alias("size"))
    return members, inner, C.cut(named.join(firsts, "label").select("c", "n", "m", "cluster", "size"))


def cluster_members(rows: DataFrame, least: float = 0.8, smallest: int = 3) -> DataFrame:
    """(cluster_id, id) of the clusters with at least ``smallest`` members. They are connectivity by definition: an exact pass
    over all pairs gives what connects them, without a neighbour graph or communities."""
    C.ship(rows.sparkSession)
    dirs, members, groups, total = V.distinct(rows)
    labels = pairs.joined(pairs.meet(pairs.blocks(dirs, total), lambda: pairs.Links(least), "a bigint, b bigint"))
    every = labels.join(groups.select("c", "n"), "c", "full").select("c", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("label", "c").alias("label"))
    kept = every.groupBy("label").agg(F.min("c").alias("cluster"), F.sum("n").alias("size")).where(F.col("size") >= smallest)
    found = C.cut(C.heavy_join(every, C.cut(kept), "label", "size").select("c", "n", "cluster"))
    alone = found.where("n = 1").select(F.col("cluster").alias("cluster_id"), F.col("c").alias("id"))
    return alone.unionByName(C.heavy_join(members.select("id", "c"), found.where("n > 1"), "c", "n").select(F.col("cluster").alias("cluster_id"), "id"))


def community_quality(rows: DataFrame, least: float = 0.8, k: int = 12, trees: int = 8, levels: int = 4) -> DataFrame:
    """(level, communities, modularity) of the community detection, level by level."""
    C.ship(rows.sparkSession)
    said = communities(similar_links(V.directions(rows)[0], least, k, trees), levels=levels)[1]
    return rows.sparkSession.createDataFrame([(n, m, round(q, 6)) for n, m, q in said], "level int, communities bigint, modularity double")


def cluster_report(rows: DataFrame, least: float = 0.8, typical: int = 5, levels: int = 4, smallest: int = 2) -> DataFrame:
    """(community_id, cluster_id, size, typical ARRAY<BIGINT>): the cluster it is part of, and ids of highest internal weighted degree, of communities of ``smallest`` or more rows.

    A copy counts as a link of 1, so copies of one direction are typical by their number.
    """
    _, inside, found = similarity_clusters(rows, least, levels=levels)
    scored = found.join(inside, "c", "left").select("m", "c", "n", "cluster", (F.coalesce("w", F.lit(0.0)) + F.col("n") - 1).alias("w"))
    named = scored.groupBy("m").agg(F.min("c").alias("community_id"), F.min("cluster").alias("cluster_id"), F.sum("n").alias("size")).where(F.col("size") >= smallest)
    by = Window.partitionBy("m").orderBy(F.desc(F.round("w", 6)), "c")
    top = scored.withColumn("r", F.row_number().over(by)).where(F.col("r") <= typical)
    best = top.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c"))), lambda x: x["c"]).alias("typical"))
    return named.join(best, "m").select("community_id", "cluster_id", "size", "typical")
