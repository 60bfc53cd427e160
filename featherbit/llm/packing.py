"""Problem 8: documents of varying length in containers of fixed capacity.

Optimal length buckets: the global histogram of lengths (at most ``capacity`` numbers, whatever the corpus) goes to the
driver, where dynamic programming chooses the bucket boundaries with the least padding. Token-budget batches are then formed
bucket by bucket, the longest first: a batch takes as many items of its bucket as its budget holds, and the budget left over
is offered, tightest first, to the shorter buckets. Batches of one make are kept as one run with a count, so the plan has a
few rows per bucket and not one per batch. Without the last step, batches of one bucket alone would leave almost half of
each container empty for documents of a little over half the capacity.

The items themselves never leave the executors. Each gets its rank within its bucket: buckets are split by a hash into
parts of about 50,000 items, parts are numbered by a prefix sum over their counts, and the rank decides run and container.

Defined results: a document without tokens (null or empty) takes no space and comes out with null container, place and
start; a document over the capacity is cut into pieces of just the capacity and one rest; repeated ids are items each; ties
go by hash, then id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

PART = 50_000


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets over distinct ascending lengths, with the least sum of (bound - length).

    The cost of one bucket satisfies the Monge inequality, so the best beginning of the last bucket never falls as the end
    rises: it is found for the middle end first, then for the halves left and right of it, all ends of one depth at once.
    That takes n log n steps per bucket and n numbers at a time, besides the beginnings kept.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths
    x = lengths.astype(float)
    c, s = np.concatenate([[0], np.cumsum(counts)]).astype(float), np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    best, back = x * c[1:] - s[1:], []  # with one bucket
    for _ in range(buckets - 1):
        before = np.concatenate([[0.0], best[:-1]])  # of what stands before a bucket that begins at i
        now, begin = np.empty(n), np.zeros(n, dtype=np.int32)
        lo, hi, least, most = np.array([0]), np.array([n - 1]), np.array([0]), np.array([n - 1])
        while len(lo):
            mid = (lo + hi) // 2
            first, size = least, np.minimum(most, mid) - least + 1
            start = np.cumsum(size) - size
            i = np.arange(size.sum()) - np.repeat(start - first, size)
            j = np.repeat(mid, size)
            cost = before[i] + x[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i])
            now[mid] = np.minimum.reduceat(cost, start)
            at = np.flatnonzero(cost == np.repeat(now[mid], size))
            of = np.searchsorted(start, at, side="right") - 1
            begin[mid[of[::-1]]] = i[at[::-1]]  # the first of equals
            left, right = lo < mid, mid < hi
            b = begin[mid]
            lo, hi, least, most = (np.concatenate(z) for z in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (least[left], b[right]), (b[left], most[right])))
        best = now
        back.append(begin)
    bounds, j = [], n - 1
    for begin in [*back[::-1], np.zeros(n, dtype=np.int32)]:
        bounds.append(lengths[j])
        if begin[j] == 0:
            break
        j = begin[j] - 1
    return np.array(sorted(bounds))


def plan_batches(bounds: np.ndarray, counts: np.ndarray, capacity: int, lend: bool = True) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (number of containers, [(bucket, items in each)]) that take just counts[b] items of each bucket b.

    Without ``lend`` a batch holds items of one bucket only.
    """
    runs: list[list] = []  # [containers, budget left, pattern]
    for b in range(len(bounds) - 1, -1, -1):
        size, left = int(bounds[b]), int(counts[b])
        fresh: list[list] = []
        for run in sorted((r for r in runs if lend and r[1] >= size), key=lambda r: r[1]):
            if not left:
                break
            each = run[1] // size
            full = min(run[0], left // each)
            rest = min(left - full * each, each - 1) if full < run[0] else 0
            untouched = run[0] - full - (rest > 0)
            if rest:
                fresh.append([1, run[1] - rest * size, [*run[2], (b, rest)]])
            if untouched:
                fresh.append([untouched, run[1], list(run[2])])
            if full:
                run[0], run[1], run[2] = full, run[1] - each * size, [*run[2], (b, each)]
            else:
                run[0] = 0
            left -= full * each + rest
        if left:
            each = capacity // size
            if left // each:
                fresh.append([left // each, capacity - each * size, [(b, each)]])
            if left % each:
                fresh.append([1, capacity - (left % each) * size, [(b, left % each)]])
        runs = [r for r in runs if r[0]] + fresh
    return [(r[0], r[2]) for r in runs]


def pack(sizes: DataFrame, capacity: int = 2048, buckets: int = 512, key: str = "doc_id", size: str = "n_tokens", lend: bool = True) -> DataFrame:
    """(key, piece, n_tokens, container_id, place, start): place counts from 0, start is the first token's place in the container."""
    sizes = C.cut(sizes.select(F.col(key), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n")))
    pieces = F.expr(f"sequence(0L, (n - 1) div {capacity})")
    items = sizes.where("n > 0").select(key, "n", F.explode(pieces).alias("piece")).select(key, "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("n"))
    histogram = items.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect()  # at most `capacity` rows
    lengths, counts = np.array([r["n"] for r in histogram], dtype=np.int64), np.array([r["c"] for r in histogram], dtype=np.int64)
    out = f"{key} {sizes.schema[key].dataType.simpleString()}, piece bigint, n bigint, container_id bigint, slot bigint"
    if len(lengths):
        bounds = bucket_bounds(lengths, counts, buckets)
        of = np.searchsorted(bounds, lengths)
        per = np.bincount(of, weights=counts, minlength=len(bounds)).astype(np.int64)
        # the plan as rows (bucket, first rank, items per container, first container, first slot)
        rows, taken, first = [], np.zeros(len(bounds), dtype=np.int64), 0
        for containers, pattern in plan_batches(bounds, per, capacity, lend):
            slot = 0
            for b, each in pattern:
                rows.append((b, taken[b], each, first, slot))
                taken[b] += containers * each
                slot += each
            first += containers
        plan = np.array(sorted(rows), dtype=np.int64)
        starts = plan[:, 0] * (1 << 44) + plan[:, 1]
        bucket_of = np.zeros(capacity + 1, dtype=np.int64)
        bucket_of[lengths] = of
        parts = 1 + per // PART
        spark = sizes.sparkSession
        C.ship(spark)
        known = F.broadcast(spark.createDataFrame([(int(n), int(b), int(parts[b])) for n, b in zip(lengths, of, strict=True)], "n bigint, b bigint, parts bigint"))  # at most `capacity` rows
        placed = items.join(known, "n").withColumn("part", F.pmod(F.xxhash64(key, "piece"), F.col("parts")))
        sums = placed.groupBy("b", "part").agg(F.count("*").alias("c"))
        before = Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("b", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
        inside = Window.partitionBy("b", "part").orderBy(F.xxhash64(key, "piece", F.lit(1)), key, "piece")
        ranked = placed.withColumn("r", F.row_number().over(inside) - 1).join(sums, ["b", "part"]).select(key, "piece", "n", "b", (F.col("before") + F.col("r")).alias("r"))

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                at = np.searchsorted(starts, f["b"].to_numpy() * (1 << 44) + f["r"].to_numpy(), side="right") - 1
                row = plan[at]
                k = f["r"].to_numpy() - row[:, 1]
                yield pd.DataFrame({key: f[key], "piece": f["piece"], "n": f["n"], "container_id": row[:, 3] + k // row[:, 2], "slot": row[:, 4] + k % row[:, 2]})

        in_container = Window.partitionBy("container_id").orderBy("slot")  # at most `capacity` rows
        full = ranked.mapInPandas(place, out).select(
            key, "piece", F.col("n").alias("n_tokens"), "container_id", (F.row_number().over(in_container) - 1).cast("bigint").alias("place"),
            (F.sum("n").over(in_container.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
        )
    null = F.lit(None).cast("bigint")
    nothing = sizes.where("n <= 0").select(key, F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("n_tokens"), null.alias("container_id"), null.alias("place"), null.alias("start"))
    return full.unionByName(nothing) if len(lengths) else nothing
