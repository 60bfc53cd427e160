"""All pairs of distinct directions with at least a given cosine: an exact pass over pairs of blocks.

Vectors lie in blocks of up to ``BLOCK`` rows, one table row each, cut where they are read. The table of blocks is joined with
itself as a Cartesian product: every task reads two partitions of it, so vectors are on disk once and nothing is shuffled.
Two blocks meet once, in the order that the parity of their numbers says, which gives all tasks about the same work.

Two blocks are compared tile by tile, each tile small enough for the cache. Vectors are rotated at random; of u and v in two
parts (a, b) and (c, d), u.v <= a.c + |b||d|, and that is one product of half the width. What it doesn't rule out is multiplied
out in single precision, and what could still reach the threshold in double precision, rounded to 9 decimals. Both filters have a
margin above their rounding error: no pair is lost. A tile of which the bound leaves more than a fiftieth is multiplied out whole.
The work is half the square of the number of directions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK, LEAST_BLOCK, TILE, DENSE, MARGIN, HELD = 8192, 1024, 1024, 0.02, 1e-5, 1_000_000


class Side:
    """The vectors of one block: ids c, unit rows x, the same in single precision y, and the part for the bound z."""

    def __init__(self, b: int, c: bytes, v: bytes) -> None:
        self.b, self.c = b, np.frombuffer(c, dtype=np.int64)
        x = np.frombuffer(v, dtype=np.float32).reshape(len(self.c), -1).astype(np.float64)
        self.x = x / np.sqrt((x * x).sum(1, keepdims=True))
        self.y = self.x.astype(np.float32)
        dims = x.shape[1]
        turned = self.x @ np.linalg.qr(np.random.default_rng(5).standard_normal((dims, dims)))[0][:, : max(1, dims // 2 - 1)]
        rest = np.sqrt(np.maximum(0.0, 1 - (turned * turned).sum(1, keepdims=True)))
        self.z = np.concatenate([turned, rest], axis=1).astype(np.float32)


def blocks(dirs: DataFrame, total: int, most: int | None = None) -> DataFrame:
    """dirs(c, v) in rows (b, c, v) of up to ``most``, stored. Small tables get blocks enough for all cores."""
    most = min(most or BLOCK, max(LEAST_BLOCK, -(-total // (2 * dirs.sparkSession.sparkContext.defaultParallelism))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, vectors, n = itertools.count(TaskContext.get().partitionId() << 24), [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([next(number)]), pa.array([b"".join(ids)]), pa.array([b"".join(vectors)])], ["b", "c", "v"])

        for batch in batches:
            c, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            at = 0
            while at < len(c):
                take = min(most - n, len(c) - at)
                ids.append(c[at : at + take].tobytes())
                vectors.append(v[at : at + take].tobytes())
                n, at = n + take, at + take
                if n == most:
                    yield row()
                    ids, vectors, n = [], [], 0
        if n:
            yield row()

    return C.stored(dirs.select("c", "v").mapInArrow(packed, "b bigint, c binary, v binary"))


def meet(table: DataFrame, work: Callable[[], Links | Nearest], kinds: str) -> DataFrame:
    """What a new ``work`` in every task gives after all pairs of blocks there, each block with itself included; cut."""
    names = [x.split()[0] for x in kinds.split(", ")]
    l, r = (table.select(F.col("b").alias(f"b{s}"), F.col("c").alias(f"c{s}"), F.col("v").alias(f"v{s}")) for s in "lr")  # noqa: E741
    parity = F.pmod(F.col("bl") + F.col("br"), F.lit(2))
    once = (F.col("bl") == F.col("br")) | ((F.col("bl") < F.col("br")) & (parity == 0)) | ((F.col("bl") > F.col("br")) & (parity == 1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, left = work(), None
        for batch in batches:
            bl, cl, vl, br, cr, vr = batch.columns
            for i in range(batch.num_rows):
                if left is None or left.b != bl[i].as_py():
                    left = Side(bl[i].as_py(), cl[i].as_py(), vl[i].as_py())
                own.pair(left, left if br[i].as_py() == left.b else Side(br[i].as_py(), cr[i].as_py(), vr[i].as_py()))
        yield from _batches(own.end(), names)

    return C.cut(l.hint("shuffle_replicate_nl").join(r, once).mapInArrow(compare, kinds))


def _batches(columns: tuple[np.ndarray, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    for g in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[g : g + 100_000]) for x in columns], names)


class Links:
    """(a, b), b < a: pairs that connect just what is connected by pairs with at least ``least``; per task one for each a."""

    def __init__(self, least: float) -> None:
        self.least, self.found, self.n = least, [], 0

    def pair(self, l: Side, r: Side) -> None:  # noqa: E741
        same = l is r
        ids = l.c if same else np.concatenate([l.c, r.c])
        label, off, seen = np.arange(len(ids)), 0 if same else len(l.c), []

        def joined(i: int, j: int) -> bool:
            own, other = label[i : i + TILE][: len(l.c) - i], label[off + j : off + j + TILE]
            return (own == own[0]).all() and (other == own[0]).all()

        def link() -> None:
            nonlocal label
            a, b, s = (np.concatenate(x) for x in zip(*seen, strict=True))
            seen.clear()
            apart = label[a] != label[off + b]
            a, b, s = a[apart], b[apart], s[apart]
            linked = s >= self.least + MARGIN
            close = np.flatnonzero(~linked)
            linked[close] = similarity(l, r, a[close], b[close]) >= self.least
            names, least = components(label[a[linked]], label[off + b[linked]])
            to = np.arange(len(ids))
            to[names] = least
            label = to[label]

        for found in tiles(l, r, self.least, joined):
            seen.append(found)
            if sum(len(x[0]) for x in seen) > 100_000:
                link()
        if seen:
            link()
        moved = np.flatnonzero(label != np.arange(len(ids)))
        self._keep(ids[moved], ids[label[moved]])

    def _keep(self, a: np.ndarray, b: np.ndarray) -> None:
        self.found.append((a, b))
        self.n += len(a)
        if self.n > HELD:
            self.found = [self.end()]
            self.n = len(self.found[0][0]) // 2  # so a task with many linked vectors doesn't begin anew at once

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([x[s] for x in self.found] or [np.zeros(0, dtype=np.int64)]) for s in (0, 1))
        names, least = components(a, b)
        moved = names != least
        return names[moved], least[moved]


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the pairs, and the smallest of each one's connected component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
        x, y = label[x], label[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return names, names[label]


def joined(links: DataFrame) -> DataFrame:
    """links(a, b) to (c, label) of all their ends: the smallest connected one. One task reads them in batches and holds one pair per end."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Links(0.0)
        for batch in batches:
            own._keep(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        a, b = own.end()
        a, b = np.concatenate([a, np.unique(b)]), np.concatenate([b, np.unique(b)])
        yield from _batches((a, b), ["c", "label"])

    return C.cut(links.coalesce(1).mapInArrow(merge, "c bigint, label bigint"))


class Nearest:
    """(c, o, s): the k nearest o of every c among those with at least ``least`` that a task compares; ties to the smaller o."""

    def __init__(self, least: float, k: int) -> None:
        self.least, self.k, self.found, self.n, self.floors = least, k, [], 0, {}

    def pair(self, l: Side, r: Side) -> None:  # noqa: E741
        same, k = l is r, self.k
        lo, ro = (self.floors.setdefault(s.b, np.full(len(s.c), self.least - MARGIN, dtype=np.float32)) for s in (l, r))

        def pruned(i: int, j: int, s: np.ndarray) -> np.ndarray:
            """Of a dense tile: what may be among the k nearest of its row or column, whose k-th best is a floor for all tiles."""
            own, other = lo[i : i + len(s)], ro[j : j + s.shape[1]]
            seen = k + (same and i == j)  # a vector itself stands in a tile on the diagonal
            if s.shape[1] >= seen:
                np.maximum(own, np.partition(s, -seen, axis=1)[:, -seen] - MARGIN, out=own)
            if len(s) >= seen:
                np.maximum(other, np.partition(s, -seen, axis=0)[-seen] - MARGIN, out=other)
            return (s >= own[:, None]) | (s >= other[None, :])

        for a, b, s in tiles(l, r, self.least, None, pruned):
            may = (s >= lo[a]) | (s >= ro[b])
            a, b = a[may], b[may]
            s = similarity(l, r, a, b)
            for ids, others, floor, i, j in ((l, r, lo, a, b), (r, l, ro, b, a)):
                fine = (s >= self.least) & (s >= floor[i])
                self.found.append((ids.c[i[fine]], others.c[j[fine]], s[fine]))
                self.n += int(fine.sum())
        if self.n > HELD:
            self.found = [self.end()]
            self.n = len(self.found[0][0]) // 2

    def end(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, o, s = (np.concatenate([x[at] for x in self.found] or [np.zeros(0, dtype=kind)]) for at, kind in ((0, np.int64), (1, np.int64), (2, np.float64)))
        order = np.lexsort((o, -s, c))
        c, o, s = c[order], o[order], s[order]
        top = np.arange(len(c)) - np.searchsorted(c, c) < self.k
        return c[top], o[top], s[top]


def similarity(l: Side, r: Side, a: np.ndarray, b: np.ndarray) -> np.ndarray:  # noqa: E741
    parts = [np.einsum("ij,ij->i", l.x.take(a[g : g + 50_000], axis=0), r.x.take(b[g : g + 50_000], axis=0)) for g in range(0, len(a), 50_000)]
    return np.round(np.concatenate(parts or [np.zeros(0)]), 9)


def hits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of what is set in h, in any order: first 8 by 8, then 8 in a row, which is several times faster if little is set."""
    n, m = h.shape
    if n % 8 or m % 8:
        return np.divmod(np.flatnonzero(h), m)
    words = h.view(np.uint64).reshape(n // 8, 8, m // 8)
    i, j = np.divmod(np.flatnonzero(np.bitwise_or.reduce(words, axis=1) != 0), m // 8)
    some = words[i, :, j].reshape(-1)
    at = np.flatnonzero(some != 0)
    one = np.flatnonzero(some[at].view(np.uint8).view(bool))
    at = at[one >> 3]
    return i[at >> 3] * 8 + (at & 7), j[at >> 3] * 8 + (one & 7)


def tiles(l: Side, r: Side, least: float, skip: Callable[[int, int], bool] | None, pruned: Callable[[int, int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:  # noqa: E741
    """Places in l and r of the pairs that may reach ``least``, and their similarity in single precision, tile by tile, each pair
    once and none of a vector with itself. ``skip`` leaves out tiles; ``pruned`` says what to look at in a dense one."""
    room, marks, bound, same = np.empty(TILE * TILE, dtype=np.float32), np.empty(TILE * TILE, dtype=bool), np.float32(least - MARGIN), l is r
    for i in range(0, len(l.c), TILE):
        for j in range(i if same else 0, len(r.c), TILE):
            if skip and skip(i, j):
                continue
            n, m = min(TILE, len(l.c) - i), min(TILE, len(r.c) - j)
            s, h = room[: n * m].reshape(n, m), marks[: n * m].reshape(n, m)
            np.greater_equal(np.matmul(l.z[i : i + n], r.z[j : j + m].T, out=s), bound, out=h)
            if dense := np.count_nonzero(h) > DENSE * s.size:
                np.greater_equal(np.matmul(l.y[i : i + n], r.y[j : j + m].T, out=s), bound, out=h)
                if pruned and np.count_nonzero(h) > DENSE * s.size:
                    h &= pruned(i, j, s)
            a, b = hits(h)
            if same and i == j:
                real = a < b
                a, b = a[real], b[real]
            s = s[a, b] if dense else np.einsum("ij,ij->i", l.y.take(i + a, axis=0), r.y.take(j + b, axis=0))
            near = s >= bound
            if near.any():
                yield a[near] + i, b[near] + j, s[near]
