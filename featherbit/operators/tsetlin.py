"""Tsetlin machines: a classifier over labelled fingerprints and an encoder over triplets of them.

A machine has heads (one per class, or one per output bit), each with clauses over the features and their complements. Training
is data-parallel: rows are dealt to a fixed number of shards by a hash of what they hold; in an epoch every shard starts from the
same states and learns from its own rows one by one; the changes are summed by head on the executors, weighted by rows, and
their mean is applied, fractions included. Shards are a setting of the model: the result doesn't depend on partitions or cores.
What the driver holds is the model, whatever the number of rows. The range of specificity is spread evenly over the clauses. All randomness comes from the seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planning import cut, ship
from .bits import dense


@dataclass(frozen=True)
class Settings:
    clauses: int = 64
    state_bits: int = 8
    target: int = 32
    specificity_low: float = 2.0
    specificity_high: float = 50.0
    active: float = 0.85
    boost: bool = True
    iterations: int = 5
    evaluate_every: int = 1
    seed: int = 0
    margin: float = 0.1
    alpha: float = 0.25
    shards: int = 8

    def __post_init__(self) -> None:
        if self.clauses < 2 or self.clauses % 2 or self.target < 1 or not 2 <= self.state_bits <= 15:
            raise ValueError("an even number of clauses, a target of 1 or more and 2 to 15 state bits are needed")
        if not 1 <= self.specificity_low <= self.specificity_high or not 0 < self.active <= 1:
            raise ValueError("1 <= specificity_low <= specificity_high and 0 < active <= 1 must hold")


class Machine:
    def __init__(self, heads: int, bits: int, s: Settings, states: np.ndarray | None = None) -> None:
        self.s, self.bits, self.half = s, bits, 1 << (s.state_bits - 1)
        if states is None:
            rng = np.random.default_rng(s.seed)
            states = (self.half - rng.integers(0, 2, (heads, s.clauses, 2 * bits))).astype(np.int16)
        self.states = states
        self.sign = np.where(np.arange(s.clauses) % 2 == 0, 1, -1)
        self.specificity = np.linspace(s.specificity_low, s.specificity_high, s.clauses)[:, None]

    def votes(self, x: np.ndarray) -> np.ndarray:
        """(rows, heads) for literals (rows, 2 * bits); clauses without literals don't vote."""
        out = np.zeros((len(x), len(self.states)), dtype=np.int64)
        absent = (1 - x).astype(np.float32)
        for h, state in enumerate(self.states):
            include = (state > self.half).astype(np.float32)
            fires = (absent @ include.T < 0.5) & (include.sum(1) > 0)[None, :]
            out[:, h] = fires @ self.sign
        return out

    def learn(self, h: int, x: np.ndarray, wanted: bool, rng: np.random.Generator) -> None:
        """One step of feedback for one head. x: bool literals."""
        s, state = self.s, self.states[h]
        fires = ~((state > self.half) & ~x).any(1)
        total = int(np.clip(fires @ self.sign, -s.target, s.target))
        chance = (s.target - total if wanted else s.target + total) / (2 * s.target)
        picked = (rng.random(s.clauses) < chance) & (rng.random(s.clauses) < s.active)
        first = picked & ((self.sign > 0) == wanted)
        k = np.flatnonzero(first)
        if len(k):
            r = rng.random((len(k), len(x)), dtype=np.float32)
            low = 1.0 / self.specificity[k]
            hit = fires[k][:, None] & x[None, :]
            up = hit if s.boost else hit & (r < 1 - low)
            state[k] += up.astype(np.int16) - (~hit & (r < low)).astype(np.int16)
        k = np.flatnonzero(picked & ~first & fires)
        if len(k):
            state[k] += (~x[None, :] & (state[k] <= self.half)).astype(np.int16)
        np.clip(state, 1, 2 * self.half, out=state)


def literals(ids: pd.Series, bits: int) -> np.ndarray:
    x = dense(list(ids), bits)
    return np.concatenate([x, 1 - x], axis=1)


def _epochs(rows: DataFrame, machine: Machine, learn: Callable[[Machine, pd.DataFrame, np.random.Generator], None], each: Callable[[int, Machine], bool | None] | None) -> Machine:
    """Iterations over ``rows``; ``each`` gets the epoch and the machine and may return False to stop."""
    ship(rows.sparkSession)
    s, bits, sc = machine.s, machine.bits, rows.sparkSession.sparkContext
    cols = rows.columns
    dealt = rows.withColumn("_h", F.xxhash64(*cols, F.lit(s.seed))).withColumn("_s", F.pmod("_h", F.lit(s.shards)).cast("int"))
    dealt = cut(dealt.repartition(s.shards, "_s").sortWithinPartitions("_s", "_h", *cols))
    exact = machine.states.astype(np.float64)
    for epoch in range(1, s.iterations + 1):
        held = sc.broadcast(machine.states)  # of the model's size

        def work(frames: Iterator[pd.DataFrame], held=held, epoch: int = epoch) -> Iterator[pd.DataFrame]:
            shard, own, n, rng = -1, None, 0, None

            def change() -> pd.DataFrame:
                x = (own.states - held.value).astype(np.float32) * n
                return pd.DataFrame({"s": shard, "h": np.arange(len(x), dtype=np.int32), "n": n, "x": [c.tobytes() for c in x]})

            for f in frames:
                for at, part in f.groupby("_s", sort=True):  # shards follow one another
                    if at != shard:
                        if n:
                            yield change()
                        shard, own, n, rng = at, Machine(0, bits, s, held.value.copy()), 0, np.random.default_rng([s.seed, epoch, int(at)])
                    for k in range(0, len(part), 1000):  # the order is that of the hash, whatever the batches
                        learn(own, part.iloc[k : k + 1000], rng)
                    n += len(part)
            if n:
                yield change()

        def add(f: pd.DataFrame) -> pd.DataFrame:
            x = sum(np.frombuffer(b, dtype=np.float32) for b in f["x"])
            return pd.DataFrame({"h": f["h"][:1], "n": f["n"].sum(), "x": [x.astype(np.float32).tobytes()]})

        part = dealt.mapInPandas(work, "s int, h int, n bigint, x binary")
        pre = part.withColumn("p", F.pmod("s", F.lit(16))).drop("s").groupBy("h", "p").applyInPandas(lambda f: add(f), "h int, n bigint, x binary")
        for r in pre.groupBy("h").applyInPandas(add, "h int, n bigint, x binary").collect():  # one row per head
            exact[r["h"]] += np.frombuffer(r["x"], dtype=np.float32).reshape(exact[0].shape) / max(1, r["n"])
        exact = np.clip(exact, 1, 2 * machine.half)
        machine = Machine(0, bits, s, np.rint(exact).astype(np.int16))
        if each and epoch % s.evaluate_every == 0 and each(epoch, machine) is False:
            break
    return machine


def train_classifier(rows: DataFrame, bits: int, classes: int, s: Settings, each: Callable[[int, Machine], bool | None] | None = None) -> Machine:
    """rows(ids, label_id). Each row teaches its class and, as a counter-example, one other class."""

    def learn(m: Machine, f: pd.DataFrame, rng: np.random.Generator) -> None:
        for at in range(0, len(f), 500):
            part = f.iloc[at : at + 500]
            for x, y in zip(literals(part["ids"], bits).astype(bool), part["label_id"].to_numpy(), strict=True):
                m.learn(int(y), x, True, rng)
                if classes > 1:
                    m.learn(int((y + 1 + rng.integers(classes - 1)) % classes), x, False, rng)

    return _epochs(rows.select("ids", "label_id"), Machine(classes, bits, s), learn, each)


def classify(rows: DataFrame, machine: Machine, labels: list[str], key: str = "doc_id") -> DataFrame:
    """(key, label): the class with the most votes, ties to the first."""
    ship(rows.sparkSession)
    held, bits, s = rows.sparkSession.sparkContext.broadcast(machine.states), machine.bits, machine.s

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, names = Machine(0, bits, s, held.value), np.array(labels, dtype=object)
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                yield pd.DataFrame({key: part[key], "label": names[m.votes(literals(part["ids"], bits)).argmax(1)]})

    return rows.select(key, "ids").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, label string")


def _share(rows: DataFrame, machine: Machine, cols: list[str], right: Callable[[Machine, pd.DataFrame], np.ndarray]) -> float:
    """The share of rows for which ``right`` holds; NaN without any."""
    ship(rows.sparkSession)
    held, bits, s = rows.sparkSession.sparkContext.broadcast(machine.states), machine.bits, machine.s

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Machine(0, bits, s, held.value)
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                yield pd.DataFrame({"n": [len(part)], "hits": [int(right(m, part).sum())]})

    r = rows.select(*cols).mapInPandas(run, "n bigint, hits bigint").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).first()
    return r["hits"] / r["n"] if r["n"] else float("nan")


def accuracy(rows: DataFrame, machine: Machine) -> float:
    """rows(ids, label_id): the share whose class has the most votes, ties to the first."""
    bits = machine.bits
    return _share(rows, machine, ["ids", "label_id"], lambda m, f: m.votes(literals(f["ids"], bits)).argmax(1) == f["label_id"].to_numpy())


def triplet_score(rows: DataFrame, machine: Machine) -> float:
    """rows(a, p, n): the share that training would leave as it is, d(a, p) + margin <= d(a, n) in Hamming shares."""
    bits = machine.bits

    def right(m: Machine, f: pd.DataFrame) -> np.ndarray:
        a, p, n = (m.votes(literals(f[c], bits)) >= 0 for c in "apn")
        return (a != p).mean(1) - (a != n).mean(1) + m.s.margin <= 0

    return _share(rows, machine, ["a", "p", "n"], right)


def train_encoder(triplets: DataFrame, bits: int, hidden: int, s: Settings, each: Callable[[int, Machine], bool | None] | None = None) -> Machine:
    """triplets(a, p, n), sets of ids. A hinge on Hamming shares: where d(a, p) + margin exceeds d(a, n), output bits are
    taught, a share ``alpha`` of them scaled by the excess: a and p towards one another's bits, n away from a's."""

    def learn(m: Machine, f: pd.DataFrame, rng: np.random.Generator) -> None:
        for at in range(0, len(f), 200):
            part = f.iloc[at : at + 200]
            a, p, n = (literals(part[c], bits) for c in "apn")
            ya, yp, yn = (m.votes(x) >= 0 for x in (a, p, n))
            excess = (ya != yp).mean(1) - (ya != yn).mean(1) + s.margin
            for i in np.flatnonzero(excess > 0):
                taught = np.flatnonzero(rng.random(hidden) < min(1.0, s.alpha * (1 + excess[i])))
                for h in taught:
                    if ya[i, h] != yp[i, h]:
                        m.learn(h, p[i].astype(bool), bool(ya[i, h]), rng)
                        m.learn(h, a[i].astype(bool), bool(ya[i, h]), rng)
                    if ya[i, h] == yn[i, h]:
                        m.learn(h, n[i].astype(bool), not ya[i, h], rng)

    return _epochs(triplets.select("a", "p", "n"), Machine(hidden, bits, s), learn, each)


def encode(rows: DataFrame, machine: Machine, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, code ARRAY<INT>): the output bits that are set."""
    ship(rows.sparkSession)
    held, bits, s = rows.sparkSession.sparkContext.broadcast(machine.states), machine.bits, machine.s

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Machine(0, bits, s, held.value)
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                y = m.votes(literals(part[ids], bits)) >= 0
                yield pd.DataFrame({key: part[key], "code": [np.flatnonzero(r).astype(np.int32) for r in y]})

    return rows.select(key, ids).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, code array<int>")


def vote(prints: DataFrame, clauses: DataFrame, key: str = "doc_id") -> DataFrame:
    """prints(key, ids), clauses(class, sign, present ARRAY, absent ARRAY) to (key, class, votes): a row per class.

    The clauses are a model: they go to the workers as two matrices, and no row is shuffled.
    """
    spark = prints.sparkSession
    ship(spark)
    got = clauses.select("class", F.col("sign").cast("double"), "present", "absent").toPandas()  # of the model's size
    names = sorted(set(got["class"]))
    bits = 1 + max((int(i) for c in ("present", "absent") for x in got[c] for i in x), default=0)
    sides = [dense(list(got[c]), bits).astype(np.float32) for c in ("present", "absent")]
    signs = np.zeros((len(got), len(names)), dtype=np.float32)
    signs[np.arange(len(got)), [names.index(c) for c in got["class"]]] = got["sign"]
    held = spark.sparkContext.broadcast((*sides, signs))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        present, absent, sign = held.value
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                x = dense([np.asarray(i)[np.asarray(i, dtype=np.int64) < bits] for i in part["ids"]], bits).astype(np.float32)
                fires = ((1 - x) @ present.T < 0.5) & (x @ absent.T < 0.5)
                votes = np.rint(fires.astype(np.float32) @ sign).astype(np.int64)
                yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), len(names)), "class": np.tile(np.array(names, dtype=object), len(part)), "votes": votes.ravel()})

    kinds = dict(clauses.dtypes)
    return prints.select(key, "ids").mapInPandas(run, f"{key} {prints.schema[key].dataType.simpleString()}, class {kinds['class']}, votes bigint")
