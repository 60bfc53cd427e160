"""Unsupervised bit compressor: total correlation explanation over binary features (Ver Steeg and Galstyan, 2014).

Each hidden unit explains the features whose mutual information with it is greatest. An iteration is one pass: every task
computes the units' probabilities for its rows and sums them per feature and unit; the sums move as one block per unit; the
driver gets features times units numbers and updates the conditional probabilities. The objective is the mean log normaliser of the units, a bound on the total
correlation explained.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planning import ship
from .bits import dense
from .clustering import early_stop


@dataclass
class Compressor:
    on: np.ndarray  # (2, units, features): log p(x = 1 | y) - log p(x = 1), weighted
    off: np.ndarray
    prior: np.ndarray  # (2, units): log p(y)
    history: list[float]

    @property
    def hidden(self) -> int:
        return self.prior.shape[1]

    def probabilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, units) p(y = 1 | x), and log normalisers."""
        s = [self.prior[y] + x @ (self.on[y] - self.off[y]).T + self.off[y].sum(1) for y in (0, 1)]
        z = np.logaddexp(*s)
        return np.exp(s[1] - z), z


def _summed(parts: DataFrame) -> DataFrame:
    """parts(u, x BINARY of doubles) to one row per u with their sum: first in 16 parts, then those."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"u": f["u"][:1], "x": [sum(np.frombuffer(b) for b in f["x"]).tobytes()]})

    some = parts.withColumn("p", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("u", "p").applyInPandas(lambda f: add(f), "u int, x binary")
    return some.groupBy("u").applyInPandas(add, "u int, x binary")


def fit(rows: DataFrame, bits: int, hidden: int, iterations: int = 20, eps: float = 1e-4, seed: int = 0, each: Callable[[int, float], bool | None] | None = None, classes: int = 0, supervision: float = 0.0) -> Compressor:
    """rows(ids), with ``supervision`` also label_id in 0 .. classes - 1: labels then count as features of that weight while
    fitting; the compressor itself reads none. Stops when the objective has settled, or ``each(iteration, objective)`` returns False."""
    ship(rows.sparkSession)
    if supervision and not classes:
        raise ValueError("supervision needs the number of classes")
    rng = np.random.default_rng(seed)
    model: Compressor | None = None
    wide = bits + (classes if supervision else 0)
    start = rng.random((hidden, wide)) - 0.5
    history: list[float] = []
    n_rows, px = 0.0, None
    for it in range(iterations):

        def work(frames: Iterator[pd.DataFrame], model: Compressor | None = model) -> Iterator[pd.DataFrame]:
            joint, y1, x1, n, z = np.zeros((hidden, wide)), np.zeros(hidden), np.zeros(wide), 0, 0.0
            for f in frames:
                for at in range(0, len(f), 1000):
                    part = f.iloc[at : at + 1000]
                    x = dense(list(part["ids"]), bits).astype(np.float32)
                    if wide > bits:
                        x = np.concatenate([x, np.eye(classes, dtype=np.float32)[part["label_id"].to_numpy(dtype=int)]], axis=1)
                    if model is None:
                        p = 1 / (1 + np.exp(-np.clip((x @ start.T) * 2, -30, 30)))
                    else:
                        p, log = model.probabilities(x)
                        z += log.sum()
                    joint, y1, x1, n = joint + p.T @ x, y1 + p.sum(0), x1 + x.sum(0), n + len(x)
            if n:
                whole = np.concatenate([joint, y1[:, None], np.zeros((hidden, 1))], axis=1)
                last = np.concatenate([x1, [n, z]])
                yield pd.DataFrame({"u": np.arange(hidden + 1, dtype=np.int32), "x": [r.tobytes() for r in (*whole, last)]})

        cols = ["ids", *(["label_id"] if wide > bits else [])]
        got = _summed(rows.select(*cols).mapInPandas(work, "u int, x binary")).collect()  # a row per unit
        if not got:
            raise ValueError("no rows")
        whole = np.stack([np.frombuffer(bytes(r["x"])) for r in sorted(got, key=lambda r: r["u"])])
        n_rows, z, px = whole[hidden, wide], whole[hidden, wide + 1], whole[hidden, :wide]
        px = (px + 0.5) / (n_rows + 1)
        joint, py = whole[:hidden, :wide], np.clip((whole[:hidden, wide] + 0.5) / (n_rows + 1), 1e-6, 1 - 1e-6)
        p1 = np.stack([(whole[hidden, :wide] - joint + px) / (n_rows * (1 - py[:, None]) + 1), (joint + px) / (n_rows * py[:, None] + 1)])
        p1 = np.clip(p1, 1e-6, 1 - 1e-6)
        on, off = np.log(p1 / px), np.log((1 - p1) / (1 - px))
        mutual = sum(w[:, None] * (p1[y] * on[y] + (1 - p1[y]) * off[y]) for y, w in ((0, 1 - py), (1, py)))
        weight = np.exp(min(it, 10) * 0.5 * (mutual - mutual.max(0)) / (mutual.std() + 1e-9))
        weight[:, bits:] *= supervision
        model = Compressor(on * weight, off * weight, np.log(np.stack([1 - py, py])), history)
        if it:
            history.append(float(z / n_rows))
            if (each and each(it, history[-1]) is False) or early_stop(history, eps):
                break
    return Compressor(model.on[:, :, :bits], model.off[:, :, :bits], model.prior, history) if model else model


def compress(rows: DataFrame, model: Compressor, bits: int, key: str = "doc_id") -> DataFrame:
    """(key, code ARRAY<INT>): the hidden units that are more likely on than off."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                p, _ = held.value.probabilities(dense(list(part["ids"]), bits).astype(np.float32))
                yield pd.DataFrame({key: part[key], "code": [np.flatnonzero(r >= 0.5).astype(np.int32) for r in p]})

    return rows.select(key, "ids").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, code array<int>")
