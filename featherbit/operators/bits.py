"""Sets of feature ids as fixed-width words of bits, packed where the rows are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.planning import ship


def dense(ids: list[np.ndarray] | pd.Series, bits: int) -> np.ndarray:
    """(rows, bits) uint8 of sets of ids; ids outside are an error."""
    out = np.zeros((len(ids), bits), dtype=np.uint8)
    lens = np.array([len(x) for x in ids], dtype=np.int64)
    if lens.sum():
        out[np.repeat(np.arange(len(ids)), lens), np.concatenate([np.asarray(x, dtype=np.int64) for x in ids])] = 1
    return out


def to_words(x: np.ndarray) -> np.ndarray:
    """(rows, ceil(bits / 64)) int64, bit i in position i % 64 of word i // 64."""
    width = -(-x.shape[1] // 64) * 64
    padded = np.zeros((len(x), max(64, width)), dtype=np.uint8)
    padded[:, : x.shape[1]] = x
    return np.packbits(padded, axis=1, bitorder="little").view(np.int64)


def pack(df: DataFrame, key: str, ids: str, bits: int, flipped: bool = False) -> DataFrame:
    """(key, words ARRAY<BIGINT>); flipped sets have their complement after them, so twice the width."""
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                x = dense(part[ids], bits)
                yield pd.DataFrame({key: part[key], "words": list(to_words(np.concatenate([x, 1 - x], axis=1) if flipped else x))})

    return df.select(key, ids).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, words array<bigint>")
