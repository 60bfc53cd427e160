"""Saved models by kind and name: a folder each, with parameters as JSON and tables as Parquet, on any file system of Spark."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.corex import Compressor
from ..operators.tokenizer import Params, Vocabulary
from ..operators.tsetlin import Machine, Settings

KINDS = ("words", "clusters", "modeler", "classifier", "encoder", "compressor")


class Registry:
    """An entry counts once its marker is written, which is done last; a name is used once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, name: str, part: str = "") -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind: {kind}")
        if not name or "/" in name:
            raise ValueError("a name without slashes is needed")
        return f"{self.root}/{kind}/{name}" + (f"/{part}" if part else "")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, kind: str, name: str) -> bool:
        fs, p = self._fs(self.path(kind, name, "_complete"))
        return fs.exists(p)

    def names(self, kind: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{kind}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if self.exists(kind, x.getPath().getName())) if fs.exists(p) else []

    def _put(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def insert(self, kind: str, name: str, params: dict, anew: bool = False, **tables: DataFrame) -> None:
        if not anew and self.exists(kind, name):
            raise ValueError(f"{kind} {name} exists already")
        for part, df in tables.items():
            df.write.mode("overwrite").parquet(self.path(kind, name, part))  # leftovers of a run that broke off
        self._put(self.path(kind, name, "params.json"), json.dumps(params))
        self._put(self.path(kind, name, "_complete"), "")

    def params(self, kind: str, name: str) -> dict:
        if not self.exists(kind, name):
            raise KeyError(f"no {kind} {name}")
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(self.path(kind, name, "params.json")).collect()))

    def table(self, kind: str, name: str, part: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, name, part))

    def save_vocabulary(self, name: str, v: Vocabulary, **more: object) -> None:
        """Counts are kept also when finalised; an unfinalised vocabulary can go on training after loading."""
        params = {"n_docs": v.n_docs, "finalized": v.finalized, "params": v.params.__dict__} | more
        self.insert("modeler", name, params, vocabulary=v.df)

    def load_vocabulary(self, name: str) -> Vocabulary:
        p = self.params("modeler", name)
        return Vocabulary(Params(**p["params"]), p["n_docs"], self.table("modeler", name, "vocabulary"), p["finalized"])

    def save_compressor(self, name: str, c: Compressor, bits: int, **more: object) -> None:
        """Written before its modeler, so one without a modeler is a leftover and is replaced."""
        rows = [(part, bytearray(np.asarray(getattr(c, part), dtype=np.float64).tobytes())) for part in ("on", "off", "prior")]
        self.insert("compressor", name, {"bits": bits, "hidden": c.hidden, "history": c.history} | more, True, weights=self.spark.createDataFrame(rows, "part string, x binary"))

    def load_compressor(self, name: str) -> Compressor:
        p = self.params("compressor", name)
        x = {r["part"]: np.frombuffer(bytes(r["x"])) for r in self.table("compressor", name, "weights").collect()}  # of the model's size
        on, off = (x[part].reshape(2, p["hidden"], p["bits"]) for part in ("on", "off"))
        return Compressor(on, off, x["prior"].reshape(2, p["hidden"]), p["history"])

    def save_machine(self, kind: str, name: str, m: Machine, **more: object) -> None:
        rows = [(h, bytearray(x.tobytes())) for h, x in enumerate(m.states)]
        self.insert(kind, name, {"bits": m.bits, "settings": m.s.__dict__} | more, states=self.spark.createDataFrame(rows, "h int, x binary"))

    def load_machine(self, kind: str, name: str) -> tuple[Machine, dict]:
        p = self.params(kind, name)
        s = Settings(**p["settings"])
        rows = self.table(kind, name, "states").orderBy("h").collect()
        states = np.stack([np.frombuffer(bytes(r["x"]), dtype=np.int16).reshape(s.clauses, 2 * p["bits"]) for r in rows])
        return Machine(0, p["bits"], s, states), p
