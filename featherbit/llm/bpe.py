"""Problem 7: encoding of a whole corpus with a public byte-level BPE tokenizer, and decoding.

Backtracking encoder. An Aho-Corasick automaton over all tokens gives, in one pass over a pre-token, the longest token that
starts at each byte. The encoder takes the longest one and keeps it if the pair (last token, new token) is compatible: a
pair is compatible if plain byte-pair merging of their joined bytes would give back just these two tokens. Otherwise it tries
the next shorter token that is a prefix, and where none is left it gives up its last token and never ends a token at that
byte again. Every byte can so be given up once, hence the time is linear, also for a pre-token of a million letters, and the
result is that of the merges. Decoding concatenates slices of one blob by a table of offsets.

The vocabulary file (fixed size, 1.5 MB) is read by the driver and shipped with the function; executors need no such path.
Ids of pre-tokens of up to 48 bytes are remembered in a table of bounded size that is emptied when full.

Defined results: null and empty texts give the empty list; the strings of special tokens are ordinary text; repeated rows
are encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how the tokenizer cuts texts into pre-tokens.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 48


def printable_bytes() -> dict[str, int]:
    """The file writes each byte as a printable character: itself where it is one, else the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Tables of one vocabulary, and the ids of pre-tokens seen before."""

    def __init__(self, vocabulary: str) -> None:
        import ahocorasick
        import regex

        model = json.loads(vocabulary)["model"]
        as_byte = printable_bytes()
        special = {x["content"] for x in json.loads(vocabulary).get("added_tokens", [])}
        ids = {t: i for t, i in model["vocab"].items() if t not in special}
        text = {i: "".join(chr(as_byte[c]) for c in t) for t, i in ids.items()}  # one character per byte
        self.size = max(model["vocab"].values()) + 1
        self.text = text
        self.length = [len(text.get(i, "")) for i in range(self.size)]
        self.left, self.right, self.joined = list(range(self.size)), list(range(self.size)), {}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, both = ids[a], ids[b], ids[a + b]
            self.left[both], self.right[both], self.joined[a * self.size + b] = a, b, both
        by_text = {t: i for i, t in text.items()}
        self.shorter = [-1] * self.size
        for i, t in text.items():
            self.shorter[i] = next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1)
        self.automaton = ahocorasick.Automaton()
        for t, i in by_text.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.find = regex.compile(PRETOKENS).findall
        self.by_text, self.seen = by_text, {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging never crosses the border between a and b: undo merges, the youngest first, and look for a pair
        of neighbours at the border that would have been merged before the merge just undone."""
        joined, size, limit = self.joined, self.size, 1 << 60
        while True:
            if joined.get(a * size + b, limit) < limit:
                return False
            part_a, part_b = self.right[a], self.left[b]
            can_a, can_b = part_a != a, part_b != b
            if can_a and (a > b or not can_b):
                a, limit = part_a, a
            elif can_b:
                b, limit = part_b, b + 1
            else:
                return True

    def word(self, s: str) -> list[int]:
        """Ids of a pre-token with one character per byte."""
        whole = self.by_text.get(s)
        if whole is not None and self.shorter[whole] < 0:
            return [whole]
        n, length = len(s), self.length
        longest = [-1] * n
        for end, i in self.automaton.iter(s):
            at = end + 1 - length[i]
            if longest[at] < 0 or length[longest[at]] < length[i]:
                longest[at] = i
        open_end = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if open_end[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:  # no token fits here: nothing may end at this byte
                open_end[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str, out: list[int]) -> None:
        seen = self.seen
        for w in self.find(text):
            got = seen.get(w)
            if got is None:
                s = w.encode("utf-8", "replace").decode("latin-1")
                got = self.word(s)
                if len(s) <= REMEMBERED_BYTES:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[w] = got
            out += got

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens one after the other, and where each begins."""
        blob = np.frombuffer("".join(self.text.get(i, "") for i in range(self.size)).encode("latin-1"), dtype=np.uint8)
        return blob, np.concatenate([[0], np.cumsum(self.length)])


_encoders: dict[int, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    k = hash(vocabulary)
    if k not in _encoders:
        _encoders[k] = Encoder(vocabulary)
    return _encoders[k]


def read_vocabulary(path: str = BYTE_BPE) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shipped(spark: SparkSession, path: str):
    C.ship(spark)
    return spark.sparkContext.broadcast(read_vocabulary(path))  # a file of fixed size


def encode(docs: DataFrame, path: str = BYTE_BPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids ARRAY<INT>)."""
    vocabulary = _shipped(docs.sparkSession, path)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[int] = []
                ends = [0]
                for t in part.column(1).to_pylist():
                    if t:
                        enc.encode(t, out)
                    ends.append(len(out))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(out, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, path: str = BYTE_BPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens INT) without moving the ids out of the worker."""
    vocabulary = _shipped(docs.sparkSession, path)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(vocabulary.value)
        for batch in batches:
            counts = []
            for t in batch.column(1).to_pylist():
                out: list[int] = []
                if t:
                    enc.encode(t, out)
                counts.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=[key, "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind.simpleString()}, n_tokens int")


def decode(encoded: DataFrame, path: str = BYTE_BPE, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): bytes that are no UTF-8 become U+FFFD; null ids give null; ids outside the vocabulary add nothing."""
    vocabulary = _shipped(encoded.sparkSession, path)
    kind = encoded.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, start = encoder_of(vocabulary.value).offsets()
        for batch in batches:
            texts = []
            for x in batch.column(1):
                if x.as_py() is None:
                    texts.append(None)
                    continue
                i = np.asarray(x.values.drop_null(), dtype=np.int64)
                i = i[(i >= 0) & (i < len(start) - 1)]
                n = start[i + 1] - start[i]
                where = np.repeat(start[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(i) else np.zeros(0, dtype=np.int64)
                texts.append(blob[where].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, F.col(ids).cast("array<int>")).mapInArrow(run, f"{key} {kind.simpleString()}, text string")
