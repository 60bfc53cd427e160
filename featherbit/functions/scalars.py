"""Scalar functions on text, vectors and feature sets, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, most: int | None = None) -> Column:
    """Whitespace tokens, ASCII-lowered, without leading and trailing punctuation; a token of punctuation becomes empty."""
    tokens = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    tokens = tokens if most is None else F.slice(tokens, 1, most)
    return F.transform(tokens, lambda x: F.regexp_replace(ascii_lower(x), r"^\p{Punct}+|\p{Punct}+$", ""))


def glue_lines(text: Column) -> Column:
    """Tabs and line feeds are deleted, not replaced: their neighbours are glued together."""
    return F.regexp_replace(text, "[\t\n]", "")


def round_multiple(n: Column, m: int) -> Column:
    return (F.ceil(n / m) * m).cast("bigint")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def hamming(a: Column, b: Column) -> Column:
    """Between two sets of ids: the number of ids in just one of them."""
    return (F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))).cast("bigint")


def jaccard(a: Column, b: Column) -> Column:
    """Of two empty sets 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_complement(ids: Column, bits: int) -> Column:
    """Ids of a set followed by bits + i for every i that isn't in it: each row then has exactly ``bits`` literals."""
    if not bits:
        return F.array().cast("array<int>")
    rest = F.array_except(F.sequence(F.lit(0), F.lit(bits - 1)), ids)
    return F.concat(ids, F.transform(rest, lambda i: i + F.lit(bits)))


def packed_hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v).cast("bigint")
