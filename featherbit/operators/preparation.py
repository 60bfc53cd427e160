"""Labelled pairs, triplets, samples and label dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import glue_lines
from .ranking import ranked

LABELS = ("entailment", "neutral", "contradiction")


def usable_pairs(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """pairs(label, a, b) whose label is one of the three; with ``most`` just that many, by hash order."""
    kept = pairs.where(F.col("label").isin(*LABELS) & F.col("a").isNotNull() & F.col("b").isNotNull())
    return kept if most is None else ranked(kept, 0, ["label", "a", "b"]).where(F.col("rank") <= most).drop("rank")


def pair_sets(pairs: DataFrame) -> DataFrame:
    """(a, label, b) once each: the sets of sentences per anchor and label."""
    return usable_pairs(pairs).select("a", "label", "b").distinct()


def triplets_of(pairs: DataFrame) -> DataFrame:
    """(anchor, positive, negative): of each anchor its entailed sentences times its neutral and contradicting ones.

    A sentence under both counts twice, and a positive may equal a negative: that is in the data.
    """
    sets = pair_sets(pairs)
    positive = sets.where("label = 'entailment'").select(F.col("a").alias("anchor"), F.col("b").alias("positive"))
    negative = sets.where("label <> 'entailment'").select(F.col("a").alias("anchor"), F.col("b").alias("negative"))
    return positive.join(negative, "anchor").select("anchor", "positive", "negative")


def sentences_of(df: DataFrame, *cols: str) -> DataFrame:
    """The distinct sentences of some columns, as ``text``."""
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("text")).where("text is not null").distinct()


def balanced_samples(samples: DataFrame, key: str = "sample_id", seed: int = 0, most: int | None = None) -> DataFrame:
    """samples(key, label, text) to (pair, positive_id, negative_id): the i-th positive with the i-th negative in hash order.

    Stops at the shorter side, so the classes are balanced; ``most`` limits the pairs.
    """
    r = ranked(samples.where(F.col("label").isin(0, 1)), seed, [key], by=["label"])
    p = r.where("label = 1").select("rank", F.col(key).alias("positive_id"))
    n = r.where("label = 0").select("rank", F.col(key).alias("negative_id"))
    both = p.join(n, "rank").select(F.col("rank").alias("pair"), "positive_id", "negative_id")
    return both if most is None else both.where(F.col("pair") <= most)


def clean_reviews(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, glue_lines(F.col(text)))


def label_dictionary(samples: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(label, label_id): ids from 0 by first appearance. One row per class, so the numbering window is small."""
    first = samples.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(key).alias("_first"))
    return first.select(F.col(label).alias("label"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first", label)) - 1).cast("int").alias("label_id"))


def with_label_ids(samples: DataFrame, dictionary: DataFrame, label: str = "label") -> DataFrame:
    """``samples`` with label_id; a label that the dictionary lacks is an error when the row is read."""
    known = dictionary.select(F.col("label").alias(label), "label_id")
    joined = samples.join(known, label, "left")
    bad = F.concat(F.lit("unknown label: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))
    return joined.withColumn("label_id", F.when(F.col("label_id").isNull(), F.raise_error(bad).cast("int")).otherwise(F.col("label_id")))


def class_counts(samples: DataFrame, label: str = "label") -> DataFrame:
    """(by_maximum, by_values): numbers of classes as greatest label plus one, and as distinct labels."""
    return samples.agg((F.max(F.col(label).cast("int")) + 1).cast("bigint").alias("by_maximum"), F.count_distinct(label).alias("by_values"))
