"""Readers and writers of the text formats, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import glue_lines, split_words


def _numbered(spark: SparkSession, *paths: str) -> DataFrame:
    """(line, value): lines numbered from 0 by path and place. Only the starts of the splits are counted and joined, no text moves."""
    at = F.monotonically_increasing_id()
    rows = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), at.alias("_m"))
    splits = rows.groupBy("_f", "_b").agg(F.min("_m").alias("_least"), F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = splits.select("_f", "_b", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), ["_f", "_b"]).select((F.col("_m") - F.col("_least") + F.col("_start")).alias("line"), "value")


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc_id, text), one row per line, numbered from 0 in the order of path and place."""
    return _numbered(spark, *paths).select(F.col("line").alias("doc_id"), F.col("value").alias("text"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(line, word, vec ARRAY<FLOAT>) of lines ``word f1 .. fn``; a line of another length than the first is an error when read."""
    head = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).first()
    dims = len(head["p"]) - 1 if head else 0
    parts = _numbered(spark, path).select("line", F.split(F.trim("value"), r"\s+").alias("p"), "value")
    wrong = F.raise_error(F.concat(F.lit(f"not {dims} numbers: "), F.substring("value", 1, 80)))
    floats = F.transform(F.slice("p", 2, max(1, dims)), lambda x: x.cast("float"))
    vec = F.when(F.size("p") == dims + 1, floats).otherwise(wrong.cast("array<float>"))
    return parts.select("line", split_words(F.col("p")[0], 1)[0].alias("word"), vec.alias("vec"))


def labelled_pairs(spark: SparkSession, *paths: str) -> DataFrame:
    """(label, a, b): columns 1, 6 and 7 of tab-separated files with a header line each."""
    schema = "label string, _2 string, _3 string, _4 string, _5 string, a string, b string"
    return spark.read.csv(list(paths), sep="\t", header=True, quote="", schema=schema, enforceSchema=True).select("label", "a", "b")


def reviews(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, label, text) of folders with ``pos`` and ``neg`` below them, one file per review; tabs and line feeds are deleted."""
    paths = [f"{d}/{side}" for d in folders for side in ("pos", "neg")]
    rows = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.select("path", F.when(F.col("path").rlike("/pos/[^/]*$"), 1).otherwise(0).alias("label"), glue_lines(F.col("text")).alias("text"))


def samples(spark: SparkSession, *paths: str, numeric: bool = True) -> DataFrame:
    """(label, text) of lines ``label<TAB>text``, cut at the first tab. With ``numeric`` any other label is an error when read."""
    parts = spark.read.text(list(paths)).select(F.split("value", "\t", 2).alias("p"))
    label = F.col("p")[0]
    if numeric:
        number = label.try_cast("int")
        label = F.when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("no numeric label: "), label)).cast("int"))
    return parts.select(label.alias("label"), F.get("p", F.lit(1)).alias("text"))


def triplets(spark: SparkSession, *paths: str) -> DataFrame:
    """(anchor, positive, negative) of lines with three fields, in this order, as written."""
    parts = spark.read.text(list(paths)).select(F.split("value", "\t").alias("p"))
    return parts.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("anchor", "positive", "negative"))])


def write_fields(df: DataFrame, path: str, *cols: str, mode: str = "errorifexists") -> None:
    """Lines of tab-separated fields; null fields are empty."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.mode(mode).text(path)
