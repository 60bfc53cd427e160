"""Problem 6: occurrences and document counts of every term, with marks for terms too rare or too common.

Each record is first reduced to its own term counts (sort its terms, take the lengths of the runs: linear but for the sort,
nothing is shuffled). The rows (term, occurrences) are then combined by hash within each map task and only the combined
rows are shuffled, so a term in a third of all records sends one row per task. The number of documents rides along as the
empty term, which no record can hold, so the texts are read once.

Defined results: a null text is no document; an empty text, or one without terms, is a document without terms; repeated
rows are counted as they stand (``documents`` has one row per id); an empty table has no terms; null limits bound nothing;
of several settings under one name the narrowest limits hold. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def record_terms(text: Column, min_len: int, max_len: int) -> Column:
    """Sorted terms of a text with repeats: runs of ASCII letters, cut out first and lower-cased then."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1))
    return F.array_sort(F.transform(F.filter(runs, lambda w: F.length(w).between(min_len, max_len)), F.lower))


def term_counts(docs: DataFrame, text: str = "text", min_len: int = 2, max_len: int = 20) -> DataFrame:
    """(term, occurrences, docs), and one row with the empty term that holds the number of documents."""
    present = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_t"))
    terms = C.computed(present, "w", record_terms(F.col("_t"), min_len, max_len)).select("w")
    starts = F.expr("filter(sequence(0, size(w)), i -> i = size(w) or i = 0 or w[i] <> w[i - 1])")
    runs = C.computed(terms, "s", F.when(F.size("w") > 0, starts).otherwise(F.array(F.lit(0))))
    counted = runs.select(F.expr("concat(transform(slice(s, 1, size(s) - 1), (a, k) -> struct(w[a] as term, s[k + 1] - a as n)), array(struct('' as term, 0 as n)))").alias("r"))
    each = counted.select(F.explode("r").alias("r")).select("r.term", "r.n")
    return each.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("docs"))


def marked_terms(docs: DataFrame, settings: DataFrame, name: str, text: str = "text", min_len: int = 2, max_len: int = 20) -> DataFrame:
    """(term, occurrences, docs, mark): mark is 'rare', 'common' or null. settings(name, min_df, max_df) holds the limits."""
    counts = C.cut(term_counts(docs, text, min_len, max_len))  # a vocabulary: small against the texts, and read twice
    total = counts.where("term = ''").select(F.col("docs").alias("n_docs"))
    limits = settings.where(F.col("name") == name).agg(F.max("min_df").alias("lo"), F.min("max_df").alias("hi"))  # one row
    share = F.col("docs") / F.col("n_docs")
    mark = F.when(share < F.col("lo"), "rare").when(share > F.col("hi"), "common")
    both = counts.where("term <> ''").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(limits))  # two tables of one row
    return both.select("term", "occurrences", "docs", mark.alias("mark"))
