"""Document frequencies of a stream: each micro-batch is counted and merged, which is all that repeated training needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokenizer import Params, Vocabulary, document_frequency


def train_stream(docs: DataFrame, params: Params, folder: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Writes the counts of every batch to ``folder``/batch=N. A batch that is run again overwrites itself, so each counts once."""

    def merge(batch: DataFrame, number: int) -> None:
        counts = document_frequency(batch, params, key, text)
        whole = batch.select(F.lit("").alias("token"), F.lit(1).cast("bigint").alias("df")).groupBy("token").agg(F.sum("df").alias("df"))
        counts.unionByName(whole).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def vocabulary_of(spark, params: Params, folder: str) -> Vocabulary:
    """All batches so far as one vocabulary, as if trained at once."""
    counts = spark.read.parquet(f"{folder}/counts").groupBy("token").agg(F.sum("df").alias("df"))
    n = counts.where("token = ''").first()
    return Vocabulary(params, n["df"] if n else 0, counts.where("token <> ''"))
