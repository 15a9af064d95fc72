"""Incremental indexing: new text files are cleaned, cut and appended by Structured Streaming.

Cutting needs one document at a time, and search takes its statistics when it runs, so the stream keeps no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as t
from corpusloom.operators.cleaning import clean
from corpusloom.operators.segment import segment
from corpusloom.session import prepare
from corpusloom.sources.files import stem_of
from corpusloom.sources.settings import Cleaning, DocumentSettings


def read_texts(spark: SparkSession, folder: str, files_each: int = 10_000) -> DataFrame:
    read = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.txt")
    read = read.option("maxFilesPerTrigger", files_each).format("text").load(folder)
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = read.select(path.alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return rows.withColumn("stem", stem_of(F.col("file_path"))).withColumn("document_id", t.document_slug(F.col("stem")))


def ingest(
    spark: SparkSession, folder: str, table: str, checkpoint: str,
    cleaning: Cleaning = Cleaning(), settings: DocumentSettings = DocumentSettings(),
) -> StreamingQuery:
    """Append the sections of files that are new since the last run to a Parquet table, then stop.

    The stream takes each path once: a file that changes later is not read again (a workspace's refresh does that).
    A batch that is run again overwrites its own part (``batch=<id>``), so no section is stored twice. doc_ord is a
    hash of the path: it identifies the document, and orders documents stably though not by name.
    """
    prepare(spark)

    def store(batch: DataFrame, batch_id: int) -> None:
        docs = batch.withColumn("doc_ord", F.xxhash64("file_path")).withColumn("text", clean(F.col("text"), cleaning))
        segment(docs, settings).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    stream = read_texts(spark, folder).writeStream.option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).foreachBatch(store).start()
