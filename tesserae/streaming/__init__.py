"""Incremental ingest: files that arrive in a folder are taken in batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators.ingest import KnowledgeBase
from tesserae.sources import files


def new_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)


def ingest_stream(base: KnowledgeBase, path: str, checkpoint: str, per_batch: int = 1000) -> StreamingQuery:
    """Takes in what is new under ``path`` and ends when all of it is done. A batch that comes again after its commit is not written twice."""

    def take(batch: DataFrame, number: int) -> None:
        rows = files.from_memory(batch.select(F.col("path").alias("display_name"), "content"))
        docs = files.documents(rows.where(F.col("ext").isin(*files.TEXTS)))
        base.ingest(docs.where("error IS NULL").drop("error"), batch=(checkpoint, number))

    stream = new_files(base.spark, path, per_batch)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
