"""A folder of payloads as a stream: new files are turned into boxes batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boxwise.sources.tables import PAYLOAD


def payload_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    pages = spark.readStream.schema(PAYLOAD).option("multiLine", True).option("maxFilesPerTrigger", files_a_batch).json(path)
    return pages.select(F.input_file_name().alias("doc_id"), F.explode("pages").alias("p")).select("doc_id", F.col("p.page").alias("page"), F.explode("p.words").alias("b")).select("doc_id", "page", "b.*")


def write_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Everything that is there now, in bounded batches; the checkpoint keeps what was done."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
