"""Parameter tables that arrive as files over time, parsed as a stream.

The dataset build is a batch job; a stream serves where new batches keep arriving. Parsing is
stateless, so the stream needs no watermark; the last row of an id wins on reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshlark.operators.tables import last_by_key, parse_delimited


def parameter_stream(spark: SparkSession, path: str, sep: str | None = ",", files: int = 16) -> DataFrame:
    """``mesh_id, p`` from text files as they appear, ``files`` of them a trigger."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(path)
    return parse_delimited(lines.where("trim(value) <> ''"), "value", sep)


def append_parameters(stream: DataFrame, table: str, checkpoint: str):
    """Start writing the stream to a Parquet table, with the batch's number for later reads."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")  # a retried batch replaces itself

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_parameters(spark: SparkSession, table: str) -> DataFrame:
    """The last parameters of every id."""
    return last_by_key(spark.read.parquet(table), "mesh_id", "batch").select("mesh_id", "p")
