"""Incremental staging of envelope files into the entity-partitioned Parquet layout.

The batch path stages an envelope once (``sources.envelope.stage_envelope``); when
envelope files keep arriving in a landing folder, this Structured Streaming job
appends each new file's rows to the same layout, exactly once per file, so later
entity reads keep pruning to their ``name=<entity>`` directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.envelope import ENVELOPE_COLUMNS, validate_envelope


def envelope_stream(spark: SparkSession, landing: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Streaming envelope rows from files dropped into ``landing`` (schema required)."""
    df = spark.readStream.schema(schema).format(fmt).load(landing)
    return validate_envelope(df).select(*ENVELOPE_COLUMNS)


def stage_stream(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append new envelope rows under ``target`` partitioned by entity name.

    ``checkpoint`` must be on shared, durable storage: it records which files are
    already staged so a restarted job neither skips nor repeats one.
    """
    w = (stream.writeStream.format("parquet").option("path", target)
         .option("checkpointLocation", checkpoint).partitionBy("name").outputMode("append"))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()
