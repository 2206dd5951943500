"""The same plans over a stream of samples. Draws come from sample identity, never from arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rasterlane.operators.base import Frame, values
from rasterlane.plans.compose import Plan
from rasterlane.sources.samples import from_compact


def compact_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of compact rows under path."""
    schema = "sample_id long, h int, w int, c int, data array<double>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stateless(stream: DataFrame, plan: Plan, channels: int = 3, seed: int = 0) -> DataFrame:
    """Pixels of a stream through a plan of operators without per-sample aggregation."""
    return plan.run(Frame(from_compact(stream, channels), channels), seed).pixels.select("sample_id", "h", "w", "y", "x", *values(channels))


def by_batch(stream: DataFrame, plan: Plan, sink: Callable[[DataFrame, int], None], checkpoint: str, channels: int = 3, seed: int = 0) -> StreamingQuery:
    """Any plan: a micro-batch holds whole samples, so aggregations by sample are complete in it."""

    def each(batch: DataFrame, number: int) -> None:
        sink(plan.run(Frame(from_compact(batch, channels), channels), seed).pixels, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()
