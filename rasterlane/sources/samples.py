"""Samples from tables, compact rows and image files; compact rows and tensors as sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlane.operators.base import Frame, values


def embedding_pixels(spark: SparkSession, sf_dir: str, channels: int = 3, h: int = 8, w: int = 8) -> DataFrame:
    """An h x w image of each vector of `embeddings`: quantised, reversed and shifted in its channels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("sample_id"), "embedding")
    e = e.select("sample_id", "embedding", F.posexplode("embedding").alias("i", "e")).where(f"i < {h * w}")
    grey = "greatest(0e0, least(255e0, floor((cast({e} as double) + 1e0) * 127.5e0)))"
    v = [grey.format(e="e"), grey.format(e="embedding[63 - i]"), f"(({grey.format(e='e')} + 7 * i) % 256)"]
    return e.select("sample_id", F.lit(h).alias("h"), F.lit(w).alias("w"), F.expr(f"cast(floor(i / {w}) as int)").alias("y"), F.expr(f"i % {w}").alias("x"), *[F.expr(f"cast({v[k]} as double)").alias(f"v{k}") for k in range(channels)])


def embedding_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 x 4 volume of each vector."""
    flat = embedding_pixels(spark, sf_dir, 1)
    i = "(y * 8 + x)"
    return flat.select("sample_id", F.lit(4).alias("d"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.expr(f"cast(floor({i} / 16) as int)").alias("z"), F.expr(f"cast(floor({i} / 4) as int) % 4").alias("y"), F.expr(f"{i} % 4").alias("x"), "v0")


def embedding_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pixels(spark, sf_dir, 1).withColumn("v0", F.expr("cast(cast(floor(v0 / 32) as int) % 4 as double)"))


def lineitem_boxes(spark: SparkSession, sf_dir: str, w: int = 90, h: int = 60) -> DataFrame:
    """Boxes in a w x h frame from `lineitem`, normalised; some leave the frame."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = rows.selectExpr("l_orderkey as sample_id", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as box_ix", "cast((l_partkey * 37) % 100 as double) as bx", "cast((l_suppkey * 53 + l_linenumber * 11) % 70 as double) as yt", "l_quantity as bw", "5 + 100 * l_discount as bh", "l_returnflag as label")
    return rows.selectExpr("sample_id", f"{h} as h", f"{w} as w", "box_ix", f"bx / {w} as x_min", f"yt / {h} as y_min", f"(bx + bw) / {w} as x_max", f"(yt + bh) / {h} as y_max", "label")


def event_keypoints(spark: SparkSession, sf_dir: str, w: int = 90, h: int = 60) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.selectExpr("user_id as sample_id", f"{h} as h", f"{w} as w", "event_id as kp_ix", "cast((event_id * 31) % 95 as double) as x", "cast((event_id * 17) % 65 as double) as y", "(event_id % 360) * 0.017453292519943295e0 as angle", "value as scale", "event_type as label")


def spectrograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image: event types as rows (by name), hours of the day as columns, counts as values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", F.hour("ts").alias("x")).agg(F.count("*").cast("double").alias("v0"))
    types = e.select("event_type").distinct().select("event_type", F.expr("row_number() over (order by event_type) - 1").alias("y"), F.expr("count(*) over ()").cast("int").alias("h"))
    return e.join(F.broadcast(types), "event_type").selectExpr("cast(0 as bigint) as sample_id", "h", "24 as w", "y", "x", "v0")


def from_compact(samples: DataFrame, channels: int) -> DataFrame:
    """Pixels of compact rows: sample_id, h, w, data (array, row-major, channels innermost)."""
    n = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    rows = samples.select("sample_id", "h", "w", "data", F.explode(n).alias("i"))
    return rows.select("sample_id", "h", "w", F.expr("cast(floor(i / w) as int)").alias("y"), F.expr("i % w").alias("x"), *[F.expr(f"cast(data[i * {channels} + {k}] as double)").alias(f"v{k}") for k in range(channels)])


def to_compact(frame: Frame) -> DataFrame:
    """One row per sample: sample_id, h, w, c, data. One shuffle, on the sample."""
    row = F.struct("y", "x", F.array(*values(frame.channels)).alias("v"))
    rows = frame.pixels.groupBy("sample_id", "h", "w").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("sample_id", "h", "w", F.lit(frame.channels).alias("c"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("data"))


def to_tensor(frame: Frame) -> DataFrame:
    """One row per sample: sample_id, c, h, w, data with channels outermost."""
    row = F.struct("y", "x", F.array(*values(frame.channels)).alias("v"))
    rows = frame.pixels.groupBy("sample_id", "h", "w").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    planes = F.array(*[F.expr(f"transform(rows, r -> r.v[{k}])") for k in range(frame.channels)])
    return rows.select("sample_id", F.lit(frame.channels).alias("c"), "h", "w", F.flatten(planes).alias("data"))


def volume_tensor(volumes: DataFrame, channels: int = 1) -> DataFrame:
    """One row per sample: sample_id, c, d, h, w, data with channels outermost."""
    row = F.struct("z", "y", "x", F.array(*values(channels)).alias("v"))
    rows = volumes.groupBy("sample_id", "d", "h", "w").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    planes = F.array(*[F.expr(f"transform(rows, r -> r.v[{k}])") for k in range(channels)])
    return rows.select("sample_id", F.lit(channels).alias("c"), "d", "h", "w", F.flatten(planes).alias("data"))


def embedding_images(spark: SparkSession, sf_dir: str, side: int = 256) -> DataFrame:
    """Samples as rows: a side x side image of each vector of `embeddings`, its 8 x 8 values (see
    embedding_pixels) repeated in squares. sample_id, h, w, c, data (bytes)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("sample_id"), F.slice("embedding", 1, 64).alias("e"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                e = np.array(part.column(1).to_pylist(), np.float32).astype(float)
                v = np.clip(np.floor((e + 1) * 127.5), 0, 255)
                small = np.stack([v, v[:, ::-1], (v + 7 * np.arange(64)) % 256], axis=2).reshape(-1, 8, 8, 3).astype(np.uint8)
                big = small.repeat(side // 8, axis=1).repeat(side // 8, axis=2)
                n = part.num_rows
                sizes = [pa.array([s] * n, pa.int32()) for s in (side, side, 3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *sizes, pa.array([x.tobytes() for x in big], pa.binary())], ["sample_id", "h", "w", "c", "data"])

    return rows.mapInArrow(draw, "sample_id long, h int, w int, c int, data binary")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Compact rows of image files by Spark's own reader (stored as BGR); sample_id from the path."""
    rows = spark.read.format("image").load(path).select("image.*")
    byte = F.expr("transform(sequence(1, length(data)), i -> cast(conv(hex(substring(data, i, 1)), 16, 10) as int))")
    return rows.select(F.abs(F.xxhash64("origin")).alias("sample_id"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("c"), byte.alias("data"))


def write(df: DataFrame, path: str, buckets: int | None = None, mode: str = "error") -> None:
    """Parquet, dealt by sample where buckets are given, so that per-sample work needs no shuffle later."""
    (df.repartition(buckets, "sample_id") if buckets else df).write.mode(mode).parquet(path)
