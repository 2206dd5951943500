"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Every row is posted in the inverted file of
each pivot that its prefix names, with its place there; the index is a table in the shared folder whose
rows are shards: the shard's vectors and its pivots' inverted files. A query reads the files of its own
pivots, which add up its footrule distance to every row that shares a pivot, and the nearest share of a
shard's rows by footrule is ranked again by the true distance on the original vectors.

Pivots come from a bounded sample of distinct vectors; every row is indexed. Queries go out in blocks of
bounded size, one at a time, and a shard gives a query at most the neighbours that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, shared_path, stored, table
from .vectors import BLOCK_BYTES, blocks, chunks, column, matrix, own_rows, usable

#: Pivots (the bound of the sample), the length of a prefix, the share of a shard's rows that is ranked again.
PIVOTS, PREFIX, SHARE = 512, 64, 0.25
#: Rows of a shard; rows whose pivot distances a task holds at once.
SHARD_ROWS, AT_ONCE = 16_384, 4096


def pivots_of(rows: DataFrame, count: int) -> np.ndarray:
    """count distinct vectors, those of least hash: a sample that repeated rows do not bend."""
    hashed = rows.select("vec", F.xxhash64("vec").alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(count)
    chosen = hashed.join(F.broadcast(least), "h", "left_semi").groupBy("h").agg(F.min("vec").alias("vec")).orderBy("h").toArrow()
    return matrix(column(chosen, "vec")) if chosen.num_rows else np.zeros((0, 1))


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first (of ties the first pivot)."""
    out = np.zeros((len(x), length), np.int32)
    norm = (pivots**2).sum(1)
    for a in range(0, len(x), AT_ONCE):
        d = norm - 2 * (x[a : a + AT_ONCE] @ pivots.T)  # the row's own norm shifts all alike
        out[a : a + AT_ONCE] = np.argsort(d, axis=1, kind="stable")[:, :length]
    return out


@dataclass
class Files:
    """Inverted files of a shard: rows begin[p] to begin[p + 1] of (row, place) are pivot p's."""

    begin: np.ndarray
    row: np.ndarray
    place: np.ndarray

    @staticmethod
    def post(near: np.ndarray, pivots: int) -> Files:
        n, m = near.shape
        order = np.argsort(near.ravel(), kind="stable")
        begin = np.searchsorted(near.ravel()[order], np.arange(pivots + 1))
        return Files(begin.astype(np.int32), (order // m).astype(np.int32), (order % m).astype(np.int16))

    def footrule(self, near: np.ndarray, rows: int) -> np.ndarray:
        """Footrule distance of one prefix to every row; a pivot outside a prefix has the place after its last.

        Where both prefixes name a pivot the sum of both places' gaps to that end, less twice the gap of
        the later place, is what the files add; a row in none of the files stays at the largest distance.
        """
        m = len(near)
        saved = np.zeros(rows, np.int32)
        for place, p in enumerate(near.tolist()):
            at = slice(self.begin[p], self.begin[p + 1])
            saved[self.row[at]] += m - np.maximum(self.place[at], place)
        return m * (m + 1) - 2 * saved


def shards(rows: DataFrame, dim: int, pivots: np.ndarray, length: int, shard_rows: int) -> DataFrame:
    """The index, in the shared folder: a row for each shard. Every row of the input is in one."""
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in chunks(batches, dim, shard_rows * 8 * dim):
            x, ids = matrix(column(shard, "vec")), column(shard, "id")
            files = Files.post(prefixes(x, sent.value, length), len(sent.value))
            held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([held, *(pa.array([a.tobytes()], pa.binary()) for a in (x, files.begin, files.row, files.place))], ["ids", "vectors", "begin", "row", "place"])

    return stored(rows.mapInArrow(run, f"ids array<{kind}>, vectors binary, begin binary, row binary, place binary"), "permutation-index")


def nearest(near: np.ndarray, vec: np.ndarray, files: Files, x: np.ndarray, own: tuple[int, int], count: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of a shard's nearest to one query; x is ordered by id, so row order settles ties."""
    far = files.footrule(near, len(x))
    far[own[0] : own[1]] = np.iinfo(np.int32).max
    left = len(x) - (own[1] - own[0])
    take = min(left, max(count, int(np.ceil(share * len(x)))))
    if take <= 0:
        return np.zeros(0, np.int64), np.zeros(0)
    reach = np.partition(far, take - 1)[take - 1]  # all rows that tie with the last are ranked again too
    rows = np.flatnonzero((far <= reach) & (far < np.iinfo(np.int32).max))
    d = np.sqrt(((x[rows] - vec) ** 2).sum(1))
    best = np.argsort(d, kind="stable")[:count]
    return rows[best], d[best]


def neighbours(
    rows: DataFrame, queries: DataFrame | None = None, count: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank, <id_col>, score: each query's nearest rows by Euclidean distance in doubles.

    queries: rows as those of rows (all rows if None). A query's neighbours are the nearest of the rows
    with another id that it finds, ties to the smaller id (null last); score is the distance of the
    original vectors. pivots bounds the sample that the index is fitted on, all rows are indexed; share:
    the part of each shard's rows, nearest by footrule, whose distance is computed (1: an exact search).

    Vectors that are null, empty, zero, hold a null or non-finite component or are not as long as most
    take no part, as row or as query. Rows that repeat are neighbours of their own; queries that repeat
    in id and vector count once. Fewer rows than count: all of them. An empty table gives an empty
    result; other columns are not read.
    """
    spark = rows.sparkSession
    every, dim = usable(rows, id_col, vector_col, "neighbours-rows", zero=False)
    asked = every
    if queries is not None:
        asked = queries.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("vec"))
        asked = asked.join(every.select("id", "vec").distinct(), ["id", "vec"], "left_semi")
    kind = every.schema["id"].dataType.simpleString()
    path, schema = shared_path(spark, "neighbours"), f"query_id {kind}, query string, id {kind}, score double"
    spark.createDataFrame([], schema).write.parquet(path)
    points = pivots_of(every, pivots) if dim else np.zeros((0, 1))
    length = min(prefix, len(points))
    if length:
        index = shards(every, dim, points, length, shard_rows)
        shared = spark.sparkContext.broadcast(points)
        for number, block in enumerate(blocks(asked.select("id", "vec"), 8 * dim + 4 * length + 32, "neighbours-queries", block_bytes)):
            search(index, block, shared, dim, length, count, share, number, kind).write.mode("append").parquet(path)
    order = Window.partitionBy("query").orderBy("score", F.asc_nulls_last("id"))
    out = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def search(index: DataFrame, block: pa.Table, pivots, dim: int, length: int, count: int, share: float, number: int, kind: str) -> DataFrame:
    """(query_id, query, id, score): at most count rows of each shard for each query of the block."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_ids = matrix(column(sent.value, "vec")), column(sent.value, "id")
        near = prefixes(q, pivots.value, length)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(0)[k].values
                x, begin, row, place = (np.frombuffer(batch.column(i)[k].as_buffer(), t) for i, t in enumerate((np.float64, np.int32, np.int32, np.int16), 1))
                x, files = x.reshape(-1, dim), Files(begin, row, place)
                first, end = own_rows(ids, q_ids)
                found = [nearest(near[i], q[i], files, x, (first[i], end[i]), count, share) for i in range(len(q))]
                of = np.repeat(np.arange(len(q)), [len(r) for r, _ in found])
                rows = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in found)])
                yield pa.RecordBatch.from_arrays(
                    [q_ids.take(pa.array(of)), pa.array([f"{number}/{i}" for i in of.tolist()], pa.string()), ids.take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0), *(d for _, d in found)]))],
                    ["query_id", "query", "id", "score"],
                )

    return index.mapInArrow(run, f"query_id {kind}, query string, id {kind}, score double")


def op12_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.where(F.pmod("vec_id", F.lit(100)) == 0))
