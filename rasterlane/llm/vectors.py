"""What the operators on vectors share: rows that take part, query sets in blocks, chunks in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored

#: Bytes of a block of queries (all that the driver and a task hold of them at once), and of a chunk of rows.
BLOCK_BYTES, CHUNK_BYTES = 64 << 20, 32 << 20


def usable(rows: DataFrame, id_col: str, vector_col: str, name: str, zero: bool = True, **more: Column) -> tuple[DataFrame, int]:
    """(id, vec array<double>, and more, in the shared folder; length of the vectors).

    Left out: vectors that are null or empty, hold a null or non-finite component, (unless zero) are all
    zero, or are not as long as most (of equally frequent lengths the shortest counts).
    """
    kept = rows.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("vec"), *[c.alias(n) for n, c in more.items()])
    good = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & (F.size("vec") > 0)
    kept = kept.where(F.coalesce(good if zero else good & F.exists("vec", lambda x: x != 0), F.lit(False)))
    kept = stored(kept, name)
    most = kept.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 0
    return kept.where(F.size("vec") == dim), dim


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows of a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def blocks(queries: DataFrame, bytes_each: int, name: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Distinct rows of queries in blocks of about limit bytes, one at a time; rows are dealt by a hash of all columns."""
    every = stored(queries.distinct().withColumn("block", F.xxhash64(*queries.columns)), name)
    number = max(1, -(-every.count() * bytes_each // limit))
    for k in range(number):
        block = every.where(F.pmod("block", F.lit(number)) == k).drop("block").toArrow()
        if block.num_rows:
            yield block.combine_chunks()


def chunks(batches: Iterator[pa.RecordBatch], dim: int, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """A task's rows in tables of about limit bytes, ordered by id (nulls last)."""
    held, rows, most = [], 0, max(1, limit // (8 * max(1, dim)))
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most - rows)
            held.append(part)
            rows, at = rows + part.num_rows, at + part.num_rows
            if rows == most:
                yield ordered(held)
                held, rows = [], 0
    if rows:
        yield ordered(held)


def ordered(held: list[pa.RecordBatch]) -> pa.Table:
    out = pa.Table.from_batches(held)
    return out.take(pc.sort_indices(out["id"])).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    found = table[name].combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def own_rows(chunk: pa.Array, queries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each query the range of rows of a chunk (ordered by id) that have its id."""
    first = pc.index_in(queries, value_set=chunk)
    begin = pc.fill_null(first, len(chunk)).to_numpy().astype(np.int64)
    new = np.ones(len(chunk) + 1, bool)
    if len(chunk) > 1:
        new[1:-1] = pc.fill_null(pc.not_equal(chunk.slice(1), chunk.slice(0, len(chunk) - 1)), False).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(new)
    end = edges[np.minimum(np.searchsorted(edges, begin, "right"), len(edges) - 1)]
    return begin, np.maximum(begin, end)
