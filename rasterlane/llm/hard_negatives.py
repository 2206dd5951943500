"""Hard negatives: each anchor's scores are sorted whole, and each positive reads its negatives from where they begin.

Anchors go out in blocks of bounded size, and every task of rows meets each block in chunks: a chunk's
integer scores with an anchor are one product, sorted by score and id. From the sorted chunk the anchor
takes its best rows of the same label; over all chunks the first of these are its positives. In a second
pass each positive finds its upper limit in the same order by binary search and reads the first rows of
another label down to its lower limit; over all chunks the first of these are its negatives. So no task
holds more than a block and a chunk, and what leaves a chunk has a bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, shared_path, table
from .vectors import BLOCK_BYTES, CHUNK_BYTES, blocks, chunks, column, matrix, own_rows, usable

#: Limits of a negative's score in hundredths of the positive's; positives, negatives; scale of components.
LOWER, UPPER, POSITIVES, NEGATIVES, SCALE = 30, 90, 5, 10, 256
#: Scores that a task holds at once.
SCORES = 4 << 20
#: Ends of a long.
LONG = (-(1 << 63), (1 << 63) - 1)


def products(a: np.ndarray, x: np.ndarray, scale: int) -> np.ndarray:
    """Exact inner products of floor(scale * component); held at the ends of a long beyond it."""
    with np.errstate(over="ignore"):
        left, right = np.floor(a * scale), np.floor(x * scale)
        bound = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, a.shape[1])
    if bound < 2**53:  # every sum is exact in a double
        return (left @ right.T).astype(np.int64)
    if bound < 2**62:
        return left.astype(np.int64) @ right.astype(np.int64).T
    whole = np.vectorize(lambda v: int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale), otypes=[object])
    return np.clip(whole(a) @ whole(x).T, *LONG).astype(np.int64)


def limits(score: int, lower: int, upper: int) -> tuple[int, int]:
    """(least, most) integer score n with lower * score <= 100 n <= upper * score."""
    return -(-lower * score // 100), upper * score // 100


def sorted_scores(anchors: np.ndarray, chunk: np.ndarray, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows by score descending then id, scores in that order); the chunk is ordered by id."""
    step = max(1, SCORES // max(1, len(chunk)))
    for a in range(0, len(anchors), step):
        found = products(anchors[a : a + step], chunk, scale)
        for k, row in enumerate(found):
            order = np.argsort(~row, kind="stable")  # ~row descends as row ascends, for every long
            yield a + k, order, row[order]


def same_label(order: np.ndarray, codes: np.ndarray, code: int, own: tuple[int, int], count: int) -> np.ndarray:
    """Places in the order of the first count rows with the label, the anchor's own left out."""
    fit = codes[order] == code
    fit &= (order < own[0]) | (order >= own[1])
    return np.flatnonzero(fit)[:count]


def other_label(order: np.ndarray, scores: np.ndarray, codes: np.ndarray, code: int, least: int, most: int, count: int) -> np.ndarray:
    """Places in the order of the first count rows of another label with least <= score <= most."""
    at = int(np.searchsorted(~scores, ~min(most, LONG[1]), "left")) if most >= LONG[0] else len(scores)
    out, step = [np.zeros(0, np.int64)], 4 * count
    while at < len(scores) and count > 0 and scores[at] >= least:
        end = min(len(scores), at + step)
        fit = at + np.flatnonzero((codes[order[at:end]] != code) & (scores[at:end] >= least))[:count]
        out.append(fit)
        count -= len(fit)
        at, step = end, 2 * step
    return np.concatenate(out)


def labels(chunk: pa.Table, block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the labels of chunk and block; labels that no anchor has are -1."""
    known = pc.unique(column(block, "label"))
    return tuple(pc.fill_null(pc.index_in(column(t, "label"), value_set=known), -1).to_numpy() for t in (chunk, block))


def scanned(rows: DataFrame, dim: int, block: pa.Table, read: Callable, kind: str, chunk_bytes: int) -> DataFrame:
    """(anchor, step, id, score) of the places that read(...) takes from each anchor's sorted scores over each chunk."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        a, a_ids = matrix(column(anchors, "vec")), column(anchors, "id")
        for chunk in chunks(batches, dim, chunk_bytes):
            x, ids = matrix(column(chunk, "vec")), column(chunk, "id")
            codes, of = labels(chunk, anchors)
            begin, end = own_rows(ids, a_ids)
            out = ([], [], [], [])
            for k, order, scores in sorted_scores(a, x, SCALE):
                for step, places in read(k, order, scores, codes, of[k], (begin[k], end[k])):
                    for into, values in zip(out, (np.full(len(places), k), np.full(len(places), step), order[places], scores[places])):
                        into.append(values)
                if sum(map(len, out[0])) > 1 << 18:
                    yield rows_of(out, ids)
                    out = ([], [], [], [])
            yield rows_of(out, ids)

    return rows.mapInArrow(run, f"anchor int, step int, id {kind}, score long")


def rows_of(out: tuple[list, ...], ids: pa.Array) -> pa.RecordBatch:
    anchor, step, row, score = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in out)
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(step, pa.int32()), ids.take(pa.array(row)), pa.array(score)], ["anchor", "step", "id", "score"])


def hard_negatives(
    rows: DataFrame, anchors: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    lower: int = LOWER, upper: int = UPPER, positives: int = POSITIVES, negatives: int = NEGATIVES, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the integer inner product of floor(256 * component), exact; higher scores come first, of
    ties the smaller id (null last). An anchor's positives are the first rows of its label that have
    another id; a positive's negatives are the first rows of other labels with lower * positive_score <=
    100 * negative_score <= upper * positive_score. anchors: rows as those of rows (all rows if None).

    Rows with a null label, a null vector, a null or non-finite component, or a vector that is not as
    long as most take no part. Rows that repeat are rows of their own as positives and negatives;
    anchors that repeat in id, vector and label count once. Scores beyond a long are held at its ends.
    An anchor without positives and a positive without negatives give no rows, nor does an empty table;
    other columns are not read.
    """
    spark = rows.sparkSession
    label = lambda df: F.col(quoted(label_col))
    every, dim = usable(rows, id_col, vector_col, "negatives-rows", label=label(rows))
    every = every.where(F.col("label").isNotNull())
    asked = every
    if anchors is not None:
        asked = anchors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("vec"), label(anchors).alias("label"))
        asked = asked.join(every.select("id", "vec", "label").distinct(), ["id", "vec", "label"], "left_semi")
    kind = every.schema["id"].dataType.simpleString()
    path = shared_path(spark, "negatives")
    schema = f"anchor_id {kind}, pair string, positive_id {kind}, positive_score long, negative_id {kind}, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    for number, block in enumerate(blocks(asked.select("id", "vec", "label"), 8 * dim + 64, "negatives-anchors", block_bytes)):

        def best(k, order, scores, codes, code, own):
            yield 0, same_label(order, codes, code, own, positives)

        top = scanned(every, dim, block, best, kind, chunk_bytes).withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives)
        top = top.select("anchor", "n", "id", "score").toArrow()  # at most `positives` rows for each anchor of the block
        wanted: dict[int, list[tuple[int, int]]] = {}
        for anchor, n, score in zip(*(top[c].to_pylist() for c in ("anchor", "n", "score"))):
            wanted.setdefault(anchor, []).append((n, *limits(score, lower, upper)))

        def below(k, order, scores, codes, code, own, wanted=wanted):
            for n, least, most in wanted.get(k, ()):
                if least <= most:
                    yield n, other_label(order, scores, codes, code, least, most, negatives)

        found = scanned(every, dim, block, below, kind, chunk_bytes)
        names = spark.createDataFrame(pa.table({"anchor": pa.array(range(block.num_rows), pa.int32()), "anchor_id": column(block, "id")}))
        pairs = spark.createDataFrame(pa.table({"anchor": top["anchor"], "step": top["n"], "positive_id": top["id"], "positive_score": top["score"]}))
        out = found.join(pairs, ["anchor", "step"]).join(names, "anchor")
        out.select("anchor_id", F.concat_ws("/", F.lit(number), "anchor", "step").alias("pair"), "positive_id", "positive_score", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    result = spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("pair").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    result = result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return result.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.pmod("vec_id", F.lit(100)) == 0))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE)::HUGEINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label AS other_label,
         list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)])::BIGINT AS score
  FROM e AS a, e AS b WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, anchor_label, other_id AS positive_id, score AS positive_score
  FROM s WHERE other_label = anchor_label AND other_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.other_label <> p.anchor_label
 AND 30 * p.positive_score::HUGEINT <= 100 * s.score::HUGEINT AND 100 * s.score::HUGEINT <= 90 * p.positive_score::HUGEINT
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 10
"""
