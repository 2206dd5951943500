"""Quality scores from a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters run over every
chunk (windows of 2 * STEP bytes), the strongest answer of each filter in a chunk is kept, and the
mean, the largest and the smallest of these over the chunks are combined into one probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts, with_fields

#: Bytes of a chunk and between chunk starts; bytes of half a window; embedding size; filters.
CHUNK, STRIDE, STEP, EMBED, FILTERS = 512, 448, 4, 8, 24
#: Bounds of the labelled rows that the network learns from, for each class, in the order of a hash:
#: rows, and bytes of text after which no further row is taken. A row that is taken counts whole.
ROWS_PER_CLASS, BYTES_PER_CLASS = 1500, 16 << 20
EPOCHS, DOCS_AT_ONCE, RATE = 8, 32, 0.004
#: Chunks that are scored at a time, and that pass through the filters together.
CHUNKS, PART = 2048, 128
THRESHOLD = 0.3


def chunk_starts(size: int) -> np.ndarray:
    """Starts of chunks that cover size bytes; the last ends with the text."""
    if size <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, size - CHUNK, STRIDE)
    return np.append(starts, size - CHUNK)


def chunks_of(raw: bytes) -> np.ndarray:
    """(chunk, byte); a text shorter than a chunk repeats, an empty one is zeros."""
    x = np.frombuffer(raw, np.uint8)
    if len(x) <= CHUNK:
        return np.resize(x, (1, CHUNK)) if len(x) else np.zeros((1, CHUNK), np.uint8)
    at = chunk_starts(len(x))
    return np.lib.stride_tricks.sliding_window_view(x, CHUNK)[at]


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    early: np.ndarray  # (STEP * EMBED, FILTERS): first half of a window
    late: np.ndarray  # second half
    bias: np.ndarray
    out: np.ndarray  # (3 * FILTERS,): of mean, largest, smallest
    base: np.ndarray  # (1,)

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        width = STEP * EMBED
        return Network(draw(256, EMBED, scale=1), draw(width, FILTERS, scale=width**-0.5), draw(width, FILTERS, scale=width**-0.5), np.zeros(FILTERS, np.float32), draw(3 * FILTERS, scale=0.1), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.early, self.late, self.bias, self.out, self.base]

    def windows(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embedded bytes, filter answers before the rectifier) of chunks."""
        e = self.embed[chunks].reshape(len(chunks), CHUNK // STEP, STEP * EMBED)
        return e, (e @ self.early)[:, :-1] + (e @ self.late)[:, 1:] + self.bias

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, filter): the strongest answer."""
        return np.maximum(self.windows(chunks)[1].max(axis=1), 0)

    def combined(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of texts whose chunks begin at the given rows.

        Each text's products are summed on their own and in one order, so that a score does not
        depend on the texts beside it.
        """
        sizes = np.diff(np.append(starts, len(pooled)))[:, None]
        f = np.hstack([np.add.reduceat(pooled, starts, dtype=np.float64) / sizes, np.maximum.reduceat(pooled, starts), np.minimum.reduceat(pooled, starts)])
        return np.cumsum(f * self.out.astype(np.float64), axis=1)[:, -1] + float(self.base[0])

    def score(self, rows: list[bytes]) -> np.ndarray:
        """A probability for each text; long texts are worked on in parts."""
        pooled, starts, held, waiting, n = [], [], [], 0, 0
        for raw in rows:
            starts.append(n)
            c = chunks_of(raw)
            n += len(c)
            for a in range(0, len(c), CHUNKS):
                held.append(c[a : a + CHUNKS])
                waiting += len(held[-1])
                if waiting >= CHUNKS:
                    pooled.append(self.pooled_in_parts(np.concatenate(held)))
                    held, waiting = [], 0
        if held:
            pooled.append(self.pooled_in_parts(np.concatenate(held)))
        return 1 / (1 + np.exp(-self.combined(np.concatenate(pooled), np.array(starts)))) if rows else np.zeros(0)

    def pooled_in_parts(self, chunks: np.ndarray) -> np.ndarray:
        """pooled(), in parts that stay in the processor's cache."""
        return np.concatenate([self.pooled(chunks[a : a + PART]) for a in range(0, len(chunks), PART)])

    def winners(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, filter): the window with the strongest answer, and that answer before the rectifier."""
        top, best = [], []
        for a in range(0, len(chunks), PART):
            z = self.windows(chunks[a : a + PART])[1]
            top.append(z.argmax(axis=1))
            best.append(np.take_along_axis(z, top[-1][:, None], 1)[:, 0])
        return np.concatenate(top), np.concatenate(best)

    def gradients(self, chunks: np.ndarray, starts: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        top, best = self.winners(chunks)
        pooled = np.maximum(best, 0)
        ends = np.append(starts[1:], len(pooled))
        sizes = (ends - starts).astype(np.float32)[:, None]
        mean, most, least = np.add.reduceat(pooled, starts) / sizes, np.maximum.reduceat(pooled, starts), np.minimum.reduceat(pooled, starts)
        f = np.hstack([mean, most, least])
        p = 1 / (1 + np.exp(-(f @ self.out + self.base[0])))
        d = ((p - target) * weight / weight.sum()).astype(np.float32)
        df = d[:, None] * self.out[None]
        doc = np.repeat(np.arange(len(starts)), ends - starts)
        dp = (df[:, :FILTERS] / sizes)[doc]
        for part, picked in ((df[:, FILTERS : 2 * FILTERS], most), (df[:, 2 * FILTERS :], least)):
            here = pooled == picked[doc]
            dp += here * part[doc] / np.maximum(np.add.reduceat(here.astype(np.float32), starts), 1)[doc]
        dp *= best > 0
        d_embed, d_early, d_late = np.zeros_like(self.embed), np.zeros_like(self.early), np.zeros_like(self.late)
        for x in range(0, len(chunks), CHUNKS):
            part, grad, at = chunks[x : x + CHUNKS], dp[x : x + CHUNKS], top[x : x + CHUNKS]
            halves, rows = part.reshape(len(part), -1, STEP), np.arange(len(part))[:, None]
            for to, out, w in ((at, d_early, self.early), (at + 1, d_late, self.late)):
                seen = halves[rows, to]  # (chunk, filter, STEP): the bytes of the strongest windows
                out += np.einsum("cf,cfk->kf", grad, self.embed[seen].reshape(*seen.shape[:2], STEP * EMBED))
                back = (grad[:, :, None] * w.T[None]).reshape(-1, EMBED)
                np.add.at(d_embed, seen.reshape(-1), back)
        return [d_embed, d_early, d_late, dp.sum(0), d @ f, d.sum(keepdims=True)]


def train(rows: list[tuple[bytes, int, float]]) -> Network:
    """Fits a network to (text, label, weight) with Adam; the same rows give the same network."""
    net = Network.fresh()
    share = sum(w for _, y, w in rows if y) / max(sum(w for *_, w in rows), 1e-9) if rows else 0.5
    share = min(max(share, 0.01), 0.99)
    net.base[:] = np.log(share / (1 - share))
    if len({y for _, y, _ in rows}) < 2:
        net.out[:] = 0
        return net
    data = [chunks_of(raw) for raw, *_ in rows]
    y, w = np.array([r[1] for r in rows], np.float32), np.array([r[2] for r in rows], np.float32)
    first, second, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    rng = np.random.default_rng(5)
    steps = EPOCHS * -(-len(rows) // DOCS_AT_ONCE)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), DOCS_AT_ONCE):
            pick = order[a : a + DOCS_AT_ONCE]
            sizes = np.array([len(data[i]) for i in pick])
            g = net.gradients(np.concatenate([data[i] for i in pick]), np.cumsum(sizes) - sizes, y[pick], w[pick])
            t += 1
            rate = RATE * (1 - (t - 1) / steps)
            for p, m, v, x in zip(net.parts(), first, second, g):
                m += 0.1 * (x - m)
                v += 0.01 * (x * x - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return net


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS
) -> Network:
    """Learns from labelled rows of each class: at most rows_per_class, of bytes_per_class bytes and one row.

    They are the first in the order of a hash of id and text; each counts with all its chunks. The
    task that fits holds no more than these. Rows weigh as many as their class has, so that scores
    are probabilities for the labelled rows. Null labels, null ids and labels without a document are
    left out; an id with both labels counts in both classes; repeats of a label or of a document
    count once. Without documents or labels of both classes the network answers with the share of
    label 1 (one half without any row).
    """
    known = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("int").alias("__y")).where("__y is not null and __id is not null").distinct()
    sizes = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    every = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    picked = None
    for y, n in sorted(sizes.items()):
        some = known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows_per_class).withColumn("__w", F.lit(n / min(n, rows_per_class)))
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return train([])
    # at most two times rows_per_class ids are broadcast; an id may have many rows, so the bounds hold again for them
    found = every.join(F.broadcast(picked), "__id").dropDuplicates(["__id", "__text", "__y"]).withColumn("__h", F.xxhash64("__id", "__text"))
    rows = [found.where(F.col("__y") == y).orderBy("__h", "__id", "__text").limit(rows_per_class) for y in sorted(sizes)]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data, left = [], {}
        every = pd.concat([*batches, pd.DataFrame({"__id": [], "__text": [], "__y": [], "__w": [], "__h": []})])
        for t, y, w in every.sort_values(["__h", "__id", "__text"])[["__text", "__y", "__w"]].itertuples(index=False):
            if left.setdefault(int(y), bytes_per_class) > 0:
                raw = t.encode("utf-8", "surrogatepass")
                left[int(y)] -= len(raw)
                data.append((raw, int(y), float(w)))
        yield pd.DataFrame({"net": [pickle.dumps(train(data).parts())]})

    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    net = both.repartition(1).mapInPandas(learn, "net binary").first()
    return Network(*pickle.loads(net["net"])) if net else train([])


def scored(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= THRESHOLD); columns of these names are replaced.

    Null and empty texts get the score of an empty text, equal texts equal scores, whatever rows are
    beside them. Whole texts of any length count, in parts. An empty table gives an empty result.
    """
    kept = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = with_fields(kept, ("score", "double"), ("predicted", "int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.score([x.encode("utf-8", "surrogatepass") for x in texts(batch, text_col)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    net = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return scored(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "score", "predicted")
