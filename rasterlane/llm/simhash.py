"""SimHash near-duplicates, found exactly with vantage-point trees.

Distinct fingerprints are dealt to shards by the top of a vantage-point tree that is built on a
bounded sample. A fingerprint also goes as a query to every shard that its ball overlaps. Each shard
builds a tree of its own fingerprints and searches it, pruning by the triangle inequality, so every
pair within the radius meets in some shard. A shard returns one row per fingerprint (its local
component), never pairs; components that share a fingerprint are merged across shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, least_keys, least_rows, quoted, released, row_key, shared_dir, stored, table, texts, with_fields

#: Distinct fingerprints that a shard should hold (a few hundred bytes of working memory each);
#: bound of the sample that deals them out, and its size for each shard.
SHARD_ROWS, SAMPLE, SAMPLE_PER_SHARD = 100_000, 1 << 20, 64
LEAF = 48
#: Candidates that a search compares at once, however dense a shard is.
CANDIDATES = 1 << 20
#: Candidates for a vantage point, and rows on which their spread is measured.
TRIED, MEASURED = 8, 256
SEED = 42


def fingerprints(rows: list[str], width: int = 3) -> np.ndarray:
    """64-bit SimHash of each text over its word shingles, repeats included."""
    digest, out = xxhash.xxh64_digest, np.zeros(len(rows), np.uint64)
    for i, text in enumerate(rows):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        last = ends[width - 1 :] - 1 if len(words) >= width else ends[-1:] - 1
        first = np.concatenate([[0], ends[: len(last) - 1]])
        ones, n = np.zeros(64, np.int64), len(last)
        for a in range(0, n, 65_536):
            cut = slice(a, a + 65_536)
            buf = b"".join([digest(joined[x:y], SEED) for x, y in zip(first[cut].tolist(), last[cut].tolist())])
            bits = np.unpackbits(np.frombuffer(buf, np.uint8)).view(np.uint64).reshape(-1, 8)
            for b in range(0, len(bits), 255):  # eight bits' counts in a word, each below 256
                ones += np.add.reduce(bits[b : b + 255], axis=0).view(np.uint8)
        out[i] = np.packbits(2 * ones > n).view(">u8")[0]
    return out


@dataclass
class VPTree:
    """Nodes hold a vantage point and a radius mu; inner has distances up to mu, outer the rest."""

    vantage: np.ndarray
    mu: np.ndarray
    inner: np.ndarray
    outer: np.ndarray  # children: node numbers, or -1 - leaf
    leaves: list[np.ndarray]  # row numbers

    @staticmethod
    def build(points: np.ndarray, leaf: int, seed: int = 7) -> VPTree:
        rng = np.random.default_rng(seed)
        vantage, mu, child, leaves = [], [], [], []
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            d = None
            if len(rows) > leaf:
                tried = points[rows[rng.integers(len(rows), size=TRIED)]]
                some = points[rows[rng.integers(len(rows), size=MEASURED)]]
                v = tried[np.bitwise_count(tried[:, None] ^ some[None]).std(axis=1).argmax()]  # the widest spread prunes most
                d = np.bitwise_count(points[rows] ^ v)
                if d.max() == 0:  # all the same
                    d = None
            if d is None:
                number = -1 - len(leaves)
                leaves.append(rows)
            else:
                number = len(vantage)
                m = min(int(np.median(d)), int(d.max()) - 1)
                vantage.append(v)
                mu.append(m)
                child.append([0, 0])
                todo += [(rows[d <= m], number, 0), (rows[d > m], number, 1)]
            if parent is not None:
                child[parent][side] = number
        c = np.array(child, np.int64).reshape(-1, 2)
        return VPTree(np.array(vantage, np.uint64), np.array(mu, np.int64), c[:, 0], c[:, 1], leaves)

    def reach(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, leaf) for every leaf that a query's ball may overlap."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64) if len(self.vantage) else np.full(len(queries), -1)
        out_q, out_leaf = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(q):
            done = node < 0
            out_q.append(q[done])
            out_leaf.append(-1 - node[done])
            q, node = q[~done], node[~done]
            d = np.bitwise_count(queries[q] ^ self.vantage[node]).astype(np.int64) if len(q) else np.zeros(0, np.int64)
            near, far = d - radius <= self.mu[node], d + radius > self.mu[node]
            q, node = np.concatenate([q[near], q[far]]), np.concatenate([self.inner[node[near]], self.outer[node[far]]])
        return np.concatenate(out_q), np.concatenate(out_leaf)

    def pairs(self, points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, point row) for all pairs within the radius, about CANDIDATES at a time."""
        every_q, every_leaf = self.reach(queries, radius)
        sizes = np.fromiter(map(len, self.leaves), np.int64, len(self.leaves))
        begin, rows = np.cumsum(sizes) - sizes, np.concatenate(self.leaves)
        for a, b in cuts(sizes[every_leaf], CANDIDATES):
            q, leaf = every_q[a:b], every_leaf[a:b]
            n = sizes[leaf]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[leaf], n)
            q, p = np.repeat(q, n), rows[at]
            near = np.bitwise_count(queries[q] ^ points[p]) <= radius
            yield q[near], p[near]


def cuts(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of about limit candidates; a larger one stands alone."""
    part = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def local_components(points: np.ndarray, home: np.ndarray, radius: int, at_once: int = 1024) -> np.ndarray:
    """For each point the smallest point that it reaches over links to home points."""
    order = np.argsort(points, kind="stable")
    points, home = points[order], home[order]
    own = np.flatnonzero(home)
    parent = np.arange(len(points))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(own):
        tree = VPTree.build(points[own], LEAF)
        for a in range(0, len(points), at_once):
            for q, p in tree.pairs(points[own], points[a : a + at_once], radius):
                q, p = q + a, own[p]
                link = np.unique(np.stack([parent[q], parent[p]], 1)[parent[q] != parent[p]], axis=0)
                for x, y in link.tolist():
                    x, y = root(x), root(y)
                    parent[max(x, y)] = min(x, y)
                while (parent[parent] != parent).any():
                    parent = parent[parent]
    out = np.empty_like(points)
    out[order] = points[parent]
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keys: bool = False) -> DataFrame:
    """__id, fp (long), and with keys __row and __digest, for every row, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found = fingerprints(texts(batch, "__text"), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], "fp"])

    rows = docs.select(F.col(quoted(id_col)).alias("__id"), *[c.alias(n) for n, c in row_key(docs, text_col).items() if keys], F.col(quoted(text_col)).alias("__text"))
    return stored(rows.mapInArrow(run, with_fields(rows.drop("__text"), ("fp", "long"))), "simhash")


def link_components(fps: DataFrame, radius: int, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(fp, root) for the fingerprints that have a neighbour within the radius. fps: distinct fp."""
    count = fps.count()
    shards = max(1, -(-count // shard_rows))
    chosen = fps.orderBy(F.xxhash64("fp"), "fp").limit(min(sample, SAMPLE_PER_SHARD * shards)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    top = VPTree.build(chosen, max(1, -(-len(chosen) // shards)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            x = f.view(np.uint64)
            q0, home = top.reach(x, 0)  # one leaf for each point, not in the points' order
            own = np.empty(len(x), np.int64)
            own[q0] = home
            q, leaf = top.reach(x, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(f[q]), pa.array(own[q] == leaf)], ["shard", "fp", "home"])

    def search(part: pd.DataFrame) -> pd.DataFrame:
        x = part["fp"].to_numpy(np.int64).view(np.uint64)
        r = local_components(x, part["home"].to_numpy(bool), radius)
        _, number, size = np.unique(r, return_inverse=True, return_counts=True)
        held = size[number] > 1
        return pd.DataFrame({"fp": x[held].view(np.int64), "root": r[held].view(np.int64)})

    dealt = fps.mapInArrow(deal, "shard long, fp long, home boolean")
    found = stored(dealt.groupBy("shard").applyInPandas(search, "fp long, root long"), "simhash-shards")
    return merged(found)


def merged(found: DataFrame) -> DataFrame:
    """(fp, root) over all shards, of rows (fp, root) that each shard found."""
    one = found.groupBy("fp").agg(F.min("root").alias("a"))
    ties = found.join(one, "fp").where("root <> a").select("a", F.col("root").alias("b")).distinct()
    if not ties.take(1):
        return one.select("fp", F.col("a").alias("root"))
    tied = components(ties)
    return one.join(tied, one["a"] == tied["node"], "left").select("fp", F.coalesce("root", "a").alias("root"))


def roots_of(rows: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(fp, root, component_id) of rows (__id, fp): each component's smallest fingerprint and id."""
    fps = stored(rows.groupBy("fp").agg(F.min("__id").alias("low")), "simhash-distinct")
    roots = link_components(fps.select("fp"), radius, shard_rows)
    joined = fps.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return joined.join(joined.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per input row: <id_col>, fingerprint (16 hex digits), component_id, fp (long).

    component_id is the smallest id that is reachable over links of at most radius differing bits,
    itself included. Null and empty texts have fingerprint zero and link like any other; whole texts
    of any length count; repeated rows and rows that share an id each give a row. Null ids count as
    larger than all others. An empty table gives an empty result; other columns are not read.
    """
    shared_dir(docs.sparkSession)
    rows = fingerprint_table(docs, id_col, text_col, width)
    out = rows.join(roots_of(rows, radius, shard_rows), "fp", "left")
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def keyed_roots(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> DataFrame:
    """__id, __row, __digest, fp, root for every row."""
    shared_dir(docs.sparkSession)
    rows = fingerprint_table(docs, id_col, text_col, width, keys=True)
    return rows.join(roots_of(rows, radius, SHARD_ROWS).select("fp", "root"), "fp")


def kept_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """The keys (__row, __digest) of the rows that keep_one keeps."""
    return least_keys(keyed_roots(docs, id_col, text_col, width, radius), ["root"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs that stay when one row of each component does: that with the smallest id (see least_rows)."""
    return least_rows(docs, keyed_roots(docs, id_col, text_col, width, radius), id_col, text_col, ["root"])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
