"""Language-model scores from a subword lattice.

Each word is a lattice over its bytes: arcs are the pieces of an existing vocabulary (and single
bytes), and a word's probability is the sum over all segmentations, by a forward recursion in log
space. Arc weights start at the vocabulary's scores and are re-estimated on all training words
(expected counts by forward and backward recursion).

A corpus has texts of several kinds, so there are KINDS such lattices, each learned from the texts that
are nearest to it. A text's score is the log10 of its marginal probability: over the kinds, over all
segmentations of each word, and its end. Kinds begin at a few texts that are far from each other and
are re-estimated on all training texts.

Tasks cut texts into chunks with a local vocabulary and numbered documents. Chunks' words meet the
global counts by one join on the word and go back to their chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import quoted, shared_dir, stored, table, texts, with_fields

VOCABULARY = "piece_bpe_32k.model"
#: Bytes of text in a chunk; rounds of re-estimation; words that a lattice pass takes at once.
CHUNK, ROUNDS, WORDS = 16 << 20, 4, 50_000
#: Lattices; slots of a text's histogram of three-byte runs; rounds over all training texts.
KINDS, SLOTS, KIND_ROUNDS = 4, 4096, 2
#: Bounds of the texts that kinds begin at, in the order of a hash: different texts, and bytes after which no more are taken.
SEEDS, SEED_BYTES = 1000, 16 << 20
#: Bytes of words of one length that are worked on at a time.
CELLS = 1 << 20
#: Expected count that all pieces start with, spread as the vocabulary's own scores.
PRIOR = 100.0


@dataclass(frozen=True)
class Trie:
    """Pieces as byte paths. piece[node] is a number, or -1. The last piece is the end of a word."""

    step: np.ndarray  # (node, byte) -> node, 0 if none
    piece: np.ndarray
    first: np.ndarray  # whether a piece begins a word
    prior: np.ndarray


def load(name: str = VOCABULARY) -> Trie:
    """The lower-case pieces of a vocabulary, all single bytes, and the end of a word."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    scored: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        text = model.id_to_piece(i)
        if "▁" in text[1:] or text != text.lower():
            continue
        scored.setdefault(text.replace("▁", " ").encode(), model.get_score(i))
    ranked = min(scored.values(), default=0) < -100  # merge order instead of log probabilities
    weight = {k: 1 / (2.7 - v) if ranked else float(np.exp(v)) for k, v in scored.items()}
    least = min(weight.values(), default=1.0) / 10
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    paths = sorted(weight)
    step, piece = [dict()], [-1]
    for number, path in enumerate(paths):
        node = 0
        for b in path:
            if b not in step[node]:
                step[node][b] = len(step)
                step.append({})
                piece.append(-1)
            node = step[node][b]
        piece[node] = number
    dense = np.zeros((len(step), 256), np.int32)
    for node, to in enumerate(step):
        if to:
            dense[node, list(to)] = list(to.values())
    first = np.array([p[:1] == b" " for p in paths] + [False])
    prior = np.array([weight[p] for p in paths] + [0.0])
    prior[-1] = prior[~first].sum() / 3
    return Trie(dense, np.array(piece), first, normalised(prior, first))


def normalised(weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pieces that begin words sum to one, and so do the others with the end."""
    out = weight.astype(float).copy()
    for side in (first, ~first):
        out[side] /= out[side].sum()
    return out


TRIES: dict[str, Trie] = {}


def trie(name: str) -> Trie:
    if name not in TRIES:
        TRIES[name] = load(name)
    return TRIES[name]


class Lattice:
    """Forward and backward recursions over many words of one length at a time."""

    def __init__(self, t: Trie, weights: np.ndarray):
        self.t = t
        with np.errstate(divide="ignore"):
            log = np.log(weights)
        self.end = log[-1]
        self.log = np.where(t.piece >= 0, log[t.piece], -np.inf)

    def forward(self, words: np.ndarray, arcs: list | None = None) -> np.ndarray:
        """(position, word) log probabilities of all ways to reach a position. words: (word, byte)."""
        count, length = words.shape
        alpha = np.full((length + 1, count), -np.inf)
        alpha[0] = 0
        everyone = np.arange(count)
        for i in range(length):
            who, node, j = everyone, np.zeros(count, np.int32), i
            while j < length:
                node = self.t.step[node, words[who, j]]
                alive = node > 0
                if not alive.all():
                    who, node = who[alive], node[alive]
                if not len(who):
                    break
                j += 1
                is_piece = self.t.piece[node] >= 0
                w, n = who[is_piece], node[is_piece]
                if len(w):
                    alpha[j, w] = np.logaddexp(alpha[j, w], alpha[i, w] + self.log[n])
                    if arcs is not None:
                        arcs.append((i, j, w, n))
        return alpha

    def expected(self, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations."""
        arcs: list = []
        alpha = self.forward(words, arcs)
        total = alpha[-1]
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        out = np.zeros(len(self.t.prior))
        for i, j, w, n in reversed(arcs):
            arc = self.log[n] + beta[j, w]
            beta[i, w] = np.logaddexp(beta[i, w], arc)
        for i, j, w, n in arcs:
            share = np.exp(alpha[i, w] + self.log[n] + beta[j, w] - total[w]) * weight[w]
            out += np.bincount(self.t.piece[n], share, len(out))
        out[-1] += weight.sum()
        return out


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, (word, byte) with a leading space) for words of the same length, in parts."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(n, kind="stable")
    cuts = np.flatnonzero(np.diff(n[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(words)]):
        size = int(n[order[a]]) + 1
        for x in range(a, b, max(1, CELLS // size)):
            rows = order[x : min(b, x + max(1, CELLS // size))]
            yield rows, np.frombuffer(b"".join(b" " + words[r] for r in rows), np.uint8).reshape(len(rows), size)


def log_probabilities(lattice: Lattice, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    out = np.zeros(len(words))
    for rows, w in by_length(words):
        out[rows] = lattice.forward(w)[-1] + lattice.end
    return out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= WORDS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def histogram(text: bytes) -> np.ndarray:
    """How often each slot of SLOTS is met by the runs of three bytes."""
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) if len(x) > 2 else x[:0]
    return np.bincount(h >> np.uint32(32 - 12), minlength=SLOTS)


def begun(hist: np.ndarray, kinds: int = KINDS) -> np.ndarray:
    """(kind, slot): log shares of texts that are far from each other, by their histograms."""
    share = (hist + 0.1) / (hist + 0.1).sum(axis=1, keepdims=True)
    log = np.log(share)
    far = np.full(len(hist), np.inf)
    size = hist.sum(axis=1)
    picked = [int(size.argmax())]
    while len(picked) < kinds:
        far = np.minimum(far, (share * (log - log[picked[-1]])).sum(axis=1) * (size >= np.median(size)))
        picked.append(int(far.argmax()))
    return log[picked]


def mass(hist: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """(kind, slot): what each kind has of the histograms, by its share of each text."""
    fit = (hist @ centre.T.astype(hist.dtype)).astype(np.float64) * (200 / np.maximum(1, hist.sum(axis=1, dtype=np.float64)))[:, None]  # long texts do not decide alone
    r = np.exp(fit - fit.max(axis=1, keepdims=True))
    return ((r / r.sum(axis=1, keepdims=True)).T.astype(hist.dtype) @ hist).astype(np.float64)


def centred(total: np.ndarray) -> np.ndarray:
    return np.log((total + 0.1) / (total + 0.1).sum(axis=1, keepdims=True))


def histograms(rows: list[str]) -> np.ndarray:
    out = np.zeros((len(rows), SLOTS), np.float32)
    for i, x in enumerate(rows):
        out[i] = histogram(x.encode("utf-8", "surrogatepass").lower())
    return out


def kinds(rows: DataFrame) -> np.ndarray:
    """(kind, slot) of the texts of rows (text, learn) to learn from; equal kinds where there are none.

    Expectation and maximisation over all training texts, KIND_ROUNDS times: a task sends one sum for each
    kind and slot. Only the beginning comes from SEEDS different texts and SEED_BYTES.
    """
    known = rows.where("learn and text <> ''")
    keys = known.select(F.xxhash64("text").alias("h"), F.octet_length("text").alias("b")).groupBy("h").agg(F.max("b").alias("b"))
    least = keys.orderBy(F.xxhash64("h"), "h").limit(SEEDS).withColumn("before", F.sum("b").over(Window.orderBy(F.xxhash64("h"), "h").rowsBetween(Window.unboundedPreceding, -1)))
    least = least.where(F.coalesce("before", F.lit(0)) < SEED_BYTES).select("h")
    some = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(least), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hist = histograms(texts(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in hist], pa.binary())], ["h", "hist"])

    found = some.mapInArrow(seeds, "h long, hist binary").orderBy(F.xxhash64("h"), "h").collect()  # SEEDS rows at most
    if not found:
        return np.zeros((KINDS, SLOTS))
    centre = begun(np.array([np.frombuffer(r["hist"], np.float32) for r in found], np.float64))
    for _ in range(KIND_ROUNDS):
        sent = rows.sparkSession.sparkContext.broadcast(centre)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            out = np.zeros((KINDS, SLOTS))
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    out += mass(histograms(texts(batch.slice(a, 256), "text")), sent.value)
            k, at = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(out[k, at])], ["kind", "slot", "n"])

        total = np.zeros((KINDS, SLOTS))
        # sums of doubles in the order of their size, so that the same texts give the same kinds
        for r in known.select("text").mapInArrow(run, "kind long, slot long, n double").groupBy("kind", "slot").agg(F.expr("aggregate(array_sort(collect_list(n)), 0e0, (s, x) -> s + x)").alias("n")).collect():
            total[r["kind"], r["slot"]] = r["n"]
        centre = centred(total)
    return centre


class Chunk:
    """A chunk in the making: its words are numbered as they are met."""

    def __init__(self, number: int, id_type: pa.DataType, kinds: np.ndarray):
        self.number, self.id_type, self.kinds = number, id_type, kinds
        self.words: dict[bytes, int] = {}
        self.learned: list[list[np.ndarray]] = [[] for _ in kinds]
        self.size = 0

    def add(self, text: str, learn: bool) -> np.ndarray:
        number = self.words.setdefault
        raw = text.encode("utf-8", "surrogatepass").lower()
        ids = np.array([number(w, len(self.words)) for w in raw.split()], np.uint32)
        if learn:
            self.learned[int((self.kinds @ histogram(raw)).argmax())].append(ids)
        self.size += len(text) + 1
        return ids

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each word, and one for the chunk with the numbers of documents learned from."""
        counts = [np.bincount(np.concatenate([*x, np.zeros(0, np.uint32)]), minlength=len(self.words)) for x in self.learned]
        every = list(self.words)
        for a in range(0, len(every), WORDS):
            part = every[a : a + WORDS]
            c = {f"c{k}": pa.array(x[a : a + len(part)], pa.int64()) for k, x in enumerate(counts)}
            yield batch_of(self.number, self.id_type, n=pa.array(range(a, a + len(part)), pa.int64()), w=pa.array(part, pa.binary()), **c)
        yield batch_of(self.number, self.id_type, n=pa.array([-1], pa.int64()), **{f"c{k}": pa.array([len(x)], pa.int64()) for k, x in enumerate(self.learned)})


COUNTS = [f"c{k}" for k in range(KINDS)]


def batch_of(chunk: int, id_type: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "n": pa.int64(), "w": pa.binary(), **{c: pa.int64() for c in COUNTS}, "id": id_type, "ids": pa.binary()}
    size = len(columns["n"])
    columns["chunk"] = pa.array(np.full(size, chunk))
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(size, t)) for k, t in kinds.items()], list(kinds))


def chunked(rows: DataFrame, kinds: np.ndarray) -> DataFrame:
    """Documents as numbers of words, and words, by chunk; in the shared folder. rows: id, text, learn.

    Rows with w are words: chunk, n (their number in the chunk), w, c0 ... (counts in documents to
    learn from, by kind). Rows with ids are documents: chunk, id, ids (Zstandard of their words'
    numbers), n (words). Rows with neither are chunks: c0 ... (documents to learn from, by kind).
    """
    sent = rows.sparkSession.sparkContext.broadcast(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, z = None, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, learn = batch.column(0), batch.column(2).to_pylist()
            if chunk is None:
                chunk = Chunk(TaskContext.get().partitionId() << 32, ids.type, sent.value)
            at, found = 0, []
            for i, text in enumerate(texts(batch, "text")):
                found.append(chunk.add(text, learn[i]))
                if chunk.size >= CHUNK or i + 1 == batch.num_rows:
                    yield batch_of(chunk.number, ids.type, n=pa.array([len(x) for x in found], pa.int64()), id=ids.slice(at, len(found)), ids=pa.array([z.compress(x.tobytes()) for x in found], pa.binary()))
                    at, found = i + 1, []
                if chunk.size >= CHUNK:
                    yield from chunk.rows()
                    chunk = Chunk(chunk.number + 1, ids.type, sent.value)
        if chunk is not None:
            yield from chunk.rows()

    schema = StructType.fromDDL(f"chunk long, n long, w binary, {', '.join(f'{c} long' for c in COUNTS)}").add("id", rows.schema["id"].dataType).add("ids", "binary")
    return stored(rows.mapInArrow(run, schema), "lm-chunks")


@dataclass(frozen=True)
class Totals:
    """tokens and types (with the end) of all; by kind the ends and words."""

    tokens: int
    types: int
    ends: np.ndarray
    words: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def end(self) -> float:
        """Probability of the end after any word."""
        ends = int(self.ends.sum())
        return ends / self.tokens if 0 < ends < self.tokens else 0.5

    def share(self) -> np.ndarray:
        """log10 of the kinds' shares of the documents, each with one more."""
        return np.log10((self.ends + 1) / (self.ends + 1).sum())

    def text(self, lp: np.ndarray) -> float:
        """log10 probability of a text, of its words' (word, kind) log10 probabilities."""
        every = (lp.sum(axis=0) + self.share()) * np.log(10)
        return float(np.logaddexp.reduce(every) / np.log(10) + len(lp) * np.log10(1 - self.end()) + np.log10(self.end()))


def totals(counts: DataFrame, ends: np.ndarray) -> Totals:
    r = counts.agg(F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum("c").alias("n"), *[F.sum(c).alias(c) for c in COUNTS]).first()
    return Totals((r["n"] or 0) + int(ends.sum()), (r["v"] or 0) + (ends.sum() > 0), ends, np.array([r[c] or 0 for c in COUNTS]))


def estimate(counts: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """(kind, piece): weights after rounds of re-estimation on all training words, by their counts.

    A task sends one row for each kind and piece, so the driver gets as many rows as there are of them.
    """
    t = load(vocabulary)
    weights = np.array([t.prior] * KINDS)
    known = counts.where("c > 0").select("w", *COUNTS)
    for _ in range(rounds):
        sent = counts.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattices = [Lattice(trie(vocabulary), w) for w in sent.value]
            out = np.zeros(sent.value.shape)
            for part in gathered(batches):
                every = part.column(0).to_pylist()
                for k, lattice in enumerate(lattices):
                    c = part.column(k + 1).to_numpy()
                    mine = np.flatnonzero(c)
                    for rows, w in by_length([every[i] for i in mine]):
                        out[k] += lattice.expected(w, c[mine[rows]].astype(float))
            k, at = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(out[k, at])], ["kind", "piece", "n"])

        expected = PRIOR * np.array([t.prior] * KINDS)
        for r in known.mapInArrow(run, "kind long, piece long, n double").groupBy("kind", "piece").agg(F.sum("n").alias("n")).collect():
            expected[r["kind"], r["piece"]] += r["n"]
        weights = np.array([normalised(e, t.first) for e in expected])
    return weights


@dataclass(frozen=True)
class Learned:
    rows: DataFrame  # chunked()
    counts: DataFrame  # w, c, c0 ...
    totals: Totals
    weights: np.ndarray


def fit(docs: DataFrame, learn: Column, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> Learned:
    """What score() needs: all texts in chunks, and what the marked ones teach."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    rows = chunked(rows, kinds(rows))
    counts = rows.where("w is not null").groupBy("w").agg(*[F.sum(c).alias(c) for c in COUNTS])
    counts = stored(counts.withColumn("c", F.expr(" + ".join(COUNTS))), "lm-counts")
    ends = rows.where("w is null and ids is null").agg(*[F.sum(c).alias(c) for c in COUNTS]).first()
    return Learned(rows, counts, totals(counts, np.array([ends[c] or 0 for c in COUNTS])), estimate(counts, vocabulary))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """<id_col>, n_tokens, n_known, train_tokens, base_score, score for every row.

    Words are runs of other characters than white space (U+0020, U+0009 to U+000D), A-Z in lower
    case; every text, null and empty ones too, has one end; whole texts of any length count. learn
    marks the rows to learn from (null: no). With nothing to learn from the lattice alone scores,
    with the vocabulary's weights. Repeated rows are scored alike, whatever their ids. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    m = fit(docs, learn, id_col, text_col, vocabulary)
    t, sent = m.totals, spark.sparkContext.broadcast(m.weights)
    pairs = [f"p{i}" for i in range(-(-KINDS // 2))]  # two kinds' log10 probabilities in one long

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = [Lattice(trie(vocabulary), w) for w in sent.value]
        for part in gathered(batches):
            w = part.column(0).to_pylist()
            lp = np.zeros((len(w), 2 * len(pairs)), np.float32)
            for k, lattice in enumerate(lattices):
                lp[:, k] = log_probabilities(lattice, w) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), part.column(1).combine_chunks(), *[pa.array(x) for x in lp.view(np.int64).T]], ["w", "c", *pairs])

    weighed = m.counts.select("w", "c").mapInArrow(weigh, f"w binary, c long, {', '.join(f'{p} long' for p in pairs)}")
    values = m.rows.where("w is not null").select("chunk", "n", "w").join(weighed, "w").select("chunk", "n", "c", *pairs)

    def add_up(v: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        at = v["n"].to_numpy()
        c, lp = np.zeros(len(v), np.int64), np.zeros((len(v), len(pairs)), np.int64)
        c[at], lp[at] = v["c"].to_numpy(), v[pairs].to_numpy()
        base, lp, z = t.base(c), lp.view(np.float32)[:, :KINDS], zstandard.ZstdDecompressor()
        out = []
        for ids in d["ids"]:
            x = np.frombuffer(z.decompress(bytes(ids)), np.uint32).astype(np.int64)
            out.append((len(x) + 1, int((c[x] > 0).sum()) + bool(t.ends.sum()), t.tokens, float(base[x].sum() + t.base(t.ends.sum())), t.text(lp[x].astype(np.float64))))
        out = pd.DataFrame(out, columns=["n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return pd.concat([d[["id"]].reset_index(drop=True), out], axis=1)

    documents = m.rows.where("ids is not null").select(F.col("chunk").alias("of"), "id", "ids")
    schema = with_fields(documents.select("id"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"))
    return values.groupBy("chunk").cogroup(documents.groupBy("of")).applyInPandas(add_up, schema).withColumnRenamed("id", id_col)


def op2_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return score(docs, ~held_out).withColumn("held_out", held_out)
