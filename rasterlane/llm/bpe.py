"""Byte-level BPE: a backtracking encoder that is exact in linear time, and a table-driven decoder.

The encoder walks a word with the longest token that starts at each place (from one Aho-Corasick
pass). A token may follow another only if merging the two tokens' text alone would give just these
two: such pairs are compatible, kept in a table that fills as pairs are met. Where the longest token
is not compatible with its predecessor the next shorter one is tried, and where none is left the walk
steps back. A sequence whose neighbours are all compatible is the one that merging gives.

Texts are cut at spaces that begin a word; a bounded cache maps what is between to its ids.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, released, spans, table, texts, with_fields

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of one generation of a worker's cache of words (it holds two at most), and characters of the
#: longest piece that is kept: a script without spaces has no words to meet again.
CACHE, LONGEST_KEPT = 64 << 20, 64
#: Characters that are decoded at a time.
BLOCK = 1 << 20
#: Bytes of a worker's cache for each pair that its table of seams may hold before it begins anew.
SEAM_BYTES = 64
#: Where spaces run together, only the last of a run begins a word.
RUN = regex.compile(r" \s")
WORD_START = regex.compile(r"(?= \S)", regex.V1)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge parents and special tokens of a byte-level BPE file."""

    def __init__(self, path: str, seams: int = 1_000_000):
        self.seams = seams
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        raw = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*raw.values(), *self.special.values()])
        self.tokens = [b""] * size
        for t, i in raw.items():
            self.tokens[i] = t.encode() if t in self.special else bytes(of[c] for c in t)
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # parents -> (rank, token)
        self.parents: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = raw[left], raw[right], raw[left + right]
            self.pairs.setdefault((a, b), (rank, c))
            if c not in self.parents:
                self.parents[c], self.rank[c] = (a, b), rank
        self.ids = {t: i for i, t in enumerate(self.tokens) if i not in self.special.values()}
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.compatible: dict[int, bool] = {}
        self.reachable: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        # reversed, so that all matches reported at one place begin at the same place of the text
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t[::-1].decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens gives just these two; from the table if met before."""
        pair = left << 32 | right
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= self.seams:  # a table of what was met, not of all pairs
                self.compatible.clear()
            known = self.compatible[pair] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, a: int, b: int) -> bool:
        """Undoes the merges of both tokens, latest first.

        The seam is lost if the pieces that touch it could merge before the merge undone last did:
        at a lower rank, or at the same rank when that merge lies to the right of the seam (of equal
        merges the leftmost goes first).
        """
        before = 1 << 60
        while True:
            over = self.pairs.get((a, b))
            if over is not None and over[0] < before:
                return False
            rank_a, rank_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                before, a = rank_a, self.parents[a][1]
            else:
                before, b = rank_b + 1, self.parents[b][0]

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of the token, or -1."""
        known = self.shorter.get(token)
        if known is None:
            t = self.tokens[token]
            known = self.shorter[token] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        return known

    def whole(self, token: int) -> bool:
        """Whether merging the token's own text gives the token (a file may hold others)."""
        known = self.reachable.get(token)
        if known is None:
            known = self.reachable[token] = plain_merge(self, self.tokens[token]) == [token]
        return known

    def encode_word(self, word: bytes) -> list[int]:
        token = self.ids.get(word)
        if token is not None and self.whole(token):
            return [token]
        n = len(word)
        best, longest = [0] * n, [-1] * n
        for end, (size, token) in self.automaton.iter(word[::-1].decode("latin-1")):
            at = n - 1 - end
            if size > best[at]:
                best[at], longest[at] = size, token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(self.tokens[token])
                if not dead[end] and (not out or self.may_follow(out[-1], token)) and self.whole(token):
                    break
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:  # no token that starts here works: step back
                dead[at] = 1
                token = out.pop()
                at -= len(self.tokens[token])
                token = self.prefix(token)
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids, by the offset table."""
        begin = self.offsets[ids]
        n = self.offsets[ids + 1] - begin
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        return self.blob[at]


def plain_merge(v: Vocabulary, word: bytes) -> list[int]:
    """Merging by rank, the definition of BPE; for single tokens and tests."""
    out = [v.ids[word[i : i + 1]] for i in range(len(word))]
    while True:
        found = min(((v.pairs[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in v.pairs), default=None)
        if found is None:
            return out
        i = found[1]
        out[i : i + 2] = [v.pairs[out[i], out[i + 1]][1]]


def weight(piece: str, ids: bytes) -> int:
    """Bytes that an entry of a cache takes, its place in the table included."""
    return sys.getsizeof(piece) + sys.getsizeof(ids) + 100


class Pieces(dict):
    """Text -> its ids as little-endian unsigned 32-bit integers, made where missing.

    Bounded by bytes: a full generation becomes the old one, from which what is met again comes back.
    Pieces of more than LONGEST_KEPT characters are made anew each time and never kept.
    """

    def __init__(self, encode, prefix: str, limit: int = CACHE):
        super().__init__()
        self.encode, self.before, self.limit, self.held, self.old = encode, prefix, limit, 0, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST_KEPT:
            return self.encode(self.before + piece)
        found = self.old.get(piece)
        if found is None:
            found = self.encode(self.before + piece)
        self.held += weight(piece, found)
        if self.held > self.limit:
            self.old, self.held = dict(self), weight(piece, found)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Whole texts to ids."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN, cache: int = CACHE):
        self.v, self.words = vocabulary, regex.compile(pattern)
        self.pretokens = Pieces(self.word, "", cache // 4)
        self.first, self.spaced = Pieces(self.piece, "", cache // 8), Pieces(self.piece, " ", cache)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def word(self, word: str) -> bytes:
        ids = self.v.encode_word(word.encode("utf-8", "surrogatepass"))
        return np.array(ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.words.findall(piece)))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text:
            return b""
        if RUN.search(text):
            head, *rest = WORD_START.split(text)
            rest = [x[1:] for x in rest]
        else:
            head, *rest = text.split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special tokens are their ids."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.v.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


#: One encoder for each file, bound of its cache and worker; workers serve many tasks.
ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(name: str = VOCABULARY, cache: int = CACHE) -> Encoder:
    if (name, cache) not in ENCODERS:
        ENCODERS[name, cache] = Encoder(Vocabulary(public_tokenizers.path(name), seams=max(1, cache // SEAM_BYTES)), cache=cache)
    return ENCODERS[name, cache]


def decode_rows(v: Vocabulary, rows: list[bytes]) -> list[bytes]:
    """UTF-8 text of each row of ids; malformed sequences are replaced."""
    out = []
    for a, b in spans([len(x) for x in rows], BLOCK):
        ids = np.frombuffer(b"".join(rows[a:b]), "<u4").astype(np.int64)
        ends = np.cumsum([len(x) // 4 for x in rows[a:b]])
        at = np.concatenate([[0], np.cumsum(v.offsets[ids + 1] - v.offsets[ids])])[np.concatenate([[0], ends])]
        body = v.decode(ids).tobytes()
        out += [body[x:y].decode("utf-8", "replace").encode() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
    return out


def tokenised(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers) and n_tokens; null text is empty.

    Empty texts have no ids; whole texts of any length are encoded, one at a time. Repeated rows are
    independent, an empty table gives an empty result; columns ids and n_tokens of docs are replaced.
    """
    kept = docs.drop("ids", "n_tokens")
    schema = with_fields(kept, ("ids", "binary"), ("n_tokens", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            ids = [e.encode(x) for x in texts(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], [*batch.schema.names, "ids", "n_tokens"])

    return kept.mapInArrow(run, schema)


def detokenised(tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """tokens with the text that the ids stand for; null ids count as none, an empty table stays empty."""
    kept = tokens.drop(out_col)
    schema = with_fields(kept, (out_col, "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(vocabulary).v
        for batch in batches:
            ids = [x or b"" for x in batch.column(batch.schema.names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decode_rows(v, ids), pa.binary()).cast(pa.string())], [*batch.schema.names, out_col])

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, cache: int = CACHE) -> DataFrame:
    """<id_col>, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one task, so that no ids move.

    Null and empty texts have no ids. Whole texts of any length are encoded, one at a time in a task's
    memory. Repeated rows and rows with equal ids are independent, an empty table gives an empty result,
    ids are of any type, other columns aren't read. cache: bytes of a generation of a worker's cache.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, cache)
        for batch in released(batches):
            rows = texts(batch, "__text")
            for a, b in spans([len(x) for x in rows], BLOCK):
                ids = [e.encode(x) for x in rows[a:b]]
                back = decode_rows(e.v, ids)
                digests = [[hashlib.sha256(x).hexdigest() for x in side] for side in (ids, back)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, digests)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text"))
    return rows.mapInArrow(run, f"{quoted(id_col)} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
