"""Token-id files: canonical length-limited Huffman codes of ids from global counts.

A file holds the code lengths of the vocabulary (the canonical code follows from them), segments of
packed codes, and a footer: ids and lengths of its documents and the bit offset of every block of
BLOCK ids. Blocks decode independently; a decoder takes many at once and looks up the next
MAX_BITS bits of each in one table.

    magic | header length u32 | header JSON | code lengths (zlib) | packed codes | documents (Arrow IPC)
          | block offsets (u64) | footer JSON | footer length u32 | magic
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import LONGEST_KEPT, WORD_START, Pieces, Vocabulary
from .common import open_input, open_output, quoted, released, shared_path, spans, stored, table

MAGIC = b"RLTOKHF1"
VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
MAX_BITS = 16
#: Ids of a block; blocks of a segment (packed and unpacked together); ids and documents that a file
#: should hold; documents that leave a reader together.
BLOCK, LANES, FILE_IDS, FILE_DOCS, ROWS = 1024, 2048, 32_000_000, 2_000_000, 65_536
#: Bytes that a worker's cache of words may hold; characters tokenised together.
CACHE, CHARS = 96 << 20, 8 << 20
#: Signs that often end words, as many as are cut off at most, and the Latin letters before them.
SIGNS, MOST_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 8
LETTERS = pa.array([chr(x) for x in [*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)]], pa.large_string())
WHITE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space before other white space: such texts are cut with more care. A line's end before white space
#: or at a text's end: such texts are cut at spaces alone, as white space may stand in one pre-token.
SPACES, LINES = f" {WHITE}", rf"\n(?:{WHITE}|\z)"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits for each id (0: does not occur), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    max_bits = max(max_bits, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, weights = [], leaves
    is_leaf = np.ones(len(leaves), bool)
    for _ in range(max_bits):
        levels.append(is_leaf)
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        weights, is_leaf = both[rank], rank < len(leaves)
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code words: by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths.max())
        step = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
        codes[order] = (np.cumsum(step) - step) >> (top - lengths[order]).astype(np.uint64)
    return codes


class Coder:
    """Packs and unpacks ids with one canonical code."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical(lengths)
        self.top = max(1, int(lengths.max(initial=0)))

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes, bit offset of every BLOCK-th id); the bytes end at a 32-bit boundary."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = ends - n
        word = at >> 5
        value = self.codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        sums[word[first]] = np.add.reduceat(value, first)
        out = sums >> np.uint64(32)
        out[1:] += sums[:-1] & np.uint64(0xFFFFFFFF)
        return out[: -(-int(ends[-1]) // 32)].astype(">u4").tobytes(), at[::BLOCK]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        times = 1 << (self.top - self.lengths[order])
        symbols, bits = np.repeat(order, times), np.repeat(self.lengths[order], times)
        pad = (1 << self.top) - len(symbols)
        return np.pad(symbols, (0, pad)), np.pad(bits, (0, pad))

    def unpack(self, data: bytes, offsets: np.ndarray, count: int, lookup: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """count ids whose blocks begin at the given bits of data; all blocks advance together."""
        symbols, bits = lookup
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = offsets.astype(np.int64).copy()
        out = np.zeros((BLOCK, len(at)), np.uint32)
        shift, mask, limit = 32 - self.top, (1 << self.top) - 1, len(words) - 1
        for step in range(min(BLOCK, count)):
            peek = words[np.minimum(at >> 3, limit)] >> (shift - (at & 7)).astype(np.uint32) & mask
            out[step] = symbols[peek]
            at += bits[peek]
        return out.T.ravel()[:count]


def gathered(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ids, one after the other."""
    ends = np.cumsum(size)
    return ids[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Words:
    """Words and their ids, one word's after the other's; size: how many each has."""

    def __init__(self, names: pa.Array, ids: np.ndarray, size: np.ndarray):
        self.names, self.ids, self.size = names, ids, size
        self.begin = np.cumsum(size) - size

    def __len__(self) -> int:
        return len(self.size)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names.to_pylist())

    def items(self) -> Iterator[tuple[str, bytes]]:
        return zip(self, (self.ids[b : b + n].tobytes() for b, n in zip(self.begin.tolist(), self.size.tolist())))

    def weights(self) -> np.ndarray:
        """Bytes that each word takes, its places and the copy in a lookup's table included."""
        return 200 + 2 * bytes_of(self.names) + self.size * self.ids.itemsize

    def places(self, names: pa.Array) -> np.ndarray:
        """Where names stand, -1 where they don't."""
        return pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def joined(self, names: pa.Array, ids: np.ndarray, size: np.ndarray) -> Words:
        return Words(pa.concat_arrays([self.names, names]), np.concatenate([self.ids, ids]), np.concatenate([self.size, size]))

    def only(self, at: np.ndarray) -> Words:
        return Words(self.names.take(pa.array(at)), gathered(self.ids, self.begin[at], self.size[at]), self.size[at])


def bytes_of(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


class LibraryEncoder:
    """Whole texts to ids with the tokenizers library.

    A text is cut at the spaces and line ends that begin words, where the library's pre-tokeniser cuts
    too; a word is what follows a space, or a line's end and what follows it. Words that are not in the
    cache go to the library joined, and its ids are cut where their bytes end. Texts with special
    tokens go to the library whole.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bytes = np.diff(Vocabulary(path).offsets)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.heads, self.signs = Pieces(self.alone, "", CACHE // 8), Pieces(self.alone, "", CACHE // 8)
        self.new = Words(pa.array([], pa.large_string()), np.zeros(0, self.kind), np.zeros(0, np.int64))

    def alone(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def asked(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with what stands before them, one after the other, and how many each has; from the library."""
        names = pc.if_else(pc.starts_with(names, "\n"), names, pc.binary_join_element_wise(pa.scalar(" ", names.type), names, pa.scalar("", names.type)))
        sizes = bytes_of(names)
        apart = bytes_of(pc.utf8_rtrim_whitespace(names)) < sizes  # white space would run into the next word's
        asks = ["".join(names.filter(pa.array(~apart)).to_pylist()), *names.filter(pa.array(apart)).to_pylist()]
        ids, *rest = self.asked(asks)
        cut = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(sizes[~apart])) + 1
        size = np.empty(len(names), np.int64)
        size[~apart], size[apart] = np.diff(cut, prepend=0), [len(x) for x in rest]
        if not rest:
            return ids, size
        begin = np.empty(len(names), np.int64)
        begin[~apart], begin[apart] = cut - size[~apart], len(ids) + np.cumsum(size[apart]) - size[apart]
        return gathered(np.concatenate([ids, *rest]), begin, size), size

    def stems(self, words: pa.Array) -> tuple[Words, np.ndarray]:
        """Words of the cache and the library with all these distinct words among them, and their places.

        The cache is bounded by bytes; when it is full it begins anew with the words at hand. Words of
        more than LONGEST_KEPT characters are never kept.
        """
        at = self.new.places(words)
        fresh = np.flatnonzero(at < 0)
        if not len(fresh):
            return self.new, at
        names = words.take(pa.array(fresh))
        every = self.new.joined(names, *self.learn(names))
        at[fresh] = len(self.new) + np.arange(len(fresh))
        weights = every.weights()
        long = np.flatnonzero(pc.greater(pc.utf8_length(names), LONGEST_KEPT).to_numpy(zero_copy_only=False)) + len(self.new)
        weights[long] = 0
        if weights.sum() > CACHE:
            kept = np.setdiff1d(at, long)
            self.new = every.only(kept[: np.searchsorted(np.cumsum(weights[kept]), CACHE, "right")])
        else:
            self.new = every.only(np.setdiff1d(np.arange(len(every)), long)) if len(long) else every
        return every, at

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with what stands before them, one after the other, and how many each has.

        Signs after a letter are a pre-token of their own, so they are cut off and looked up apart.
        """
        stems = pc.ascii_rtrim(words, characters=SIGNS)
        signs = bytes_of(words) - bytes_of(stems)
        after_letter = pc.is_in(pc.utf8_slice_codeunits(stems, -1), value_set=LETTERS).to_numpy(zero_copy_only=False)
        signs[~after_letter | (signs > MOST_SIGNS)] = 0
        cut = pc.if_else(pa.array(signs > 0), stems, words).dictionary_encode()
        every, at = self.stems(cut.dictionary)
        at = at[cut.indices.to_numpy()]
        ids, begin, size = [every.ids], np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        begin[:, 0], size[:, 0], end = every.begin[at], every.size[at], len(every.ids)
        for n in np.unique(signs[signs > 0]).tolist():
            some = np.flatnonzero(signs == n)
            ends = pc.utf8_slice_codeunits(words.take(pa.array(some)), -n).dictionary_encode()
            found = [np.frombuffer(self.signs[x], self.kind) for x in ends.dictionary.to_pylist()]
            sizes, of = np.fromiter(map(len, found), np.int64, len(found)), ends.indices.to_numpy()
            begin[some, 1], size[some, 1] = (end + np.cumsum(sizes) - sizes)[of], sizes[of]
            ids += found
            end += int(sizes.sum())
        return gathered(np.concatenate(ids), begin.ravel(), size.ravel()), size.sum(1)

    def cut(self, rows: pa.Array) -> pa.Array:
        """Texts without runs of white space as lists of what precedes the first word and of words."""
        together = pc.match_substring_regex(rows, LINES)
        lines = pc.replace_substring(rows, "\n", " \n")
        return pc.split_pattern(pc.if_else(together, rows, lines) if pc.any(together).as_py() else lines, " ")

    def encode(self, rows: list[str] | pa.Array) -> list[bytes]:
        """Ids of whole texts. Arrow cuts the texts, numbers the distinct words and finds them in the
        cache; only new words meet Python, and the texts' ids are gathered from theirs by index."""
        rows = pa.array(rows, pa.large_string()) if isinstance(rows, list) else rows.cast(pa.large_string())
        whole = pa.array(np.zeros(len(rows), bool))
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(rows, s))
        odd = pc.match_substring_regex(rows, SPACES).to_numpy(zero_copy_only=False)
        whole = whole.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(rows)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.alone(rows[i].as_py())
        plain, odd = np.flatnonzero(~whole & ~odd), np.flatnonzero(~whole & odd)
        order = np.concatenate([plain, odd])
        if not len(order):
            return out
        parts = self.cut(rows.take(pa.array(plain)))
        if len(odd):
            some = rows.take(pa.array(odd))
            for a, b in spans(pc.binary_length(some).to_pylist(), CHARS // 8):
                cut = [[head, *(x[1:] for x in rest)] for head, *rest in map(WORD_START.split, some.slice(a, b - a).to_pylist())]
                parts = pa.concat_arrays([parts, pa.array(cut, parts.type)])
        offsets, every = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten()
        is_word = np.ones(len(every), bool)
        is_word[offsets[:-1]] = False
        heads = [self.heads[x] if x else b"" for x in every.take(pa.array(offsets[:-1])).to_pylist()]
        coded = every.filter(pa.array(is_word)).dictionary_encode()
        blob, sizes = self.pieces(coded.dictionary)
        width, begin = self.kind.itemsize, np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        ids, ends = [np.zeros(0, self.kind)], [np.zeros(1, np.int64)]
        for a in range(0, len(codes), 1 << 20):
            c = codes[a : a + (1 << 20)]
            n = sizes[c]
            end = np.cumsum(n)
            ids.append(gathered(blob, begin[c], n))
            ends.append(end + ends[-1][-1])
        raw, ends = np.concatenate(ids).tobytes(), np.concatenate(ends)
        cut = (ends[offsets - np.arange(len(offsets))] * width).tolist()
        for i, head, x, y in zip(order.tolist(), heads, cut, cut[1:]):
            out[i] = head + raw[x:y]
        return out


def filled(batches: Iterator[pa.RecordBatch], limit: int = CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of small batches together, up to limit bytes; larger batches as they are."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(name: str = VOCABULARY) -> LibraryEncoder:
    if name not in ENCODERS:
        ENCODERS[name] = LibraryEncoder(name)
    return ENCODERS[name]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """id, n, z (Zstandard of the ids, end id included), tie; in the shared folder.

    Null text is empty, an empty text has the end id alone, whole texts of any length are encoded one at
    a time; ids are of any type; repeated rows give a row each, an empty table none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, z = library_encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], e.kind).tobytes()
        for batch in released(filled(batches)):
            rows = batch.column(1).fill_null("")
            for a, b in spans(pc.binary_length(rows).to_pylist(), CHARS):
                ids = [x + end for x in e.encode(rows.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) // e.kind.itemsize for x in ids], pa.int64()), pa.array([z.compress(x) for x in ids], pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                    ["id", "n", "z", "tie"],
                )

    return stored(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("__text")).mapInArrow(run, f"id {kind}, n long, z binary, tie long"), "token-ids")


def unzipped(batch: pa.RecordBatch, kind: np.dtype) -> list[np.ndarray]:
    z = zstandard.ZstdDecompressor()
    return [np.frombuffer(z.decompress(x), kind) for x in batch.column(batch.schema.names.index("z")).to_pylist()]


def global_counts(ids: DataFrame, size: int, kind: np.dtype) -> np.ndarray:
    """How often each id occurs: each task adds up its own, the driver gets one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            rows = unzipped(batch, kind)
            if rows:
                total += np.bincount(np.concatenate(rows), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    out = np.zeros(size, np.int64)
    for r in ids.select("z").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = r["n"]
    return out


class Writer:
    """One file: documents come in order, ids leave in segments of BLOCK * LANES."""

    def __init__(self, uri: str, coder: Coder, vocabulary: str):
        self.uri, self.coder = uri, coder
        self.out, self.commit = open_output(uri)
        lengths = zlib.compress(coder.lengths.astype(np.uint8).tobytes())
        header = json.dumps({"vocabulary": vocabulary, "block": BLOCK, "segment": BLOCK * LANES, "lengths": len(lengths)}).encode()
        self.out.write(MAGIC + struct.pack("<I", len(header)) + header + lengths)
        self.ids, self.n, self.docs, self.held, self.waiting = [], [], 0, 0, []
        self.offsets, self.bytes, self.tokens = [], [0], 0

    def add(self, doc_ids: pa.Array, rows: list[np.ndarray]) -> None:
        self.ids.append(doc_ids)
        self.n.append(np.fromiter(map(len, rows), np.int64, len(rows)))
        self.docs += len(rows)
        for ids in rows:
            self.tokens += len(ids)
            self.waiting.append(ids)
            self.held += len(ids)
            if self.held >= BLOCK * LANES:
                self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate([*self.waiting, np.zeros(0, np.int64)]).astype(np.int64)
        size = BLOCK * LANES
        stop = len(ids) if last else len(ids) // size * size
        for a in range(0, stop, size):
            packed, offsets = self.coder.pack(ids[a : min(a + size, stop)])
            self.out.write(packed)
            self.offsets.append(offsets)
            self.bytes.append(self.bytes[-1] + len(packed))
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self.flush(True)
        docs = pa.table({"doc_id": pa.chunked_array(self.ids), "n": np.concatenate(self.n)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(docs)
        docs = sink.getvalue().to_pybytes()
        offsets = np.concatenate([*self.offsets, np.zeros(0, np.int64)]).astype("<u8").tobytes()
        footer = json.dumps({"documents": len(docs), "offsets": len(offsets), "tokens": self.tokens, "segments": self.bytes}).encode()
        self.out.write(docs + offsets + footer + struct.pack("<I", len(footer)) + MAGIC)
        self.commit()


def write_files(ids: DataFrame, folder: str, lengths: np.ndarray, vocabulary: str, kind: np.dtype, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> list[dict]:
    """Writes the ids in ascending order of id (nulls first), a file for each range; the files' manifest.

    A file should hold at most file_ids ids and file_docs documents. Of equal ids the order is that of
    their ids' check sums, and rows that are equal in both may be dealt to any file.
    """
    spark = ids.sparkSession
    size = ids.agg(F.sum("n").alias("n"), F.count("*").alias("docs")).first()
    total = int(size["n"] or 0)
    parts = max(1, -(-total // file_ids), -(-size["docs"] // file_docs), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 1_000_000))
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            if batch.num_rows:
                writer = writer or Writer(f"{folder}/part-{number:06d}-{uuid.uuid4().hex}.tok", Coder(sent.value), vocabulary)
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    writer.add(part.column(0), unzipped(part, kind))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([writer.uri]), pa.array([writer.docs], pa.int64()), pa.array([writer.tokens], pa.int64())], ["part", "uri", "docs", "tokens"])

    # the last key lets rows that are equal in id and text be dealt apart; it is a place in a stored table
    ordered = ids.select("id", "z", "tie", F.monotonically_increasing_id().alias("at")).repartitionByRange(parts, "id", "tie", "at").sortWithinPartitions("id", "tie")
    manifest = stored(ordered.select("id", "z").mapInArrow(run, "part long, uri string, docs long, tokens long"), "token-manifest")
    return [r.asDict() for r in manifest.orderBy("part").collect()]  # one row for each file


class TokenFile:
    """A file's documents (Arrow: doc_id, n) and its ids, by segments or a block alone."""

    def __init__(self, f):
        self.f, size = f, f.size()
        assert f.read_at(len(MAGIC), 0) == MAGIC and f.read_at(len(MAGIC), size - len(MAGIC)) == MAGIC, "not a token file"
        (n,) = struct.unpack("<I", f.read_at(4, 8))
        self.header = json.loads(f.read_at(n, 12))
        self.coder = Coder(np.frombuffer(zlib.decompress(f.read_at(self.header["lengths"], 12 + n)), np.uint8))
        self.begin = 12 + n + self.header["lengths"]
        (m,) = struct.unpack("<I", f.read_at(4, size - 12))
        self.footer = json.loads(f.read_at(m, size - 12 - m))
        end = size - 12 - m - self.footer["offsets"]
        self.offsets = np.frombuffer(f.read_at(self.footer["offsets"], end), "<u8")
        self.documents = pa.ipc.open_stream(f.read_at(self.footer["documents"], end - self.footer["documents"])).read_all()
        self.lookup, self.per = self.coder.table(), self.header["segment"] // self.header["block"]

    def segments(self) -> Iterator[np.ndarray]:
        """The ids in order, a segment's at a time."""
        for k, (a, b) in enumerate(zip(self.footer["segments"], self.footer["segments"][1:])):
            count = min(self.header["segment"], self.footer["tokens"] - k * self.header["segment"])
            yield self.coder.unpack(self.f.read_at(b - a, self.begin + a), self.offsets[k * self.per : (k + 1) * self.per], count, self.lookup)

    def block(self, k: int) -> np.ndarray:
        """The ids of block k alone: only its own bytes are read, from its bit offset on."""
        a, b = self.footer["segments"][k // self.per : k // self.per + 2]
        bit = int(self.offsets[k])
        last = (k + 1) % self.per == 0 or k + 1 == len(self.offsets)
        end = b - a if last else -(-int(self.offsets[k + 1]) // 8)
        count = min(self.header["block"], self.footer["tokens"] - k * self.header["block"])
        data = self.f.read_at(end - bit // 8, self.begin + a + bit // 8)
        return self.coder.unpack(data, np.array([bit % 8]), count, self.lookup)


def read_file(uri: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(documents, their lengths, check sums of their ids) of a file, ROWS documents at a time, in order."""
    with open_input(uri) as f:
        file = TokenFile(f)
        n = file.documents["n"].to_numpy()
        at, left, crc, sums = 0, int(n[0]) if len(n) else 0, 0, []
        for ids in file.segments():
            raw, used = ids.astype("<u4"), 0
            while used < len(raw):
                take = min(left, len(raw) - used)
                crc = zlib.crc32(raw[used : used + take], crc)
                used, left = used + take, left - take
                if left == 0:
                    sums.append(crc)
                    at, crc = at + 1, 0
                    left = int(n[at]) if at < len(n) else 0
                    if len(sums) == ROWS:
                        yield file.documents.slice(at - ROWS, ROWS), n[at - ROWS : at], np.array(sums, np.int64)
                        sums = []
        if sums:
            yield file.documents.slice(at - len(sums)), n[at - len(sums) :], np.array(sums, np.int64)


def read_digests(spark: SparkSession, manifest: list[dict], id_col: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """<id_col> (of type kind), start, n_tokens, ids_crc32 of every document, from the files."""
    base, rows = 0, []
    for m in manifest:
        rows.append((m["uri"], base))
        base += m["tokens"]
    files = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for documents, n, sums in read_file(uri):
                    ends = start + np.cumsum(n)
                    ids = documents["doc_id"].combine_chunks()
                    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
                    yield pa.RecordBatch.from_arrays([ids, pa.array(ends - n), pa.array(n), pa.array(sums)], [id_col, "start", "n_tokens", "ids_crc32"])
                    start = int(ends[-1])

    return files.mapInArrow(run, f"{quoted(id_col)} {kind}, start long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> list[dict]:
    """Tokenises docs and writes the token files into folder; returns the manifest (part, uri, docs, tokens).

    Ids of any type that sorts stand in the files as they are (nulls first); see encoded() for odd texts.
    An empty table gives no files.
    """
    e = library_encoder(vocabulary)
    size, kind = max(e.size, end_id + 1), e.kind
    ids = encoded(docs, id_col, text_col, vocabulary, end_id)
    return write_files(ids, folder, code_lengths(global_counts(ids, size, kind)), vocabulary, kind)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, shared_path(spark, "tokens"))
    return read_digests(spark, manifest, "doc_id", docs.schema["doc_id"].dataType.simpleString())
