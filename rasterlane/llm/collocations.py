"""Phrases whose words belong together: counted level by level with hashed buckets (PCY and DHP) and Apriori.

Level k counts phrases of k words exactly and, in the same pass over the texts, adds the phrases of k + 1
words that may still be frequent to a table of hashed buckets. Each task has a table of its own, of fixed
size; tables are added up by slices and become one bit for a bucket: whether it reached the least count.
The next level counts a phrase only where its bucket's bit is set (a bucket holds at least what each of
its phrases has) and where both phrases it is made of are frequent (Apriori). The frequent phrases go
out as a bitmap of their hashes of the same fixed size. Both bitmaps may let phrases through that are
not frequent, never the reverse, and exact counts decide; so sizes change only the cost.

Everything is per language: the language is part of every hash and key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, spans, stored, table

#: Longest phrase, least count, percent of its count at which a longer phrase stands for a shorter one.
LONGEST, LEAST, COVERED = 4, 30, 80
#: Log2 of the buckets (a byte each in a task, a bit each in what is sent out), and of a slice of them.
BUCKET_BITS, SLICE_BITS = 25, 16
#: Bytes of text counted together; parts of a language that are ranked apart before the last ranking.
AT_ONCE, PARTS = 4 << 20, 1024
#: Signs that end a piece, and the white space between words (fixed values).
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
SPLIT = bytes.maketrans(ENDS + BLANKS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * len(ENDS) + b" " * len(BLANKS) + b"abcdefghijklmnopqrstuvwxyz")


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes spread over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashes(values: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in values), np.uint64, len(values))


def grown(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with one more word."""
    return mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)


class Bits:
    """A bitmap of fixed size."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.mask = packed, np.uint64(8 * len(packed) - 1)

    def __getitem__(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def second(h: np.ndarray) -> np.ndarray:
    """The other probe of a frequent phrase."""
    return h >> np.uint64(27)


class Buckets:
    """A task's counts of hashed phrases, none above the least count that matters."""

    def __init__(self, bits: int, least: int):
        self.least, self.counts = least, np.zeros(1 << bits, np.uint8 if least < 256 else np.uint32)
        self.per = 1 << min(bits, SLICE_BITS)

    def add(self, h: np.ndarray) -> None:
        at, n = np.unique(h & np.uint64(len(self.counts) - 1), return_counts=True)
        at = at.astype(np.int64)
        self.counts[at] = np.minimum(self.counts[at] + n, self.least)

    def put(self, h: np.ndarray) -> None:
        self.counts[(h & np.uint64(len(self.counts) - 1)).astype(np.int64)] = self.least

    def slices(self) -> Iterator[tuple[int, bytes]]:
        z = zstandard.ZstdCompressor(level=1)
        for k, part in enumerate(self.counts.reshape(-1, self.per)):
            if part.any():
                yield k, z.compress(part.tobytes())


class Words:
    """The words of some texts: number of the word, of its piece and of its language, in order."""

    def __init__(self, rows: list[bytes], langs: np.ndarray):
        data = np.frombuffer(b"\n".join(rows), np.uint8)
        blank, end = data == 32, data == 10
        word = ~(blank | end)
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate([[0], np.cumsum(last - first)])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[word])]).dictionary_encode()
        self.word, self.dictionary = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
        self.piece = np.cumsum(end)[first] if len(first) else np.zeros(0, np.int64)
        starts = np.cumsum([0, *(len(x) + 1 for x in rows[:-1])])
        self.lang = langs[np.searchsorted(starts, first, "right") - 1]

    def phrases(self, at: np.ndarray, width: int) -> pa.Array:
        """Phrases of width words that begin at the given words, space-joined."""
        words = [self.dictionary.take(pa.array(self.word[at + j])) for j in range(width)]
        return (pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if width > 1 else words[0]).cast(pa.large_string()).cast(pa.string())


def parts_of(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[list[bytes], list]]:
    """(texts, languages) of about limit bytes, lower case, every piece ended by a line feed.

    A longer text is cut where a piece ends, so no phrase is lost; a piece without an end stays whole.
    """
    rows, langs = [], []
    for text, lang in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(0).to_pylist()):
        text, at = text.translate(SPLIT), 0
        while len(text) - at > limit:
            cut = text.rfind(b"\n", at, at + limit)
            cut = text.find(b"\n", at + limit) if cut < at else cut
            if cut < 0:
                break
            rows.append(text[at:cut])
            langs.append(lang)
            at = cut + 1
        rows.append(text[at:])
        langs.append(lang)
    for a, b in spans([len(x) + 1 for x in rows], limit):
        yield rows[a:b], langs[a:b]


class Level:
    """What a pass over texts at one width needs: bitmaps of this width's buckets and of the frequent shorter phrases."""

    def __init__(self, width: int, longest: int, least: int, bits: int, buckets: bytes | None, frequent: bytes | None):
        self.width, self.more, self.least, self.bits = width, width < longest, least, bits
        self.buckets, self.frequent = (None if x is None else Bits(np.frombuffer(x, np.uint8)) for x in (buckets, frequent))

    def counted(self, rows: list[bytes], langs: list, table: Buckets | None) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(language, phrase, count) of the phrases that may be frequent; table gets the next width."""
        names, of = np.unique(np.array(langs, dtype=object), return_inverse=True)
        w = Words(rows, of)
        n, k = len(w.word), self.width
        word = hashes(w.dictionary.to_pylist())[w.word] if n else np.zeros(0, np.uint64)
        h = mixed(word ^ hashes([x.encode() for x in names])[w.lang]) if n else word
        alive = np.ones(n, bool)
        for j in range(1, k):
            if j == k - 1:
                usual = self.frequent[h] & self.frequent[second(h)]
                alive = (w.piece[j:] == w.piece[: max(0, n - j)]) & usual[:-1] & usual[1:]
            h = grown(h[:-1], word[j:])
        if k > 1:
            alive &= self.buckets[h]
        at = np.flatnonzero(alive)
        # the phrases so far get dense numbers word by word, so that a key of two numbers stays exact
        size, key = max(1, len(w.dictionary)), w.lang[at]
        for j in range(k):
            key = np.unique(key * size + w.word[at + j], return_inverse=True)[1]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        if table is not None and n > k:
            both = alive[: n - k] & alive[1 : n - k + 1] & (w.piece[k:] == w.piece[: n - k])
            here = np.flatnonzero(both)
            table.add(grown(h[here], word[here + k]))
        return pa.array(names[w.lang[first]].tolist(), pa.string()), w.phrases(first, k), count


SCHEMA = "lang string, phrase string, n long, slice int, counts binary"


def sliced(table: Buckets) -> Iterator[pa.RecordBatch]:
    for k, data in table.slices():
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["lang", "phrase", "n", "slice", "counts"])


def passed(docs: DataFrame, width: int, longest: int, least: int, bits: int, buckets: bytes | None, frequent: bytes | None, at_once: int) -> DataFrame:
    """One pass: rows of counted phrases, and slices of each task's buckets for the next width."""
    sent = docs.sparkSession.sparkContext.broadcast((buckets, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Level(width, longest, least, bits, *sent.value)
        table = Buckets(bits, least) if level.more else None
        for batch in batches:
            for rows, langs in parts_of(batch, at_once):
                lang, phrase, n = level.counted(rows, langs, table)
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], ["lang", "phrase", "n", "slice", "counts"])
        if table is not None:
            yield from sliced(table)

    return stored(docs.mapInArrow(run, SCHEMA), f"phrases-{width}")


def bitmap(slices: DataFrame, least: int, bits: int) -> bytes:
    """The bits of buckets that reach the least count over all tasks: 2^bits bits, whatever the input."""
    per = 1 << min(bits, SLICE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, z, sums = np.uint8 if least < 256 else np.uint32, zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(z.decompress(data), kind).astype(np.uint64)
                sums[k] = np.minimum(sums[k] + more, least).astype(kind) if k in sums else more.astype(kind)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()], pa.binary())], ["slice", "bits"])

    out = bytearray(1 << bits >> 3)
    for r in slices.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(run, "slice int, bits binary").collect():
        out[r["slice"] * per >> 3 : (r["slice"] + 1) * per >> 3] = r["bits"]
    return bytes(out)


def marked(grams: DataFrame, width: int, least: int, bits: int) -> bytes:
    """The bitmap of frequent phrases (lang, phrase), two bits for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = Buckets(bits, least), 0
        for batch in batches:
            if batch.num_rows:
                h = hashes([x.encode() for x in batch.column(0).to_pylist()])
                words = np.array([x.encode().split(b" ") for x in batch.column(1).to_pylist()], dtype=object).reshape(-1, width)
                h = mixed(hashes(words[:, 0].tolist()) ^ h)
                for j in range(1, width):
                    h = grown(h, hashes(words[:, j].tolist()))
                table.put(h)
                table.put(second(h))
                size += len(h)
        if size:
            yield from sliced(table)

    return bitmap(grams.select("lang", "phrase").mapInArrow(run, SCHEMA), least, bits)


def exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def frequent_phrases(docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int, bits: int, at_once: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, width, a) of all phrases with a >= least, (lang, n) of all words)."""
    rows = docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    buckets = frequent = sizes = None
    every = []
    for width in range(1, longest + 1):
        found = passed(rows, width, longest, least, bits, buckets, frequent, at_once)
        counts = found.where("slice IS NULL").select("lang", "phrase", "n")
        if sizes is None:
            sizes = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
        grams = stored(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least).select("lang", "phrase", F.lit(width).alias("width"), "a"), f"frequent-{width}")
        every.append(grams)
        if width < longest:
            buckets, frequent = bitmap(found, least, bits), marked(grams, width, least, bits)
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out, sizes


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", limit: int = 2000, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, bucket_bits: int = BUCKET_BITS, at_once: int = AT_ONCE) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at . , ; : ! ? and U+000A to U+000D, pieces into words
    at spaces and tabs. a: how often the phrase occurs in pieces, overlaps included. A phrase cut in two
    has parts that occur l and r times and scores floor(2000000 a / (l + r)); the lowest score over the
    cuts counts, of ties the first cut. Phrases of 2 to longest words with a >= least are candidates;
    one that lies in a longer candidate with at least covered percent of its count goes. The first limit
    stay by score, count (both descending) and phrase (byte order). n: all words of the language.

    Null languages are 'und', null texts empty; empty texts add nothing, whole texts of any length count
    (cut between pieces), repeated rows count each. An empty table gives an empty result; other columns
    are not read. Counts are exact; bucket_bits changes only the cost and the fixed memory of a task.
    """
    grams, sizes = frequent_phrases(docs, lang_col, text_col, longest, least, bucket_bits, at_once)
    some = grams.where("width > 1")
    cuts = some.select("*", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k")).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substr(phrase, length(first) + 2)"))
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # the largest count of the longer candidates around each phrase
    inner = F.expr("flatten(transform(sequence(2, width - 1), m -> transform(sequence(1, width - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    around = grams.where("width > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("over").isNull() | (exact(F.col("over")) * 100 < exact(F.col("a")) * covered))
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # parts of a language are ranked apart, so that no task ranks all of it
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= limit)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= limit)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, k AS width, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM spots, range(1, 5) AS r(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cuts AS (
  SELECT g.lang, g.phrase, g.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * g.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, width)) AS k, string_split(phrase, ' ') AS w FROM grams WHERE width > 1) AS g
  JOIN grams AS x ON x.lang = g.lang AND x.phrase = array_to_string(g.w[1:k], ' ')
  JOIN grams AS y ON y.lang = g.lang AND y.phrase = array_to_string(g.w[k + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM grams, range(2, 4) AS p(m), range(1, 4) AS q(i) WHERE m < width AND i + m - 1 <= width GROUP BY 1, 2),
kept AS (
  SELECT s.* FROM scored AS s LEFT JOIN inner_phrases AS o USING (lang, phrase)
  WHERE o.most IS NULL OR 100::HUGEINT * o.most < 80::HUGEINT * s.a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN sizes USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER w <= 2000
"""
