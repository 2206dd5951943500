"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one word of bits per slot, a bit for each language. An n-gram sets its
language's bit in HASHES slots; the conjunction of an n-gram's slots is the set of all languages that
contain it. A text's languages are compared by how many of its n-grams carry their bit, after the
share that would carry it by accident (the language's fill to the power HASHES) is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, released, spans, stored, table, texts, with_fields

#: Characters of an n-gram, slots of the filter (a power of two), hash functions.
GRAM, SLOTS, HASHES = 4, 1 << 20, 2
#: Bounds of the sample: different texts of each language, in the order of a hash, that the filter learns
#: from, and the bytes of text after which no more are taken.
DOCS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 2000, 64 << 20
#: An n-gram is a language's own if this share of its sampled documents, and at least LEAST_DOCS, have it.
SHARE, LEAST_DOCS = 0.004, 2
#: Characters that are worked on at a time.
BLOCK = 1 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def gram_hashes(chars: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM code points."""
    n = len(chars) - GRAM + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(GRAM if n > 0 else 0):
        h = (h ^ chars[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def slots(h: np.ndarray) -> list[np.ndarray]:
    """Positions in the filter, one array for each hash function."""
    mask = np.uint64(SLOTS - 1)
    return [((h >> np.uint64(s)) & mask).astype(np.int64) for s in range(0, 22 * HASHES, 22)]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def padded(text: str) -> str:
    pad = " " * (GRAM // 2)
    return pad + text.lower() + pad


@dataclass(frozen=True)
class LanguageFilter:
    """languages, and for each slot as many bit words as they need."""

    languages: list[str]
    words: np.ndarray  # (word, slot)

    @cached_property
    def fill(self) -> np.ndarray:
        """The share of n-grams that would carry each language's bit by accident."""
        return np.array([np.mean((self.words[i // 8] >> np.uint8(i % 8)) & np.uint8(1)) for i in range(len(self.languages))]) ** HASHES

    def counts(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(text, language): n-grams that carry the language's bit. starts: where each text begins."""
        at = slots(gram_hashes(chars))
        seams = (starts[1:, None] - np.arange(1, GRAM)).ravel()  # n-grams of two texts count for none
        out = np.zeros((len(starts), len(self.languages)), np.int64)
        for w, bits in enumerate(self.words):
            found = bits[at[0]]
            for p in at[1:]:
                found &= bits[p]
            found[seams] = 0
            for i in range(w * 8, min(len(self.languages), w * 8 + 8)):
                out[:, i] = np.add.reduceat((found >> np.uint8(i % 8)) & np.uint8(1), starts, dtype=np.int64)
        return out

    def predict(self, rows: list[str]) -> tuple[list[str], list[float]]:
        lengths = [len(x) for x in rows]
        hits, total = np.zeros((len(rows), len(self.languages))), np.zeros(len(rows))
        for a, b in spans(lengths, BLOCK):
            if b == a + 1:  # may be longer than a block: pieces that overlap by GRAM - 1
                text = padded(rows[a])
                parts, owner = [text[i : i + BLOCK + GRAM - 1] for i in range(0, len(text) - GRAM + 1, BLOCK)], a
                for x in parts:
                    c = codes(x)
                    hits[owner] += self.counts(c, np.zeros(1, np.int64))[0]
                    total[owner] += len(c) - GRAM + 1
                continue
            whole = [padded(x) for x in rows[a:b]]
            n = np.array([len(x) for x in whole])
            starts = np.cumsum(n) - n
            c = codes("".join(whole))
            hits[a:b] += self.counts(c, starts)
            total[a:b] += n - GRAM + 1
        by_accident = self.fill
        share = np.maximum(hits / np.maximum(total, 1)[:, None] - by_accident, 0) / np.maximum(1 - by_accident, 1e-9)
        langs, scores = [], []
        for text, s in zip(rows, share):
            if not len(s) or not LETTER.search(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            i = int(np.argmax(s))
            langs.append(self.languages[i])
            scores.append(float(s[i] / s.sum()) if s.sum() > 0 else 0.0)
        return langs, scores


def sampled(rows: DataFrame, docs_per_language: int, bytes_per_language: int) -> tuple[DataFrame, dict[str, int]]:
    """(the sample of rows (lang, text), different texts of each language).

    Different texts are ranked by a hash, so a text that repeats counts once and is taken once; ranks and
    bytes are summed over hashes alone, of about docs_per_language texts of a language.
    """
    keyed = rows.withColumn("h", F.xxhash64("text"))
    keys = stored(keyed.select("lang", "h", F.octet_length("text").alias("b")).groupBy("lang", "h").agg(F.max("b").alias("b")), "language-texts")
    sizes = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for lang in sorted(sizes):
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * docs_per_language / sizes[lang]))).otherwise(rate)
    some = keys.where(F.pmod(F.xxhash64("h", "lang"), F.lit(1 << 20)) < rate * (1 << 20))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h", "lang"), "h")
    some = some.withColumns({"rank": F.row_number().over(order), "before": F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    some = some.where((F.col("rank") <= docs_per_language) & (F.coalesce("before", F.lit(0)) < bytes_per_language))
    # docs_per_language keys for each language that the driver holds a row of: small enough for every task
    return keyed.join(F.broadcast(some.select("lang", "h")), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text"), sizes


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE) -> LanguageFilter:
    """Learns from at most docs_per_language different texts of each language, chosen by a hash of the text.

    No text is taken once bytes_per_language are reached. Tasks count in how many sampled documents each
    n-gram occurs; the driver gets the n-grams that are some language's own (their number is bounded by
    the sample), with the bits of their languages. Rows with a null text or language teach nothing.
    """
    rows = train.select(F.col(quoted(lang_col)).alias("lang"), F.col(quoted(text_col)).alias("text")).where("lang is not null and text is not null")
    sample, sizes = sampled(rows, docs_per_language, bytes_per_language)
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros((0, SLOTS), np.uint8))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            body = texts(batch, "text")
            for lang in np.unique(langs):
                seen = [np.unique(gram_hashes(codes(padded(body[i])))) for i in np.flatnonzero(langs == lang)]
                seen = [x for x in seen if len(x)]
                if seen:
                    h, n = np.unique(np.concatenate(seen), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = sample.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    own = F.lit(False)
    for lang in languages:
        own |= (F.col("lang") == lang) & (F.col("n") >= max(min(LEAST_DOCS, sizes[lang]), SHARE * min(docs_per_language, sizes[lang])))
    found = counted.where(own).groupBy("gram").agg(F.collect_set("lang").alias("langs"))
    words = np.zeros((-(-len(languages) // 8), SLOTS), np.uint8)
    for r in found.groupBy("langs").agg(F.collect_list("gram").alias("grams")).toLocalIterator():
        at = slots(np.array(r["grams"], np.int64).view(np.uint64))
        for lang in r["langs"]:
            i = languages.index(lang)
            for p in at:
                words[i // 8][p] |= np.uint8(1 << (i % 8))
    return LanguageFilter(languages, words)


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; every column of docs is kept, clashing ones are replaced.

    und with score 0 where the text is null or has no letter. Whole texts count, long ones in pieces.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    schema = with_fields(kept, ("lang_pred", "string"), ("score", "double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            langs, scores = shared.value.predict(texts(batch, text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"), 4, 2))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(training(docs)))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
