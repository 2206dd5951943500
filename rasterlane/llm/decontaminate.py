"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by at most its error budget of edits. Split
into budget + 1 pieces, at least one piece of it then occurs unchanged in the passage. An
Aho-Corasick automaton finds the pieces in whole texts; the stretch of text around each hit is
verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, released, row_key, shared_dir, stored, table, text_bytes, texts, with_fields

#: Edits allowed per character of the item.
ERROR_RATE = 0.05
#: Bytes of items that are searched for in one pass over the documents.
BLOCK_BYTES = 16 << 20


def normalise(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split())


def budget(m: int, error_rate: float = ERROR_RATE) -> int:
    """The whole edits that the rate leaves an item of m characters, whatever its length."""
    return int(m * error_rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces that cover the item, with their offsets."""
    cut = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def pattern_bits(item: str) -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        bits[c] |= 1 << i
    return dict(bits)


def myers(bits: dict[str, int], m: int, text: str, most: int) -> int:
    """Least edit distance between the pattern and any stretch of text; most + 1 if above most."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = bits.get(c, 0)
        x = eq | down
        diag = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(diag | up) & full, up & diag
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(x | plus) & full, plus & x
        best = min(best, score)
    return min(best, most + 1)


class Matcher:
    """The items' pieces in one automaton."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float):
        self.items = [(k, t, budget(len(t), error_rate)) for k, t in items]
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, t, errors) in enumerate(self.items):
            for a, piece in pieces(t, errors):
                owners[piece].append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.bits: dict[int, dict[str, int]] = {}

    def find(self, raw: str) -> list[tuple[object, int]]:
        """(item key, edit distance) of the items that are in the text within their budget."""
        text = normalise(raw)
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (n, where) in self.automaton.iter(text):
            for i, a in where:
                _, t, errors = self.items[i]
                begin = end - n + 1 - a - errors
                windows[i].append((max(0, begin), min(len(text), begin + len(t) + 2 * errors)))
        out = []
        for i, found in windows.items():
            key, t, errors = self.items[i]
            if t in text:
                out.append((key, 0))
                continue
            if i not in self.bits:
                self.bits[i] = pattern_bits(t)
            best, reached = errors + 1, (0, -1)
            for a, b in sorted(found):
                if b <= reached[1] and a >= reached[0]:
                    continue
                best, reached = min(best, myers(self.bits[i], len(t), text[a:b], errors)), (a, b)
            if best <= errors:
                out.append((key, best))
        return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(<id_col>, item_id, distance): one row per document row and item that it contains.

    Case and runs of white space are ignored; an item of m characters is found with up to
    floor(m * error_rate) edits (so under 20 characters unchanged). Null and empty texts contain
    nothing, null and empty items are in nothing; whole texts of any length are searched. Items are
    sent to the tasks in blocks of about block_bytes, one pass over the documents each, so that what
    is sent does not grow with the benchmark. Ids and item keys of any type; an id that occurs in
    several rows is reported for each row, an item that occurs in several for each. Empty tables give
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(quoted(item_col)).cast("string").alias("k"), F.col(quoted(item_text_col)).alias("t")).where("t is not null")
    blocks = -(-text_bytes(items, "t") // block_bytes)
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text")).where("__text is not null")
    schema = with_fields(rows.select("__id"), ("item", "string"), ("distance", "int"))
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("t", "k"), F.lit(blocks)) == block).collect()
        mine = sorted(((r["k"], normalise(r["t"])) for r in mine), key=lambda x: (x[1], str(x[0])))
        mine = [x for x in mine if x[1]]
        if not mine:
            continue
        sent = spark.sparkContext.broadcast(mine)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, error_rate)
            for batch in released(batches):
                found = [(n, k, d) for n, text in enumerate(texts(batch, "__text")) for k, d in matcher.find(text)]
                at = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int32())], ["__id", "item", "distance"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.select(F.col("__id").alias(id_col), F.col("item").cast(benchmark.schema[item_col].dataType).alias("item_id"), "distance")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text contains no item, with all their columns.

    Rows are found by their whole text and columns (see row_key), not by id; id_col is not read.
    """
    shared_dir(docs.sparkSession)
    key = row_key(docs, text_col)
    tagged = docs.withColumn("__key", F.concat_ws("-", F.hex(key["__row"]), key["__digest"]))
    hits = stored(find_contamination(tagged, benchmark, "__key", text_col).select("__key").distinct(), "contaminated")
    return tagged.join(hits.hint("shuffle_hash"), "__key", "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
