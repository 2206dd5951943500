"""Near copies by exact word-shingle similarity, the second half of the SimHash stage of a pipeline.

Texts whose shingle sets have a Jaccard similarity of at least SIMILARITY are linked. Such pairs
lie up to 17 of 64 SimHash bits apart on the test tables, a radius that leaves a metric tree nothing to
prune; candidates are therefore found in two rounds, and each is decided by the sets themselves, so that
clean texts stay.

The first round joins most of each group at a cost that is linear in the entries: buckets are bands of
min-hashes, whose members are put in two orders (by the size of the set, and by the key of another band,
which brings those together that share two bands), and each is compared with the next one in either.

The second round is exact and finds every link between what the first left apart (prefix filtering): with
shingles in one order, two sets at s share one among the first n - ceil(s * n) + 1 of each, so all sets
that have such a shingle in common meet, in pairs whose sizes fit and that are not yet joined. A pair is
passed over only where the sets' parity words, a bit a shingle, prove that they differ in too much. Shingles
that the same sets hold (a passage that was copied) make one bucket. The order begins with what a sample of
the sets does not hold twice; any order gives all links, a good one small buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, least_rows, quoted, released, row_key, shared_dir, slot, slots, spans, stored, texts, with_fields
from .simhash import SEED

WIDTH, SIMILARITY = 5, 0.8
#: Buckets of a text, and min-hashes that a bucket's texts share.
BANDS, ROWS = 32, 4
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Sketches keep four bits of each min-hash. Of 128, a pair at 0.8 differs in 24 on average (deviation
#: 4.4); pairs that differ in more than this, six deviations off, are not looked at in full.
DIFFER = 50
#: Shingles that are min-hashed at a time; bytes of text whose sets are held at a time.
BLOCK, PART = 4096, 4 << 20
#: Sets of the sample that orders shingles, and frequent shingles that it names at most.
SAMPLE, FREQUENT = 4096, 1 << 18
#: Words of a set's parity, which has a bit a shingle within these bounds, and of the wider one that pairs are held to.
PARITY, MOST, WIDE = 4, 128, 128
#: Bucket members that are compared by shifting all rows; comparisons, and words of parity, at a time.
SHIFTS, AT_ONCE, WORDS = 16, 1 << 20, 1 << 20


def mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of width words; a shorter text is one run."""
    digest, words = xxhash.xxh64_digest, text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(b"".join([digest(w, SEED) for w in words]), np.uint64)
    k = min(width, len(x))
    h = np.full(len(x) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h, x[i : i + len(h)])
    return np.unique(h)


def set_key(s: np.ndarray) -> int:
    """One hash for a set; 0 for the empty one."""
    return int(np.frombuffer(xxhash.xxh64_digest(s.tobytes(), SEED), np.int64)[0]) if len(s) else 0


def bands(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's BANDS bucket keys and its sketch; none for the empty set."""
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), BLOCK):
        np.minimum(low, (MULTIPLIERS[:, None] * s[None, a : a + BLOCK]).min(axis=1), out=low)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        h = mixed(h, row)
    nibbles = (mixed(low, np.uint64(1)) >> np.uint64(60)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return h.view(np.int64), np.bitwise_or.reduce(nibbles, axis=1).view(np.int64)


def parity(s: np.ndarray, words: int = 0) -> np.ndarray:
    """Words (a power of two; 0: PARITY to MOST, by the set's size) whose bits say whether the set has an odd number of shingles there.

    Two sets' words differ in at most as many bits as the sets have shingles not in common. Halves of
    the words added without carry are the parity in half as many words.
    """
    words = words or min(MOST, max(PARITY, 1 << (max(len(s) - 1, 0) >> 6).bit_length()))
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set, in the order of the sample's counts and then of the hash, of which two
    sets that are similar enough share one."""
    if not len(s):
        return s
    known, counts = frequent
    size = len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        count = np.where(known[at] == s, counts[at], 0)
        s = s[np.argsort(count, kind="stable")]  # s is sorted by hash
    return s[:size]


def unlike_roots(token: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i, j) of one bucket and different roots, each once. Rows are sorted by token, then root."""
    first = np.flatnonzero(np.diff(token, prepend=token[:1] - 1))
    size = np.diff([*first, len(token)])
    mixed_roots = root[first] != root[first + size - 1]
    bucket = np.repeat(np.arange(len(first)), size)
    small = np.flatnonzero((mixed_roots & (size <= SHIFTS))[bucket])
    for d in range(1, SHIFTS):
        i = small[:-d] if d < len(small) else small[:0]
        j = small[d:] if d < len(small) else small[:0]
        keep = (bucket[i] == bucket[j]) & (root[i] != root[j])
        yield i[keep], j[keep]
    for k in np.flatnonzero(mixed_roots & (size > SHIFTS)).tolist():
        end = first[k] + size[k]
        starts = first[k] + np.flatnonzero(np.diff(root[first[k] : end], prepend=root[first[k]] - 1))
        for a, b in zip(starts.tolist(), starts[1:].tolist()):  # each root's rows against all later ones
            step = max(1, AT_ONCE // (b - a))
            for c in range(b, int(end), step):
                later = np.arange(c, min(c + step, int(end)))
                yield np.repeat(np.arange(a, b), len(later)), np.tile(later, b - a)


def folded(words: np.ndarray, begin: np.ndarray, width: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """Parity of the rows in w words each, from their own width words at begin."""
    at = np.arange(w)
    out = words[begin[rows][:, None] + at]
    for k in range(1, int(width[rows].max(initial=0)) // w):
        wider = np.flatnonzero(width[rows] > k * w)
        out[wider] ^= words[begin[rows[wider]][:, None] + k * w + at]
    return out


def parities_apart(words: np.ndarray, begin: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the parities of rows i and j differ, each pair in the narrower one's words."""
    out, narrow = np.zeros(len(i), np.int64), np.minimum(width[i], width[j])
    for w in np.unique(narrow).tolist():
        of = np.flatnonzero(narrow == w)
        for a in range(0, len(of), max(1, WORDS // w)):
            part = of[a : a + max(1, WORDS // w)]
            out[part] = np.bitwise_count(folded(words, begin, width, i[part], w) ^ folded(words, begin, width, j[part], w)).sum(axis=1)
    return out


def differing(a: str, b: str) -> str:
    """How many of two sketches' min-hashes differ, as SQL."""
    part = []
    for i in range(BANDS * ROWS // 16):
        x = f"({a}[{i}] ^ {b}[{i}])"
        y = f"({x} | shiftright({x}, 1))"
        part.append(f"bit_count(({y} | shiftright({y}, 2)) & {0x1111111111111111}L)")
    return " + ".join(part)


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches whose last column has about PART bytes of text (or one text), with that text."""
    for batch in released(batches):
        last = batch.column(batch.num_columns - 1)
        for a, b in spans(pc.fill_null(pc.binary_length(last), 0).to_pylist(), PART):
            part = batch.slice(a, b - a)
            yield part, texts(part, batch.schema.names[-1])


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """__id, __row, __digest, fp (the set's key), n (its size), keys, sketch, parity for every row, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body in in_parts(batches):
            sets = [shingles(t, width) for t in body]
            keys = [bands(s) for s in sets]
            columns = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([k[i] for k in keys], pa.list_(pa.int64())) for i in range(2)], pa.array([parity(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "fp", "n", "keys", "sketch", "parity"])

    rows = docs.select(F.col(quoted(id_col)).alias("__id"), *[c.alias(n) for n, c in row_key(docs, text_col).items()], F.col(quoted(text_col)).alias("__text"))
    schema = with_fields(rows.drop("__text"), ("fp", "long"), ("n", "long"), ("keys", "array<long>"), ("sketch", "array<long>"), ("parity", "array<long>"))
    return stored(rows.mapInArrow(run, schema), "shingle-signatures")


def set_table(docs: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """fp, s (the set), wide (its WIDE parity words) of the rows with these keys (__row, __digest, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body in in_parts(batches):
            sets = [shingles(t, width) for t in body]
            ends = np.cumsum([0, *map(len, sets)])
            s = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), s, pa.array([parity(x, WIDE) for x in sets], pa.list_(pa.int64()))], ["fp", "s", "wide"])

    rows = docs.join(slots(wanted), slot(docs, text_col) == F.col("__slot"), "left_semi")
    rows = rows.select(*[c.alias(n) for n, c in row_key(docs, text_col).items()], F.col(quoted(text_col)).alias("__text"))
    found = rows.join(wanted.hint("shuffle_hash"), ["__row", "__digest"]).select("fp", "__text")
    return stored(found.mapInArrow(run, "fp long, s array<long>, wide array<long>").dropDuplicates(["fp"]), "shingle-sets")


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches are close."""
    return pairs.join(sketches.toDF("a", "ka"), "a").join(sketches.toDF("b", "kb"), "b").where(f"{differing('ka', 'kb')} <= {DIFFER}").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets are similar enough.

    Wide parity words go out first: whole sets are copied only for pairs that these cannot rule out.
    """
    words = sets.select("fp", "wide", F.size("s").alias("n"))
    apart = F.expr("aggregate(zip_with(wa, wb, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    close = pairs.join(words.toDF("a", "wa", "na"), "a").join(words.toDF("b", "wb", "nb"), "b")
    close = stored(close.where(apart <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-6).select("a", "b"), "shingle-close")
    both = close.join(sets.select("fp", "s").toDF("a", "sa"), "a").join(sets.select("fp", "s").toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return stored(both.where(common >= least * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "shingle-links")


def adjacent(entries: DataFrame, order: list[str]) -> DataFrame:
    """(key, fp, n, b, m): members of each bucket of two or more, with the next one in an order."""
    following = Window.partitionBy("key").orderBy(*order)
    near = entries.withColumns({"b": F.lead("fp").over(following), "m": F.lead("n").over(following), "first": F.lag("fp").over(following).isNull()})
    return near.where("b is not null or not first").select("key", "fp", "n", "b", "m", "turn")


def first_links(docs: DataFrame, fps: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """Links (a, b) between neighbours in the buckets of min-hashes."""
    entries = fps.select("fp", "n", "keys", F.posexplode("keys").alias("i", "key"))
    entries = entries.select("fp", "n", "key", F.expr(f"keys[(i + {BANDS // 2}) % {BANDS}]").alias("turn"))
    shared = stored(adjacent(entries, ["n", "fp"]), "shingle-buckets")
    again = adjacent(shared.select("key", "fp", "n", "turn"), ["turn", "n", "fp"])
    fits = F.least("n", "m") >= least * F.greatest("n", "m")
    pairs = shared.unionByName(again).where(F.col("b").isNotNull() & fits).select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b"))
    held = stored(fps.join(shared.select("fp").distinct(), "fp", "left_semi").select("fp", "sketch"), "shingle-held")
    close = stored(likely(pairs.distinct(), held), "shingle-pairs")
    return verified(close, sets_of(docs, fps, close, text_col, width), least)


def sets_of(docs: DataFrame, fps: DataFrame, pairs: DataFrame, text_col: str, width: int) -> DataFrame:
    """fp, s of the sets in pairs (a, b)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    return set_table(docs, stored(fps.join(ends, "fp", "left_semi").select("__row", "__digest", "fp"), "shingle-wanted"), text_col, width)


def frequent_shingles(docs: DataFrame, fps: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that occur in two or more of SAMPLE sets, and in how many: the FREQUENT most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body in in_parts(batches):
            for t in body:
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, width).view(np.int64))], ["token"])

    chosen = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("__row", "__digest")
    rows = docs.select(*[c.alias(n) for n, c in row_key(docs, text_col).items()], F.col(quoted(text_col)).alias("__text"))
    rows = rows.join(F.broadcast(chosen), ["__row", "__digest"], "left_semi").select("__text")
    counts = rows.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "token").limit(FREQUENT).toPandas()
    known, c = counts["token"].to_numpy(np.int64).view(np.uint64), counts["c"].to_numpy(np.int64)
    order = np.argsort(known)
    return known[order], c[order]


def prefix_buckets(docs: DataFrame, fps: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """token, fp: the prefixes' shingles that two or more sets have in theirs."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, fps, text_col, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, body in in_parts(batches):
            sets = [shingles(t, width) for t in body]
            first = [prefix(s, sent.value, least) for s in sets]
            fp = np.repeat(np.array([set_key(s) for s in sets], np.int64), [len(x) for x in first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*first, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(fp)], ["token", "fp"])

    rows = docs.select(F.col(quoted(text_col)).alias("__text"))
    own = Window.partitionBy("token")
    entries = rows.mapInArrow(run, "token long, fp long").withColumns({"low": F.min("fp").over(own), "high": F.max("fp").over(own)})
    return stored(entries.where("low <> high").select("token", "fp"), "shingle-prefixes")


def unlike_buckets(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """token, fp, n, root of buckets with two or more roots; shingles with the same sets share a bucket.

    A bucket's name is a hash of its members: buckets that it confuses become one, which loses no pair.
    """
    own = Window.partitionBy("token")
    members = entries.distinct().select(F.bit_xor(F.xxhash64("fp")).over(own).alias("token"), "fp").distinct()
    rows = members.join(sets.select("fp", "n", "root"), "fp").withColumns({"low": F.min("root").over(own), "high": F.max("root").over(own)})
    return rows.where("low <> high").select("token", "fp", "n", "root")


def remaining_pairs(entries: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that share a prefix's shingle, have different roots, and may be similar enough.

    entries: token, fp. sets: fp, n, parity, root of distinct fp. A bucket's rows are held at once, a
    bit a shingle and some 50 bytes each (MOST words at most).
    """

    def compared(table: pa.Table) -> pa.RecordBatch:
        token, fp, n, root = (table[c].to_numpy() for c in ("token", "fp", "n", "root"))
        lists = table["parity"].combine_chunks()
        begin = lists.offsets.to_numpy()
        begin, width, words = begin[:-1] - begin[0], np.diff(begin), lists.flatten().to_numpy().view(np.uint64)
        out = [np.zeros((0, 2), np.int64)]
        for i, j in unlike_roots(token, root):
            fits = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-6
            i, j = i[fits], j[fits]
            near = parities_apart(words, begin, width, i, j) <= (n[i] + n[j]) * (1 - least) / (1 + least) + 1e-6
            out.append(np.stack([fp[i[near]], fp[j[near]]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in released(batches):
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            begin = int(np.searchsorted(token, token[-1]))  # the last bucket may go on in the next batch
            if waiting and (begin or waiting[-1].column(0)[-1].as_py() != token[0]):
                yield compared(pa.Table.from_batches([*waiting, batch.slice(0, begin)]))
                waiting = []
            elif begin:
                yield compared(pa.Table.from_batches([batch.slice(0, begin)]))
            waiting.append(batch.slice(begin))
        if waiting:
            yield compared(pa.Table.from_batches(waiting))

    rows = unlike_buckets(entries, sets).join(sets.select("fp", "parity"), "fp").select("token", "fp", "n", "root", "parity")
    return stored(rows.repartition("token").sortWithinPartitions("token", "root").mapInArrow(run, "a long, b long").distinct(), "shingle-rest")


def link_components(docs: DataFrame, fps: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """(node, root) for the sets that have a similar one. fps: distinct fp with a row's key, n, keys, sketch, parity."""
    links = first_links(docs, fps, text_col, width, least)
    roots = stored(components(links), "shingle-roots")
    sets = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "n", "parity", F.coalesce("root", "fp").alias("root"))
    pairs = remaining_pairs(prefix_buckets(docs, fps, text_col, width, least), sets, least)
    if not pairs.take(1):
        return roots
    more = verified(pairs, sets_of(docs, fps, pairs, text_col, width), least)
    return stored(components(links.unionByName(more)), "shingle-roots") if more.take(1) else roots


def grouped(docs: DataFrame, rows: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """__id, __row, __digest, root, component_id for every row of signatures."""
    fps = stored(rows.groupBy("fp").agg(F.min("__id").alias("low"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"), F.min(F.struct("__row", "__digest")).alias("k")).select("*", "k.*").drop("k"), "shingle-distinct")
    roots = link_components(docs, fps, text_col, width, least)
    joined = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    by_fp = joined.join(joined.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.select("__id", "__row", "__digest", "fp").join(by_fp, "fp").drop("fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """<id_col>, component_id for every row: the smallest id that is reachable over links.

    Texts without a word have one empty set and are linked. Null ids count as larger than all others.
    """
    shared_dir(docs.sparkSession)
    return grouped(docs, signatures(docs, id_col, text_col, width), text_col, width, least).select(F.col("__id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY, among: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay when one row of each component does: that with the smallest id (see least_rows).

    among: keys (__row, __digest) of the rows that take part; the others go.
    """
    shared_dir(docs.sparkSession)
    every = signatures(docs, id_col, text_col, width)
    rows = every if among is None else every.join(among, ["__row", "__digest"], "left_semi")
    return least_rows(docs, grouped(docs, rows, text_col, width, least), id_col, text_col, ["root"], every=every)
