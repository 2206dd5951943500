"""Exact deduplication over an extendible-hash index on shared files (DataFrame operations only).

1. Every row becomes an entry without its text: 64-bit hash, SHA-256 and length of the text, id.
2. The directory doubles until no bucket is overfull: a bucket is a prefix of the hash whose length is
   its local depth, and only overfull buckets split. A bucket of one hash cannot split.
3. The index has a row for each hash with its bucket and the length of its chain. It is dealt by key
   ranges (bucket, hash) and written so, a file for each owner task. Entries of one hash are counted
   before they are dealt, so a hash that a third of all rows share is as short as any other.
4. A chain of one entry is a text of its own. The texts of longer chains go to the owners of their key
   ranges, once. An owner walks each chain in the order of its bytes and compares every text with the
   one before it: a class begins where they differ, so different texts that share a hash stay in one
   chain and become different classes. No text is dealt by its content or for a second time.
5. A chain of more than CHAIN_ROWS entries is cut into links that owners walk apart. A link names each
   of its classes by one text; these few are put in order once more to find which of them are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import least_rows, quoted, row_key, shared_dir, stored, table

#: Entries that a bucket should hold; bits that the directory gains where a bucket is overfull.
BUCKET_ROWS, STEP = 100_000, 6
#: Entries of a chain that one owner walks; longer chains are cut into links.
CHAIN_ROWS = 1000


def normalised(text: Column) -> Column:
    """text without the white space of the contract; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def prefix(h: Column, depth: int) -> Column:
    """The first depth bits of a 64-bit hash, as a number."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, bucket_rows: int) -> tuple[DataFrame, int]:
    """((slot, bucket, local_depth) for the slots that occur, global depth).

    The directory begins with as many slots as the entries need if they are spread evenly and doubles
    further while a slot is overfull. A slot's local depth is the least at which its bucket holds at
    most bucket_rows entries or a single hash. entries: h, rows.
    """
    total = entries.agg(F.sum("rows")).first()[0] or 0
    depth = max(0, (-(-total // bucket_rows) - 1).bit_length()) + STEP
    while True:
        depth = min(depth, 63)
        slots = stored(entries.groupBy(prefix(F.col("h"), depth).alias("slot")).agg(F.sum("rows").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")), "dedup-slots")
        if depth == 63 or not slots.where((F.col("n") > bucket_rows) & (F.col("lo") < F.col("hi"))).take(1):
            break
        depth += STEP
    each = slots.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn("at", F.expr(f"shiftright(slot, {depth} - d)"))
    fits = (F.sum("n") <= bucket_rows) | (F.min("lo") == F.max("hi"))
    buckets = each.groupBy("d", "at").agg(fits.alias("fits"))
    deep = each.join(buckets, ["d", "at"]).groupBy("slot").agg(F.coalesce(F.min(F.when(F.col("fits"), F.col("d"))), F.lit(depth)).alias("local_depth"))
    return deep.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {depth} - local_depth), {depth} - local_depth)")), depth


def build_index(entries: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The index in the shared folder: bucket, h, rows (length of the hash's chain), in key order."""
    counted = stored(entries.groupBy("h").agg(F.count("*").alias("rows")), "dedup-hashes")
    slots, depth = directory(counted, bucket_rows)
    index = counted.withColumn("slot", prefix(F.col("h"), depth)).join(slots, "slot").select("bucket", "h", "rows")
    return stored(index.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"), "dedup-index")


def walked(members: DataFrame) -> DataFrame:
    """members (bucket, h, link, norm, uid) with class: the number of the text in its link.

    They are dealt by key range and put in order within it; equal texts stand together, and a class
    begins at every text that is not byte for byte the one before.
    """
    chain = Window.partitionBy("bucket", "h", "link").orderBy("norm", "uid")
    dealt = members.repartitionByRange("bucket", "h", "link").withColumn("before", F.lag("norm").over(chain))
    dealt = dealt.withColumn("starts", F.when(F.col("norm") == F.col("before"), 0).otherwise(1))
    return dealt.withColumn("class", F.sum("starts").over(chain.rowsBetween(Window.unboundedPreceding, 0))).drop("before")


def classes(docs: DataFrame, id_col: str, text_col: str, bucket_rows: int, hash_of, keys: bool, chain_rows: int = CHAIN_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(single, members, found).

    single: rows whose hash no other row has (__id, __sha, and with keys __row, __digest). members: the
    others with h, link, class, n (code points), __sha and uid, each row's place in docs. found: for each
    h, link and class the number `whole` of its text in the chain, the text's rows (size) and the best of
    them (least n negated, then id, null last, then uid).
    """
    text = F.col(quoted(text_col))
    key = [c.alias(n) for n, c in row_key(docs, text_col).items()] if keys else []
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), *key, F.char_length(F.coalesce(text, F.lit(""))).alias("n"), normalised(text).alias("norm"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumn("h", hash_of(F.col("norm")))
    extra = ["__row", "__digest"] if keys else []
    entries = stored(rows.select("h", "__id", *extra, F.sha2("norm", 256).alias("__sha")), "dedup-entries")
    index = build_index(entries, bucket_rows)
    chains = stored(index.where("rows > 1").select("bucket", "h", F.ceil(F.col("rows") / chain_rows).alias("links")), "dedup-chains")
    single = entries.join(chains.select("h"), "h", "left_anti")
    members = walked(rows.join(chains, "h").withColumn("link", F.pmod(F.xxhash64("uid"), F.col("links"))))
    # only the first text of each class in a chain of several links is kept, to compare the links
    name = F.when((F.col("links") > 1) & (F.col("starts") == 1), F.col("norm")).alias("name")
    members = stored(members.select("bucket", "h", "links", "link", "class", "__id", *extra, "n", "uid", F.sha2("norm", 256).alias("__sha"), name), "dedup-members")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("__id").isNull().alias("none"), "__id", "uid")).alias("best")
    found = stored(members.groupBy("bucket", "h", "links", "link", "class").agg(F.count("*").alias("size"), best, F.max("name").alias("name")), "dedup-classes")
    alone = found.where("links = 1").select("h", "link", "class", F.col("class").alias("whole"), "size", "best")
    cut = walked(found.where("links > 1").withColumnsRenamed({"link": "of", "class": "part", "name": "norm"}).withColumns({"link": F.lit(0), "uid": F.struct("of", "part")}))
    same = Window.partitionBy("bucket", "h", "link", "class")
    cut = cut.select("h", F.col("of").alias("link"), F.col("part").alias("class"), F.col("class").alias("whole"), F.sum("size").over(same).alias("size"), F.min("best").over(same).alias("best"))
    return single, members, alone.unionByName(cut)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, hash_of=F.xxhash64, chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space (U+0020, U+0009 to U+000D) is deleted; null is
    empty, whole texts of any length count. The row with the most code points, then the smallest id
    stays (null ids last, of any type that sorts); of repeated rows one stays. An empty table gives an
    empty result; other columns are not read. hash_of: the index's 64-bit hash of a text.
    """
    shared_dir(docs.sparkSession)
    single, members, found = classes(docs, id_col, text_col, bucket_rows, hash_of, False, chain_rows)
    alone = single.select(F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256"))
    both = members.join(found, ["h", "link", "class"])
    shared = both.select(F.col("__id").alias(id_col), F.col("best.__id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("best.uid") == F.col("uid")).alias("kept"), F.col("__sha").alias("text_sha256"))
    return alone.unionByName(shared)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, hash_of=F.xxhash64, chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns (see least_rows)."""
    shared_dir(docs.sparkSession)
    single, members, found = classes(docs, id_col, text_col, bucket_rows, hash_of, True, chain_rows)
    alone = single.select(F.concat(F.lit("s"), "__row").alias("g"), F.col("__digest").alias("t"), F.lit(0).alias("n"), "__id", "__row", "__digest")
    shared = members.join(found.select("h", "link", "class", "whole"), ["h", "link", "class"])
    shared = shared.select(F.col("h").cast("string").alias("g"), F.col("whole").cast("string").alias("t"), (-F.col("n")).alias("n"), "__id", "__row", "__digest")
    return least_rows(docs, alone.unionByName(shared), id_col, text_col, ["g", "t"], ["n"])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha AS text_sha256
FROM t
WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)
"""
