"""What the operators of this subpackage share: shared folders, tables, batching, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: The folder that stands in for spark.checkpoint.dir in a local session that has none.
LOCAL: dict[str, str] = {}
#: Slots of rows' keys that tell rows which surely stay, or are surely not looked for, from the rest.
SLOTS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, only a local session (tests) gets one of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL.get("dir") or LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="rasterlane-"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rasterlane/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    found = docs.select(F.sum(F.octet_length(F.col(quoted(text_col)))).alias("b")).first()["b"]
    return int(found or 0)


def with_fields(df: DataFrame, *more: tuple[str, str]) -> StructType:
    """df's columns and more (name, type), whatever characters the names have."""
    out = StructType(list(df.schema.fields))
    for name, kind in more:
        out = out.add(name, StructType.fromDDL(f"x {kind}")["x"].dataType)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_key(df: DataFrame, text_col: str) -> dict[str, Column]:
    """__row and __digest: equal for rows that are equal in every column, different for others.

    Two rows that differ share both only if their texts have one SHA-256 and their columns one 64-bit hash.
    """
    every = [F.col(quoted(c)) for c in df.columns]
    plain = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(every, df.schema.fields)]
    return {"__row": F.xxhash64(*plain, *[c.isNull() for c in every]), "__digest": F.sha2(F.coalesce(F.col(quoted(text_col)), F.lit("")), 256)}


def slots(keys: DataFrame) -> DataFrame:
    """The slots (SLOTS at most) that rows' __row fall into, small enough to go to every task."""
    return F.broadcast(keys.select(F.pmod("__row", F.lit(SLOTS)).alias("__slot")).distinct())


def slot(docs: DataFrame, text_col: str) -> Column:
    return F.pmod(row_key(docs, text_col)["__row"], F.lit(SLOTS)).alias("__slot")


def least_keys(keyed: DataFrame, group: list[str], first: list | None = None) -> DataFrame:
    """__row, __digest of the row that stays of each group, in the shared folder (see least_rows)."""
    order = F.struct(*(first or []), F.col("__id").isNull().alias("none"), "__id", "__row", "__digest")
    kept = keyed.groupBy(*group).agg(F.min(order).alias("__k"))
    return stored(kept.select(F.col("__k.__row").alias("__row"), F.col("__k.__digest").alias("__digest")), "kept")


def least_rows(docs: DataFrame, keyed: DataFrame, id_col: str, text_col: str, group: list[str], first: list | None = None, every: DataFrame | None = None) -> DataFrame:
    """Of each group one row of docs stays, with all its columns.

    keyed: group columns, __id, __row, __digest (of row_key) and what first needs. The row that is
    least in first (if given), then has the smallest id (null last), then the smallest key stays; of
    rows that are equal in every column one stays. Rows are found by their key, never by id alone.
    every: the keys of all rows of docs, where keyed has not all of them.

    Rows in whose slot nothing goes stay where they are; the others are matched with the keys that stay.
    """
    kept = least_keys(keyed, group, first)
    counts = (keyed if every is None else every).groupBy("__row", "__digest").agg(F.count("*").alias("n"))
    going = counts.join(kept.withColumn("stays", F.lit(True)), ["__row", "__digest"], "left").where("n > 1 or stays is null")
    going = stored(going.select("__row", "n"), "going")
    marked = docs.withColumn("__slot", slot(docs, text_col))
    safe = marked.join(slots(going), "__slot", "left_anti").drop("__slot")
    found = marked.join(slots(going), "__slot", "left_semi").drop("__slot")
    found = found.withColumns(row_key(docs, text_col)).join(kept.hint("shuffle_hash"), ["__row", "__digest"], "left_semi")
    if going.where("n > 1").take(1):
        found = found.dropDuplicates(["__row", "__digest"])
    own = [F.col(quoted(c)) for c in docs.columns]
    return safe.select(*own).unionByName(found.select(*own))


def spans(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to about limit; a longer row gets a range of its own."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; after the last one Arrow gives back what it keeps of freed memory, as workers serve on."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A column of strings; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.names.index(name)).to_pylist()]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected edges (a, b).

    Alternates large-star and small-star steps until the edges stay the same. Each round is two
    aggregations and joins on the node, and is cut by a checkpoint in the shared folder.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    seen = None
    for _ in range(rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = small.select("x.a", "x.b").where("a <> b").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def open_output(uri: str):
    """(stream, commit): a file that appears under its name only when commit() is called.

    Any file system that pyarrow knows by the URI; the folder must be one that executors share.
    """
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    out = fs.open_output_stream(f"{path}.tmp")

    def commit() -> None:
        out.close()
        fs.move(f"{path}.tmp", path)

    return out, commit


def open_input(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)
