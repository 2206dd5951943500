"""WARC archives compressed record by record with a Zstandard dictionary.

Every archive file begins with a skippable frame that holds a dictionary built from records of that
file; each record then is a Zstandard frame of its own, so a reader needs nothing but the file and
may start at any record. Where the records are too few or too alike to train entropy tables on, the
dictionary is their content alone, which Zstandard takes as well; no archive is without one. Records
whose payload another record has already are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_input, open_output, quoted, shared_path, stored, table, text_bytes

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Payload bytes that a file should hold, and at least where that leaves cores idle.
FILE_BYTES, LEAST_FILE_BYTES = 256 << 20, 4 << 20
#: Largest dictionary, its share of the bytes that it is built from (one in), those bytes, and the
#: length of the slices that records are cut into for it.
DICTIONARY_BYTES, SHARE, SAMPLE_BYTES, SLICE = 64 << 10, 16, 4 << 20, 2 << 10
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: object) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(key))}"


def named(key: str | None) -> str:
    """An id as a header's value: null is nothing; others are JSON strings, which have no line ends and
    tell an empty id apart."""
    return "" if key is None else json.dumps(key)


def from_name(value: str) -> str | None:
    return json.loads(value) if value else None


def record(key: str | None, uri: str, payload: bytes, kind: str, refers_to: str | None) -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP header of its payload and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id(key)}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": uri.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "X-Page-ID": named(key),
        "Content-Type": "application/http; msgtype=response",
    }
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_id(refers_to)}>", "X-Refers-To-Page-ID": named(refers_to)}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; its length and block digest are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of one sixteenth of the records' bytes, at most 64 KB; records are cut into slices,
    so that few long ones are samples enough."""
    slices = [raw[a : a + SLICE] for raw in samples for a in range(0, len(raw), SLICE)]
    size = min(DICTIONARY_BYTES, max(1 << 10, sum(map(len, slices)) // SHARE))
    try:
        return zstandard.train_dictionary(size, slices, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the beginnings of the records themselves
        each = max(64, size // max(1, len(samples)))
        return b"".join(raw[:each] for raw in samples)[:size]


class ArchiveWriter:
    """Holds records until there are enough for a dictionary, then writes as they come."""

    def __init__(self, uri: str, level: int = 3):
        self.uri, self.level = uri, level
        self.out, self.commit = open_output(uri)
        self.held: list[bytes] = []  # a longer record is cut for the dictionary only
        self.size = self.records = self.bytes = 0
        self.z = None

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.z is not None:
            self.bytes += self.out.write(self.z.compress(raw))
            return
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= SAMPLE_BYTES:
            self.begin()

    def begin(self) -> None:
        d = dictionary([raw[:SAMPLE_BYTES] for raw in self.held])
        self.bytes += self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(d)) + d)
        self.z = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=True)
        for raw in self.held:
            self.bytes += self.out.write(self.z.compress(raw))
        self.held = []

    def close(self) -> None:
        if self.z is None:
            self.begin()
        self.commit()


def read_archive(uri: str, at_once: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive in order."""
    with open_input(uri) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{uri} does not begin with a dictionary")
        z, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(n))), b""
        frame, parts = z.decompressobj(), []
        while True:
            if not rest:
                rest = f.read(at_once)
                if not rest:
                    break
            parts.append(frame.decompress(rest))
            rest = b""
            if frame.eof:
                rest = frame.unused_data
                yield parse(b"".join(parts))
                frame, parts = z.decompressobj(), []
        if parts and any(parts):
            raise ValueError(f"{uri} ends within a record")


def decided(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """pages with __tie (the row's hash), __of (the id of the response) and __first (whether the row is
    that response or a repeat of it).

    Digests, not payloads, are grouped; of equal payloads the smallest id (null last) is the response,
    and of rows with that id the first by the whole row's hash.
    """
    body = F.coalesce(F.col(quoted(payload_col)), F.lit(""))
    every = [F.col(quoted(c)).cast("string") for c in pages.columns]
    rows = pages.withColumns({"__sha": F.sha2(body, 256), "__tie": F.xxhash64(*every, *[c.isNull() for c in every]), "__id": F.col(quoted(id_col))})
    keys = rows.where(F.octet_length(body) >= least_bytes).select("__sha", "__id", "__tie")
    first = keys.groupBy("__sha").agg(F.count("*").alias("size"), F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__tie")).alias("low")).where("size > 1")
    first = stored(first.select("__sha", F.col("low.__id").alias("__of"), F.col("low.__tie").alias("__low")), "warc-copies")
    return rows.join(first, "__sha", "left").withColumn("__first", F.col("__low").isNull() | ((F.col("__low") == F.col("__tie")) & F.col("__id").eqNullSafe(F.col("__of"))))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", least_bytes: int = 0, file_bytes: int = FILE_BYTES, least_file_bytes: int = LEAST_FILE_BYTES
) -> DataFrame:
    """Writes a record for every row; returns the manifest: uri, records, bytes of each file.

    Null payloads are empty, payloads of any length are written whole. Ids of any type that sorts and
    casts to text and back; null ids are kept and come last. Rows that are equal in id, payload and
    uri meet in one file, where the first becomes the response if any of them is to be; rows of
    one id that differ do not meet. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = decided(pages.select(*[F.col(quoted(c)) for c in dict.fromkeys([id_col, payload_col, *([uri_col] if uri_col else [])])]), id_col, payload_col, least_bytes)
    uri = F.coalesce(F.col(quoted(uri_col)).cast("string"), F.lit("")) if uri_col else F.lit("")
    rows = rows.select(F.col("__id").cast("string").alias("id"), uri.alias("uri"), F.coalesce(F.col(quoted(payload_col)), F.lit("")).alias("body"), F.col("__of").cast("string").alias("of"), F.col("__low").isNotNull().alias("copied"), "__first", F.col("__tie").alias("tie"))
    size = text_bytes(pages, payload_col)
    files = max(1, -(-size // file_bytes), min(-(-size // least_file_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, number, written = None, TaskContext.get().partitionId(), set()
        for batch in batches:
            for key, target, body, of, copied, first, tie in zip(*(c.to_pylist() for c in batch.columns)):
                if w is None:
                    w = ArchiveWriter(f"{folder}/part-{number:06d}-{uuid.uuid4().hex}.warc.zst")
                payload = body.encode("utf-8", "surrogatepass")
                again = first and (key, tie) in written
                if first and copied:
                    written.add((key, tie))
                w.add(record(key, target, payload, "response" if first and not again else "revisit", of))
        if w is not None:
            w.close()
            yield pa.RecordBatch.from_arrays([pa.array([w.uri]), pa.array([w.records], pa.int64()), pa.array([w.bytes], pa.int64())], ["uri", "records", "bytes"])

    return stored(rows.repartition(files, "id", "tie").mapInArrow(run, "uri string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, id_col: str = "page_id", id_type: str = "long") -> DataFrame:
    """<id_col>, payload_bytes, payload_digest, record_type, refers_to, uri, archive, payload of every record."""
    files = manifest.select("uri").repartition(max(1, manifest.count()))
    names = ["id", "payload_bytes", "payload_digest", "record_type", "of", "uri", "archive", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                out: list[tuple] = []
                size = 0
                for head, block in read_archive(uri):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                    kind, full = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or digest(payload) != full):
                        raise ValueError(f"damaged payload in {uri}")
                    of = from_name(head.get("X-Refers-To-Page-ID", ""))
                    out.append((from_name(head["X-Page-ID"]), length, full, kind, of, head["WARC-Target-URI"], uri, payload if kind == "response" else None))
                    size += len(payload)
                    if size > 8 << 20:
                        yield made(out, names)
                        out, size = [], 0
                if out:
                    yield made(out, names)

    found = files.mapInArrow(run, "id string, payload_bytes long, payload_digest string, record_type string, of string, uri string, archive string, payload binary")
    return found.select(F.col("id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("of").cast(id_type).alias("refers_to"), "uri", "archive", "payload")


def made(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = write_archives(pages, shared_path(spark, "warc"))
    return read_archives(manifest, id_type=pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
