import base64
import hashlib
import zlib

import numpy as np
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterlane.llm import huffman, warc
from rasterlane.llm.common import open_input, shared_path, table


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=3000), st.integers(6, 16))
def test_codes_round_trip(ids, bits):
    ids = np.array(ids)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=50), bits)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= max(bits, 6) and (2.0**-used).sum() <= 1 and (lengths[ids] > 0).all()
    coder = huffman.Coder(lengths)
    packed, offsets = coder.pack(ids)
    assert coder.unpack(packed, offsets, len(ids), coder.table()).tolist() == ids.tolist()


def test_lengths_are_optimal_where_unlimited():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert (counts * huffman.code_lengths(counts)).sum() == cost


def test_token_files_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(huffman, "LANES", 2)
    rows = [(5, "five words are in here", 1), (1, None, 1), (3, "", 1), (None, "no id", 1), (3, "again", 1), (9, "long " * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    manifest = huffman.write_tokens(docs, shared_path(spark, "test-tokens"))
    found = huffman.read_digests(spark, manifest).collect()
    lib = huffman.library_encoder().library
    want = sorted((i is not None, i or 0, len(ids := [*lib.encode(t or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == [None, 1, 3, 3, 5, 9]
    assert huffman.read_digests(spark, huffman.write_tokens(docs.limit(0), shared_path(spark, "test-tokens"))).count() == 0


def test_archives_round_trip(spark):
    body = "<html>" + "text " * 400 + "</html>"
    rows = [(i, f"http://x/{i}", body if i % 3 == 0 else f"{body}{i}", 1) for i in range(60)] + [(100, None, None, 1), (101, "u\nv", "", 1), (None, "n", "n", 1), (7, "http://x/7", f"{body}7", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, uri int")
    manifest = warc.write_archives(pages, shared_path(spark, "test-warc"))
    found = warc.read_archives(manifest).collect()
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = sorted(str((i, len((h or "").encode()), sha(h))) for i, _, h, _ in rows)
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"])) for r in found) == want
    assert sorted(str(r["page_id"]) for r in found if r["record_type"] == "response") == sorted(map(str, first.values()))
    of = {sha(h): i for h, i in first.items()}
    assert all(r["refers_to"] == (of[r["payload_digest"]] if r["record_type"] == "revisit" else None) for r in found)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response"}
    assert payloads[1] == f"{body}1".encode()
    assert warc.read_archives(warc.write_archives(pages.limit(0), shared_path(spark, "test-warc"))).count() == 0


def test_a_dictionary_leads_each_large_file(spark):
    rows = [(i, "u", "".join(f"<p>{i * j % 977} some words of page {i % 13}</p>" for j in range(120))) for i in range(800)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), shared_path(spark, "test-warc"), file_bytes=1 << 30)
    for r in manifest.collect():
        from rasterlane.llm.common import open_input

        with open_input(r["uri"]) as f:
            head = f.read(4)
        assert head == warc.DICTIONARY_FRAME.to_bytes(4, "little")
    assert warc.read_archives(manifest).count() == 800


def leading_dictionary(uri):
    from rasterlane.llm.common import open_input

    with open_input(uri) as f:
        magic, n = (int.from_bytes(f.read(4), "little") for _ in range(2))
        return magic == warc.DICTIONARY_FRAME and f.read(n)


def test_every_archive_has_a_dictionary(spark):
    """On the small tables, in small files, and where there is next to nothing to build it from."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    for frame, least in ((pages, 4 << 20), (pages, 64 << 10), (pages.limit(2), 1), (pages.where("page_id < 0").unionByName(pages.limit(1).selectExpr("page_id", "url", "null as html")), 1)):
        manifest = warc.write_archives(frame, shared_path(spark, "test-warc"), least_file_bytes=least)
        rows = manifest.collect()
        assert rows and all(len(leading_dictionary(r["uri"])) >= 64 for r in rows)
        assert sorted(r["page_id"] for r in warc.read_archives(manifest).collect()) == sorted(r["page_id"] for r in frame.collect())
    one = warc.write_archives(pages, shared_path(spark, "test-warc")).collect()
    assert len(one) == 1 and one[0]["bytes"] < pages.selectExpr("sum(length(html))").first()[0] / 2
    packed = zstandard.ZstdCompressor(level=3)
    assert one[0]["bytes"] < sum(len(packed.compress((r["html"] or "").encode())) for r in pages.collect())  # the dictionary pays


def plain_ids(codes, lengths, data, bit, count):
    """Ids from a bit on, one bit at a time by a table of code words."""
    words = {(int(n), int(c)): i for i, (n, c) in enumerate(zip(lengths, codes)) if n}
    bits, out, n, c = "".join(f"{b:08b}" for b in data), [], 0, 0
    while len(out) < count:
        n, c, bit = n + 1, c * 2 + int(bits[bit]), bit + 1
        if (n, c) in words:
            out.append(words[n, c])
            n = c = 0
    return out


def test_blocks_decode_alone_with_a_plain_decoder(spark, monkeypatch):
    """The file format from its description: header, code lengths, offsets, documents."""
    import json
    import struct

    monkeypatch.setattr(huffman, "LANES", 2)
    docs = spark.createDataFrame([(i, f"text number {i} " + "and so on " * (i % 7 * 100), "x") for i in range(40)], "doc_id long, text string, n string").coalesce(1)
    (m,) = huffman.write_tokens(docs, shared_path(spark, "test-tokens"))
    lib = huffman.library_encoder().library
    want = [x for i in range(40) for x in [*lib.encode(f"text number {i} " + "and so on " * (i % 7 * 100), add_special_tokens=False).ids, 2]]
    with open_input(m["uri"]) as f:
        raw = f.read()
    assert raw[:8] == raw[-8:] == huffman.MAGIC
    n = struct.unpack("<I", raw[8:12])[0]
    header = json.loads(raw[12 : 12 + n])
    lengths = np.frombuffer(zlib.decompress(raw[12 + n : 12 + n + header["lengths"]]), np.uint8)
    codes, top = {}, 0  # canonical: by length, then id
    code = np.zeros(len(lengths), np.int64)
    for length in range(1, int(lengths.max()) + 1):
        top *= 2
        for i in np.flatnonzero(lengths == length):
            code[i], top = top, top + 1
    begin, k = 12 + n + header["lengths"], struct.unpack("<I", raw[-12:-8])[0]
    footer = json.loads(raw[-12 - k : -12])
    end = len(raw) - 12 - k - footer["offsets"]
    offsets = np.frombuffer(raw[end : end + footer["offsets"]], "<u8")
    assert footer["tokens"] == len(want) and len(offsets) == -(-len(want) // header["block"]) > 3
    per = header["segment"] // header["block"]
    with open_input(m["uri"]) as f:
        file = huffman.TokenFile(f)
        for b, bit in enumerate(offsets.tolist()):
            mine = want[b * header["block"] : (b + 1) * header["block"]]
            a, z = footer["segments"][b // per : b // per + 2]
            assert plain_ids(code, lengths, raw[begin + a : begin + z], bit, len(mine)) == mine
            assert file.block(b).tolist() == mine


def test_token_files_take_ids_of_any_type(spark):
    for kind, value in (("smallint", "3"), ("double", "2.5"), ("date", "date'2020-01-02'"), ("decimal(10,2)", "1.25"), ("binary", "x'00ff'"), ("boolean", "true"), ("timestamp", "timestamp'2020-01-02 03:04:05'"), ("string", "'a'")):
        docs = spark.range(3).selectExpr(f"case when id > 0 then cast({value} as {kind}) end as `d id`", "concat('some text ', id) as text", "1 as start")
        found = huffman.read_digests(spark, huffman.write_tokens(docs, shared_path(spark, "test-tokens"), "d id"), "d id", kind).collect()
        assert sorted(str(r["d id"]) for r in found) == sorted(str(r["d id"]) for r in docs.collect()) and len({r["ids_crc32"] for r in found}) == 3


def test_a_file_holds_a_bounded_number_of_documents(spark, monkeypatch):
    """Empty texts that all have one id are dealt to several files, and leave a reader in several batches."""
    monkeypatch.setattr(huffman, "ROWS", 100)
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'' as text")
    ids = huffman.encoded(docs)
    lengths = np.zeros(50_000, np.uint8)
    lengths[2] = 1
    manifest = huffman.write_files(ids, shared_path(spark, "test-tokens"), lengths, huffman.VOCABULARY, huffman.library_encoder().kind, file_docs=500)
    assert len(manifest) > 4 and sum(m["docs"] for m in manifest) == 3000 and max(m["docs"] for m in manifest) < 1500
    found = huffman.read_digests(spark, manifest).collect()
    assert sorted(r["start"] for r in found) == list(range(3000)) and {r["n_tokens"] for r in found} == {1}
    sizes = [d.num_rows for d, _, _ in huffman.read_file(manifest[0]["uri"])]
    assert max(sizes) == 100 and sum(sizes) == manifest[0]["docs"]


def test_archives_of_odd_ids_and_long_payloads(spark):
    rows = [("b", "same", 1), ("a", "same", 2), ("", "same", 3), (None, "same", 4), (None, "own", 5), ('q"\n%é', "x" * 3_000_000, 6), ("%0A", None, 7)]
    pages = spark.createDataFrame(rows, "`p``id` string, html string, id int")
    found = warc.read_archives(warc.write_archives(pages, shared_path(spark, "test-warc"), id_col="p`id", uri_col=None), "p`id", "string").collect()
    got = {(r["p`id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in found}
    assert got == {
        ("b", 4): ("revisit", ""), ("a", 4): ("revisit", ""), ("", 4): ("response", None), (None, 4): ("revisit", ""), (None, 3): ("response", None),
        ('q"\n%é', 3_000_000): ("response", None), ("%0A", 0): ("response", None),
    }
