import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterlane.llm import bpe, huffman

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ALPHABET = [*"abtheingionER  \n\t.,!'sdl01é漢😀\xa0\x1c\x85", "<|endoftext|>", " the", "'ll", "  ", "zzzz"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join) | st.text(max_size=30))
def test_encoders_give_the_library_s_ids(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    e = bpe.encoder()
    assert np.frombuffer(e.encode(text), "<u4").tolist() == expected
    h = huffman.library_encoder()
    assert np.frombuffer(h.encode([text])[0], h.kind).tolist() == expected
    assert bpe.decode_rows(e.v, [e.encode(text)]) == [LIBRARY.decode(expected, skip_special_tokens=False).encode()]


def test_words_merge_exactly():
    v, rng = bpe.encoder().v, random.Random(3)
    for _ in range(500):
        word = bytes(rng.choice(b"aabbcetionrsh") for _ in range(rng.randint(1, 40)))
        assert v.encode_word(word) == bpe.plain_merge(v, word)


def test_small_caches_change_nothing():
    e = bpe.Encoder(bpe.encoder().v, cache=400)
    text = "the cat and the dog and the cat " * 5
    assert np.frombuffer(e.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_round_trip_of_odd_rows(spark):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (1, "a b", "x"), (None, "word " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs).collect()}
    for i, text, _ in rows:
        ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4")
        assert (i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()) in found
    assert bpe.round_trip(docs.limit(0)).count() == 0
    back = bpe.detokenised(bpe.tokenised(docs)).where("doc_id = 1").first()
    assert back["decoded"] == "a b"


def test_long_pieces_are_encoded_but_never_kept():
    """Scripts without spaces: a cache holds bytes, not entries."""
    rng = random.Random(5)
    rows = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)) for _ in range(20)]
    e, h = bpe.Encoder(bpe.encoder().v), huffman.LibraryEncoder(huffman.VOCABULARY)
    for text in rows:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        spaced = LIBRARY.encode(f"x {text}", add_special_tokens=False).ids
        assert np.frombuffer(e.encode(text), "<u4").tolist() == ids and np.frombuffer(e.encode(f"x {text}"), "<u4").tolist() == spaced
        assert np.frombuffer(h.encode([text])[0], h.kind).tolist() == ids and np.frombuffer(h.encode([f"x {text}"])[0], h.kind).tolist() == spaced
    held = sum(len(k) for cache in (e.pretokens, e.first, e.spaced, h.heads, h.new) for k in cache)
    assert held < 3000


def test_caches_are_bounded_by_bytes(monkeypatch):
    p = bpe.Pieces(lambda x: x.encode(), "", 10_000)
    for i in range(5000):
        assert p[f"piece {i}"] == f"piece {i}".encode()
        assert sum(bpe.weight(k, v) for k, v in p.items()) <= 10_000 and sum(bpe.weight(k, v) for k, v in p.old.items()) <= 10_000
    monkeypatch.setattr(huffman, "CACHE", 10_000)
    h = huffman.LibraryEncoder(huffman.VOCABULARY)
    for i in range(40):
        text = " ".join(f"word{i * 50 + j}," for j in range(50))
        assert np.frombuffer(h.encode([text])[0], h.kind).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert sum(bpe.weight(k, v) for k, v in h.new.items()) <= 10_000


def test_words_with_a_sign_are_kept_once():
    """The cache holds stems; a comma or full stop after letters costs no entry, and odd words keep their own ids."""
    h = huffman.LibraryEncoder(huffman.VOCABULARY)
    for text in ("x elephant elephant, elephant. été, été x1, a.b, , .. É.", "x elephant. brandnew, elephant\n two　 　three 漢字, été", "x " + "y" * 70 + ", z"):
        assert np.frombuffer(h.encode([text])[0], h.kind).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert {"elephant", "été", "brandnew", "x1,"} <= set(h.new) and not {"elephant,", "elephant.", "été,", "brandnew,"} & set(h.new)


def test_line_ends_and_runs_of_signs_cost_no_entries():
    """Words around a line's end and before signs are looked up by themselves, whatever stands beside them in a batch."""
    h = huffman.LibraryEncoder(huffman.VOCABULARY)
    rows = ["x elephant!!\nTiger elephant,%%%\nTiger... elephant\nTiger", "x elephant\r\nTiger\r\n\r\nelephant", "\nTiger\n", "x\n\n\nTiger", "elephant\n", "x  elephant\nTiger", "x y'!!! it's. é́!! ×!! z---------", "", "x<|endoftext|>\ny", "x elephant \nTiger\n elephant"]
    for ids, text in zip(h.encode(rows), rows):
        assert np.frombuffer(ids, h.kind).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    one = huffman.LibraryEncoder(huffman.VOCABULARY)
    one.encode(["x elephant!!\nTiger elephant,%%%\nTiger... elephant\nTiger"])
    assert set(one.new) == {"elephant", "\nTiger"}


def test_small_batches_are_joined():
    """Each call looks up its words among all kept ones, so batches of few rows are encoded together."""
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array(["x" * n])], ["id", "text"]) for i, n in enumerate([10, 10, 5000, 10, 10, 10])]
    found = list(huffman.filled(iter(batches), 1000))
    assert [b.num_rows for b in found] == [2, 1, 3] and [x for b in found for x in b.column(0).to_pylist()] == [*range(6)]
    assert list(huffman.filled(iter([]))) == []
