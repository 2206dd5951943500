import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterlane.llm import exact_dedup, shingle_dedup, simhash
from rasterlane.llm.common import components


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out.append((i, min(groups[key])[1], len(groups[key]), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out)


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "ab", "a\tb ", "", None, " ", "é x", "éx", "long " * 3000, f"one {i}", "A b"])) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, h string, size int")
    found = exact_dedup.exact_dedup(docs, bucket_rows=10, chain_rows=7).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == brute_exact(rows)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["keep_id"] for r in found})


def test_repeated_rows_and_null_ids_keep_one(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y"), (2, "y ")], "doc_id long, text string")
    found = exact_dedup.exact_dedup(docs).collect()
    assert sum(r["kept"] for r in found) == 2 and {r["group_size"] for r in found} == {2, 3}
    assert sorted(map(tuple, exact_dedup.keep_first(docs).collect())) == [(1, "x"), (2, "y ")]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_directory_splits_overfull_buckets_only(spark):
    rows = [(0, 50)] + [((1 << 63) - (1 << 64) + (i << 40), 1) for i in range(100)]
    slots, depth = exact_dedup.directory(spark.createDataFrame(rows, "h long, rows long"), 20)
    found = slots.collect()
    assert [r["local_depth"] for r in found if r["slot"] == 0] == [1]  # one hash: doubling cannot split it
    sizes = {}
    for h, n in rows:
        slot = (h % (1 << 64)) >> (64 - depth)
        bucket = next(r["bucket"] for r in found if r["slot"] == slot)
        sizes[bucket] = sizes.get(bucket, 0) + n
    assert all(n <= 20 for b, n in sizes.items() if b) and len(sizes) > 5
    assert depth > exact_dedup.STEP + 3  # it doubled beyond its first size, without a bound


@pytest.mark.parametrize("chain_rows", [1, 9, 1000])
def test_colliding_hashes_make_chains_of_different_texts(spark, chain_rows):
    """Every text has one of two hashes: only the bytes tell them apart, within links and across them."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b", "ab", "", None, "é x", "éx", f"one {i}", "z" * 5000])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda norm: F.length(norm) % 2
    found = exact_dedup.exact_dedup(docs, bucket_rows=10, hash_of=lambda norm: weak(norm).cast("long"), chain_rows=chain_rows).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == brute_exact(rows)
    kept = exact_dedup.keep_first(docs, hash_of=lambda norm: weak(norm).cast("long"), chain_rows=chain_rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["keep_id"] for r in found})


def test_owners_walk_chains_without_dealing_texts_again(spark):
    """One exchange by key range, and none by a text's content."""
    members = spark.createDataFrame([(0, 1, 0, "a", 1), (0, 1, 0, "b", 2), (0, 1, 0, "a", 3), (0, 2, 0, "a", 4)], "bucket long, h long, link long, norm string, uid long")
    out = exact_dedup.walked(members)
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "rangepartitioning(bucket" in exchanges[0] and "norm" not in exchanges[0].partition("]")[0].partition("rangepartitioning")[2].partition(")")[0]
    assert sorted((r["uid"], r["class"]) for r in out.collect()) == [(1, 1), (2, 2), (3, 1), (4, 1)]


def test_any_id_type_and_odd_names(spark):
    docs = spark.createDataFrame([("b", "x y", 1), ("a", "xy", 2), (None, "xy", 3), ("c", None, 4), ("d", " ", 5)], "`my``id` string, text string, h int")
    found = {r[0]: r["keep_id"] for r in exact_dedup.exact_dedup(docs, "my`id").collect()}
    assert found == {"b": "b", "a": "b", None: "b", "c": "d", "d": "d"}
    assert sorted(r["h"] for r in exact_dedup.keep_first(docs, "my`id").collect()) == [1, 5]
    assert sorted(r["h"] for r in simhash.keep_one(docs, "my`id").collect()) == [1, 2, 4]
    assert {r[0]: r["component_id"] for r in simhash.near_duplicates(docs, "my`id").collect()} == {"b": "b", "a": "a", None: "a", "c": "c", "d": "c"}


@pytest.mark.parametrize("keep", [simhash.keep_one, shingle_dedup.keep_one])
def test_rows_are_told_apart_by_more_than_their_id(spark, keep):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black brown grey")
    rows = [(1, a, "s"), (1, b, "s"), (None, a, "t"), (None, b, None), (None, None, "s"), (None, c, "s"), (3, c, "s"), (3, c, "s"), (3, a, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = keep(docs).collect()
    assert sorted(map(str, found)) == sorted(str(r) for r in spark.createDataFrame([(1, a, "s"), (1, b, "s"), (None, None, "s"), (3, c, "s")], docs.schema).collect())
    assert keep(docs.limit(0)).count() == 0 and keep(docs).columns == docs.columns


def brute_fingerprint(text, width=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = ["", " \t", "One", "one two", "One two three four", "a b c " * 900, "É é \x1c x y"]
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]


def test_dense_balls_are_searched_in_bounded_parts():
    """4000 fingerprints within two bits of each other: candidates are compared a part at a time, none is lost."""
    bits = [(1 << a) | (1 << b) for a in range(64) for b in range(a)] + [1 << a for a in range(64)] + [0]
    points = np.array(bits, np.uint64)
    tree, got, most = simhash.VPTree.build(points, simhash.LEAF), 0, 0
    old, simhash.CANDIDATES = simhash.CANDIDATES, 5000
    try:
        for q, p in tree.pairs(points, points[:300], 2):
            got, most = got + len(q), max(most, len(q))
    finally:
        simhash.CANDIDATES = old
    assert got == int((np.bitwise_count(points[:300, None] ^ points[None]) <= 2).sum()) and most <= 5000 + simhash.LEAF
    assert simhash.cuts(np.array([3, 9, 1, 1, 1]), 4) == [(0, 2), (2, 5)] and simhash.cuts(np.zeros(0, np.int64), 4) == []


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_links_against_brute_force(spark, shard_rows):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base) | {b ^ (1 << rng.randrange(64)) for b in base[:60]} | {b ^ (3 << rng.randrange(62)) for b in base[:40]}
    chain = rng.getrandbits(64)
    for k in range(0, 40, 2):
        chain ^= 3 << k
        fps.add(chain)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {r["fp"]: r["root"] for r in simhash.link_components(df, 2, shard_rows).collect()}
    mine = [root.get(int(x), int(x)) for x in fps.view(np.int64)]
    same = {}
    for a, b in zip(label.tolist(), mine):
        assert same.setdefault(a, b) == b
    assert len(set(same.values())) == len(same)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(3, ""), (2, None), (5, "one two three"), (5, "one two three"), (9, "ONE two\tthree"), (None, "one two three"), (7, "others are not like it")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(3, 2), (2, 2), (5, 5), (9, 5), (None, 5), (7, 7)}
    assert {r["fingerprint"] for r in found if r["component_id"] == 2} == {"0" * 16}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(21)} == {0} and {found[100 + i] for i in range(30)} == {100}
