import math
import random
import re
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pytest

from rasterlane.llm import collocations, hard_negatives, permutation_index, queries
from rasterlane.llm.vectors import usable

SF = "/root/testdata/sf0.001"


# Phrases


def brute_phrases(rows, limit=2000, longest=4, least=30, covered=80):
    """[(lang, rank, phrase, a, l, r, n, score)] with dictionaries and Python integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    f = {k: a for k, a in f.items() if a >= least}
    out = []
    for (lang, *w), a in f.items():
        if len(w) == 1:
            continue
        if any(100 * b >= covered * a and any(list(x[i + 1 : i + 1 + len(w)]) == w for i in range(len(x) - len(w))) for x, b in f.items() if x[0] == lang and len(x) - 1 > len(w)):
            continue
        cut = min((2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, cut[0], a, " ".join(w), f[lang, *w[: cut[1]]], f[lang, *w[cut[1] :]]))
    out.sort(key=lambda r: (r[0], -r[1], -r[2], r[3].encode()))
    return [(lang, rank, p, a, left, right, n[lang], s) for lang, group in groupby(out, lambda r: r[0]) for rank, (_, s, a, p, left, right) in enumerate(group, 1) if rank <= limit]


def some_texts(seed):
    rng = random.Random(seed)
    words = ["a", "B", "b", "é", "É", "x\x01", "hot", "hot", "tail", "　wide", "co-op"]
    return [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", ";:", "!?"]) for _ in range(rng.randrange(60)))) for _ in range(120)]


@pytest.mark.parametrize(("at_once", "bits"), [(200, 6), (1 << 20, 18)])
def test_phrases_against_brute_force(spark, at_once, bits):
    """Also with texts cut between pieces, and with so few buckets that most of them are shared."""
    rows = some_texts(1) + [(None, None), ("en", ""), ("en", " \t"), ("fr", "hot tail " * 500), ("de", "no end to this piece " * 40)]
    docs = spark.createDataFrame([(a, b, "c", 7) for a, b in rows], "lang string, text string, phrase string, n int").repartition(3)
    want = brute_phrases(rows, least=12)
    found = map(tuple, collocations.collocations(docs, least=12, bucket_bits=bits, at_once=at_once).collect())
    assert sorted(found, key=lambda r: (r[0], r[1])) == want and len(want) > 20


def test_phrases_keep_the_first_of_each_language(spark):
    rows = some_texts(2)
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = collocations.collocations(docs, limit=3, least=10, covered=50, longest=3, bucket_bits=12)
    assert sorted(map(tuple, found.collect())) == sorted(brute_phrases(rows, 3, 3, 10, 50))


def test_phrases_of_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs, bucket_bits=10).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("x", "")], "lang string, text string"), bucket_bits=10).collect() == []


def test_bitmaps_let_every_frequent_phrase_through(spark):
    docs = spark.createDataFrame([("en", "a b c. " * 40), ("en", "c d. " * 3)], "lang string, text string")
    first = collocations.passed(docs, 1, 3, 30, 12, None, None, 1 << 20)
    bits = collocations.Bits(np.frombuffer(collocations.bitmap(first, 30, 12), np.uint8))
    w = collocations.Words([b"a b c", b"c d"], np.array([0, 0]))
    h = collocations.mixed(collocations.hashes(w.dictionary.to_pylist())[w.word] ^ collocations.hashes([b"en"])[0])
    pairs = collocations.grown(h[:-1], collocations.hashes(w.dictionary.to_pylist())[w.word][1:])
    assert bits[pairs[:2]].all() and not bits[pairs[3:]].any()  # a b, b c; not c d


# Vectors


def brute_neighbours(rows, asked, count=10):
    out = {}
    for q, v in asked:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, x))), i) for i, x in rows if i != q)
        out[q] = near[:count]
    return out


ODD = [(901, None), (902, [0.0, 0.0, 0.0]), (903, [1.0, None, 2.0]), (904, [float("nan"), 1.0, 1.0]), (905, [float("inf"), 1.0, 1.0]), (906, []), (907, [1.0, 2.0])]


def test_neighbours_with_the_whole_share_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)]  # many ties and repeats
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame([(i, v, "x", 0.0) for i, v in rows + ODD], "vec_id long, embedding array<double>, id string, score double").repartition(3)
    asked = [r for r in rows if r[0] % 10 == 0]
    found = permutation_index.neighbours(df, df.where("vec_id % 10 = 0 or vec_id > 900"), share=1.0, pivots=20, prefix=6, shard_rows=70, block_bytes=600).collect()
    want = brute_neighbours(rows, asked)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got == want
    few = df.where("vec_id < 4")
    assert {r["query_id"]: 0 for r in permutation_index.neighbours(few).collect()} == {i: 0 for i, _ in rows if i < 4}
    assert permutation_index.neighbours(df.where("vec_id > 900")).count() == 0 and permutation_index.neighbours(df.limit(0)).count() == 0


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(4)
    near = np.stack([rng.permutation(30)[:8] for _ in range(50)]).astype(np.int32)
    files = permutation_index.Files.post(near, 30)
    for q in near[:10]:
        place = [{p: k for k, p in enumerate(x.tolist())} for x in near]
        mine = {p: k for k, p in enumerate(q.tolist())}
        want = [sum(abs(mine.get(p, 8) - x.get(p, 8)) for p in range(30)) for x in place]
        assert files.footrule(q, 50).tolist() == want


def test_recall_of_the_query(spark):
    found = queries.QUERIES["op12_permutation_index"](spark, "/root/testdata/sf0.1").collect()
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(np.float64)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = got[ids[q]]
        assert sorted(mine) == list(range(1, 11)) and all(np.isclose(s, d[ids == v][0], rtol=1e-12) for v, s in mine.values())
        hits += len({v for v, _ in mine.values()} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 0.95 * 10 * len(got) and len(got) == 20


def brute_negatives(rows, anchors, lower=30, upper=90, positives=5, negatives=10):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows]
    out = []
    for i, v, y in [r for r in rows if r[0] in anchors]:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in rows)
        for p, j, _ in [s for s in scored if s[2] == y and s[1] != i][:positives]:
            fit = [s for s in scored if s[2] != y and lower * -p <= 100 * -s[0] <= upper * -p][:negatives]
            out += [(i, j, k, s[1], -p, -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e6])
def test_hard_negatives_against_brute_force(spark, scale):
    """Small chunks and blocks, ties, negative and zero scores, scores beyond exact doubles."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) * scale for x in rng.integers(-3, 4, 4)], int(rng.integers(3))) for i in range(250)]
    odd = [(i, None if v is None else (v + [1.0])[: len(v) + 1] if i == 903 else v, 1) for i, v in ODD if i != 902] + [(950, [1.0, 1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, score string").repartition(3)
    found = hard_negatives.hard_negatives(df, df.where("vec_id % 10 = 0"), chunk_bytes=32 * 40, block_bytes=600)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, set(range(0, 250, 10)))


def test_hard_negatives_beyond_a_long_and_of_empty_tables(spark):
    df = spark.createDataFrame([(1, [1e300], "a"), (2, [1e300], "a"), (3, [1e-300], "b"), (4, [0.5], "b")], "vec_id long, embedding array<double>, label string")
    assert hard_negatives.hard_negatives(df, df.where("vec_id = 1")).collect() == []  # the negatives score 0 and the long's end
    assert hard_negatives.products(np.array([[1e300]]), np.array([[1e300], [-1e300]]), 256).tolist() == [[(1 << 63) - 1, -(1 << 63)]]
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(df.where("label = 'a'")).count() == 0


def test_repeated_anchors_count_once_and_repeated_rows_each(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0)] * 2 + [(2, [1.0, 0.0], 0)] * 2 + [(3, [0.5, 0.0], 1)] * 2, "vec_id long, embedding array<float>, label int")
    found = sorted(map(tuple, hard_negatives.hard_negatives(df, df.where("vec_id = 1")).collect()))
    assert found == sorted([(1, 2, 1, 3, 65536, 32768), (1, 2, 2, 3, 65536, 32768)] * 2)


def test_limits_are_exact():
    for p in (-7, 0, 1, 33, 10**18 + 7, -(10**18)):
        least, most = hard_negatives.limits(p, 30, 90)
        assert 100 * least >= 30 * p > 100 * (least - 1) and 100 * most <= 90 * p < 100 * (most + 1)


def test_usable_takes_the_most_frequent_length(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [3.0, 4.0]), (4, [3.0])], "a long, v array<float>")
    rows, dim = usable(df, "a", "v", "usable-test")
    assert dim == 1 and sorted(r["id"] for r in rows.collect()) == [1, 4]


@pytest.mark.parametrize("name", ["op11_collocations", "op13_hard_negatives"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
