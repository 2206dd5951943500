"""What the pipeline's stages drop and keep beyond the plain cases."""

import numpy as np

import corpus_pipeline
from rasterlane.llm import shingle_dedup
from rasterlane.llm.common import table

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_language_filters_decide(spark):
    docs = table(spark, SF, "documents")
    odd = [(10**6, "ѪѪѬѬ ѮѮѰѰ ѲѲѴѴ", None, None, 14), (10**6 + 1, "the one and the other of them", None, None, 29), (10**6 + 2, "12 34", None, None, 5)]
    found = STAGES["language_id"](spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), SF)
    assert ids(found.where("doc_id >= 1000000")) == [10**6 + 1]


def test_language_without_labels(spark):
    docs = table(spark, SF, "documents")
    rows = [(1, "the one and the other", None, None, 21), (2, "ѪѪѬѬ", None, None, 4), (3, "12 34", None, None, 5), (4, None, None, None, 0)]
    assert ids(STAGES["language_id"](spark, spark.createDataFrame(rows, docs.schema), SF)) == [1, 2]


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_copies_by_shingle_similarity(spark):
    """All pairs by brute force: copies with changed words go, below 0.8 everything stays."""
    base = [[f"w{(i * 7919 + d * 104729) % 5003}" for i in range(150)] for d in range(6)]
    texts = [" ".join(b) for b in base]
    for d, b in enumerate(base):
        for changed in range(1, 8):
            texts.append(" ".join(f"new{d}" if k % 20 == 10 and k // 20 < changed else w for k, w in enumerate(b)))
    texts += ["a b", "A  b", "a c", "one two three four five six seven eight", "one two three four five six seven nine"]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, "only without an id")], "doc_id long, text string")
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(texts):
            for j, b in enumerate(texts[:i]):
                if jaccard(a, b) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in label):
            break
    found = STAGES["simhash_near_dedup"](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == [i for i, x in enumerate(label) if i == x]
    assert [r["text"] for r in found if r["doc_id"] is None] == ["only without an id"]
    assert 6 < len(set(label)) < len(texts)




def test_no_link_is_lost_in_a_crowded_bucket(spark, monkeypatch):
    """All min-hashes put every text into one bucket, with unlinked ones between; its links are found all the same."""
    base = [[f"w{(i * 7919 + d * 104729) % 50021}" for i in range(60)] for d in range(60)]
    common = [f"c{i}" for i in range(70)]
    texts = [" ".join(common + b) for b in base] + [" ".join([*common, *b[:57], "x", "y", "z"]) for b in base]
    monkeypatch.setattr(shingle_dedup, "bands", lambda s: (np.zeros(shingle_dedup.BANDS if len(s) else 0, np.int64), np.zeros(8 if len(s) else 0, np.int64)))
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(texts, texts[60:])) and max(jaccard(a, b) for i, a in enumerate(texts) for b in texts[:i] if i < 60) < 0.8
    sets = [shingle_dedup.shingles(t) for t in texts]
    pairs = {(i, j) for i, a in enumerate(sets) for j in range(i) if len(np.intersect1d(a, b := sets[j])) >= 0.8 * len(np.union1d(a, b))}
    label = list(range(len(texts)))
    for i, j in sorted(pairs):
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    order = np.random.default_rng(3).permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    assert {r[0]: r[1] for r in shingle_dedup.near_duplicates(docs).collect()} == dict(enumerate(label))


def test_pairs_of_unlike_roots():
    """Small and large buckets alike give each pair of one bucket and different roots once."""
    rng = np.random.default_rng(5)
    token = np.sort(np.concatenate([rng.integers(0, 40, 200), np.full(90, 99)]))
    root = rng.integers(0, 6, len(token))
    order = np.lexsort((root, token))
    token, root = token[order], root[order]
    found = [(min(i, j), max(i, j)) for x, y in shingle_dedup.unlike_roots(token, root) for i, j in zip(x.tolist(), y.tolist())]
    want = {(i, j) for i in range(len(token)) for j in range(i + 1, len(token)) if token[i] == token[j] and root[i] != root[j]}
    assert len(found) == len(set(found)) and set(found) == want


def test_parity_tells_long_unlike_sets_apart(spark):
    """A family of long sets that share half of their shingles: 256 bits say nothing about them, a bit a shingle does."""
    rng = np.random.default_rng(11)
    common = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 600).astype(np.uint64)])) for _ in range(40)]
    sets.append(np.unique(np.concatenate([sets[0][:-60], rng.integers(0, 1 << 63, 60).astype(np.uint64)])))
    sets.append(sets[1][: int(0.81 * len(sets[1]))])  # similar enough, and in fewer words of parity at times
    rows = [(i, len(s), shingle_dedup.parity(s).tolist(), i) for i, s in enumerate(sets)]
    entries = spark.createDataFrame([(int(t), i) for i, s in enumerate(sets) for t in s[:400].view(np.int64)], "token long, fp long")
    frame = spark.createDataFrame(rows, "fp long, n long, parity array<long>, root long")
    found = {(r["a"], r["b"]) for r in shingle_dedup.remaining_pairs(entries, frame, 0.8).collect()}
    assert {(0, 40), (1, 41)} <= found and len(found) < 20


def test_shingles_of_the_same_sets_share_a_bucket(spark):
    entries = spark.createDataFrame([(t, fp) for t in range(500) for fp in (1, 2)] + [(900, 1), (900, 3), (901, 3), (901, 4)], "token long, fp long")
    sets = spark.createDataFrame([(1, 9, 1), (2, 9, 2), (3, 9, 3), (4, 9, 3)], "fp long, n long, root long")
    found = shingle_dedup.unlike_buckets(entries.unionByName(entries), sets).collect()
    assert sorted((r["fp"], r["root"]) for r in found) == [(1, 1), (1, 1), (2, 2), (3, 3)] and len({r["token"] for r in found}) == 2


def test_parity_in_fewer_words():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 3, 256, 257, 700, 5000, 20000)]
    words = [shingle_dedup.parity(s).view(np.uint64) for s in sets]
    assert list(map(len, words)) == [4, 4, 4, 8, 16, 128, 128]
    width = np.array(list(map(len, words)))
    i, j = np.triu_indices(len(sets), 1)
    found = shingle_dedup.parities_apart(np.concatenate(words), np.cumsum(width) - width, width, i, j)
    for a, b, n in zip(i.tolist(), j.tolist(), found.tolist()):
        w = min(width[a], width[b])
        assert n == np.bitwise_count(shingle_dedup.parity(sets[a], w).view(np.uint64) ^ shingle_dedup.parity(sets[b], w).view(np.uint64)).sum()
        assert n <= len(np.setxor1d(sets[a], sets[b]))
