import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from rasterlane.llm import language_id
from rasterlane.llm.common import table
from tests.llm.test_dedup import brute_exact, brute_fingerprint

SF = "/root/testdata/sf0.001"


def has_a_language(model, text):
    """Gram by gram and bit by bit: whether any language has more grams than accident would give it."""
    if not regex.search(r"\p{L}", text):
        return False
    body, full = "  " + text.lower() + "  ", (1 << 64) - 1
    grams = len(body) - 3
    hits = [0] * len(model.languages)
    for i in range(grams):
        h = 0
        for c in body[i : i + 4]:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & full
            h ^= h >> 29
        for k in range(len(hits)):
            hits[k] += all(int(model.words[k // 8][(h >> s) % language_id.SLOTS]) >> k % 8 & 1 for s in (0, 22))
    return any(n / grams > f for n, f in zip(hits, model.fill))


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b)) if a or b else 1


def least_edits(items, text):
    """For each item the least edit distance to any stretch of the text (dynamic programming, a column a character)."""
    wide = max(map(len, items))
    pattern = np.array([[ord(c) for c in t.ljust(wide, "\0")] for t in items])
    n, steps = np.array([len(t) for t in items]), np.arange(wide + 1)
    column = np.broadcast_to(steps, (len(items), wide + 1)).copy()
    best = column[np.arange(len(items)), n]
    for c in text:
        new = np.minimum(column[:, :-1] + (pattern != ord(c)), column[:, 1:] + 1)
        new = np.hstack([np.zeros((len(items), 1), int), new])
        column = np.minimum.accumulate(new - steps, axis=1) + steps
        best = np.minimum(best, column[np.arange(len(items)), n])
    return best


def test_against_plain_python(spark):
    """Every stage again without Spark or the operators' code; only the fitted language filter is shared."""
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    model = language_id.fit(language_id.training(table(spark, SF, "documents")))
    rows = [(i, t or "") for i, t in rows if has_a_language(model, t or "")]
    keep = {k for _, k, *_ in brute_exact(rows)}
    rows = [r for r in rows if r[0] in keep]
    split = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, t in rows]
    fps = np.array([brute_fingerprint(t, 5) for _, t in rows], np.uint64)
    near, label = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2, np.arange(len(rows))
    while (label != (new := np.array([label[n].min() for n in near]))).any():
        label = new
    rows, split = [r for k, r in enumerate(rows) if label[k] == k], [w for k, w in enumerate(split) if label[k] == k]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if jaccard(a, sets[j]) >= 0.8 and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    items = [" ".join(t.lower().split()) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    most = np.array([len(t) * 5 // 100 for t in items])
    rows = [(i, t) for i, t in rows if not (least_edits(items, " ".join(t.lower().split())) <= most).any()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation(), library.no_padding()
    ids = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch([t for _, t in rows], add_special_tokens=False)]
    want = sorted((i, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (i, t), x in zip(rows, ids))
    found = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert found == want and 0 < len(want) < 200


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    odd = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "12 34", "en", "s", 5), (None, "the one and the other", "en", "s", 9)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    assert zlib.crc32(b"1") >= 0


@pytest.mark.parametrize("name", ["language_id", "exact_dedup"])
def test_clean_documents_stay(spark, name):
    docs = table(spark, SF, "documents").dropDuplicates(["text"])
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() >= 0.98 * docs.count()
