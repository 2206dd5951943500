import random
from collections import Counter
from decimal import Decimal

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterlane.llm import decontaminate as dec
from rasterlane.llm import language_id as lid
from rasterlane.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = lid.op8_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out and lang is not null")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    assert found.where("score < 0 or score > 1").count() == 0


def test_odd_texts_and_columns(spark):
    docs = table(spark, SF, "documents")
    model = lid.fit(lid.training(docs), docs_per_language=100)
    rows = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "12 !?", 5.0), (4, "the and of the", 5.0), (4, "the and of the", 5.0), (None, "der und die ist nicht " * 100_000, 5.0)], "doc_id long, text string, score double")
    found = lid.identify(rows, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [r["lang_pred"] for r in found.collect()] == ["und", "und", "und", "en", "en", "de"]
    empty = lid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in lid.identify(rows, empty).collect()} == {"und"}
    assert lid.identify(rows.limit(0), model).count() == 0


def test_batches_do_not_matter(spark):
    model = lid.fit(lid.training(table(spark, SF, "documents")), docs_per_language=50)
    texts = ["the thing and", "le une de", "x", "la que los ción"]
    whole = model.predict(texts)
    assert [model.predict([t]) for t in texts] == [([a], [b]) for a, b in zip(*whole)]


def edit(a, b):
    row = [0] * (len(b) + 1)
    best = None
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        best = min(row)
    return best if a else 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=20), st.text("abc ", max_size=60))
def test_myers_is_the_least_distance_to_a_stretch(item, text):
    assert dec.myers(dec.pattern_bits(item), len(item), text, 99) == edit(item, text)


def test_contamination_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 20, 40])))) for k in range(12)]
    docs = []
    for i in range(150):
        body = [word() for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            t = list(items[i % 12][1])
            for _ in range(rng.choice([0, 1, 4, 9, 25])):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["z"], [t[at], "q"]])
            body.insert(rng.randint(0, len(body)), "".join(t).upper().replace(" ", "\n "))
        docs.append((i, " ".join(body)))
    expected = set()
    for i, text in docs:
        for k, item in items:
            d = edit(dec.normalise(item), dec.normalise(text))
            if d <= dec.budget(len(dec.normalise(item))):
                expected.add((i, k, d))
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(998, None, 1), (999, "", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (77, None), (78, " ")], "item_id long, text string")
    for block in (dec.BLOCK_BYTES, 300):
        assert {tuple(r) for r in dec.find_contamination(frame, bench, block_bytes=block).collect()} == expected
    kept = dec.decontaminated(frame, bench)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, *_ in expected} | {998, 999}
    assert dec.find_contamination(frame, bench.limit(0)).count() == 0
    assert dec.find_contamination(frame.limit(0), bench).count() == 0


def test_budget_follows_the_length_alone():
    assert [dec.budget(m) for m in (1, 19, 20, 23, 24, 40, 100, 399)] == [0, 0, 1, 1, 1, 2, 5, 19]
    assert all(min(len(p) for _, p in dec.pieces("x" * m, dec.budget(m))) >= min(m, 10) for m in range(1, 500))


def test_edited_items_in_a_very_long_text_and_odd_keys(spark):
    item = "the quick brown fox jumps over a lazy dog by the river"
    long = "filler words of no meaning " * 40_000
    rows = [("a", f"{long} {item.replace('quick', 'quack').upper()} {long}", 1), ("a", long, 2), (None, item.replace("brown", "brwn"), 3), ("b", None, 4), ("c", item[:30], 5)]
    docs = spark.createDataFrame(rows, "`d``id` string, text string, item int")
    bench = spark.createDataFrame([(Decimal("1.50"), item), (Decimal("1.50"), item), (None, item)], "item_id decimal(9,2), text string")
    found = dec.find_contamination(docs, bench, "d`id")
    assert found.schema["item_id"].dataType == bench.schema["item_id"].dataType
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [(d, k, 1) for d in ("a", None) for k in (Decimal("1.50"), Decimal("1.50"), None)]))
    assert sorted(r["item"] for r in dec.decontaminated(docs, bench, "d`id").collect()) == [2, 4, 5]


def plain_hash(gram):
    h = 0
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
    return h


def plain_grams(text):
    x = "  " + text.lower() + "  "
    return [x[i : i + 4] for i in range(len(x) - 3)]


def plain_slots(gram):
    h = plain_hash(gram)
    return [h % lid.SLOTS, (h >> 22) % lid.SLOTS]


def test_the_filter_against_sets_of_n_grams(spark):
    """Bits, shares and predictions from Python sets of each language's own n-grams."""
    rng = random.Random(8)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["quick", "brown", "fox", "über"], "cc": ["lorem", "brown", "zzz", "漢字"]}
    train = [(" ".join(rng.choices(words[k], k=rng.randrange(1, 9))), k) for k in words for _ in range(40)]
    train += [("lorem ipsum", "aa")] * 200 + [(None, "aa"), ("no language", None), ("", "bb")]
    model = lid.fit(spark.createDataFrame(train, "text string, lang string"))
    own = {}
    for k in sorted(words):
        texts = {t for t, lang in train if lang == k and t is not None}  # a text that repeats counts once
        counts = Counter(g for t in texts for g in set(plain_grams(t)))
        own[k] = {g for g, n in counts.items() if n >= max(min(2, len(texts)), lid.SHARE * min(lid.DOCS_PER_LANGUAGE, len(texts)))}
    assert model.languages == sorted(words)
    filled = {k: {p for g in own[k] for p in plain_slots(g)} for k in own}
    for i, k in enumerate(model.languages):
        assert set(np.flatnonzero(model.words[i // 8] >> np.uint8(i % 8) & 1).tolist()) == filled[k]
    asked = ["lorem brown fox", "zzz 漢字", "ipsum " * 50, "unheard", "1 2 3", "", "x"]
    langs, scores = model.predict(asked)
    for text, lang, score in zip(asked, langs, scores):
        grams = plain_grams(text)
        share = []
        for k in model.languages:
            accident = (len(filled[k]) / lid.SLOTS) ** 2
            hit = sum(all(p in filled[k] for p in plain_slots(g)) for g in grams) / max(1, len(grams))
            share.append(max(hit - accident, 0) / max(1 - accident, 1e-9))
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        best = max(range(3), key=lambda i: share[i])
        assert lang == model.languages[best] and abs(score - (share[best] / sum(share) if sum(share) else 0)) < 1e-9


def test_the_sample_is_of_different_texts_and_bounded(spark):
    """One hot text is taken once; rows and bytes are limits, not aims."""
    rows = [("hot text of all", "aa")] * 3000 + [(f"text number {i} " + "w" * 80, "aa") for i in range(500)] + [(f"other {i}", "bb") for i in range(5)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    sample, sizes = lid.sampled(frame, 50, 1 << 20)
    found = Counter(r["lang"] for r in sample.collect())
    assert sizes == {"aa": 501, "bb": 5} and found["aa"] == 50 and found["bb"] == 5
    assert sample.where("text like 'hot%'").count() <= 1
    small, _ = lid.sampled(frame.where("lang = 'aa'"), 400, 2000)
    assert 2000 <= sum(len(r["text"]) for r in small.collect()) < 2000 + 120
