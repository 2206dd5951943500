import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rasterlane.llm import chat, quality, subword_lm
from rasterlane.llm.common import table

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    found = quality.op1_quality(spark, SF).join(table(spark, SF, "labels").select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    one, zero = found[found.quality == 1].score.to_numpy(), found[found.quality == 0].score.to_numpy()
    assert (one[:, None] > zero[None]).mean() > 0.9
    assert ((found.score >= 0.3) == (found.predicted == 1)).all() and found.score.between(0, 1).all()


def test_chunks_cover_whole_texts():
    for size in (0, 1, 511, 512, 513, 5000):
        at = quality.chunk_starts(size)
        seen = np.zeros(max(size, 1), bool)
        for a in at:
            seen[a : a + quality.CHUNK] = True
        assert seen.all() and len(quality.chunks_of(bytes(size))) == len(at)


def brute_score(net, raw):
    """Chunk by chunk, window by window, byte by byte."""
    x = (list(raw) * (quality.CHUNK // max(1, len(raw)) + 1))[: quality.CHUNK] if len(raw) <= quality.CHUNK else list(raw)
    x = x or [0] * quality.CHUNK
    starts = [*range(0, len(x) - quality.CHUNK, quality.STRIDE), len(x) - quality.CHUNK]
    pooled = []
    for a in starts:
        best = np.zeros(quality.FILTERS)
        for w in range(a, a + quality.CHUNK - quality.STEP, quality.STEP):
            seen = np.concatenate([net.embed[b] for b in x[w : w + 2 * quality.STEP]]).astype(float)
            best = np.maximum(best, seen @ np.vstack([net.early, net.late]).astype(float) + net.bias)
        pooled.append(best)
    f = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0), np.min(pooled, axis=0)])
    return 1 / (1 + math.exp(-(f @ net.out.astype(float) + net.base[0])))


def test_quality_against_brute_force():
    net = quality.Network.fresh()
    rows = [b"", b"a", b"some words " * 30, bytes(range(256)) * 9, b"x" * 513]
    assert np.allclose(net.score(rows), [brute_score(net, r) for r in rows], atol=1e-5)
    assert all(net.score([r])[0] == s for r, s in zip(rows, net.score(rows)))


def test_fit_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "good " * (50 + i) if i % 2 else "bad " * (50 + i)) for i in range(60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    net = quality.fit(docs, labels)
    assert all(np.array_equal(a, b) for a, b in zip(net.parts(), quality.fit(docs.dropDuplicates(), labels.distinct()).parts()))
    small = quality.fit(docs, labels, rows_per_class=5, bytes_per_class=400)
    assert not np.array_equal(net.out, small.out)
    assert len(quality.scored(docs, quality.fit(docs.limit(0), labels)).select("score").distinct().collect()) == 1


def test_quality_gradients():
    net = quality.Network.fresh()
    for p in net.parts():
        p[...] = p.astype(np.float32)
    rng = np.random.default_rng(0)
    chunks = rng.integers(0, 255, (5, quality.CHUNK), dtype=np.uint8)
    starts, y, w = np.array([0, 2]), np.array([1.0, 0.0], np.float32), np.array([1.0, 3.0], np.float32)

    def loss():
        z = net.combined(net.pooled(chunks), starts).astype(float)
        p = 1 / (1 + np.exp(-z))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    for p, g in zip(net.parts(), net.gradients(chunks, starts, y, w)):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i].copy()
        p[i] = old + 1e-2
        up = loss()
        p[i] = old - 1e-2
        down = loss()
        p[i] = old
        assert abs((up - down) / 2e-2 - g[i]) < 0.05 * abs(g[i]) + 1e-3


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text", "c"), (2, None, "c"), (3, "", "c"), (4, "x " * 200_000, "c"), (None, "good text", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (50, 1)], "doc_id long, quality int")
    found = quality.scored(docs, quality.fit(docs, labels))
    rows = found.collect()
    assert found.columns == ["doc_id", "text", "score", "predicted"] and rows[1]["score"] == rows[2]["score"] and rows[0]["score"] == rows[4]["score"]
    assert quality.scored(docs, quality.fit(docs, labels.limit(0))).count() == 5


def brute_lattice(t, weights, word):
    s = b" " + word
    ways = [0.0] * (len(s) + 1)
    ways[0] = 1.0
    for i in range(len(s)):
        node = 0
        for j in range(i, len(s)):
            node = t.step[node, s[j]]
            if not node:
                break
            if t.piece[node] >= 0:
                ways[j + 1] += ways[i] * weights[t.piece[node]]
    return math.log(ways[-1] * weights[-1])


def test_lattice_sums_all_segmentations():
    t = subword_lm.load()
    lattice = subword_lm.Lattice(t, t.prior)
    words = [b"the", b"thering", b"x", "éß漢".encode(), b"a" * 70, b"the"]
    got = subword_lm.log_probabilities(lattice, words)
    assert np.allclose(got, [brute_lattice(t, t.prior, w) for w in words])
    counts = np.zeros(len(t.prior))
    for _, w in subword_lm.by_length(words):
        counts += lattice.expected(w, np.ones(len(w)))
    assert abs(counts[t.first].sum() - len(words)) < 1e-6 and abs(counts[-1] - len(words)) < 1e-9


def test_scores_against_brute_force(spark):
    """Every kind, every word, every segmentation, in plain Python; counts of kinds from the texts themselves."""
    texts = ["the cat sat on the mat", "a cat and the dog", "der hund und die katze", "die katze der hund das haus", "", None, "zzyzx the", "The THE\tthe", "the cat sat on the mat"] * 2
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, c0 string")
    learn = F.col("doc_id") % 5 != 1
    m = subword_lm.fit(docs, learn, "doc_id", "text")
    centre = subword_lm.kinds(docs.select(F.coalesce("text", F.lit("")).alias("text"), learn.alias("learn")))
    counts, ends = [Counter() for _ in range(subword_lm.KINDS)], [0] * subword_lm.KINDS
    for i, x in enumerate(texts):
        if i % 5 != 1:
            raw = (x or "").lower().encode()
            k = int((centre @ subword_lm.histogram(raw)).argmax())
            counts[k].update(raw.split())
            ends[k] += 1
    assert m.totals.ends.tolist() == ends and m.totals.words.tolist() == [sum(c.values()) for c in counts]
    t, tokens = subword_lm.load(), sum(ends) + sum(sum(c.values()) for c in counts)
    stop = sum(ends) / tokens

    def brute(x):
        out = 0.0
        for k, c in enumerate(counts):
            p = (ends[k] + 1) / (sum(ends) + len(ends)) * stop
            for w in (x or "").lower().encode().split():
                p *= (1 - stop) * math.exp(brute_lattice(t, m.weights[k], w))
            out += p
        return math.log10(out)

    for r in subword_lm.score(docs, learn).collect():
        assert abs(r["score"] - brute(texts[r["doc_id"]])) < 1e-4
    assert abs(sum(10 ** brute(x) for x in ("the", "cat"))) < 1


def test_re_estimation_never_lowers_the_likelihood(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    m = subword_lm.fit(docs, F.lit(True), "doc_id", "text")
    rows = m.counts.where("c > 0").select("w", *subword_lm.COUNTS).toPandas()
    words, got = [bytes(w) for w in rows["w"]], []
    for rounds in (0, 1, 3):
        weights = subword_lm.estimate(m.counts, subword_lm.VOCABULARY, rounds)
        got.append(sum((subword_lm.log_probabilities(subword_lm.Lattice(subword_lm.load(), w), words) * rows[c]).sum() for w, c in zip(weights, subword_lm.COUNTS)))
    assert got[0] < got[1] < got[2]


def test_kinds_are_told_apart(spark):
    """By all training texts: the same kinds in plain Python, and groups that share no runs."""
    rng = np.random.default_rng(0)
    groups = [[b"abc abd aba ", b"bca "], [b"xyz xyy ", b"zzx "], [b"123 456 ", b"789 "], [b"mno nop ", b"opm "]]
    rows = [b"".join(rng.choice(g, 40)).decode() for g in groups for _ in range(15)]
    docs = spark.createDataFrame([(x, i % 15 > 0) for i, x in enumerate(rows)] + [(None, True)], "text string, learn boolean").fillna("").repartition(3)
    centre = subword_lm.kinds(docs)
    found = [int((centre @ subword_lm.histogram(r.encode())).argmax()) for r in rows]
    assert [len(set(found[i : i + 15])) for i in range(0, 60, 15)] == [1, 1, 1, 1] and len(set(found)) == 4
    hist = subword_lm.histograms([x for i, x in enumerate(rows) if i % 15 > 0])
    assert np.allclose(subword_lm.centred(subword_lm.mass(hist, centre)), centre, atol=1e-6)  # at rest over all texts
    assert (subword_lm.histogram(b"") == 0).all() and subword_lm.histogram(b"abcd").sum() == 2


def test_every_training_text_moves_the_kinds(spark, monkeypatch):
    """More texts than seeds: those that are no seeds count too."""
    monkeypatch.setattr(subword_lm, "SEEDS", 4)
    docs = spark.range(200).selectExpr("concat('some words ', id, case when id % 2 = 0 then ' zzq zzq' else ' kkj kkj' end) as text", "true as learn")
    some, every = subword_lm.kinds(docs.limit(50)), subword_lm.kinds(docs)
    assert not np.allclose(some, every)


def test_base_scores_and_counts(spark):
    rows = [(1, "The the cat"), (2, None), (3, ""), (4, "a\x1cb \x85 cat"), (5, "dog " * 2000), (5, "dog " * 2000), (6, "unseen words")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, w int")
    found = {r["doc_id"]: r for r in subword_lm.score(docs, F.col("doc_id") != 6).collect()}
    split = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "").encode().split()
    c = Counter()
    for i, t in rows:
        if i != 6:
            c.update(split(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        tokens = [*split(t), None]
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[x] > 0 for x in tokens), n)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)) < 1e-6
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert subword_lm.score(docs, F.lit(False)).count() == 7
    assert subword_lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_roles_and_turns_come_back(spark):
    """By line and by turn, on conversations that were not learned from."""
    found = chat.op3_chat(spark, SF).where("held_out").join(table(spark, SF, "conversations").selectExpr("conv_id", "turn", "role"), ["conv_id", "turn"]).toPandas()
    truth = found.line == 0
    marked = found.rendered.notna()
    assert len(found) > 200 and marked.all()
    assert (found.role_pred == found.role).mean() > 0.8
    assert (found.begins_turn == truth).mean() > 0.85
    turns = found[truth]
    assert ((turns.role_pred == turns.role) & turns.begins_turn).mean() > 0.75
    assert 0.8 * truth.sum() < found.begins_turn.sum() < 1.2 * truth.sum()


def every_path(model, seen):
    """The best score over all sequences of states, one by one."""
    best = (-math.inf, None)
    for path in itertools.product(range(chat.STATES), repeat=len(seen)):
        score, before = 0.0, chat.START
        for s, x in zip(path, seen):
            score += model.move[before, s] + model.show[s, x]
            before = s
        best = max(best, (score, path))
    return best


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(3)
    model = chat.Model(rng.integers(0, 9, (chat.STATES + 1, chat.STATES)).astype(float), rng.integers(0, 9, (chat.STATES, chat.SYMBOLS)).astype(float))
    for n in (1, 2, 3, 4, 5):
        seen = rng.integers(0, chat.SYMBOLS, n)
        score, path = every_path(model, seen)
        assert model.path(seen).tolist() == list(path)
        assert abs(model.matrix(seen)[chat.START].max() - score) < 1e-9


def test_transcripts_cut_anywhere_and_over_many_stretches(spark, monkeypatch):
    """Line by line, by turns or as one row: the same states and the same canonical form; and as one Viterbi path over all."""
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"line {i}\nmore\n\nand more" if i % 3 else f"what is {i}?") for i in range(700)]
    turns += [(2, 0, "user", "hi"), (3, 0, "system", "be kind"), (3, 1, "user", "User: ok"), (3, 1, "user", "User: ok"), (None, None, None, None)]
    frame = chat.as_transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    model = chat.learn(frame)
    whole = frame.where("conv_id = 1").orderBy("turn").toPandas()["text"].str.cat(sep="\n")
    path = model.path(chat.symbols(whole)).tolist()
    monkeypatch.setattr(chat, "BLOCK", 16)
    as_one = spark.createDataFrame([(1, 0, whole)], "conv_id long, turn long, text string")
    forms = []
    for rows, order in ((chat.lines_of(frame), ("turn", "line")), (frame, ("turn",)), (as_one, ("turn",))):
        found = sorted((r for r in chat.formatted(rows, model, order_cols=order).collect() if r["conv_id"] == 1), key=lambda r: r["ord"])
        assert [s for r in found for s in r["states"]] == path
        forms.append("".join(r["rendered"] for r in found))
    assert forms[0] == forms[1] == forms[2] and forms[0].count("<|im_start|>") == forms[0].count("<|im_end|>") == sum(s % 3 == chat.FIRST for s in path)
    short = [r for r in chat.formatted(frame, model).collect() if r["conv_id"] != 1]
    assert len(short) == 5 and all(r["rendered"].endswith("<|im_end|>\n") for r in short if r["conv_id"] != 3)


def test_chat_of_odd_rows(spark):
    rows = [("b", 1, "User: " + "long " * 100_000), ("b", 2, None), (None, None, "[AI]: x"), ("", 1, "user: y"), ("", 1, "user: y")]
    frame = spark.createDataFrame(rows, "`c``id` string, turn int, text string")
    found = chat.formatted(frame, chat.Model(np.zeros((chat.STATES + 1, chat.STATES)), np.zeros((chat.STATES, chat.SYMBOLS))), "c`id")
    assert found.columns == ["c`id", "ord", "text", "states", "rendered"] and found.count() == 5
    assert sorted(r["rendered"] for r in found.collect() if r["c`id"] is None) == ["<|im_start|>assistant\nx\n<|im_end|>\n"]
    empty = frame.limit(0).withColumn("role", F.lit("user"))
    assert chat.formatted(empty, chat.learn(empty, "c`id"), "c`id").count() == 0


def test_rendering():
    u, a = chat.ROLES.index("user") * 3, chat.ROLES.index("assistant") * 3
    text = "### Human:\nhello\nthere\n\nAI: yes"
    assert chat.render(text, [u, u + 1, u + 1, u + 2, a], True, True) == "<|im_start|>user\nhello\nthere\n<|im_end|>\n<|im_start|>assistant\nyes\n<|im_end|>\n"
    assert chat.render("AI: yes", [a], False, False) == "<|im_end|>\n<|im_start|>assistant\nyes\n"
