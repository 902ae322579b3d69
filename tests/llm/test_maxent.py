import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sumfold.llm import maxent
from sumfold.llm.common import crc_mod
from tests.llm.helpers import frame, odd_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, ids):
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for t in texts]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for t, h in zip(tokens, held, strict=True)]


@pytest.mark.parametrize("head", [maxent.HEAD, 8, 0])
def test_base_scores_equal_brute_force(spark, head):
    texts = [*odd_texts(), *[prose(30, s) + f" rare{s} Rare{s % 3} ÄÖ" for s in range(40)]]
    ids = [*range(len(texts) - 1), None]
    docs = frame(spark, texts, ids)
    held = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    got = maxent.score(docs, maxent.train(docs, ~held, head=head, rounds=1), held).collect()
    assert len(got) == len(texts)
    want = Counter((i, *w[:4], round(w[4], 6)) for i, w in zip(ids, brute(texts, ids), strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_learns_and_probabilities_add_up(spark):
    en, fr = "the of and to in a is that it for".split(), "le la de et les des un une que pour".split()
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(en if j % 2 else fr, 60)) for j in range(300)]
    docs = frame(spark, texts)
    held = crc_mod("doc_id", 5) == 1
    model = maxent.train(docs, ~held)
    got = maxent.score(docs, model, held).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s > got.b + 0.1 * got.n  # a tenth of a decade for each token at least
    for context in ([b"the", b"of"], [b"la"], [b"zz"], [b"le", b"zz", b"zz"]):
        assert mass(model, context) == pytest.approx(1, abs=1e-5)


def probability(model, counts, context, word):
    """Of one word after a context, or of an unknown word of each class if word is a class."""
    v, w = model.vocabulary, model.weights
    b, at = maxent.Batch(v, [[*context, b"\x01" if isinstance(word, int) else word]]), len(context)
    if isinstance(word, int):
        b.group[at], b.place[at], b.word[at], b.again[at] = word, v.side - 1, -1, False
    log, ratio = maxent.token_logs(v, w, b)
    if b.word[at] >= 0:
        return math.exp(log[at])
    return math.exp(log[at]) * ((0 if isinstance(word, int) else counts.get(word, 0)) + 0.5 + ratio[at])


def mass(model, context):
    """Of all that can follow: known words, the end among them, an unknown word of each class, and the last word if it is unknown."""
    counts = {bytes(r.token): r.c for r in model.counts.collect()}
    total = sum(probability(model, counts, context, x) for x in [*counts, *range(model.vocabulary.side - 1)])
    if context[-1] not in counts:  # its share as an unknown word is counted already
        total += probability(model, counts, context, context[-1]) - 0.5 * math.exp(maxent.token_logs(model.vocabulary, model.weights, maxent.Batch(model.vocabulary, [[*context, context[-1]]]))[0][len(context)])
    return total


@pytest.mark.parametrize("head", [maxent.HEAD, 6, 0])
def test_scores_equal_brute_force(spark, head):
    texts = [*odd_texts(), *[prose(30, s) + f" rare{s} rare{s} Rare{s % 3} rare{s % 3} ÄÖ ÄÖ" for s in range(30)], "new new new known"]
    docs = frame(spark, texts)
    held = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    model = maxent.train(docs, ~held, head=head, rounds=1)
    counts = {bytes(r.token): r.c for r in model.counts.collect()}
    for context in ([b"river", b"stone"], [b"rare1", b"rare1"], [b"never"]):
        assert mass(model, context) == pytest.approx(1, abs=1e-5)
    for r in maxent.score(docs, model, held).collect():
        words = [*maxent.tokens(texts[r.doc_id]), maxent.END]
        if len(words) < 60:
            assert r.score == pytest.approx(sum(math.log10(probability(model, counts, words[:k], x)) for k, x in enumerate(words)), abs=1e-4)


def test_sizes_grow_with_the_vocabulary():
    got = [maxent.sizes(n, 64, 1 << 20) for n in (0, 10**4, 10**5, 10**6, 10**9)]
    assert got[0] == (16, 1 << 15) and got[-1] == (64, 1 << 20) and got == sorted(got) and len(set(got)) == 3
    assert maxent.sizes(10**9) == (maxent.SIDE, maxent.ROWS)


def test_empty_table(spark):
    docs = frame(spark, [])
    held = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    assert maxent.score(docs, maxent.train(docs, ~held, rounds=1), held).collect() == []


def plain_step(w, square, level, rows, goal, group):
    """The same AdaGrad step with every sum taken column by column."""
    z = sum(w.table[level][r] for r in rows) + (w.bias[0] if level == 0 else w.bias[1][group])
    g = np.exp(np.clip(z, -60, 60))
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(len(goal)), goal] -= 1
    flat = rows.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    start = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
    total = np.add.reduceat(np.ascontiguousarray(g.T).take(order % len(goal), axis=1), start, axis=1).T
    which, n = flat[order][start].astype(int), np.diff(np.append(start, len(order)))
    total /= np.sqrt(n)[:, None].astype(np.float32)
    square[which] += (total * total).sum(axis=1) / g.shape[1]
    w.table[level][which] -= np.float32(maxent.RATE) * total / np.sqrt(square[which])[:, None]


def test_a_step_is_the_plain_one_in_less_time():
    rng, side, size = np.random.default_rng(3), 32, 1 << 16
    v = maxent.Vocabulary(side, size, *[None] * 5, 0, 0, *[None] * 3, -1)
    bias = (rng.normal(size=side).astype(np.float32), rng.normal(size=(side, side)).astype(np.float32))
    one, plain = maxent.Learner(v, maxent.Weights(bias, [np.zeros((size, side), np.float32)] * 2)), maxent.Learner(v, maxent.Weights(bias, [np.zeros((size, side), np.float32)] * 2))
    took = [[], []]
    for _ in range(7):
        goal, group = rng.integers(0, side, (2, maxent.CHUNK))
        rows = np.stack([rng.integers(0, size, maxent.CHUNK), rng.zipf(1.3, maxent.CHUNK) % size, rng.zipf(1.1, maxent.CHUNK) % size, rng.integers(0, 257, maxent.CHUNK)]).astype(np.int32)
        for level in (0, 1):
            begun = time.thread_time()
            one.step(level, rows, goal, group)
            took[0].append(time.thread_time() - begun)
            begun = time.thread_time()
            plain_step(plain.w, plain.square[level], level, rows, goal, group)
            took[1].append(time.thread_time() - begun)
    for a, b in zip([*one.w.table, *one.square], [*plain.w.table, *plain.square], strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-4)
    assert min(took[0]) < 0.7 * min(took[1])


def test_sums_equal_brute_force():
    rng = np.random.default_rng(4)
    g = rng.normal(size=(500, 16)).astype(np.float32)
    for n in ([1, 1, 1], [1], [500, 8, 9, 7, 1, 16, 1], [70000, 1, 66000, 3]):
        n = np.array(n)
        token, start = rng.integers(0, 500, n.sum()), np.cumsum(n) - n
        total, by = maxent.sums(g, token, start, n)
        assert sorted(by) == list(range(len(n)))
        want = [g.astype(float)[token[start[i] : start[i] + n[i]]].sum(axis=0) for i in by]
        assert np.allclose(total, want, rtol=1e-3, atol=1e-2)


def test_window_equals_brute_force():
    rng = np.random.default_rng(5)
    n = [1, 1, 47, 48, 49, 50, 9000, 1, *rng.integers(1, 80, 200), *[1] * 5000]
    group, at = rng.integers(0, 5, sum(n)), np.concatenate([np.arange(k) for k in n])
    got = maxent.most_held(group, at, 16)
    for i in {*range(400), *range(4000, 4300), *range(8100, len(group), 7)}:
        before = Counter(group[i - min(at[i], maxent.WINDOW) : i].tolist())
        best = min(before, key=lambda c: (-before[c], c), default=None)
        assert got[i] == (-1 if best is None else best * 8 + min(7, before[best] * 8 // sum(before.values())))


def test_texts_are_split_and_numbered_alike_by_either_path(spark):
    texts = [*odd_texts(), "\x0bA\x0cb\x1cC\x85d E　f\r\n", "   ", "ÄÖ İ KK ÀB", "x" * 70000 + " y", "zz zz zz. zz. a", "a " * 9000, " tail", None]
    words, n = maxent.split(pa.array([*texts, "cut"], pa.string())[:-1])
    assert words.to_pylist() == [w for t in texts for w in maxent.tokens(t)] and n.tolist() == [len(maxent.tokens(t)) for t in texts]
    assert maxent.split(pa.array([None, "", " "], pa.string()))[1].tolist() == [0, 0, 0]
    for head in (maxent.HEAD, 5, 0):
        counts = maxent.count_tokens(frame(spark, texts))
        assert {bytes(r.token): r.c for r in counts.collect()} == Counter(w for t in texts for w in [*maxent.tokens(t), maxent.END])
        v = maxent.vocabulary(counts, head)
        batches = [pa.record_batch([pa.array(texts[a : a + 4], pa.string())], ["t"]) for a in range(0, len(texts), 4)]
        for batch, found in maxent.look_up(v, iter(batches), 0):
            whole = maxent.Batch(v, [maxent.tokens(t) for t in batch.column(0).to_pylist()])
            parts = [maxent.Batch(v, p) for _, _, p in found.pieces()]
            for x in ("n", "word", "group", "place", "again"):
                assert np.concatenate([getattr(p, x) for p in parts]).tolist() == getattr(whole, x).tolist()
            flat = [w for t in batch.column(0).to_pylist() for w in [*maxent.tokens(t), maxent.END]]
            assert whole.tokens(np.arange(len(flat))).to_pylist() == flat
            assert [i for i in range(1, len(flat)) if flat[i] == flat[i - 1] != maxent.END] == np.flatnonzero(whole.again).tolist()


def test_counts_are_merged_within_a_task(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FLUSH", 40)
    texts = [prose(30, s % 3) + f" own{s}" for s in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {bytes(r.token): r.c for r in maxent.count_tokens(frame(spark, texts)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == Counter(w for t in texts for w in [*maxent.tokens(t), maxent.END])
