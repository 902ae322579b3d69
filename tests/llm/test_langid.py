import math
import random

import pytest
from pyspark.sql import functions as F

from sumfold.llm import langid
from tests.llm.helpers import frame

PARTS = {"en": "the and of that with this from have ing tion ed er ly th ou gh", "fr": "le la les des une que pour eau eux oi tion é è ment ai ch", "de": "der die das und ein sch ung keit lich ich ei au pf tz ä ü"}


def text(lang, n, rng):
    p = PARTS[lang].split()
    return " ".join("".join(rng.choice(p) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    langs = [rng.choice(list(PARTS)) for _ in range(240)]
    return langid.train([text(x, rng.randint(5, 80), rng) for x in langs], langs)


def test_held_out_accuracy(spark, model):
    rng = random.Random(9)
    langs = [rng.choice(list(PARTS)) for _ in range(200)]
    docs = frame(spark, [text(x, rng.randint(5, 60), rng) for x in langs], langs=langs)
    got = langid.identify(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.lang_score <= 1 for r in got) and sum(r.lang_rejected for r in got) <= 0.03 * len(got)


def test_undetermined(spark, model):
    docs = frame(spark, [None, "", "123 !!! 4", "😀", "the", "x" * 100_000])
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und"] * 4 and all(got[i].lang_score == 0 and got[i].lang_rejected for i in range(4))
    assert got[4].lang_pred == "en" and got[5].lang_pred in PARTS
    assert len(langid.identify(frame(spark, []), model).collect()) == 0


def test_fit_uses_labelled_rows_only(spark):
    rng = random.Random(3)
    langs = [rng.choice(list(PARTS)) for _ in range(150)]
    texts = [text(x, 30, rng) for x in langs]
    docs = frame(spark, [*texts, None, "a b", "la le"], langs=[*langs, "en", None, None])
    m = langid.fit(docs, F.col("doc_id") % 5 != 0, per_lang=30)
    assert m.langs == sorted(PARTS)


def test_nothing_to_learn_from(spark):
    empty = frame(spark, [])
    assert langid.identify(empty, langid.fit(empty)).collect() == []
    docs = frame(spark, ["some words", None, "", "12 3", "some words"], langs=[None] * 5)
    got = sorted(langid.identify(docs, langid.fit(docs)).collect(), key=lambda r: r.doc_id)
    assert [(r.lang_pred, r.lang_score, r.lang_rejected) for r in got] == [("und", 0.0, x) for x in (False, True, True, True, False)]
    lettered = langid.fit(frame(spark, ["1 2", "3"], langs=["en", "de"]))
    assert lettered.langs == []


def plain_sgd(texts, langs, epochs=4, rate=0.5, seed=7):
    """The same training on dense vectors, feature by feature: a brute-force model."""
    import numpy as np

    names, rng, data = sorted(set(langs)), np.random.default_rng(seed), []
    for j, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        for f, share in langid.examples(t):
            x = np.zeros(langid.BUCKETS)
            for b, s in zip(f, share, strict=True):
                x[b] = s
            data.append((x, names.index(lang), j % 5 == 0))
    emb = rng.normal(0, 1 / langid.DIM, (langid.BUCKETS, langid.DIM)).astype(np.float32).astype(float)
    w, b = np.zeros((langid.DIM, len(names))), np.zeros(len(names))
    used = [x for x in data if not x[2]]
    step = 0
    for _ in range(epochs):
        for j in rng.permutation(len(used)):
            x, y, _ = used[j]
            h = x @ emb
            p = np.exp(h @ w + b) / np.exp(h @ w + b).sum()
            p[y] -= 1
            lr = rate * (1 - step / (epochs * len(used)))
            step += 1
            back = w @ p
            w, b = w - lr * np.outer(h, p), b - lr * 0.1 * p
            some = np.flatnonzero(x)
            emb[some] -= lr * min(64, len(some)) * np.outer(x[some], back)
    return names, emb, w, b


def test_predictions_equal_brute_force():
    rng = random.Random(2)
    langs = [rng.choice(list(PARTS)) for _ in range(40)]
    texts = [text(x, rng.randint(3, 30), rng) for x in langs]
    m, (names, emb, w, b) = langid.train(texts, langs), plain_sgd(texts, langs)
    seen, asked = langid.WordTable(m.table), [text(x, 12, rng) for x in PARTS] + ["la", "x" * 500]
    got, p = m.predict(asked, seen)
    for t, name, score in zip(asked, got, p, strict=True):
        grams = [g for word in t.lower().split() for s in [f"<{word}>"] for n in (2, 3, 4) for g in (s[k : k + n] for k in range(len(s) - n + 1))]
        h = sum(emb[langid.subwords([(g, 1)])[0][len(g) - 2]] for g in grams) / len(grams)  # an n-gram is the longest that starts at its first character
        z = (h @ w + b) / m.heat
        e = [math.exp(x - max(z)) for x in z]
        assert names[e.index(max(e))] == name and max(e) / sum(e) == pytest.approx(score, abs=2e-3)


def test_long_words_count_whole(model, monkeypatch):
    rng = random.Random(5)
    tail = text("fr", 300, rng).replace(" ", "")
    seen = langid.WordTable(model.table)
    names, p = model.predict([tail, "sch" * 22 + tail], seen)
    assert names == ["fr", "fr"] and not seen.index  # the first 66 characters alone are German
    words = [tail, "und", "x" * 64, "y" * 65]
    whole, scores = langid._features(words), langid.WordTable(model.table).sums([words, [], ["und"]])
    grams = sum(len(w) + 3 - n for w in words for n in (2, 3, 4))
    assert scores[0, -1] == grams and scores[1, -1] == 0
    for piece, block in ((7, 50), (1, 1)):
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "BLOCK", block)
        assert all((a == b).all() for a, b in zip(langid._features(words), whole, strict=True))
        assert langid.WordTable(model.table).sums([words, [], ["und"]]) == pytest.approx(scores, rel=1e-4, abs=1e-3)
