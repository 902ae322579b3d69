import math
from collections import Counter, defaultdict

import pytest

from sumfold.llm import mixing
from tests.llm.helpers import frame, odd_texts, prose


def docs_of(spark, hot=120):
    texts = [*odd_texts(), *[prose(20, s) for s in range(hot)], *[prose(15, 500 + s) for s in range(30)], *[prose(10, 700 + s) for s in range(8)]]
    sources = [None] * len(odd_texts()) + ["hot"] * hot + ["mid"] * 30 + ["few"] * 8
    return frame(spark, texts, sources=sources), texts, sources


def shares(texts, sources):
    t = defaultdict(int)
    for x, s in zip(texts, sources, strict=True):
        t[s] += len((x or "").split()) + 1
    total = sum(t.values())
    return {s: n / total for s, n in t.items()}, t


def test_repetition_limit(spark):
    docs, texts, sources = docs_of(spark)
    share, tokens = shares(texts, sources)
    m = mixing.mixture(docs, max_rounds=2.0)
    spread = math.log(max(share.values()) / min(share.values()))
    assert m.exponent == pytest.approx(max(0.0, 1 - math.log(2.0) / spread), abs=1e-6)
    rows = mixing.layout(m).collect()
    assert len(rows) == len(texts) and {r.copies for r in rows} <= {1, 2}
    z = sum(p**m.exponent for p in share.values())
    for s in share:
        mine = sorted((r for r in rows if r.source == s), key=lambda r: r.start)
        at = 0
        for r in mine:  # gapless permutation
            assert r.start == at
            at += r.tokens
        assert at == tokens[s] and mine[0].weight == pytest.approx(share[s] ** m.exponent / z)
        got = sum(r.tokens * r.copies for r in mine)
        assert mine[0].budget - 0.6 <= got <= mine[0].budget + max(r.tokens for r in mine)


def test_entropy_target(spark):
    docs, texts, sources = docs_of(spark)
    share, _ = shares(texts, sources)
    own = -sum(p * math.log(p) for p in share.values())
    goal = (own + math.log(len(share))) / 2
    m = mixing.mixture(docs, entropy=goal)
    w = [r.weight for r in m.sources.collect()]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(goal, abs=1e-5)
    assert mixing.mixture(docs, entropy=0.0).exponent == 1.0 and mixing.mixture(docs, entropy=99.0).exponent == 0.0


def test_flattening(spark):
    docs, texts, sources = docs_of(spark)
    share, _ = shares(texts, sources)
    own = -sum(p * math.log(p) for p in share.values())
    seen = []
    for part in (0.0, 0.25, 0.5, 1.0):
        m = mixing.mixture(docs, max_rounds=None, flatten=part)
        assert m.entropy == pytest.approx(own + part * (math.log(len(share)) - own), abs=1e-5)
        seen.append(m.exponent)
    assert seen[0] == pytest.approx(1, abs=1e-6) and seen == sorted(seen, reverse=True) and seen[-1] < 0.01
    both = mixing.mixture(docs, max_rounds=1.2, flatten=0.5)  # the stricter limit holds
    assert both.exponent == pytest.approx(1 - math.log(1.2) / math.log(max(share.values()) / min(share.values())), abs=1e-6)


def test_repeated_and_missing_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 10)
    docs = frame(spark, [prose(5, s) for s in range(200)], ids=[None] * 100 + [7] * 100, sources=["hot"] * 200)
    m = mixing.mixture(docs, budget=3000)
    rows = m.laid.collect()
    assert len({r.block for r in rows}) > 10 and len({r.start for r in rows}) == 200
    assert mixing.realise(docs, m).count() == sum(r.copies for r in mixing.layout(m).collect())


def test_rows_are_repeated_as_laid_out(spark):
    docs, *_ = docs_of(spark)
    m = mixing.mixture(docs, max_rounds=2.0)
    want = Counter({r.doc_id: r.copies for r in mixing.layout(m).collect()})
    got = mixing.realise(docs, m)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want


def test_budget_smaller_than_the_input(spark):
    docs, texts, sources = docs_of(spark)
    m = mixing.mixture(docs, max_rounds=2.0, budget=600)
    total = sum(r.tokens * r.copies for r in mixing.layout(m).collect())
    assert 600 - 5 <= total <= 600 + 4 * 4100
    assert Counter(r.doc_id for r in mixing.realise(docs, m).collect()) == Counter({r.doc_id: r.copies for r in mixing.layout(m).collect() if r.copies})


def test_many_blocks_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 10)
    docs, texts, _ = docs_of(spark)
    m = mixing.mixture(docs)
    assert m.blocks > 10 and len(mixing.layout(m).collect()) == len(texts)
    assert mixing.layout(mixing.mixture(frame(spark, []))).collect() == []
    (one,) = mixing.layout(mixing.mixture(frame(spark, ["a b"]))).collect()
    assert one.copies == 1 and one.weight == 1.0
