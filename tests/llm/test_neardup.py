import random
from collections import defaultdict

import numpy as np
import pytest

from sumfold.llm import neardup
from tests.llm.helpers import frame, odd_texts, prose


def changed(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(5)
    texts = odd_texts()
    for s in range(12):
        base = prose(150, 50 + s)
        texts += [base, base, *[changed(base, 1 + j % 3, rng) for j in range(5)]]
    texts += [prose(120, 500 + s) for s in range(40)]
    shared = prose(60, 999)  # one passage in many texts that differ otherwise
    texts += [prose(80, 600 + s) + " " + shared for s in range(20)]
    return texts


def brute(texts, least=0.8):
    """Least index of the connected component of each text over exact weighted Jaccard similarity."""
    total, n = np.zeros(1 << neardup.DF_BITS), len(texts)
    plain = neardup.Sampler()
    for t in texts:
        if t:
            total[np.unique(plain.features(t)[0] >> np.uint64(64 - neardup.DF_BITS)).astype(int)] += 1
    s = neardup.Sampler(neardup.idf_of(total, n))
    w = [s.weighted(t) if t else None for t in texts]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            same = texts[i] == texts[j] or (w[i] is not None and w[j] is not None and len(w[i][0]) and len(w[j][0]) and neardup.similarity(w[i], w[j]) >= least)
            if same:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def found(spark):
    texts = corpus()
    return texts, neardup.classes(frame(spark, texts)).collect()


def test_classes_equal_brute_force(found):
    texts, got = found
    want = brute(texts)
    assert len(got) == len(texts)
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))


def test_one_document_of_each_class_stays(spark):
    texts = corpus()
    docs = frame(spark, [*texts, texts[20]], ids=[*range(len(texts)), 20])  # a row twice
    got = neardup.kept(docs, neardup.classes(docs)).collect()
    want = [i for i, c in enumerate(brute(texts)) if i == c]
    assert sorted(r.doc_id for r in got) == want and got[0].__fields__ == docs.columns


def test_null_ids_and_few_rows(spark):
    assert neardup.classes(frame(spark, [])).collect() == []
    docs = frame(spark, ["same text here", "same text here", None, "other"], ids=[None, None, 5, 6])
    assert len(neardup.classes(docs).collect()) == 4
    assert sorted(str(r.doc_id) for r in neardup.kept(docs, neardup.classes(docs)).collect()) == ["5", "6", "None"]


def test_components_of_a_chain(spark):
    rng = random.Random(2)
    names = [f"n{i:03d}" for i in range(60)]
    edges = [(names[i], names[i + 1]) if rng.random() < 0.5 else (names[i + 1], names[i]) for i in range(59) if i != 29]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: names[0] if i < 30 else names[30] for i, n in enumerate(names)}


def test_samples_estimate_weighted_jaccard():
    rng = random.Random(8)
    s = neardup.Sampler(np.random.default_rng(1).uniform(1, 6, 1 << neardup.DF_BITS).astype(np.float32), k=600)
    base = prose(300, 3)
    for n in (3, 10, 25):
        other = changed(base, n, rng)
        agree = np.mean(s.bands(base, 600) == s.bands(other, 600))
        (h, w), (g, v) = s.weighted(base), s.weighted(other)
        both = np.minimum(w[np.isin(h, g)], v[np.isin(g, h)]).sum()
        assert abs(agree - both / (w.sum() + v.sum() - both)) < 0.08


def test_long_text_in_chunks():
    s = neardup.Sampler(np.ones(1 << neardup.DF_BITS, np.float32))
    text = prose(200, 1) + " " + " ".join(f"w{i}" for i in range(50_000))
    assert len(s.bands(text)) == neardup.BANDS and (s.bands(text) == s.bands(text)).all()


def test_a_large_group_of_near_copies_makes_few_comparisons(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(200, 77)
    texts = [changed(base, 2, rng) for _ in range(150)]
    pairs = []
    real = neardup.Verifier.judged
    monkeypatch.setattr(neardup.Verifier, "judged", lambda self, p: pairs.append(p.count()) or real(self, p))
    got = neardup.classes(frame(spark, texts)).collect()
    by = defaultdict(int)
    for r in got:
        by[r.class_id] += 1
    assert by == {0: 150} and sum(pairs) < 10 * 150


def test_links_are_counted(found):
    texts, rows = found
    kinds = defaultdict(set)
    for r in rows:
        kinds[r.class_id].add(texts[r.doc_id])
    for r in rows:
        others = len(kinds[r.class_id]) - 1
        assert (r.links > 0) == (others > 0 and texts[r.doc_id] is not None) and r.weighted_links <= r.links <= others
    assert len({(r.text_key, r.links, r.weighted_links) for r in rows}) == len({r.text_key for r in rows})
