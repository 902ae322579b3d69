import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sumfold.llm import winnow
from tests.llm.helpers import frame, odd_texts, prose


def brute_hash(codes, k):
    h = 0
    for c in codes:
        h = (h * winnow.BASE + c + 1) & (2**64 - 1)
    h ^= h >> 32
    return (h * 0xD6E8FEB86659FD93 & (2**64 - 1)) >> 32


def brute(text, k=winnow.K, w=winnow.W):
    if not text:
        return []
    k = min(k, len(text))
    h = [brute_hash([ord(c) for c in text[i : i + k]], k) for i in range(len(text) - k + 1)]
    w = min(w, len(h))
    out = []
    for i in range(len(h) - w + 1):
        window = h[i : i + w]
        at = i + max(j for j, x in enumerate(window) if x == min(window))
        if not out or out[-1] != (h[at], at):
            out.append((h[at], at))
    return out


@given(st.text(max_size=300), st.integers(1, 30), st.integers(1, 30))
@settings(max_examples=150, deadline=None)
def test_equals_brute_force(text, k, w):
    text = text.encode("utf-8", "ignore").decode()
    assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in winnow.winnow(text, k, w)] == brute(text, k, w)


def test_ties_take_the_rightmost():
    fp = winnow.winnow("a" * 200, 5, 10)
    assert (fp & np.uint64(0xFFFFFFFF)).tolist() == list(range(9, 196))


def test_shared_passages_share_a_hash():
    rng = random.Random(4)
    shared = prose(40, 9)[: winnow.K + winnow.W - 1]
    for s in range(20):
        a, b = (prose(rng.randint(0, 50), 100 * s + j) + shared + prose(rng.randint(0, 50), 200 * s + j) for j in (1, 2))
        assert set((winnow.winnow(a) >> np.uint64(32)).tolist()) & set((winnow.winnow(b) >> np.uint64(32)).tolist())


def test_successors(spark):
    texts = [*odd_texts(), *[prose(20 + s, s) for s in range(60)]]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    got = {r.doc_id: r for r in winnow.successor_fingerprints(frame(spark, texts, ids)).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    assert len(got) == len(texts)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == winnow.packed(winnow.winnow(t)) and r.edited_fingerprint == winnow.packed(winnow.winnow(e))
        assert r.near_edited == winnow.likeness(winnow.winnow(t), winnow.winnow(e)) and r.near_next == winnow.likeness(winnow.winnow(t), winnow.winnow(nxt))


def test_repeated_and_null_ids_and_few_rows(spark):
    assert winnow.successor_fingerprints(frame(spark, [])).collect() == []
    (one,) = winnow.successor_fingerprints(frame(spark, ["only text"])).collect()
    assert one.near_next == 1.0
    got = winnow.successor_fingerprints(frame(spark, ["x", "y", "y", "z", "w"], ids=[1, 7, 7, None, 3])).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 7, 7, None, 3])


def test_fingerprints_keep_rows(spark):
    docs = frame(spark, odd_texts())
    got = winnow.fingerprints(docs).collect()
    assert len(got) == len(odd_texts()) and all(r.fingerprint == winnow.packed(winnow.winnow(r.text)) for r in got)
