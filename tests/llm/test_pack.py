import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sumfold.llm import pack
from tests.llm.helpers import frame, odd_texts, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(sizes, capacity):
    """Best fit with descending sizes: how many sequences."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit(sizes):
    counts = Counter(sizes)
    plan = pack.best_fit_plan(counts, 40)
    placed, fill = Counter(), defaultdict(list)
    for size, rank, n, first, per, offset in plan.tolist():
        for t in range(n):
            placed[size, rank + t] += 1
            fill[first + t // per].append((offset + t % per * size, size))
    assert placed == Counter((s, r) for s, n in counts.items() for r in range(n))
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 40
    assert len(fill) == one_by_one(sizes, 40)


def test_ids_equal_the_tokenizer(spark):
    enc = pack.Encoder(PATH)
    assert enc.fast is not None
    texts = [t or "" for t in odd_texts()] + [" leading", "a b", "x<|endoftext|>y", "don't  stop\n\n now\t", "a" * 3000, " " * 2500, "٣٤ ½ Ⅷ", "ﬁ é"]
    for t in texts:
        assert enc.ids(t) == enc.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("packed", [pack.pack, pack.pack_by_sweeps])
def test_pieces_and_sequences(spark, packed):
    texts = [*odd_texts(), *[prose(3 + 7 * s, s) for s in range(60)], *["the same short text"] * 30]
    ids = [*range(len(texts) - 2), None, 4]
    docs = frame(spark, texts, ids)
    enc = pack.Encoder(PATH)
    got = packed(pack.pieces(docs, PATH, 64), 64).collect()
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        x = np.array([*enc.ids(t or ""), 0], "<u4")
        first = (len(x) - 1) % 64 + 1
        cuts = [0, *range(first, len(x), 64), len(x)] if len(x) > first else [0, len(x)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) == one_by_one([r.length for r in got], 64)


@pytest.mark.parametrize("packed", [pack.pack, pack.pack_by_sweeps])
def test_many_ranges_and_buckets(spark, monkeypatch, packed):
    monkeypatch.setattr(pack, "RANGE", 4000)
    monkeypatch.setattr(pack, "RANKED", 20)
    rng = random.Random(1)
    rows = [(i, 0, 0, 7 if i % 3 == 0 else rng.randint(1, 16), i) for i in range(500)]
    got = packed(spark.createDataFrame(rows, pack.PIECES), 16).collect()
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert len(got) == 500 and max(fill.values()) <= 16 and len({(r.sequence_id, r.offset) for r in got}) == 500
    assert len(fill) == one_by_one([r[3] for r in rows], 16)


@pytest.mark.parametrize("sizes", [[16] * 40, [1] * 300, [9] * 20 + [7] * 20, [6] * 50, [5, 11] * 30 + [1] * 17, [16 - i % 16 for i in range(160)]])
def test_as_few_sequences_as_best_fit(spark, sizes):
    rows = [(None if i % 5 == 0 else i, 0, 0, s, 3) for i, s in enumerate(sizes)]
    got = pack.pack_by_sweeps(spark.createDataFrame(rows, pack.PIECES), 16).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 16
    plan = pack.best_fit_plan(Counter(sizes), 16)
    assert len(fill) == one_by_one(sizes, 16) == len({f + t // p for _, _, n, f, p, _ in plan.tolist() for t in range(n)})


def test_sweep_of_a_range_takes_successors(monkeypatch):
    monkeypatch.setattr(pack.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    rng = random.Random(8)
    events = sorted([(rng.randint(1, 30), k, i) for i in range(200) for k in [int(rng.random() < 0.5)]], key=lambda e: (-e[0], e[1], e[2]))
    frame_ = pd.DataFrame([(s, k, i if k == 0 else 0, 1, False, i, 0, 0, s, 0) for s, k, i in events], columns=pack._names(pack.EVENT))
    out = pd.concat(list(pack._swept(iter([frame_[:70], frame_[70:]]))))
    gaps, want, alone = [], {}, []
    for s, k, i in events:  # one by one: the least free gap, the latest among equals
        if k == 0:
            gaps.append((s, i))
        elif gaps:
            want[i] = gaps.pop(gaps.index(min(reversed(gaps), key=lambda g: g[0])))
        else:
            alone.append(i)
    got = out[out["state"] == pack.MATCHED]
    assert {r.doc_id: (r.room, r.sequence_id) for r in got.itertuples()} == want
    assert out[out["state"] == pack.UNPLACED]["doc_id"].tolist() == alone and sorted(out[out["state"] == pack.FREE]["sequence_id"]) == sorted(i for _, i in gaps)


def test_empty_table(spark):
    assert pack.pack(pack.pieces(frame(spark, []), PATH)).collect() == [] == pack.pack_by_sweeps(pack.pieces(frame(spark, []), PATH)).collect()
