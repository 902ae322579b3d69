import numpy as np
import pytest
from pyspark.sql import functions as F

from sumfold.llm import topk


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int, rank int, query_id int")


def brute(rows, k, every=50):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def answer(df, every=50, **kw):
    rows = topk.quantised(df, "vec_id", "embedding")
    got = {}
    for r in topk.search(rows, rows.where(F.col("vec_id") % every == 0), 5, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("block", [16_384, 3])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)], 0, 1, 2, 3) for i in range(700)]
    rows += [(700 + i, rows[0][1], 0, 1, 2, 3) for i in range(30)]  # ties with one another
    rows += [(800, None, 0, 1, 2, 3), (801, [float("nan")] * 16, 0, 1, 2, 3), (802, [1.0] * 15 + [None], 0, 1, 2, 3), (None, [1.0] * 16, 0, 1, 2, 3), (850, [float("inf")] * 16, 0, 1, 2, 3)]
    assert answer(vectors(spark, rows), block=block) == brute(rows, 5)


def test_few_rows(spark):
    assert answer(vectors(spark, [])) == {}
    assert answer(vectors(spark, [(0, [1.0, 2.0], 0, 1, 2, 3)])) == {}
    rows = [(0, [1.0, 2.0], 0, 1, 2, 3), (1, [0.5, -2.0], 0, 1, 2, 3), (50, [-1.0, 0.0], 0, 1, 2, 3)]
    assert answer(vectors(spark, rows)) == brute(rows, 5)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e6, 1e-3], 0, 1, 2, 3), (1, [2e6, 7.0], 0, 1, 2, 3), (2, [2e6, 7.5], 0, 1, 2, 3)]
    assert answer(vectors(spark, rows)) == brute(rows, 5)


def test_maxscore_skips_components():
    rng = np.random.default_rng(0)
    rows = np.floor(256 * rng.normal(0, 0.1, (4000, 64)) * np.geomspace(1, 0.02, 64)).astype(np.int64)
    best = topk.Best(1, 5)
    read = [topk.maxscore(rows[:1], np.array([0]), np.arange(a, a + 500), rows[a : a + 500], best) for a in range(0, 4000, 500)]
    assert read[-1] < 0.8 * read[0]
    s = rows @ rows[0]
    assert best.score[0].tolist() == sorted(s[1:].tolist(), reverse=True)[:5]
