import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sumfold.llm import hilbert
from tests.llm.helpers import frame, odd_texts, prose


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 3), (3, 2), (3, 1)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    n = 1 << bits
    cells = spark.range(n**dims)
    axes = [(F.floor(F.col("id") / n**d) % n).cast("int") for d in range(dims)]
    rows = cells.select(hilbert.curve_index(axes, bits).alias("h"), *[a.alias(f"a{d}") for d, a in enumerate(axes)]).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(n**dims))
    for x, y in zip(rows, rows[1:], strict=False):
        assert sum(abs(x[f"a{d}"] - y[f"a{d}"]) for d in range(dims)) == 1


def test_law_rows(spark):
    texts = [*odd_texts(), *[prose(5 + s % 50, s) for s in range(150)], *["copy of one text"] * 90]
    docs = frame(spark, texts, ids=[*range(len(texts) - 2), 3, None], sources=[None, "hot", "hot", "b"] * (len(texts) // 4) + ["c"] * (len(texts) % 4))
    got = hilbert.shards(docs, 24).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(texts) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(n))
    assert Counter((r["size"], r.text_crc32) for r in got) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    order = sorted(got, key=lambda r: (r["shard"], r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in order)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    got = hilbert.shards(frame(spark, ["x"] * n), 24).collect()
    assert len(got) == n and all(r.slot == 0 for r in got) and len({r["shard"] for r in got}) == n


def test_all_metadata_null(spark):
    docs = frame(spark, ["a", None, "b"], sources=[None] * 3, langs=[None] * 3)
    assert len(hilbert.shards(docs, 2).collect()) == 3


def test_cells_of_whole_values(spark):
    values = [None] * 3 + [f"https://host/{x}" for x in "aabbbbcdefgh"] + [""]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select("s", hilbert.cells_of(df, "s", 2).alias("c")).collect()
    for r in got:
        less = sum(r.s is not None and (v is None or v < r.s) for v in values)
        assert r.c == less * 4 // len(values)
    assert len({r.c for r in got if r.s and r.s.startswith("https")}) > 1  # a common prefix makes no common cell
    none = spark.createDataFrame([], "s string")
    assert none.select(hilbert.cells_of(none, "s")).collect() == []
    for kind, rows in (("double", [2.5, -1.0, None, 7.0]), ("date", ["2024-01-01", None, "2023-05-05", "2024-01-02"]), ("boolean", [True, False, None, True])):
        df = spark.createDataFrame([(None if v is None else str(v),) for v in rows], "v string").select(F.col("v").cast(kind).alias("v"))
        got = df.select("v", hilbert.cells_of(df, "v", 2).alias("c")).collect()
        assert all(r.c == sum(r.v is not None and (x.v is None or x.v < r.v) for x in got) for r in got)
