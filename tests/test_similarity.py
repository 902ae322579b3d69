import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumfold.operators import knn, lsh, minhash


def sets(spark, rows):
    return spark.createDataFrame(rows, "key string, words array<string>")


def signed(df, n=128):
    return df.withColumn("sig", minhash.signature_arrow(F.col("words"), n))


def test_signatures_equal_brute_force(spark):
    words = ["a", "b", "c", "déjà"]
    h = [int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") for w in words]
    want = [min((a * x + b) % 2**32 for x in h) for a, b in minhash.coefficients(16)]
    df = sets(spark, [("k", [*words, "a"]), ("e", [])])
    for f in (minhash.signature, minhash.signature_arrow):
        got = {r.key: r.s for r in df.select("key", f(F.col("words"), 16).alias("s")).collect()}
        assert got["k"] == want and got["e"] == [minhash.EMPTY] * 16
    with pytest.raises(ValueError):
        minhash.coefficients(0)


def test_estimates_and_unions(spark):
    a, b = [f"w{i}" for i in range(200)], [f"w{i}" for i in range(100, 300)]
    df = signed(sets(spark, [("a", a), ("b", b), ("u", [*a, *b])]), 256)
    s = {r.key: r.sig for r in df.collect()}
    assert abs(np.mean(np.array(s["a"]) == np.array(s["b"])) - 1 / 3) < 0.1
    assert [min(x, y) for x, y in zip(s["a"], s["b"], strict=True)] == s["u"]
    assert minhash.merge_rows(df.where("key <> 'u'"), "sig").first().sig == s["u"]
    r = df.where("key = 'a'").select(F.col("sig").alias("x"), F.col("words").alias("wx")).crossJoin(df.where("key = 'b'").select(F.col("sig").alias("y"), F.col("words").alias("wy"))).select(minhash.merged(F.col("x"), F.col("y")).alias("m"), minhash.exact_jaccard(F.col("wx"), F.col("wy")).alias("j")).first()
    assert r.m == s["u"] and r.j == pytest.approx(1 / 3)


def test_weighted(spark):
    rows = [("a", {f"w{i}": 1.0 + i % 5 for i in range(60)}), ("b", {f"w{i}": 1.0 + i % 5 for i in range(60)}), ("c", {f"w{i}": 1.0 + i % 3 for i in range(20, 80)}), ("d", {f"z{i}": 2.0 for i in range(30)}), ("e", {"q": 0.0})]
    df = spark.createDataFrame([(k, list(m), list(m.values())) for k, m in rows], "key string, items array<string>, weights array<double>")
    s = df.select("key", minhash.weighted_signature(F.col("items"), F.col("weights"), 256).alias("s"))
    got = {r.key: r.s for r in s.collect()}
    same = lambda x, y: np.mean([(p.h, p.t) == (q.h, q.t) for p, q in zip(got[x], got[y], strict=True)])
    w = dict(rows)
    true = sum(min(w["a"].get(i, 0), w["c"].get(i, 0)) for i in {*w["a"], *w["c"]}) / sum(max(w["a"].get(i, 0), w["c"].get(i, 0)) for i in {*w["a"], *w["c"]})
    assert same("a", "b") == 1.0 and same("a", "d") < 0.1 and abs(same("a", "c") - true) < 0.12 and got["e"] == []
    both = s.where("key = 'a'").select(F.col("s").alias("x")).crossJoin(s.where("key = 'e'").select(F.col("s").alias("y")))
    assert both.select(minhash.weighted_merged(F.col("x"), F.col("y")).alias("m")).first().m == got["a"]
    long = spark.createDataFrame([(k, i, x) for k, m in rows for i, x in m.items()], "key string, item string, w double")
    pairs = spark.createDataFrame([("a", "c"), ("a", "d")], "a string, b string")
    exact = {(r.a, r.b): r.jaccard for r in minhash.exact_weighted_jaccard(long, "key", "item", "w", pairs).collect()}
    assert exact[("a", "c")] == pytest.approx(true) and exact[("a", "d")] == 0.0


def test_bands():
    assert lsh.bands_and_rows(0.5, 128) == (32, 4) and lsh.bands_and_rows(0.7, 128) == (16, 8) and lsh.bands_and_rows(0.8, 128) == (8, 16)
    with pytest.raises(ValueError):
        lsh.bands_and_rows(1.5, 128)


def test_index(spark):
    base = [f"w{i}" for i in range(50)]
    df = signed(sets(spark, [("a", base), ("a2", base), ("b", [*base[:47], "x", "y", "z"]), ("c", [f"q{i}" for i in range(50)]), ("e", []), ("e2", [])]))
    index = lsh.MinHashLSH(df, 0.5)
    assert {(r.a, r.b) for r in index.pairs().collect()} == {("a", "b")}
    assert {r.key: r.representative for r in index.members().collect()} == {"a": "a", "a2": "a", "b": "b", "c": "c", "e": "e", "e2": "e"}
    asked = df.where("key = 'b'").select(F.col("key").alias("query"), "sig")
    assert {r.key for r in index.query(asked).collect()} == {"a", "a2", "b"}
    rest = index.remove(df.where("key in ('a', 'nothing')"))
    assert {r.key for r in rest.query(asked).collect()} == {"a2", "b"}
    moved = signed(sets(spark, [("b", [f"q{i}" for i in range(50)])]))
    merged = sum([index, lsh.MinHashLSH(moved, 0.5)])
    assert {r.key for r in merged.query(asked).collect()} == {"a", "a2"} and {(r.a, r.b) for r in merged.pairs().collect()} == set()
    assert index.stats().first().bands == 32
    with pytest.raises(ValueError):
        index + lsh.MinHashLSH(moved, 0.7)
    with pytest.raises(ValueError):
        lsh.MinHashLSH(moved, 0.5, 128, (64, 4))
    top = lsh.most_similar(df, asked, 2).orderBy("rank").collect()
    assert [r.key for r in top] == ["b", "a"] and {r.key for r in lsh.most_similar(df, asked, 3, prefix_bits=8).collect()} >= {"a", "a2", "b"}


def test_containment(spark):
    ab, big = [f"w{i}" for i in range(60)], [f"w{i}" for i in range(90)]
    df = signed(sets(spark, [("big", big), ("same", ab), ("tiny", ab[:5]), ("far", [f"z{i}" for i in range(60)])])).withColumn("size", F.size("words").cast("long"))
    asked = df.where("key = 'same'").select(F.col("key").alias("query"), "sig", "size", "words")
    got = {r.key: r.containment for r in lsh.containment_candidates(df, asked, 0.7, 128).collect()}
    assert set(got) == {"big", "same"} and got["same"] == 1.0
    parts = lsh.size_partitions(df.select("key", "size"), 2).collect()
    assert parts[0].lower == 1 and parts[-1].upper is None
    assert asked.select(lsh.exact_containment(F.col("words"), F.array(F.lit("w1"))).alias("c")).first().c == pytest.approx(1 / 60)


def grid(spark):
    return spark.createDataFrame([(f"{i:02d}{j:02d}", [float(i), float(j)]) for i in range(10) for j in range(10)], "key string, v array<double>")


@pytest.mark.parametrize("name", ["euclidean", "manhattan", "cosine"])
def test_nearest(spark, name):
    g = grid(spark)
    rows = {r.key: np.array(r.v) for r in g.collect()}
    q = np.array([4.2, 6.1])
    f = {"euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "manhattan": lambda a, b: np.abs(a - b).sum(), "cosine": lambda a, b: 1 - (a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) if np.linalg.norm(b) else 1.0}[name]
    want = sorted((round(float(f(q, v)), 9), k) for k, v in rows.items())[:5]
    asked = spark.createDataFrame([("q", q.tolist())], "query string, v array<double>")
    got = knn.nearest(g, asked, 5, lambda a, b: F.round(knn.DISTANCES[name](a, b), 9)).orderBy("rank").collect()
    assert [(r.distance, r.key) for r in got] == want
    halves = [g.where("key < '0500'"), g.where("key >= '0500'")]
    assert knn.federated(halves, asked, 5, lambda a, b: F.round(knn.DISTANCES[name](a, b), 9)).orderBy("rank").collect() == got


def test_queries_in_blocks(spark, monkeypatch):
    g = grid(spark)
    asked = g.limit(25).select(F.col("key").alias("query"), "v")
    one = sorted(map(tuple, knn.nearest(g, asked, 3).collect()))
    monkeypatch.setattr(knn, "BLOCK", 7)
    assert len(knn.blocks(asked, 7)) == 4 and sorted(map(tuple, knn.nearest(g, asked, 3).collect())) == one


def test_approximate_index(spark):
    index = knn.ApproximateIndex(grid(spark), 4.0, 8)
    asked = spark.createDataFrame([("q", [4.0, 6.0])], "query string, v array<double>")
    assert index.search(asked, 1, 3.0).first().key == "0406"
    more = spark.createDataFrame([("new", [4.0, 6.1])], "key string, v array<double>")
    assert index.insert(more).search(asked, 2, 3.0).count() == 2 and index.stats().count() == 8
    with pytest.raises(ValueError):
        index.insert(grid(spark).limit(1))


def test_containment_ensemble_finds_long_documents(spark, tmp_path):
    from sumfold.plans import registry

    item = [f"w{i}" for i in range(20)]
    texts = {1: item + [f"z{i}" for i in range(3000)], 2: item[:8] + [f"y{i}" for i in range(900)], 3: item[:7] + ["x"], 4: item, 5: []}
    spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item)), (8, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.query, r.key): (r.containment, round(r.jaccard_score, 9)) for r in registry.queries()["containment_ensemble"](spark, str(tmp_path)).collect()}
    assert got == {(7, 1): (1.0, round(20 / 3020, 9)), (7, 2): (0.4, round(8 / 920, 9)), (7, 4): (1.0, 1.0)}


def test_exact_pairs(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, sorted({*base[: rng.integers(1, 40)], *(f"r{rng.integers(0, 60)}" for _ in range(rng.integers(0, 30)))})) for i in range(60)]
    rows += [(100 + i, list(rows[5][1])) for i in range(4)] + [(200, []), (201, [])]
    df, words = sets(spark, [(f"{k:03d}", w) for k, w in rows]), dict(rows)
    first = {k: min(j for j in words if words[j] == w) for k, w in words.items() if w}
    heads, copies = sorted(set(first.values())), {(j, k): 1.0 for k, j in first.items() if j != k}
    for t in (0.1, 0.3, 0.5, 0.8, 1.0):
        sim = {(a, b): len({*words[a]} & {*words[b]}) / len({*words[a]} | {*words[b]}) for a in heads for b in heads if a < b}
        want = {p: s for p, s in sim.items() if s >= t} | copies
        assert (5, 103) in want
        got = lsh.exact_pairs(df, t).collect()
        assert len(got) == len(want) and {(int(r.a), int(r.b)): r.similarity for r in got} == pytest.approx(want)


@pytest.mark.parametrize("small", [False, True])
def test_exact_pairs_in_many_blocks_write_no_candidates(spark, monkeypatch, small):
    from sumfold.operators import setjoin

    if small:  # many blocks, sizes dealt over several blocks, batches of a few counters, items looked up by value
        for name, n in (("CELLS", 400), ("LEAST_CELLS", 100), ("DENSE", 0), ("COUNTERS", 50), ("HITS", 200)):
            monkeypatch.setattr(setjoin, name, n)
    written, once = {}, setjoin.once
    monkeypatch.setattr(setjoin, "once", lambda df, tag: [out := once(df, tag), written.update({tag: out.count()})][0])
    rng = np.random.default_rng(5)
    words = {i: {*rng.zipf(1.3, int(rng.integers(5, 120))).tolist()} for i in range(200)}
    words |= {300 + i: {*list(words[i])[:-1], -i} for i in range(50)} | {400 + i: words[i] for i in range(20)} | {500 + i: {*range(1, 20), 1000 + i} for i in range(150)}
    df = spark.createDataFrame([(k, [str(x) for x in w]) for k, w in words.items()], "key long, words array<string>")
    first = {}
    for k in sorted(words):
        first.setdefault(frozenset(words[k]), k)
    heads = sorted(first.values())
    stored = setjoin.numbered(df)
    assert (setjoin.blocks(stored).count() > 10) == small
    for t in (0.02, 0.3, 0.9):
        want = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a in heads for b in heads if a < b}
        want = {p: s for p, s in want.items() if s >= t}
        got = setjoin.pairs(stored, t).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == pytest.approx(want)
        assert written.pop("pairs") == len(want)
    assert lsh.exact_pairs(df.limit(0), 0.5).collect() == []


def test_exact_query_finds_links_at_the_threshold(spark, tmp_path):
    from sumfold.plans import registry

    item = [f"w{i}" for i in range(11)]
    texts = [(i, " ".join([*item[:2], *(f"z{i}_{j}" for j in range(9))])) for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["exact_query"](spark, str(tmp_path)).collect()
    assert {(r.query, r.key) for r in got} == {(7, i) for i in range(30)} and {r.similarity for r in got} == {0.1}


def test_plagiarism_exact_has_copies_and_all_pairs_at_the_threshold(spark, tmp_path):
    from sumfold.plans import registry

    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 10_000, 95)] for _ in range(20)]  # 91 runs; one changed word at place 40 and one at the end leave 85 of 97
    near = [[*b[:40], "new", *b[41:94], "end"] for b in base]
    texts = base + near + [base[0]] * 5
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.similarity for r in registry.queries()["plagiarism_exact"](spark, str(tmp_path)).collect()}
    assert got == {(i, 20 + i): round(85 / 97, 8) for i in range(20)} | {(0, 40 + i): 1.0 for i in range(5)}


def test_tf_weighted_search_compares_ids_that_are_far_apart(spark, tmp_path):
    from sumfold.plans import registry

    texts = [(100, "a a b"), (250, "a a b"), (777, "a b c d"), (9, "x")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.query, r.key): r.jaccard for r in registry.queries()["tf_weighted_search"](spark, str(tmp_path)).collect()}
    assert got == {(100, 250): 1.0, (100, 777): 0.4}


def test_tf_weighted_search_shuffles_no_pairs(spark, monkeypatch, tmp_path):
    from collections import Counter

    from sumfold.operators import termsearch
    from sumfold.plans import registry

    rng = np.random.default_rng(6)
    texts = [(i * 20, " ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(0, 80))) if x < 300)) for i in range(60)] + [(100, "w1 w1 w2"), (None, "w1"), (7, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bags = {}
    for k, t in texts:
        if k is not None and t:
            bags[k] = bags.get(k, Counter()) + Counter(t.split())
    want = {(q, k): round(s / ((bags[q] | bags[k]).total()), 8) for q in bags if q % 100 == 0 for k in bags if k != q and (s := (bags[q] & bags[k]).total())}
    monkeypatch.setattr(termsearch, "HITS", 50)
    monkeypatch.setattr(termsearch, "COUNTERS", 30)
    for tokens, dense in ((1 << 20, 1024), (1 << 20, 7), (100, 0)):
        monkeypatch.setattr(termsearch, "TOKENS", tokens)
        monkeypatch.setattr(termsearch, "DENSE", dense)
        df = registry.queries()["tf_weighted_search"](spark, str(tmp_path))
        assert {(r.query, r.key): r.jaccard for r in df.collect()} == pytest.approx(want)
    texts = [(i * 20, "a b") for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/unique/documents.parquet")
    plan = registry.queries()["tf_weighted_search"](spark, f"{tmp_path}/unique")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("rows", [7, 2048])
def test_approximate_search_shuffles_no_vectors(spark, monkeypatch, rows):
    monkeypatch.setattr(knn, "ROWS", rows)
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(0, 1, (120, 3)), 1)
    v[60:70] = v[0]  # ties, by key
    df = spark.createDataFrame([(f"k{i:03d}", x.tolist()) for i, x in enumerate(v)], "key string, v array<float>")
    index = knn.ApproximateIndex(df, 0.8, 2)
    asked = df.where("key < 'k030'").select(F.col("key").alias("query"), "v")
    joined = index.model.approxSimilarityJoin(index._with(asked.select(F.col("query").alias("key"), "v")), index._with(df), 1.5, "distance")
    want = knn._best(joined.select(F.col("datasetA.key").alias("query"), F.col("datasetB.key").alias("key"), "distance"), 4)
    got = index.search(asked, 4, 1.5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and index.search(asked.limit(0), 4, 1.5).collect() == []
    monkeypatch.setattr(knn, "BLOCK", 9)
    assert sorted(map(tuple, index.search(asked, 4, 1.5).collect())) == sorted(map(tuple, want.collect()))
