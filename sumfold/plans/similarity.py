"""Queries over signatures, similarity joins and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumfold.operators import exact, knn, lsh, minhash, termsearch
from sumfold.plans.registry import query
from sumfold.sources.tables import once, spread, table

PERMS = 32
BROADCAST_KEYS = 1_000_000


def _words(text="text"):
    """Distinct lower-case words, split at single spaces."""
    return F.array_distinct(F.filter(F.split(F.lower(F.col(text)), " "), lambda w: F.length(w) > 0))


def _docs(spark, d):
    """(key, words) of all documents."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("key"), _words().alias("words"))


def _signed(df):
    return df.withColumn("sig", minhash.signature_arrow(F.col("words"), PERMS, 1))


def _signed_once(df):
    """(key, sig), stored, for plans that read signatures on several sides."""
    return once(_signed(df).select("key", "sig"), "signatures")


_WORDS = "list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 0))"
_PAIRS = "(VALUES " + ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(minhash.coefficients(PERMS, 1))) + ") AS p(pos, a, b)"


def _cells(source: str, key: str) -> str:
    return f"""SELECT key, pos, min((a * ('0x' || substr(sha256(w), 1, 8))::UBIGINT::HUGEINT + b) % 4294967296)::BIGINT AS h
               FROM (SELECT DISTINCT {key} AS key, unnest({_WORDS}) AS w FROM {source}), {_PAIRS} GROUP BY ALL"""


def _sigs(source: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT key, list(h ORDER BY pos) AS sig FROM ({_cells(source, key)}) GROUP BY key"


_SIM = f"(list_sum(list_transform(list_zip({{0}}, {{1}}), lambda p: (p[1] = p[2])::INT)) / {PERMS}.0)"


@query(_cells("documents", "doc_id"))
def minhash_signatures(spark, d):
    return _signed(_docs(spark, d)).select("key", F.posexplode("sig").alias("pos", "h"))


@query(_cells("documents", "lang"))
def minhash_merge_union(spark, d):
    docs = spread(table(spark, d, "documents").select("lang", "text")).select("lang", _words().alias("words"))
    return minhash.merge_rows(_signed(docs), "sig", ("lang",)).select(F.col("lang").alias("key"), F.posexplode("sig").alias("pos", "h"))


@query(f"""
    WITH w AS (SELECT doc_id AS key, {_WORDS} AS words FROM documents), s AS ({_sigs()}), x AS (SELECT * FROM w JOIN s USING (key))
    SELECT a.key AS a, b.key AS b, round(length(list_intersect(a.words, b.words)) / length(list_distinct(list_concat(a.words, b.words)))::DOUBLE, 8) AS exact, round({_SIM.format('a.sig', 'b.sig')}, 8) AS estimate
    FROM x a JOIN x b ON b.key IN (a.key + 1, a.key + 2, a.key + 3)
""")
def jaccard_exact_vs_est(spark, d):
    x = once(_signed(_docs(spark, d)), "signatures")
    a, b = x.select(F.col("key").alias("a"), F.col("words").alias("wa"), F.col("sig").alias("sa")), x.select(F.col("key").alias("b"), F.col("words").alias("wb"), F.col("sig").alias("sb"))
    a = a.withColumn("b", F.explode(F.array(F.col("a") + 1, F.col("a") + 2, F.col("a") + 3)))  # neighbours as an equi-join
    return a.join(b, "b").select("a", "b", F.round(minhash.exact_jaccard(F.col("wa"), F.col("wb")), 8).alias("exact"), F.round(minhash.jaccard(F.col("sa"), F.col("sb")), 8).alias("estimate"))


@query("""
    WITH t AS (SELECT o_custkey AS key, l_partkey % 50 AS item, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    s AS (SELECT key, sum(w) AS t FROM t GROUP BY key), p AS (SELECT a.key AS a, b.key AS b FROM s a JOIN s b ON b.key = a.key + 1),
    l AS (SELECT x.key AS a, y.key AS b, sum(least(x.w, y.w)) AS low FROM t x JOIN t y ON y.key = x.key + 1 AND x.item = y.item GROUP BY ALL)
    SELECT a, b, round(coalesce(low, 0) / (sa.t + sb.t - coalesce(low, 0)), 8) AS jaccard FROM p LEFT JOIN l USING (a, b) JOIN s sa ON sa.key = a JOIN s sb ON sb.key = b
""")
def weighted_jaccard_exact(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    w = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("key"), (F.col("l_partkey") % 50).alias("item")).agg(F.sum("l_quantity").alias("w"))
    keys = w.select("key").distinct()
    pairs = keys.select(F.col("key").alias("a"), (F.col("key") + 1).alias("b")).join(keys.select(F.col("key").alias("b")), "b")
    return minhash.exact_weighted_jaccard(w, "key", "item", "w", pairs).withColumn("jaccard", F.round("jaccard", 8))


@query()
def weighted_minhash_estimates(spark, d):
    """Consistent weighted samples of customers' baskets, compared with the next customer's."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    w = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("key"), (F.col("l_partkey") % 50).alias("item")).agg(F.sum("l_quantity").alias("w"))
    s = w.groupBy("key").agg(exact.list_of("item", "item").alias("items"), exact.list_of("w", "item").alias("weights")).select("key", minhash.weighted_signature(F.col("items"), F.col("weights"), 64).alias("sig"))
    other = s.select((F.col("key") - 1).alias("key"), F.col("sig").alias("next"))
    return s.join(other, "key").select(F.col("key").alias("a"), minhash.weighted_jaccard(F.col("sig"), F.col("next")).alias("estimate"))


_B, _R = 8, 4
_BAND = f"SELECT key, i AS band, list_slice(sig, i * {_R} + 1, i * {_R} + {_R}) AS band_key FROM s, range({_B}) AS t(i)"


def _pairs_sql(sigs: str, least: float) -> str:
    return f"""
        WITH s AS (SELECT min(key) AS key, sig FROM ({sigs}) GROUP BY sig), k AS ({_BAND}), c AS (SELECT DISTINCT x.key AS a, y.key AS b FROM k x JOIN k y ON x.band = y.band AND x.band_key = y.band_key AND x.key < y.key)
        SELECT a, b, round({_SIM.format('sa.sig', 'sb.sig')}, 8) AS similarity FROM c JOIN s sa ON sa.key = a JOIN s sb ON sb.key = b WHERE {_SIM.format('sa.sig', 'sb.sig')} >= {least}
    """


@query(_pairs_sql(_sigs(), 0.5))
def lsh_pairs(spark, d):
    index = lsh.MinHashLSH(_signed_once(_docs(spark, d)), 0.5, PERMS, (_B, _R))
    return index.pairs().withColumn("similarity", F.round("similarity", 8))


@query(f"SELECT key, min(key) OVER (PARTITION BY sig) AS representative FROM ({_sigs()})")
def lsh_members(spark, d):
    return lsh.MinHashLSH(_signed_once(_docs(spark, d)), 0.5, PERMS, (_B, _R)).members()


def _benchmark(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), _words().alias("words"))
    return b.withColumn("size", F.size("words").cast("long")).withColumn("sig", minhash.signature_arrow(F.col("words"), PERMS, 1))


_Q = f"SELECT key AS query, sig FROM ({_sigs('benchmark', 'item_id')})"


@query(f"""
    WITH s AS ({_sigs()}), k AS ({_BAND}), q AS ({_Q}), qk AS (SELECT query, i AS band, list_slice(sig, i * {_R} + 1, i * {_R} + {_R}) AS band_key FROM q, range({_B}) AS t(i)),
    c AS (SELECT DISTINCT query, key FROM qk JOIN k USING (band, band_key))
    SELECT query, key, round({_SIM.format('q.sig', 's.sig')}, 8) AS similarity FROM c JOIN q USING (query) JOIN s USING (key) WHERE {_SIM.format('q.sig', 's.sig')} >= 0.1
""")
def lsh_query(spark, d):
    index = lsh.MinHashLSH(_signed_once(_docs(spark, d)), 0.1, PERMS, (_B, _R))
    return index.query(_benchmark(spark, d)).withColumn("similarity", F.round("similarity", 8))


@query(_pairs_sql(f"SELECT * FROM ({_sigs()}) WHERE key NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", 0.3))
def lsh_remove_merge(spark, d):
    """Three indexes, merged, without the toxic documents."""
    x = _signed_once(_docs(spark, d))
    parts = [lsh.MinHashLSH(x.where(F.pmod("key", F.lit(3)) == i), 0.3, PERMS, (_B, _R)) for i in range(3)]
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("key"))
    return sum(parts).remove(toxic).pairs().withColumn("similarity", F.round("similarity", 8))


def _exact_sql(words: str, least: float) -> str:
    """Pairs of the different sets of (key, words) by exact Jaccard similarity, then copies with their least key."""
    return f"""
        WITH w AS (SELECT key, list_sort(words) AS words, length(words) AS n FROM ({words}) WHERE length(words) > 0), h AS (SELECT min(key) AS key, words, any_value(n) AS n FROM w GROUP BY words),
        c AS (SELECT key, n, unnest(words) AS i FROM h), p AS (SELECT x.key AS a, y.key AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE AS j FROM c x JOIN c y ON x.i = y.i AND x.key < y.key GROUP BY 1, 2)
        SELECT a, b, round(j, 8) AS similarity FROM p WHERE j >= {least} UNION ALL SELECT h.key, w.key, 1.0::DOUBLE FROM h JOIN w USING (words) WHERE h.key <> w.key
    """


_SETS = f"SELECT doc_id AS key, {_WORDS} AS words FROM documents"


@query(f"""
    WITH q AS (SELECT item_id AS query, {_WORDS} AS qw FROM benchmark), k AS (SELECT doc_id AS key, {_WORDS} AS kw FROM documents),
    x AS (SELECT query, key, length(list_intersect(qw, kw)) AS n, length(qw) + length(kw) AS t FROM q JOIN k ON true)
    SELECT query, key, round(n / (t - n)::DOUBLE, 8) AS similarity FROM x WHERE n > 0 AND n / (t - n)::DOUBLE >= 0.1
""")
def exact_query(spark, d):
    """All documents of similarity 0.1 or more to an item, which the bands of lsh_query mostly miss."""
    return lsh.overlaps(_docs(spark, d), _benchmark(spark, d)).where("jaccard_score >= 0.1").select("query", "key", F.round("jaccard_score", 8).alias("similarity"))


@query(_exact_sql(_SETS, 0.5))
def exact_similar_pairs(spark, d):
    """All pairs of similarity 0.5 or more, of which the bands of lsh_pairs miss a part."""
    return lsh.exact_pairs(_docs(spark, d), 0.5).withColumn("similarity", F.round("similarity", 8))


@query(_exact_sql(_SETS + " WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", 0.3))
def exact_pairs_without_toxic(spark, d):
    """All pairs of similarity 0.3 or more without the toxic documents, which the bands of lsh_remove_merge mostly miss."""
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("key"))
    if toxic.count() <= BROADCAST_KEYS:  # else the texts are dealt by key
        toxic = F.broadcast(toxic)
    return lsh.exact_pairs(_docs(spark, d).join(toxic, "key", "left_anti"), 0.3).withColumn("similarity", F.round("similarity", 8))


@query(f"WITH s AS ({_sigs()}), k AS ({_BAND}), g AS (SELECT band, band_key, count(*) AS n FROM k GROUP BY ALL) SELECT {_B} AS bands, {_R} AS rows, count(*) AS buckets, round(avg(n), 8) AS avg_bucket, max(n) AS max_bucket FROM g")
def lsh_stats(spark, d):
    return lsh.MinHashLSH(_signed(_docs(spark, d)), 0.5, PERMS, (_B, _R)).stats().withColumn("avg_bucket", F.round("avg_bucket", 8))


@query(f"""
    WITH s AS ({_sigs()}), q AS ({_Q}), x AS (SELECT query, key, {_SIM.format('q.sig', 's.sig')} AS similarity FROM q JOIN s ON true), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key)::INTEGER AS rank FROM x)
    SELECT query, rank, key, round(similarity, 8) AS similarity FROM r WHERE rank <= 5
""")
def topk_similar(spark, d):
    return lsh.most_similar(_signed_once(_docs(spark, d)), _benchmark(spark, d), 5).withColumn("similarity", F.round("similarity", 8))


@query()
def topk_similar_by_prefix(spark, d):
    return lsh.most_similar(_signed_once(_docs(spark, d)), _benchmark(spark, d), 5, prefix_bits=8)


@query(f"""
    WITH q AS (SELECT item_id AS query, {_WORDS} AS qw FROM benchmark), k AS (SELECT doc_id AS key, {_WORDS} AS kw FROM documents),
    x AS (SELECT query, key, length(list_intersect(qw, kw)) / length(qw)::DOUBLE AS containment FROM q JOIN k ON true WHERE length(qw) > 0)
    SELECT query, key, round(containment, 8) AS containment FROM x WHERE containment >= 0.5
""")
def containment_search(spark, d):
    """Exact: shared words counted through an inverted index, so only sets that share a word meet."""
    q, k = _benchmark(spark, d), _docs(spark, d)
    cells = q.select("query", "size", F.explode("words").alias("w")).join(k.select("key", F.explode("words").alias("w")), "w")
    got = cells.groupBy("query", "key", "size").agg(F.count("*").alias("n")).withColumn("containment", F.col("n") / F.col("size"))
    return got.where("containment >= 0.5").select("query", "key", F.round("containment", 8).alias("containment"))


@query()
def containment_ensemble(spark, d):
    """Documents of any size that hold 0.4 or more of an item's words: all of them, with exact figures."""
    return lsh.overlaps(_docs(spark, d), _benchmark(spark, d)).where("containment >= 0.4")


@query(f"""
    WITH x AS (SELECT length({_WORDS})::BIGINT AS size FROM documents WHERE length({_WORDS}) > 0), c AS (SELECT unnest(quantile_disc(size, [0.25, 0.5, 0.75]))::BIGINT AS e FROM x),
    e AS (SELECT (row_number() OVER (ORDER BY e))::INTEGER AS part, e AS lower FROM c UNION ALL SELECT 0, 1)
    SELECT part, lower, lead(lower) OVER (ORDER BY part) AS upper FROM e
""")
def ensemble_partitions(spark, d):
    sizes = _docs(spark, d).select("key", F.size("words").cast("long").alias("size")).where("size > 0")
    return lsh.size_partitions(sizes, 4)


def _index(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


_DIST = {
    "euclidean": "sqrt(list_sum(list_transform(list_zip(q.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))", "manhattan": "list_sum(list_transform(list_zip(q.v, k.v), lambda p: abs(p[1] - p[2])))",
    "cosine": "1 - list_inner_product(q.v, k.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(k.v, k.v)))",
}


def _knn_sql(name: str) -> str:
    return f"""
        WITH k AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT key AS query, v FROM k WHERE key % 100 = 0),
        x AS (SELECT query, key, round({_DIST[name]}, 6) AS distance FROM q JOIN k ON true), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key)::INTEGER AS rank FROM x)
        SELECT query, rank, key, distance FROM r WHERE rank <= 10
    """


def _rounded(name):
    return lambda a, b: F.round(knn.DISTANCES[name](a, b), 6) + 0.0


@query(_knn_sql("euclidean"))
def knn_euclidean(spark, d):
    return knn.nearest(_index(spark, d), _asked(spark, d), 10, _rounded("euclidean"))


@query(_knn_sql("manhattan"))
def knn_manhattan(spark, d):
    return knn.nearest(_index(spark, d), _asked(spark, d), 10, _rounded("manhattan"))


@query(_knn_sql("cosine").replace("AS distance FROM q", "+ 0.0 AS distance FROM q"))
def knn_cosine(spark, d):
    return knn.nearest(_index(spark, d), _asked(spark, d), 10, _rounded("cosine"))


@query(_knn_sql("euclidean"))
def knn_federated(spark, d):
    index = _index(spark, d)
    return knn.federated([index.where(F.pmod("key", F.lit(3)) == i) for i in range(3)], _asked(spark, d), 10, _rounded("euclidean"))


@query()
def knn_approximate(spark, d):
    return knn.ApproximateIndex(_index(spark, d), 1.0, 6).search(_asked(spark, d), 10, 2.0)


@query()
def knn_index_stats(spark, d):
    return knn.ApproximateIndex(_index(spark, d), 1.0, 6).stats()


@query(f"""
    WITH t AS (SELECT doc_id AS key, unnest(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 0)) AS w FROM documents), c AS (SELECT key, w, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
    s AS (SELECT key, sum(n) AS t FROM c GROUP BY key), l AS (SELECT x.key AS a, y.key AS b, sum(least(x.n, y.n)) AS low FROM c x JOIN c y ON x.w = y.w AND y.key = x.key + 1 GROUP BY ALL)
    SELECT a, b, round(low / (sa.t + sb.t - low), 8) AS jaccard FROM l JOIN s sa ON sa.key = a JOIN s sb ON sb.key = b
""")
def tf_weighted_similarity(spark, d):
    words = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.explode(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 0)).alias("w"))
    c = words.groupBy("key", "w").agg(F.count("*").cast("double").alias("n"))
    keys = c.select("key").distinct()
    pairs = keys.select(F.col("key").alias("a"), (F.col("key") + 1).alias("b")).join(keys.select(F.col("key").alias("b")), "b")
    return minhash.exact_weighted_jaccard(c, "key", "w", "n", pairs).where("jaccard > 0").withColumn("jaccard", F.round("jaccard", 8))


_SHINGLES = """list_distinct(CASE WHEN length(w) = 0 THEN [] WHEN length(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
              ELSE list_transform(range(1, length(w) - 3), lambda i: list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ')) END)"""
_FIVES = f"(SELECT doc_id, {_SHINGLES} AS x FROM (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda v: length(v) > 0) AS w FROM documents))"
_SHINGLE_SIGS = f"""SELECT key, list(h ORDER BY pos) AS sig FROM (SELECT key, pos, min((a * ('0x' || substr(sha256(v), 1, 8))::UBIGINT::HUGEINT + b) % 4294967296)::BIGINT AS h
                    FROM (SELECT doc_id AS key, unnest(x) AS v FROM {_FIVES}), {_PAIRS} GROUP BY ALL) GROUP BY key"""


def _shingles(w, k=5):
    """Distinct runs of k words of an array of words; all words as one, if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(k))))
    return F.array_distinct(F.filter(runs, lambda x: F.length(x) > 0))


@query(_pairs_sql(_SHINGLE_SIGS, 0.8).replace(f"i * {_R} + 1, i * {_R} + {_R}", "i * 2 + 1, i * 2 + 2").replace(f"range({_B})", "range(16)"))
def plagiarism_pairs(spark, d):
    """Near copies among all documents by runs of five words, similarity 0.8 or more."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.filter(F.split(F.lower("text"), " "), lambda v: F.length(v) > 0).alias("w"))
    docs = docs.select("key", _shingles(F.col("w")).alias("words"))
    index = lsh.MinHashLSH(_signed_once(docs), 0.8, PERMS, (16, 2))
    return index.pairs().withColumn("similarity", F.round("similarity", 8))


@query(_exact_sql(f"SELECT doc_id AS key, x AS words FROM {_FIVES}", 0.8))
def plagiarism_exact(spark, d):
    """All near copies by runs of five words at an exact similarity of 0.8 or more; every exact copy stands with the first of its equals."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.filter(F.split(F.lower("text"), " "), lambda v: F.length(v) > 0).alias("w"))
    return lsh.exact_pairs(docs.select("key", _shingles(F.col("w")).alias("words")), 0.8).withColumn("similarity", F.round("similarity", 8))


@query(f"""
    WITH t AS (SELECT doc_id AS key, unnest(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 0)) AS w FROM documents), c AS (SELECT key, w, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
    s AS (SELECT key, sum(n) AS t FROM c GROUP BY key), l AS (SELECT x.key AS query, y.key AS key, sum(least(x.n, y.n)) AS low FROM c x JOIN c y ON x.w = y.w AND x.key % 100 = 0 AND x.key <> y.key GROUP BY ALL)
    SELECT query, l.key, round(low / (a.t + b.t - low), 8) AS jaccard FROM l JOIN s a ON a.key = query JOIN s b ON b.key = l.key
""")
def tf_weighted_search(spark, d):
    """Each document of the block doc_id % 100 = 0 against all others that share a word, whatever their ids."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("key"), F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 0).alias("words"))
    return termsearch.search(docs, docs.where("key % 100 = 0").select(F.col("key").alias("query"), "words"))
