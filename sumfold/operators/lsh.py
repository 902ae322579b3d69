"""Locality-sensitive indexes as similarity joins: banded MinHash, top-k search, containment by bands and, exactly, by an inverted index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumfold.operators import knn, minhash, setjoin

BLOCK = 10_000


def bands_and_rows(threshold: float, num_perm: int) -> tuple[int, int]:
    """The factor pair b * r = num_perm whose (1 / b) ** (1 / r) is closest to the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    pairs = [(b, num_perm // b) for b in range(1, num_perm + 1) if num_perm % b == 0]
    return min(pairs, key=lambda p: abs((1 / p[0]) ** (1 / p[1]) - threshold))


def band_keys(sig: Column, b: int, r: int) -> Column:
    """Array of (band, key); the key is the band's slice of the signature itself."""
    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.struct(i.alias("band"), F.slice(sig, i * r + 1, F.lit(r)).alias("band_key")))


class MinHashLSH:
    """An index over rows (key, sig). Empty sets (all places at the maximum) are not indexed, since they would share every bucket."""

    def __init__(self, df: DataFrame, threshold: float = 0.5, num_perm: int = 128, params: tuple[int, int] | None = None):
        self.df, self.threshold, self.num_perm = df.select("key", "sig"), threshold, num_perm
        self.b, self.r = params or bands_and_rows(threshold, num_perm)
        if self.b * self.r > num_perm:
            raise ValueError("bands * rows exceeds num_perm")

    def buckets(self) -> DataFrame:
        full = self.df.where(F.exists("sig", lambda h: h != minhash.EMPTY))
        return full.select("key", F.inline(band_keys(F.col("sig"), self.b, self.r)))

    def query(self, asked: DataFrame) -> DataFrame:
        """(query, key, similarity) for every indexed set of at least the threshold. asked: (query, sig)."""
        other = MinHashLSH(asked.select(F.col("query").alias("key"), "sig"), self.threshold, self.num_perm, (self.b, self.r))
        hits = other.buckets().withColumnRenamed("key", "query").join(self.buckets(), ["band", "band_key"]).select("query", "key").distinct()
        sims = hits.join(asked.select("query", F.col("sig").alias("_q")), "query").join(self.df.select("key", F.col("sig").alias("_k")), "key")
        return sims.select("query", "key", minhash.jaccard(F.col("_q"), F.col("_k")).alias("similarity")).where(F.col("similarity") >= self.threshold)

    def members(self) -> DataFrame:
        """(key, representative): sets of equal signatures share the least key."""
        heads = self.df.groupBy("sig").agg(F.min("key").alias("representative"))
        return self.df.join(heads, "sig").select("key", "representative")

    def pairs(self) -> DataFrame:
        """(a, b, similarity) of all similar pairs a < b of representatives; see members for the other sets.

        Copies are collapsed first, so a large group of equal sets makes no pairs.
        """
        heads = MinHashLSH(self.df.groupBy("sig").agg(F.min("key").alias("key")), self.threshold, self.num_perm, (self.b, self.r))
        left, right = heads.buckets().withColumnRenamed("key", "a"), heads.buckets().withColumnRenamed("key", "b")
        hits = left.join(right, ["band", "band_key"]).where("a < b").select("a", "b").distinct()
        sims = hits.join(heads.df.select(F.col("key").alias("a"), F.col("sig").alias("_a")), "a").join(heads.df.select(F.col("key").alias("b"), F.col("sig").alias("_b")), "b")
        return sims.select("a", "b", minhash.jaccard(F.col("_a"), F.col("_b")).alias("similarity")).where(F.col("similarity") >= self.threshold)

    def remove(self, keys: DataFrame) -> MinHashLSH:
        """The index without some keys (key)."""
        return MinHashLSH(self.df.join(keys.select("key"), "key", "left_anti"), self.threshold, self.num_perm, (self.b, self.r))

    def combine(self, other: MinHashLSH) -> MinHashLSH:
        """Both indexes; for a key of both the other's signature wins, and its buckets alone count."""
        if (self.threshold, self.num_perm, self.b, self.r) != (other.threshold, other.num_perm, other.b, other.r):
            raise ValueError("parameters differ")
        kept = self.df.join(other.df.select("key"), "key", "left_anti")
        return MinHashLSH(kept.unionByName(other.df), self.threshold, self.num_perm, (self.b, self.r))

    def __add__(self, other):
        return self if isinstance(other, int) and other == 0 else self.combine(other)

    __radd__ = __add__

    def stats(self) -> DataFrame:
        """items, bands, rows, buckets and members by bucket."""
        sizes = self.buckets().groupBy("band", "band_key").agg(F.count("*").alias("n"))
        return sizes.agg(F.count("*").alias("buckets"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_bucket"), F.coalesce(F.max("n"), F.lit(0)).alias("max_bucket")).select(F.lit(self.b).alias("bands"), F.lit(self.r).alias("rows"), "buckets", "avg_bucket", "max_bucket")


def most_similar(index: DataFrame, asked: DataFrame, k: int, prefix_bits: int | None = None) -> DataFrame:
    """The k most similar sets (query, rank, key, similarity), ties by key.

    index: (key, sig); asked: (query, sig). Without prefix_bits every set is compared with a broadcast block
    of the queries at a time. With them only sets are that share the trailing bits of some place with the
    query, by an equi-join; leading bits of minima are zero in most sets, which would make all sets meet.
    """
    q = asked.select("query", F.col("sig").alias("_q"))
    if prefix_bits is None:
        parts = [index.join(F.broadcast(part)) for part in knn.blocks(q, BLOCK)]
        sims = reduce(lambda a, b: a.unionAll(b), parts)
    else:
        cells = lambda df, key: df.select(key, F.posexplode(F.transform("sig", lambda h: h.bitwiseAND((1 << prefix_bits) - 1))).alias("pos", "lead"))
        hits = cells(asked, "query").join(cells(index, "key"), ["pos", "lead"]).select("query", "key").distinct()
        sims = hits.join(q, "query").join(index.select("key", "sig"), "key")
    scored = sims.select("query", "key", minhash.jaccard(F.col("_q"), F.col("sig")).alias("similarity"))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "key", "similarity")


def size_partitions(sizes: DataFrame, parts: int) -> DataFrame:
    """(part, lower, upper) of equi-count partitions over (key, size); the last has no upper bound (null)."""
    cuts = sizes.agg(F.percentile_approx("size", [i / parts for i in range(1, parts)], 100_000).alias("c")).first().c if parts > 1 else []
    edges = [1, *[int(c) for c in cuts or []]]
    rows = [(i, e, edges[i + 1] if i + 1 < len(edges) else None) for i, e in enumerate(edges)]
    return sizes.sparkSession.createDataFrame(rows, "part int, lower long, upper long")


def containment_candidates(index: DataFrame, asked: DataFrame, threshold: float, num_perm: int, params: tuple[int, int] | None = None) -> DataFrame:
    """(query, key, jaccard_score, containment): sets that hold at least the threshold's share of the query.

    index: (key, sig, size); asked: (query, sig, size). A set smaller than threshold * |query| cannot contain
    it and is left out before signatures are compared. containment follows from the Jaccard estimate j:
    j (1 + |x| / |q|) / (1 + j). Candidates share a band, so sets much larger than the query, whose Jaccard
    similarity is small, are mostly missed; overlaps finds them all.
    """
    b, r = params or bands_and_rows(threshold / 2, num_perm)
    left = asked.select("query", F.col("size").alias("_qs"), F.inline(band_keys(F.col("sig"), b, r)))
    right = index.select("key", F.col("size").alias("_ks"), F.inline(band_keys(F.col("sig"), b, r)))
    hits = left.join(right, ["band", "band_key"]).where(F.col("_ks") >= threshold * F.col("_qs")).select("query", "key", "_qs", "_ks").distinct()
    sims = hits.join(asked.select("query", F.col("sig").alias("_q")), "query").join(index.select("key", F.col("sig").alias("_k")), "key")
    j = F.col("jaccard_score")
    sims = sims.withColumn("jaccard_score", minhash.jaccard(F.col("_q"), F.col("_k")))
    return sims.select("query", "key", "jaccard_score", F.least(F.lit(1.0), j * (1 + F.col("_ks") / F.col("_qs")) / (1 + j)).alias("containment")).where(F.col("containment") >= threshold)


def overlaps(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, key, jaccard_score, containment), both exact, of all pairs that share an item.

    index: (key, words); asked: (query, words); words are distinct. Shared items are counted through an inverted
    index, so only sets that share one meet.
    """
    left = asked.select("query", F.size("words").alias("_qs"), F.explode("words").alias("_item"))
    right = index.select("key", F.size("words").alias("_ks"), F.explode("words").alias("_item"))
    n = left.join(right, "_item").groupBy("query", "key", "_qs", "_ks").agg(F.count("*").alias("_n"))
    return n.select("query", "key", (F.col("_n") / (F.col("_qs") + F.col("_ks") - F.col("_n"))).alias("jaccard_score"), (F.col("_n") / F.col("_qs")).alias("containment"))


def exact_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: every pair of different sets of at least the threshold's Jaccard similarity, and each copy with the least key of its equals.

    sets: (key, words), words distinct; empty sets make no rows. Sets are compared as sets of 64-bit hashes. Two sets of
    the threshold share one of the rarest items of each, so all pairs are found, in memory, by pairs of blocks of stored
    sets (see setjoin); copies are collapsed first, so n equal sets make n - 1 rows. Runs at once.
    """
    stored = setjoin.numbered(sets)
    heads = stored.groupBy("digest").agg(F.min("key").alias("a"))
    copies = stored.select(F.col("key").alias("b"), "digest").join(heads, "digest").where("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    return setjoin.pairs(stored, threshold).unionByName(copies)


def exact_containment(query: Column, other: Column) -> Column:
    """Share of the query's items that the other array has."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, other)) / F.size(query))
