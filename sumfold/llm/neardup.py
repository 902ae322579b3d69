"""MinHash near-dedup by improved consistent weighted sampling.

A text's features are its word 5-grams (all its words, if fewer), weighted by TF-IDF.
Document frequencies are counted over all documents in 2**DF_BITS hashed counters, so
their size is fixed and what they resolve is a share of the documents, alike at every
input size; the IDF is scaled to 1 .. 2 by the logarithm of the number of documents, so a
shingle weighs at most twice another, however large the corpus or a group in it. Every
text draws BANDS x ROWS consistent weighted samples; texts that agree in a band are
candidates. A candidate pair is linked if its exact weighted Jaccard similarity reaches the
threshold, or its plain one (of the sets of shingles) does; the result counts both.

Copies are collapsed before anything is compared. In a bucket, members are compared with
one pivot, the member that shares most buckets, not with each other. For buckets that
stay apart, the shingles that no other such text has are found. Texts that have so many of
them that they cannot reach the threshold with anyone leave, the others meet two more pivots.
What two texts share with the first pivot, and what they have that nobody else has, bounds
their similarity; the pairs that are still in different classes and whose bound reaches the
threshold are compared one by one. So no candidate link between classes is
lost, and a large group of near copies does not make all its pairs.

Buckets and groups of more than SPLIT texts are dealt over several tasks wherever their members
meet, so a group that holds a third of all texts is no single task.

Classes are connected components. Null texts are classes of their own; empty texts are
copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumfold.llm.common import cut, small_batches

SHINGLE, SIMILARITY, BANDS, ROWS, DF_BITS = 5, 0.8, 10, 3, 20
CHUNK, WORDS, BROADCAST_IDS, SPLIT = 1 << 13, 150_000, 500_000, 256
DF_BLOCK = 1 << 12


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gamma2(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) in the middle of n equal cells."""
    u, lo, hi = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return hi


class Sampler:
    """Features, weights, samples and similarity of texts."""

    def __init__(self, idf: np.ndarray | None = None, k: int = BANDS * ROWS, shingle: int = SHINGLE, seed: int = 5):
        self.idf, self.shingle, self.words = idf, shingle, {}
        self.by_place, self.by_draw, self.by_row = _odd(shingle, seed), _odd(k, seed + 1)[:, None], _odd(k, seed + 2)
        g = _gamma2(1 << 16)
        self.r, self.ln_c = g.astype(np.float32), np.log(g).astype(np.float32)
        self.beta = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashed shingles and how often each occurs."""
        words = text.lower().split()
        if len(self.words) > WORDS:
            self.words.clear()
        seen = self.words
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        x = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        n = min(self.shingle, len(x))
        if not n:
            return x, np.empty(0, np.int64)
        h = np.full(len(x) - n + 1, n, np.uint64)
        for j in range(n):
            h += x[j : len(x) - n + 1 + j] * self.by_place[j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.unique(h, return_counts=True)

    def weighted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        h, tf = self.features(text)
        return h, (tf * self.idf[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)]).astype(np.float32)

    def bands(self, text: str, bands: int = BANDS) -> np.ndarray:
        """A 64-bit key for each band; none for a text without words."""
        h, s = self.weighted(text)
        if not len(h):
            return np.empty(0, np.int64)
        ln_s, best, key = np.log(s), None, None
        for a in range(0, len(h), CHUNK):
            u = h[None, a : a + CHUNK] * self.by_draw
            u ^= u >> np.uint64(31)
            u *= np.uint64(0x94D049BB133111EB)
            u ^= u >> np.uint64(30)
            bits = u.view(np.uint16).reshape(len(u), -1, 4)
            r = self.r.take(bits[:, :, 3])
            t = np.floor(ln_s[a : a + CHUNK] / r + (b := self.beta.take(bits[:, :, 1])))
            score = self.ln_c.take(bits[:, :, 2]) - r * (t - b) - r
            at = score.argmin(axis=1)
            row = np.arange(len(u))
            low, who = score[row, at], h[a : a + CHUNK][at] ^ (t[row, at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            if best is None:
                best, key = low, who
            else:
                key, best = np.where(low < best, who, key), np.minimum(low, best)
        mixed = (key ^ (key >> np.uint64(33))) * self.by_row
        mixed ^= mixed >> np.uint64(29)
        out = mixed.reshape(bands, -1).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(bands, dtype=np.uint64)
        return (out ^ (out >> np.uint64(32))).view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, float]:
    """Shared shingles of two weighted texts, and the sum of their smaller weights."""
    (h, w), (g, v) = a, b
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    return len(i), float(np.minimum(w[i], v[j]).sum(dtype=np.float64))


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted Jaccard similarity (minima over maxima) and that of the sets; 1 for two texts without features."""
    n, w = overlap(a, b)
    most = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - w
    return (w / most, n / (len(a[0]) + len(b[0]) - n)) if most else (1.0, 1.0)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the two."""
    return max(similarities(a, b))


def idf_of(counts: np.ndarray, n: int) -> np.ndarray:
    """1 for what is in every document to 2 for what is in none."""
    return (1 + np.log((1 + n) / (1 + np.minimum(counts, n))) / np.log(2 + n)).astype(np.float32)


def inverse_frequencies(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> np.ndarray:
    """Scaled IDF of each hashed counter, over all rows of docs."""
    size, per = 1 << DF_BITS, DF_BLOCK

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, total, n = Sampler(shingle=shingle), np.zeros(size, np.int64), 0
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                got = [np.unique(s.features(t)[0] >> np.uint64(64 - DF_BITS)) for t in pdf["t"][a : a + 256] if t]
                if got:
                    total += np.bincount(np.concatenate(got).astype(np.int64), minlength=size)
            n += len(pdf)
        total = np.concatenate([total, [n]])
        parts = [total[i : i + per] for i in range(0, len(total), per)]
        yield pd.DataFrame({"block": range(len(parts)), "half": int(np.random.default_rng(int(total.sum())).integers(64)), "n": [x.astype("<i8" if x.max(initial=0) >> 31 else "<i4").tobytes() for x in parts], "wide": [bool(x.max(initial=0) >> 31) for x in parts]})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8" if wide else "<i4").astype(np.int64) for x, wide in zip(pdf["n"], pdf["wide"], strict=True))
        return pd.DataFrame({"block": pdf["block"][:1], "half": 0, "n": [total.astype("<i8").tobytes()], "wide": True})

    schema = "block int, half int, n binary, wide boolean"
    parts = docs.select(F.col(text).alias("t")).mapInPandas(counted, schema)
    parts = parts.groupBy("block", "half").applyInPandas(summed, schema)  # in two steps, so that many tasks' counters meet in no single one
    rows = sorted(parts.groupBy("block").applyInPandas(summed, schema).select("block", "n").collect())  # 2**DF_BITS counters
    total = np.concatenate([np.frombuffer(r.n, "<i8") for r in rows]) if rows else np.zeros(size + 1, np.int64)
    return idf_of(total[:-1], int(total[-1]))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of the connected component of every node in links (a, b), by alternating large and small stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = cut(small, "links")
        ends = edges.select("a", F.lit(1).alias("up")).unionAll(edges.select("b", F.lit(None).cast("int")).distinct())
        crossed = ends.groupBy("a").agg(F.count("up").alias("up"), F.count("*").alias("n")).where("up > 1 or (up = 1 and n > 1)")
        if crossed.isEmpty():  # every node has one root, and no root has one
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select("b", "b").distinct().toDF("node", "root"))


class Verifier:
    def __init__(self, docs: DataFrame, text: str, idf, least: float, shingle: int):
        self.rows = docs.select(F.md5(F.col(text).cast("binary")).alias("key"), F.col(text).alias("t"))
        self.idf, self.least, self.shingle = idf, least, shingle

    def texts(self, keys: DataFrame) -> DataFrame:
        """(key, t): each text once. keys is read twice."""
        few = keys.count() <= BROADCAST_IDS
        found = self.rows.join(F.broadcast(keys) if few else keys, "key", "left_semi")
        return found.groupBy("key").agg(F.first("t").alias("t"))

    def judged(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked, weighty, n, w) for pairs (a, b) of text keys: whether the texts are similar enough, by weight as well, and their overlap. pairs is read twice."""
        idf, least, shingle = self.idf, self.least, self.shingle
        texts = cut(self.texts(pairs.select("a").unionAll(pairs.select("b")).toDF("key").distinct()), "neardup-texts")

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, held = Sampler(idf.value, shingle=shingle), {}

            def of(key: str, text: str):
                if key not in held:
                    if len(held) >= 64:
                        held.pop(next(iter(held)))
                    held[key] = s.weighted(text)
                return held[key]

            for pdf in batches:
                both = [(s.weighted(x), of(b, y)) for x, b, y in zip(pdf["x"], pdf["b"], pdf["y"], strict=True)]
                shared = [overlap(x, y) for x, y in both]
                like = np.array([similarities(x, y) for x, y in both]).reshape(-1, 2) >= least
                yield pdf[["a", "b"]].assign(linked=like.any(axis=1), weighty=like[:, 0], n=[n for n, _ in shared], w=[w for _, w in shared])

        full = pairs.join(texts.select(F.col("key").alias("b"), F.col("t").alias("y")), "b")
        full = full.join(texts.select(F.col("key").alias("a"), F.col("t").alias("x")), "a")
        return cut(full.select("a", "b", "x", "y").mapInPandas(judge, "a string, b string, linked boolean, weighty boolean, n long, w double"), "neardup-judged")

    def unshared(self, keys: DataFrame) -> DataFrame:
        """(key, n, w, u, uw): shingles and weight of each text, and of those that no other of the texts has. keys is read twice."""
        idf, shingle = self.idf, self.shingle

        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = Sampler(idf.value, shingle=shingle)
            for pdf in batches:
                got = [s.weighted(t) for t in pdf["t"]]
                yield pd.DataFrame({"key": pdf["key"], "n": [len(h) for h, _ in got], "w": [float(w.sum(dtype=np.float64)) for _, w in got], "h": [h.view(np.int64) for h, _ in got], "x": [w for _, w in got]})

        cells = cut(self.texts(keys).mapInPandas(listed, "key string, n long, w double, h array<long>, x array<float>"), "neardup-cells")
        each = cells.select(F.unhex("key").alias("k"), F.inline(F.arrays_zip("h", "x")))
        alone = each.groupBy("h").agg(F.count("*").alias("c"), F.min("k").alias("k"), F.min("x").alias("x")).where("c = 1")
        alone = alone.groupBy(F.lower(F.hex("k")).alias("key")).agg(F.count("*").alias("u"), F.sum("x").alias("uw"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        return cells.select("key", "n", "w").join(alone, "key", "left").select("key", "n", "w", zero("u").alias("u"), zero("uw").alias("uw"))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (k, key, root, size) of the buckets that hold more than one class; size: members of the class in the bucket."""
    rooted = cut(members.join(roots, members["key"] == roots["node"], "left").select("k", "key", F.coalesce("root", "key").alias("root")), "neardup-rooted")
    parts = cut(rooted.groupBy("k", "root").agg(F.count("*").alias("size")), "neardup-parts")
    several = parts.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    return rooted.join(parts.join(several, "k", "left_semi"), ["k", "root"])


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, text_key (md5, null for null), class_id (least doc_id of its class), links, weighted_links.

    links counts the other texts that were compared with a row's text and are similar enough; weighted_links those that are so by
    weight. Once two texts are in one class they need not be compared, so links is no count of all similar texts.
    Null ids are no class_id unless no row of the class has one; repeated rows and equal texts are one text; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(docs, text, shingle))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Sampler(idf.value, shingle=shingle)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["i"], "key": pdf["key"], "bands": [s.bands(t).tolist() if t else [] for t in pdf["t"]]})

    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.md5(F.col(text).cast("binary")).alias("key"), F.col(text).alias("t"))
    signs = cut(rows.mapInPandas(signed, "doc_id long, key string, bands array<long>"), "neardup-signs")
    texts = signs.where("key is not null").groupBy("key").agg(F.first("bands").alias("bands"))
    members = cut(texts.select(F.explode("bands").alias("k"), "key"), "neardup-bands")
    crowded = cut(members.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "neardup-crowded")
    members = cut(members.join(crowded, "k"), "neardup-members")
    liked = cut(members.groupBy("key").agg(F.sum("n").alias("liked")), "neardup-liked")
    pivots = cut(members.join(liked, "key").groupBy("k").agg(F.max(F.struct("liked", "key")).alias("p")), "neardup-pivots")
    members = members.select("k", "key")
    check = Verifier(docs, text, idf, least, shingle)
    ordered = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    tried = cut(members.join(pivots, "k").where("key <> p.key").select(*ordered(F.col("key"), F.col("p.key"))).distinct(), "neardup-tried")
    judged = check.judged(tried)
    links = judged.where("linked").select("a", "b", "weighty")
    apart = cut(_apart(members, components(links.select("a", "b"))), "neardup-apart")
    if not apart.isEmpty():
        gap = 1 - least + 1e-6
        alone = check.unshared(cut(apart.select("key").distinct(), "neardup-keys"))
        alone = cut(alone.where((F.col("uw") <= gap * F.col("w")) | (F.col("u") <= gap * F.col("n"))), "neardup-unshared")
        able = cut(apart.select("k", "key", "root").join(alone, "key").join(liked, "key").join(pivots.select("k", F.col("p.key").alias("first")), "k"), "neardup-able")
        # the next two members that share most buckets meet those of other classes
        best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("liked"), F.desc("key")))
        others = able.where("key <> first").withColumn("z", F.pmod(F.xxhash64("key"), F.lit(SPLIT)))
        others = others.withColumn("r", best("k", "z")).where("r <= 2").withColumn("r", best("k")).where("r <= 2")
        others = cut(others.select("k", F.struct("key", "root").alias("p")), "neardup-others")
        more = able.join(others, "k").select("key", "root", "p")
        more = more.where("root <> p.root").select(*ordered(F.col("key"), F.col("p.key"))).distinct()
        more = cut(more.join(tried, ["a", "b"], "left_anti"), "neardup-tried")
        links = cut(links.unionAll(check.judged(more).where("linked").select("a", "b", "weighty")), "neardup-links")
        # buckets of one pivot make one group, so a pair that shares several of them is looked at once
        grouped = cut(able.select(F.col("first").alias("k"), "key", "n", "w", "u", "uw").distinct(), "neardup-grouped")
        rest = _apart(grouped.select("k", "key"), components(links.select("a", "b"))).join(grouped, ["k", "key"])
        # what each shares with its pivot; the pivot shares all
        seen = judged.select("a", "b", F.col("n").alias("sn"), F.col("w").alias("sw"))
        rest = rest.withColumns({"a": F.greatest("key", "k"), "b": F.least("key", "k")}).join(seen, ["a", "b"], "left")
        rest = cut(rest.select("k", "key", "root", "size", "n", "w", "u", "uw", F.coalesce("sn", "n").alias("on"), F.coalesce("sw", "w").alias("ow")), "neardup-rest")
        main = cut(rest.groupBy("k").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.expr(f"cast(count(*) div {SPLIT} as int)").alias("cuts")), "neardup-main")
        rest = rest.join(main, "k")
        few = rest.where("root <> main").select("k", F.explode(F.sequence(F.lit(0), "cuts")).alias("z"), *[F.col(c).alias(f"{c}_x") for c in ("key", "root", "n", "w", "u", "uw", "on", "ow")])
        few = cut(few, "neardup-few")
        rest = rest.withColumn("z", F.pmod(F.xxhash64("key"), F.col("cuts") + 1).cast("int"))

        def reach(all_: str, own: str, first: str) -> Column:
            """Two texts share at most the smaller part of the pivot that they have, and the smaller part besides it that is shared with anyone."""
            x, y = {c: F.col(f"{c}_x") for c in (all_, own, first)}, {c: F.col(c) for c in (all_, own, first)}
            most = F.least(x[first], y[first]) + F.least(x[all_] - x[first] - x[own], y[all_] - y[first] - y[own])
            return most >= (least - 1e-6) * (x[all_] + y[all_] - most)

        last = few.join(rest, ["k", "z"]).where((F.col("root_x") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("key_x") > F.col("key"))) & (reach("w", "uw", "ow") | reach("n", "u", "on")))
        last = last.select(*ordered(F.col("key_x"), F.col("key"))).distinct()
        last = cut(last.join(tried.unionAll(more), ["a", "b"], "left_anti"), "neardup-tried")
        links = cut(links.unionAll(check.judged(last).where("linked").select("a", "b", "weighty")), "neardup-links")
    roots = components(links.select("a", "b"))
    named = signs.select("doc_id", "key").join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))
    named = cut(named, "neardup-named")
    heads = cut(named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id")), "neardup-heads")
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), "weighty").groupBy("node").agg(F.count("*").alias("n"), F.count_if("weighty").alias("m"))
    out = named.join(heads, "root", "left").join(cut(ends, "neardup-ends"), F.col("key") == F.col("node"), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("doc_id", F.col("key").alias("text_key"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), number("n").alias("links"), number("m").alias("weighted_links"))


def kept(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each class, with the class's least id. Rows of null text all stay.

    found: what `classes` gives for docs. Only rows whose id and text occur more than once meet in a shuffle with their texts.
    """
    named = [F.col(f"`{c}`") for c in docs.columns]
    own = found.where("text_key is not null and doc_id = class_id").groupBy("class_id", "text_key").agg(F.count("*").alias("n"))
    heads = own.groupBy("class_id").agg(F.min_by(F.struct("text_key", "n"), "text_key").alias("x"))  # an id may stand on several texts of its class
    heads = heads.select(F.col("class_id").alias("doc_id"), "x.*")
    heads = cut(heads.select(F.col("doc_id").alias("_sf_i"), F.col("text_key").alias("_sf_k"), F.col("n").alias("_sf_n")), "neardup-kept")
    key = F.md5(F.col(text).cast("binary"))
    hit = docs.join(heads, (F.col(doc_id).cast("long") == F.col("_sf_i")) & (key == F.col("_sf_k")))
    one = hit.where("_sf_n = 1").select(*named)
    many = hit.where("_sf_n > 1").dropDuplicates(["_sf_i", "_sf_k"]).select(*named)
    nameless = found.where("text_key is not null and class_id is null").groupBy(F.col("text_key").alias("_sf_k")).agg(F.count("*").alias("_sf_n"))  # classes without any id
    odd = docs.where(F.col(doc_id).isNull()).join(nameless, key == F.col("_sf_k")).dropDuplicates(["_sf_k"]).select(*named)
    return one.unionAll(many).unionAll(odd).unionAll(docs.where(F.col(text).isNull()).select(*named))
