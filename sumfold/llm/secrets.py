"""Secret scans: fixed patterns plus character Markov models.

Two first-order character models, one of random strings and one of ordinary identifiers,
are trained from labelled samples; a candidate string is a secret if its log-likelihood
ratio exceeds a threshold. Everything runs as DataFrame expressions.

Spans are code points, end exclusive. Null texts count as empty and have no spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run of 20 or more from its first AKIA
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
THRESHOLD = 8.0  # nats in favour of the random model
SAMPLE_ORDINARY, SAMPLE_RANDOM = 2_000, 6_000  # bounds of the labelled samples: documents, strings
SPAN = "array<struct<start:long,kind:int,end:long>>"


def _located(text: Column, pattern: str, kind: int, fits=None) -> Column:
    """Spans of the matches of pattern. split() and regexp_extract_all() walk the same matches, so piece and match lengths give the places."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    hits = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))

    def put(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["h"]).alias("end"))
        return F.struct((start + x["h"]).alias("at"), F.array_append(acc["out"], span).alias("out"))

    spans = F.aggregate(F.filter(pairs, lambda x: x["h"].isNotNull()), zero, put, lambda acc: acc["out"])
    if fits is not None:
        good = fits(text, p)
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), good.alias("ok")), lambda x: x["ok"]), lambda x: x["s"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """assign, access and hex spans, each kind leftmost and non-overlapping."""
    long_value = lambda t, p: F.transform(F.regexp_extract_all(t, p, F.lit(2)), lambda x: F.length(x) >= 6)
    return F.concat(_located(text, ASSIGN, 0, long_value), _located(text, ACCESS, 1), _located(text, HEX, 2))


def train(samples: DataFrame, string: str = "string", secret: str = "secret", smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character pairs (row: first character), from labelled strings.

    Null strings or labels and characters outside the alphabet do not count. The result has a
    cell for each pair of the alphabet, so its size is fixed.
    """
    s = samples.select(F.col(string).alias("s"), F.col(secret).cast("boolean").alias("y")).where("s is not null and y is not null and length(s) > 1")
    pairs = s.select("y", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.col("s").substr(i, F.lit(2)))).alias("p"))
    k = len(ALPHABET)
    n = {True: [[smooth] * k for _ in range(k)], False: [[smooth] * k for _ in range(k)]}
    for r in pairs.where(F.col("p").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("y", "p").count().collect():
        n[r.y][ALPHABET.index(r.p[0])][ALPHABET.index(r.p[1])] += r["count"]
    out = []
    for a in range(k):
        rand, word = sum(n[True][a]), sum(n[False][a])
        out += [math.log(n[True][a][b] / rand) - math.log(n[False][a][b] / word) for b in range(k)]
    return out


def labelled_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = SAMPLE_ORDINARY, strings: int = SAMPLE_RANDOM) -> DataFrame:
    """(string, secret): random strings in the usual notations, and ordinary words and identifiers of about `documents` documents.

    Strings inside base spans are no ordinary ones. The bounds are parameters; the sample is
    chosen by a hash of the id.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    kinds = F.array(digest.substr(1, 40), b64.substr(1, 40), F.regexp_replace(b64, "[+/=]", "").substr(1, 32), F.upper(F.regexp_replace(b64, "[+/=]", "")).substr(1, 24))
    random = spark.range(strings).select(F.explode(kinds).alias("string"), F.lit(True).alias("secret"))
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    n = max(1, rows.count())
    rows = rows.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 30)) < F.lit(int(min(1.0, documents / n) * (1 << 30))))
    plain = F.col("t")
    for p in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, p, " ")
    word = rows.select(F.explode(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9+/_=-]{2,}"), F.lit(0))).alias("string"))
    joined = rows.select(F.split(F.regexp_replace(plain, "[^A-Za-z0-9]+", " "), " ").alias("w")).select(F.explode("w").alias("a"))
    shaped = joined.where("length(a) > 2").select(F.explode(F.array(F.concat(F.lit("get_"), F.lower("a"), F.lit("_id2")), F.concat(F.lower("a"), F.initcap("a")), F.concat(F.lower("a"), F.lit("-2024-01-30/"), F.lower("a")))).alias("string"))
    return random.unionAll(word.unionAll(shaped).withColumn("secret", F.lit(False)))


def ratio(string: Column, table: Column) -> Column:
    """Log-likelihood ratio of a string: random against ordinary."""
    k = len(ALPHABET)
    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(table, a * k + b))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def markov_spans(text: Column, llr: list[float], threshold: float = THRESHOLD) -> Column:
    """Candidates with a letter and a digit, or both cases, that the random model explains better by more than the threshold."""
    table = F.lit(llr)
    judged = lambda t, p: F.transform(
        F.regexp_extract_all(t, p, F.lit(0)),
        lambda s: F.when(s.rlike("[A-Za-z]") & (s.rlike("[0-9]") | (s.rlike("[A-Z].*[A-Z]") & s.rlike("[a-z]"))), ratio(s, table) > threshold).otherwise(F.lit(False)),
    )
    return _located(text, CANDIDATE, 3, judged)


def scan(docs: DataFrame, llr: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs plus `secret_spans`: base spans, then Markov spans that touch none of them, by start and kind.

    Row-local: no shuffle, every row and column is kept, but for a column of that name, which is replaced. Null and empty texts have no spans,
    repeated rows have theirs each; spans that start together stand in order of kind; an empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    with_base = docs.withColumn("_sf_base", base_spans(t)).withColumn("_sf_more", markov_spans(t, llr, threshold))
    free = F.filter("_sf_more", lambda m: ~F.exists("_sf_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return with_base.withColumn("secret_spans", F.array_sort(F.concat("_sf_base", free))).drop("_sf_base", "_sf_more")


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with every stretch that spans cover replaced by the mask; null stays null."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        gap = text.substr(acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mask)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, empty, put)
    rest = F.concat(F.array_join(done["out"], ""), text.substr(done["at"].cast("int") + 1, F.length(text)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
