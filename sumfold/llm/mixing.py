"""Mixing sources to target weights by temperature.

A source with token share p gets the weight p**a / sum(p**a). The exponent a in [0, 1] is
bisected to 2**-30 (five halvings a pass, each pass one small aggregate over the sources):
the least a whose mixture keeps the target entropy and the repetition limit. Weights become token
budgets, and each source is laid out as a permutation of blocks, and of documents in a
block, that is repeated until the budget is met; the last round may be partial.
Only DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumfold.llm.common import cut

GRID, PASSES, BLOCK, SEED = 32, 6, 4096, 11
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    """Words and one end; null counts as empty."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


@dataclass
class Mixture:
    exponent: float
    entropy: float  # of the weights, in nats
    sources: DataFrame  # source, tokens, share, weight, budget, rounds, left (whole tokens of the last round)
    laid: DataFrame  # doc_id, source, tokens, block, draw, start (tokens before it in its source's permutation)
    blocks: int
    seed: int


def _key(source: Column) -> Column:
    return F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def _section(sources: DataFrame, good) -> float:
    """The least exponent in [0, 1] for which good(entropy, max/min share, exponent) holds; 1 if none does."""
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        at = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
        aggs = [F.max("share").alias("top"), F.min("share").alias("low")]
        for i, a in enumerate(at):
            p = F.pow("share", F.lit(a))
            aggs += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log("share")).alias(f"l{i}")]
        r = sources.agg(*aggs).first()
        if r.top is None:
            return 1.0
        ok = [good(math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"], r.top / r.low, a) for i, a in enumerate(at)]
        first = ok.index(True) if True in ok else GRID
        if first == 0:
            return at[0]
        lo, hi = at[first - 1], at[first]
    return hi


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A row's place in its source's permutation: 60 bits of a digest of its id and text, so repeated or missing ids do not meet in one block."""
    own = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 15), 16, 10).cast("long")


def mixture(
    docs: DataFrame, max_rounds: float | None = None, entropy: float | None = None, flatten: float | None = None, budget: int | None = None, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> Mixture:
    """Weights, budgets and block permutations of all documents: the flattest mixture that keeps the limits given.

    max_rounds: no source is repeated more often than this, relative to the least repeated.
    entropy: the mixture's entropy is at most this many nats.
    flatten: it is at most so far from the sources' own entropy (0) to that of equal weights (1).
    budget: tokens of the whole mixture; None: enough that every document occurs at least once.
    A null source is a source of its own; a null text has one token, its end, as an empty one; repeated rows
    count each; rows of one draw stand in order of id. An empty table gives no sources and no rows.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _key(F.col(f"`{source}`")).alias("source"), words(F.col(f"`{text}`")).alias("tokens"), _draw(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed).alias("draw"))
    slim = cut(slim, "mix-docs")
    totals = cut(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "mix-sources")
    whole = totals.agg(F.sum("tokens").alias("t"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    all_tokens, n = whole.t or 0, whole.n or 0
    shared = totals.withColumn("share", F.col("tokens") / F.lit(float(max(1, all_tokens))))
    most = math.inf if entropy is None else entropy
    if flatten is not None and n:
        own = -shared.agg(F.sum(F.col("share") * F.log("share"))).first()[0]
        most = min(most, own + flatten * (math.log(whole.k) - own))
    limit = math.inf if max_rounds is None else max_rounds
    a = _section(shared, lambda h, spread, a: h <= most + 1e-12 and (1 - a) * math.log(spread) <= math.log(limit) + 1e-12)
    shared = shared.withColumn("raw", F.pow("share", F.lit(a)))
    z = shared.agg(F.sum("raw").alias("z"), F.max(F.col("share") / F.col("raw")).alias("m")).first()
    total = float(budget) if budget is not None else all_tokens * (z.m or 0.0) * (z.z or 0.0)
    sources = shared.withColumn("weight", F.col("raw") / F.lit(z.z or 1.0)).withColumn("budget", F.round(F.col("weight") * F.lit(total)).cast("long"))
    sources = sources.withColumns({"rounds": F.expr("budget div tokens"), "left": F.expr("budget % tokens")})
    sources = cut(sources.select("source", "tokens", "share", "weight", "budget", "rounds", "left"), "mix-weights")
    reached = sources.agg(-F.sum(F.col("weight") * F.log("weight"))).first()[0] or 0.0
    blocks = max(1, n // BLOCK)
    placed = slim.withColumn("block", _block(F.col("draw"), blocks))
    sizes = placed.groupBy("source", "block").agg(F.sum("tokens").alias("b"))
    before = F.sum("b").over(Window.partitionBy("source").orderBy("block")) - F.col("b")
    sizes = cut(sizes.select("source", "block", before.alias("before")), "mix-blocks")
    inside = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    laid = placed.withColumn("inside", inside).join(sizes, ["source", "block"])
    laid = laid.select("doc_id", "source", "tokens", "block", "draw", (F.col("before") + F.col("inside")).alias("start"))
    return Mixture(a, reached, sources, laid, blocks, seed)


def _block(draw: Column, blocks: int) -> Column:
    """Blocks are numbered in the order in which they are laid out."""
    return F.pmod(draw, F.lit(blocks))


def layout(m: Mixture) -> DataFrame:
    """One row for each document: doc_id, source, tokens, weight, budget, start, copies (0 if the budget ends before it)."""
    s = m.sources.select("source", "weight", "budget", "rounds", "left")
    out = m.laid.join(s, "source").withColumn("copies", (F.col("rounds") + (F.col("start") < F.col("left")).cast("long")))
    return out.select("doc_id", F.when(~F.col("source.none"), F.col("source.name")).alias("source"), "tokens", "weight", "budget", "start", "copies")


def realise(docs: DataFrame, m: Mixture, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with every row repeated as its source's budget asks; same columns. Rows of one id and text are repeated alike.

    A source's last round ends at one (block, draw, id); rows decide by comparing with it, so texts
    are not shuffled while the sources fit a checked broadcast.
    """
    at = F.struct("block", "draw", "doc_id")
    ends = m.laid.join(m.sources.select("source", "left"), "source").where(F.col("start") < F.col("left")).groupBy("source").agg(F.max(at).alias("_sf_end"))
    ends = cut(m.sources.select("source", "rounds").join(ends, "source", "left").select(F.col("source").alias("_sf_source"), F.col("rounds").alias("_sf_rounds"), "_sf_end"), "mix-ends")
    if ends.count() <= BROADCAST_SOURCES:
        ends = F.broadcast(ends)
    draw, own = _draw(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), m.seed), F.col(f"`{doc_id}`")
    mine = F.struct(_block(draw, m.blocks).alias("block"), draw.alias("draw"), own.alias("doc_id"))
    out = docs.join(ends, _key(F.col(f"`{source}`")) == F.col("_sf_source"))
    copies = F.col("_sf_rounds") + F.when(F.col("_sf_end").isNotNull() & (mine <= F.col("_sf_end")), 1).otherwise(0)
    rows = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<long>"))
    return out.withColumn("_sf_copy", F.explode(rows)).select(*[F.col(f"`{c}`") for c in docs.columns])
