"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.llm import hilbert, html, langid, maxent, mixing, neardup, pack, secrets, topk, twins, winnow
from sumfold.llm.common import crc_mod, table
from sumfold.sources.tables import spread

SHARDS = 24
MAX_ROUNDS, FLATTEN = 4.0, 0.5  # op3: no source is repeated more than four times, the entropy goes half of the way to that of equal weights


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    return maxent.score(docs, maxent.train(docs, ~held_out), held_out)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.shards(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op3_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mixture(table(spark, sf_dir, "documents"), max_rounds=MAX_ROUNDS, flatten=FLATTEN)
    out = mixing.layout(m).withColumns({"weight": F.round("weight", 9), "exponent": F.round(F.lit(m.exponent), 9), "entropy": F.round(F.lit(m.entropy), 9)})
    return out.select("doc_id", "source", "tokens", "weight", "budget", "start", "copies", "exponent", "entropy")


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    n = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secret_spans")).alias("spans"), n(3).alias("n_markov")
    )


def op5_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "links", "weighted_links")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(pack.pieces(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.successor_fingerprints(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op9_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs, ~held_out)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_maxent_scores, op2_hilbert_shards, op3_temperature_mixture, op4_secret_spans, op5_minhash_classes, op6_best_fit_packing, op7_winnowing, op8_html_text, op9_maxscore_topk, op10_language]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_hilbert_shards": twins.hilbert_shards(SHARDS, hilbert.BITS),
        "op3_temperature_mixture": twins.temperature_mixture(MAX_ROUNDS, FLATTEN, mixing.BLOCK, mixing.SEED),
        "op9_maxscore_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                       WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
                  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
        """,
    }
