"""Training-corpus pipeline: language ID, near-dedup, secret scans, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.llm import langid, mixing, neardup, pack, secrets
from sumfold.llm.common import mark, stored, sweep, table
from sumfold.sources.tables import spread

MAX_ROUNDS = 2.0

#: No SQL expresses the trained language model, the sampled candidates and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go."""
    out = langid.identify(docs, langid.fit(docs))
    return out.where(~F.col("lang_rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return neardup.kept(docs, neardup.classes(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows."""
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    text = secrets.redacted(F.col("text"), F.col("secret_spans"))
    changed = {"text": text, "n_chars": F.when(F.size("secret_spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to MAX_ROUNDS times; every document occurs at least once."""
    return mixing.realise(docs, mixing.mixture(docs, max_rounds=MAX_ROUNDS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return pack.pack(pack.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mixing", mix), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table and intermediate tables go once the next one's is written; the rest go with the application."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        before = mark()
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, max(0, before - (name != STAGES[0][0])), but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
