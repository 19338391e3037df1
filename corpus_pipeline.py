"""A corpus made ready for training: five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last
return the columns of `docs`. Null ids, null or empty texts, repeated rows, empty tables and extra
columns pass as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versehall.llm import byte_bpe, near_dup, source_mix, surrogates, toxicity
from versehall.llm.common import stage, table, unused

RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is at least one half go."""
    name = unused(docs, "__toxicity")[0]
    return toxicity.score(docs, table(spark, sf_dir, "labels"), name=name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more stays, that with the smallest doc_id;
    of rows that repeat a doc_id one stays; rows without a doc_id stay."""
    id_, once_ = unused(docs, "__id", "__once")
    kept = near_dup.near_duplicates(docs.select("doc_id", "text"), percent=80).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_)).distinct()
    once = F.row_number().over(Window.partitionBy(id_).orderBy(F.xxhash64("text")))
    # a merge join at any size, so that the cost of dealing out the texts stays in proportion
    own = docs.join(kept.hint("merge"), F.col("doc_id").cast("long") == F.col(id_)).withColumn(once_, once).where(F.col(once_) == 1)
    return own.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the text."""
    done = surrogates.pseudonymise(docs, surrogates.session_key(spark), count=unused(docs, "__entities")[0])
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    prefix, copy = unused(docs, "__mix_repeats", "__copy")
    taken = source_mix.mix(docs, prefix=prefix.removesuffix("repeats")).where(F.col(prefix) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(prefix)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digests of ids and of the decoded bytes."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return byte_bpe.encode_documents(docs, path, pattern, keep_ids=True, keep=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii_surrogates", replace_personal_data),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: A recurrent network and keyed surrogates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
