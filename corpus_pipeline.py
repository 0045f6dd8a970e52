"""The corpus pipeline: toxicity, near duplicates, contamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; ``run`` writes each result to the shared folder and rereads
it. All but the last return the columns of ``docs``. Rows that are wholly
alike (same id, same text) share one decision; of such near duplicates
one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm import bpe, decontaminate, jaccard, pii, toxicity
from relyframe.llm.common import documents, row_keys
from relyframe.session import scratch_path

VOCABULARY = "byte_bpe_50k.tiktoken"


def _by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of 128 bits for each row's id and text."""
    return docs.withColumns(dict(zip(("__k1", "__k2"), row_keys(docs))))


def _keys(verdict: DataFrame) -> DataFrame:
    return verdict.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()


def _without(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key has no row in ``verdict`` (k1, k2)."""
    return _by_row(docs).join(_keys(verdict), ["__k1", "__k2"], "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scored at or above the threshold go."""
    found = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, found.where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join stays: the smallest id (none last), then key.

    Texts without words are linked with nothing, so they all stay.
    """
    found = jaccard.join_components(docs).where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    keys = _keys(found.groupBy("component").agg(first.alias("f")).select("f.k1", "f.k2"))
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # rows that are wholly alike become one before the shuffle
    rows = _by_row(docs.where(worded)).groupBy("__k1", "__k2").agg(F.first(F.struct(*docs.columns)).alias("row"))
    kept = rows.join(keys, ["__k1", "__k2"], "left_semi").select("row.*")
    return kept.unionByName(docs.where(~worded))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the texts."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", sanitise), ("byte_bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        at = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
