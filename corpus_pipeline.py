"""A training corpus from documents: five stages, each one of the operators.

Every stage works on all rows that its predecessor kept, and its decisions take
effect; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.llm import decontaminate, jaccard, langid, mixing, pii
from triloom.llm.store import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rows whose language is undetermined or in doubt.

    Null and empty texts and texts without letters are undetermined; repeated
    rows stay or go together; without a labelled row, or from an empty table,
    nothing is left.  Other columns are kept as they are.
    """
    return langid.keep_known(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8).

    It is that with the smallest id; rows without an id come last.  Rows, not
    ids, are compared: equal rows are one node and leave one row, rows that
    share an id or have none are nodes of their own.  Rows without words link
    with nothing and all stay.  Of ties one stays, whichever, as they are equal.
    An empty table stays empty.  Other columns take part in telling rows apart.
    """
    # Nulls don't change the hash, so it is told where they are.
    key = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))
    rows = docs.select(key.alias("row_key"), "doc_id", "text", F.struct(*docs.columns).alias("row"))
    groups = jaccard.similar_groups(rows, id_col="row_key", words=5, percent=80)
    ids = rows.groupBy("row_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    nodes = groups.groupBy("row_key").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")).join(ids, "row_key")
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row_key", (F.col("copies") > 1).alias("equal"), "n_shingles")).alias("best")
    kept = written(nodes.groupBy("component_id").agg(best).select("best.row_key", (F.col("best.equal") & (F.col("best.n_shingles") > 0)).alias("repeated")))
    # Equal rows are merged where they are before they are sent, however many they are.
    lone = rows.join(kept.where("not repeated"), "row_key").select("row.*")
    merged = rows.join(kept.where("repeated"), "row_key").select("row.*").distinct()
    return lone.union(merged)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages, and without rows that are mostly such.

    Null and empty texts share nothing with the benchmark and stay; repeated
    rows are treated alike; with an empty benchmark all rows stay untouched.
    """
    clean = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind.

    All rows stay; null, empty and clean texts are untouched; repeated rows are
    treated alike.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of rows whose sources, languages and topics have the target weights.

    A null source or language is a class of its own; rows without words are never
    drawn; rows that share an id share their draw.
    """
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("target_weights", target_weights),
]
#: SQL can't express the trained stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The pipeline as a query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """None here."""
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
