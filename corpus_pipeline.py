"""A corpus from raw documents to packed sequences: toxicity, near-duplicates, repeated strings, secrets, packing.

Each stage takes what the one before it kept, as a written table. The first two drop documents, the next two change texts
(and ``n_chars``), the last returns pieces with their tokens and places in sequences. No stage can be expressed in SQL as a
whole, so there is no SQL for the result; tests hold it to a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm.common import spare
from claimsieve.llm.near_copies import near_copies
from claimsieve.llm.packing import pack_documents
from claimsieve.llm.secrets import redact_secrets
from claimsieve.llm.suffix_dedup import remove_repeats
from claimsieve.llm.toxicity import fit, score_documents
from claimsieve.plans.storage import delete_since, mark, materialize, new_path


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; the classifier is fitted on the labelled ones."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = spare(docs, "_stage_score")
    return score_documents(docs, model, out_col=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id (the first row, if ids repeat or are NULL)."""
    number = spare(docs, "_stage_row")
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")  # written, so that numbers stay
    found = near_copies(rows, id_col=number).select(F.col("doc_id").alias(number), F.col("component_id").alias("component"))
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.col(number).alias("row"))
    first = found.join(rows.select(number, "doc_id"), number).groupBy("component").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(number)), number, "left_semi").drop(number)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 200 bytes that occur more than once."""
    return _counted(remove_repeats(docs, stored=True))  # a stage is given a written table


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return _counted(redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their tokens and places in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again; what a stage wrote on its way is deleted with its input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = mark()
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        delete_since(spark, start, (path,))
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
