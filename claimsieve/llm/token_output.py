"""Token-id files: Parquet with list columns, sorted by document, for selective reads of tokens and metadata.

Layout of a data set::

    tokens/   doc_id long, part int, local_start long, n_tokens long, ids array<int>
    parts/    part int, base long, n_docs long, n_tokens long        one row per file of tokens/

``ids`` is dictionary-encoded (a page then holds bit-packed 16-bit codes of a 50k vocabulary); the sorted and the
counting columns are delta-encoded. Row groups and pages are small and carry column and offset indexes, so a filter on
``doc_id`` reads the pages of those documents only and a read without ``ids`` reads no tokens. A document starts at
``base + local_start``: writers need not know what other tasks write.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimsieve.llm.common import bounded, portions
from claimsieve.llm.token_ids import text_encoder
from claimsieve.plans.storage import new_path

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10


def write_token_dataset(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (NULL: empty), append ``end_id`` to each document and write the data set in id order.

    Rows with equal ids (repeats) all stay, ordered by a hash of their text; NULL ids come first. Other columns of
    ``docs`` are ignored, whatever their names. An empty table gives a data set without rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = ["doc_id", F.xxhash64("text")]
    tokens = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(_encoder(tokenizer_path, end_id), "doc_id long, part int, local_start long, n_tokens long, ids array<int>")
    (
        tokens.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(f"{path}/tokens")
    )
    sizes = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # One row per written file: a window over all of them is small at any size of the input.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"), "n_docs", "n_tokens").coalesce(1).write.parquet(f"{path}/parts")


def read_token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id, start, n_tokens`` without reading any tokens; filters on ``doc_id`` skip pages."""
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids``; filters on ``doc_id`` and a choice of columns reach the files."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "base")
    tokens = spark.read.parquet(f"{path}/tokens")
    # parts has a row for each file of tokens, at most the number of write tasks.
    return tokens.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _encoder(tokenizer_path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = text_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch, texts in portions(batches, "text"):
            ids = [x + end for x in encoder.encode(texts)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").view("<i4"))
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "part": pa.array(np.full(len(n), part, np.int32)), "local_start": pa.array(start + ends - n), "n_tokens": pa.array(n), "ids": pa.ListArray.from_arrays(pa.array(offsets), values)}
            )
            start += int(n.sum())

    return encode


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})


def token_digest(tokens: DataFrame) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids_crc32`` of what ``read_tokens`` returns."""
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all ``documents`` into token files in the shared folder and digest what is read back."""
    import public_tokenizers

    path = new_path(spark, "token-dataset")
    write_token_dataset(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digest(read_tokens(spark, path))
