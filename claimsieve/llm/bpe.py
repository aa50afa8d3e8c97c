"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a word of the vocabulary is found by a minimal perfect hash in one probe. The others are merged from
bytes: a heap gives the pair of lowest rank (leftmost among equals), neighbours are linked, and stale heap entries are
passed over. The hash tables are built once on the driver; their size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm.common import PieceCache, bounded, portions


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys, n slots, one displacement for about four keys."""

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.buckets = self.n // 4 + 1
        groups: dict[int, list[int]] = {}
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for h in hashes:
            groups.setdefault(h % self.buckets, []).append(h)
        self.shift = [0] * self.buckets
        taken = bytearray(self.n)
        for b, own in sorted(groups.items(), key=lambda g: -len(g[1])):
            d = 0
            while True:
                slots = [self._slot(h, d) for h in own]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s in slots:
                taken[s] = 1
        self.keys: list[bytes] = [b""] * self.n
        for k, h in zip(keys, hashes, strict=True):
            self.keys[self._slot(h, self.shift[h % self.buckets])] = k

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 7) + d * ((h >> 31) | 1) + (d >> 10)) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of a key, or -1 for what isn't a key."""
        h = xxhash.xxh64_intdigest(key)
        s = self._slot(h, self.shift[h % self.buckets])
        return s if self.keys[s] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece that isn't in the vocabulary as a whole."""
    n = len(piece)
    after = list(range(1, n + 2))  # start of the part after the one that starts here; 0: joined to the part before
    before = list(range(-1, n))
    get = ranks.get
    # An entry is one number: rank, start of the pair, start of its second part and its end, from high bits to low.
    w = (n + 1).bit_length()
    w2, w3, mask = 2 * w, 3 * w, (1 << w) - 1
    heap = [r << w3 | i << w2 | (i + 1) << w | (i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        x = heappop(heap)
        i, j, k = x >> w2 & mask, x >> w & mask, x & mask
        if after[i] != j or after[j] != k:
            continue
        after[i] = k
        after[j] = 0
        if k < n:
            before[k] = i
            if (r := get(piece[i : after[k]])) is not None:
                heappush(heap, r << w3 | i << w2 | k << w | after[k])
        if (p := before[i]) >= 0 and (r := get(piece[p:k])) is not None:
            heappush(heap, r << w3 | p << w2 | i << w | k)
    out, i = [], 0
    while i < n:
        k = after[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


class BytePairCodec:
    """Encodes and decodes texts; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash):
        import regex

        self.ranks, self.table = ranks, table
        self.ids = [ranks[k] for k in table.keys] if ranks else []
        self.pieces = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimal = {i: b"%d" % i for i in ranks.values()}
        self.cache = PieceCache(self._encode_pieces)

    def encode_piece(self, piece: bytes) -> list[int]:
        slot = self.table.slot(piece)
        return [self.ids[slot]] if slot >= 0 else merge_bytes(piece, self.ranks)

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out = []
        for x in pieces:
            ids: list[int] = []
            for p in self.pieces(x.decode()):
                ids += self.encode_piece(p.encode())
            out.append(array("I", ids).tobytes())
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u4") for b in self.cache.joined(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(1)
def _codec(path: str, pattern: str, table: PerfectHash) -> BytePairCodec:
    return BytePairCodec(load_ranks(path), pattern, table)


def _with_codec(spark: SparkSession, ranks_path: str, pattern: str):
    table = spark.sparkContext.broadcast(PerfectHash(sorted(load_ranks(ranks_path))))
    return lambda: _codec(ranks_path, pattern, table.value)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, ids array<int>`` for every row; the text is whole, NULL counts as empty (no ids).

    Repeated rows give a row each. Other columns, whatever their names, are left out; an empty table gives no rows.
    """
    codec = _with_codec(docs.sparkSession, ranks_path, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for batch, texts in portions(batches, "text"):
            ids = c.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).view("<i4")))})

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def bpe_decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Rows ``doc_id, data binary`` from ``doc_id, ids``; NULL ids give no bytes."""
    codec = _with_codec(tokens.sparkSession, ranks_path, pattern)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for batch in batches:
            data = [c.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "data": pa.array(data, pa.binary())})

    return bounded(tokens).select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, data binary")


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    codec = _with_codec(docs.sparkSession, ranks_path, pattern)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for batch, texts in portions(batches, "text"):
            n, ids_hash, text_hash = [], [], []
            for ids in c.encode(texts):
                ids = ids.tolist()
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(b" ".join(map(c.decimal.__getitem__, ids))).hexdigest())
                text_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash), "decoded_sha256": pa.array(text_hash)})

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all ``documents``."""
    import public_tokenizers as tokens

    return bpe_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN)
