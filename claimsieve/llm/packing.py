"""Best-fit packing of documents into sequences of bounded length.

Only how many pieces there are of each length matters for the plan, so the plan is made from a histogram of at most
``max_len`` entries, whatever the size of the corpus. Exact-complement hashing comes first: for each length, hash indexes of
single, pair and triple sums give combinations that fill the gap exactly, and each is used as often as availability
counts allow. Best fit in falling order packs the rest. Pieces then look up their place by (length, rank).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimsieve.llm.common import bounded, portions
from claimsieve.llm.token_ids import text_encoder
from claimsieve.plans.storage import materialize


class ExactSums:
    """Indexes of the sums of one, two and three available lengths, of which ``reserve`` pieces each are held back.

    Availability only falls, so an entry that no longer stands is dropped when it is met and never comes back.
    """

    def __init__(self, left: np.ndarray, max_len: int, reserve: int = 0):
        self.left, self.max_len, self.reserve = left, max_len, reserve
        self.lengths = np.flatnonzero(left > reserve).tolist()
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for a in reversed(self.lengths):  # so that the most even pair of a sum comes last
            for b in self.lengths:
                if b > a or a + b >= max_len:
                    break
                self.pairs.setdefault(a + b, []).append((a, b))
        self.triples: dict[int, list[int]] = {}

    def _times(self, pattern: tuple[int, ...]) -> int:
        """How often a pattern can be used."""
        return min((int(self.left[x]) - self.reserve) // pattern.count(x) for x in pattern)

    def _pair(self, total: int, before: tuple[int, ...]) -> tuple[int, ...] | None:
        """A pair of this sum, neither over the last length of ``before``, that can be used along with it."""
        entries = self.pairs.get(total, [])
        while entries and self._times(entries[-1]) < 1:
            entries.pop()
        for a, b in reversed(entries):
            if a > before[-1]:
                return None
            if self._times((*before, a, b)) > 0:
                return (*before, a, b)
        return None

    def fill(self, length: int, most: int) -> tuple[int, ...] | None:
        """The length with one to ``most`` others, none longer, that fill a sequence exactly."""
        gap = self.max_len - length
        if gap <= length and self._times((length, gap)) > 0:
            return length, gap
        if most >= 2 and (found := self._pair(gap, (length,))):
            return found
        if most >= 3:
            if gap not in self.triples:  # the longest of three, the shortest such last
                self.triples[gap] = [c for c in reversed(self.lengths) if 3 * c >= gap and gap - c in self.pairs]
            entries = self.triples[gap]
            while entries and (self.left[entries[-1]] <= self.reserve or not self.pairs[gap - entries[-1]]):
                entries.pop()
            for c in reversed(entries):
                if c > length:
                    return None
                if self._times((length, c)) > 0 and (found := self._pair(gap - c, (length, c))):
                    return found
        return None

    def use(self, pattern: tuple[int, ...]) -> int:
        n = self._times(pattern)
        for x in pattern:
            self.left[x] -= n
        return n


#: Tried in turn: how many pieces may fill a gap exactly, and how many pieces of each length are held back for best fit. Where
#: there are few pieces, using the short ones up early leaves long ones with nothing to fill their gaps.
_TRIES = tuple((most, reserve) for reserve in (0, 1, 3) for most in (3, 2, 1))


def plan_packing(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, how many sequences)`` that use exactly ``counts`` pieces of each length.

    The shortest of a few plans is taken; the search ends at one that has no more sequences than the tokens need.
    """
    least = -(-sum(k * n for k, n in counts.items()) // max_len)
    best: list[tuple[tuple[int, ...], int]] = []
    fewest = None
    for most, reserve in _TRIES:
        plan = _plan(counts, max_len, most, reserve)
        n = sum(k for _, k in plan)
        if fewest is None or n < fewest:
            best, fewest = plan, n
        if n <= least:
            break
    return best


def _plan(counts: dict[int, int], max_len: int, most: int, reserve: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(max_len + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[tuple[int, ...], int]] = []
    if left[max_len]:
        done.append(((max_len,), int(left[max_len])))
        left[max_len] = 0
    sums = ExactSums(left, max_len, reserve)
    for length in reversed(sums.lengths):
        while left[length] > reserve and (pattern := sums.fill(length, most)):
            done.append((pattern, sums.use(pattern)))
    return done + _best_fit(left, max_len)


def _best_fit(left: np.ndarray, max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in falling order; equal bins are handled together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((pattern, n))

    for length in range(max_len, 0, -1):
        n = int(left[length])
        while n:
            i = bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                pattern, m = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(i)
                each = min(gap // length, max(1, n // m))  # as many of this length as best fit would add one by one
                use = min(m, n // each)
                if m > use:
                    put(gap, pattern, m - use)
                put(gap - each * length, (*pattern, *[length] * each), use)
                n -= use * each
            else:
                each = min(max_len // length, n)
                use = n // each
                put(max_len - each * length, (length,) * each, use)
                n -= use * each
    return [x for b in bins.values() for x in b]


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``max_len`` tokens of every whole text (NULL: empty) with its end id.

    Only documents that are too long are cut: all pieces but the first have ``max_len`` tokens. Rows:
    ``doc_id, piece, start, length, ids_crc32, part, rank`` and, if ``with_ids``, ``ids``. ``rank`` counts pieces of
    the same length in the same task.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    return rows.mapInArrow(_cutter(tokenizer_path, max_len, end_id, with_ids), schema + ", ids array<int>" * with_ids)


def _cutter(tokenizer_path: str, max_len: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = text_encoder(tokenizer_path), TaskContext.get().partitionId(), [0] * (max_len + 1)
        for batch, texts in portions(batches, "text"):
            out: list[tuple] = []
            pieces: list[bytes] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                raw += end
                n = len(raw) // 4
                a, b = 0, n - (n - 1) // max_len * max_len
                k = 0
                while a < n:
                    piece = raw[4 * a : 4 * b]
                    out.append((doc, k, a, b - a, zlib.crc32(piece), part, seen[b - a]))
                    seen[b - a] += 1
                    if with_ids:
                        pieces.append(piece)
                    a, b, k = b, b + max_len, k + 1
            cols = list(zip(*out, strict=True))
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "rank": pa.int64()}
            arrays = {k: pa.array(c, t) for (k, t), c in zip(types.items(), cols, strict=True)}
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(cols[3])]).astype(np.int32)
                arrays["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(pieces), "<u4").view("<i4")))
            yield pa.record_batch(arrays)

    return cut


def pack_pieces(pieces: DataFrame, max_len: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces (``length`` from 1 to ``max_len``, ``part``, ``rank``).

    ``pieces`` is read twice and must be a written table, so that ranks stay what they were. Sequences are numbered
    from 0 without gaps, and offsets in a sequence have none. No rows give no rows.
    """
    spark = pieces.sparkSession
    sizes = pieces.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most max_len rows
    used: Counter = Counter()
    runs: list[tuple[int, ...]] = []
    sequence = 0
    for pattern, n in plan_packing(counts, max_len):
        offset = 0
        for length, times in sorted(Counter(pattern).items(), reverse=True):
            runs.append((length, used[length], sequence, times, offset))
            used[length] += times * n
            offset += length * times
        sequence += n
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    # A few runs per length: their number does not depend on how many pieces there are.
    plan = spark.sparkContext.broadcast(table)
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    return ranked.mapInArrow(_placer(plan), _schema(ranked) + ", sequence_id long, offset long").drop("rank")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def _placer(plan):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        first = np.searchsorted(table[:, 0], np.arange(int(table[-1, 0]) + 2)) if len(table) else None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                of = length == x
                a, b = first[x], first[x + 1]
                at[of] = a + np.searchsorted(table[a:b, 1], rank[of], side="right") - 1
            _, r0, sequence, times, offset = table[at].T
            within = rank - r0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence + within // times), pa.array(offset + within % times * length)], names=[*batch.schema.names, "sequence_id", "offset"]
            )

    return place


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset`` for all documents.

    A NULL or empty text is its end id alone. Repeated rows and ids are documents of their own, each with its pieces. Other
    columns, whatever their names, are left out; an empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, max_len, end_id, with_ids=with_ids), "pieces")
    return pack_pieces(pieces, max_len)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into sequences of at most 1024 tokens."""
    import public_tokenizers

    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
