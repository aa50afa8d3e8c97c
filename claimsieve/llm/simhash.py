"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most three of 64 bits agree on two of five blocks of 13 bits, so every link is between
fingerprints that meet in one of ten tables keyed by two blocks. What meets is compared bit-sliced: 64 fingerprints form
one word per bit (a plane), and one xor with a plane updates 64 distances, kept in carry-save counters. Words in which all
lanes are beyond the radius are abandoned while planes are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm.common import bounded, portions
from claimsieve.plans.components import connected_components
from claimsieve.plans.storage import materialize

RADIUS = 3
#: Five blocks of the 64 bits: first bit and width.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Members of a key that are compared as one tile; larger groups are dealt to tiles of two chunks.
CHUNK = 2048
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of the shingles of ``words`` words; 0 for a text without words."""
    w = text.encode().lower().split()  # of bytes: lowers A-Z and splits at \x09-\x0D and \x20 only
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        hashes = [digest(b" ".join(w), 42)]
    elif words == 3:
        hashes = [digest(b"%b %b %b" % s, 42) for s in zip(w, w[1:], w[2:])]
    else:
        hashes = [digest(b" ".join(w[i : i + words]), 42) for i in range(len(w) - words + 1)]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[a : a + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows ``doc_id, fp`` (the 64 bits as a signed long) of every row; a NULL text counts as empty: 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            fp = np.array([fingerprint(t, words) for t in texts], np.uint64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))})

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, "doc_id long, fp long")


def _tables() -> Column:
    """The ten (table, key) of a fingerprint."""
    cut = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in BLOCKS]
    pairs = [(i, j) for i in range(5) for j in range(i)]
    return F.array(*(F.lit(t << 40).cast("long") + cut[i] * F.lit(1 << 13) + cut[j] for t, (i, j) in enumerate(pairs)))


def close_pairs_forest(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``src, dst`` between distinct fingerprints (column ``fp``) that connect all within ``radius``.

    A group that meets in a key gives edges that connect what is linked in it, not all pairs. Large groups are dealt to
    tiles of two chunks by a hash, so that no task holds a whole group.
    """
    keyed = fps.select("fp", F.explode(_tables()).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1")
    n_chunks = F.ceil(F.col("count") / F.lit(CHUNK)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    met = keyed.join(sizes, "key").select("fp", "key", n_chunks.alias("n")).withColumn("c", own)
    tiles = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.least(o, F.col("c")) * F.lit(1 << 20) + F.greatest(o, F.col("c")))
    dealt = met.select("fp", "key", F.explode(tiles).alias("tile"))
    count = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(count, "key", "tile").sortWithinPartitions("key", "tile", "fp").mapInArrow(_compare(radius), "src long, dst long").distinct()


def _compare(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = [batch.column(c).to_numpy() for c in ("key", "tile", "fp")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            key, tile, _ = cols
            last = int(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))[-1])
            if last:
                yield _edges([c[:last] for c in cols], radius)
            rest = [c[last:] for c in cols]  # at most one tile, which may go on
        if rest is not None:
            yield _edges(rest, radius)

    return compare


def _edges(cols: list[np.ndarray], radius: int) -> pa.RecordBatch:
    key, tile, fp = cols
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
    src, dst = bit_sliced_links(fp.view(np.uint64), np.cumsum(new) - 1, radius)
    return pa.record_batch({"src": pa.array(fp[src]), "dst": pa.array(fp[dst])})


def bit_sliced_links(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked fingerprints that connect all linked ones of each group; ``group`` is sorted from 0."""
    if radius != 3:
        raise ValueError("the carry-save counters hold distances up to 3")
    n = len(fp)
    sizes = np.bincount(group)
    start = np.cumsum(sizes) - sizes
    lane = np.arange(n) - start[group]
    words_of = (sizes + 63) // 64
    first_word = np.cumsum(words_of) - words_of
    word = first_word[group] + lane // 64
    # Planes: word w of plane b has bit b of 64 fingerprints of one group.
    word_start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    shift = (lane % 64).astype(np.uint64)
    planes = np.empty((64, len(word_start)), np.uint64)
    for b in range(64):
        planes[b] = np.bitwise_or.reduceat(((fp >> np.uint64(b)) & np.uint64(1)) << shift, word_start)
    filled = np.bitwise_or.reduceat(np.uint64(1) << shift, word_start)
    src: list[np.ndarray] = []
    dst: list[np.ndarray] = []
    multiple = words_of[group] > 1
    single = np.flatnonzero(~multiple & (sizes[group] > 1))
    for q in np.array_split(single, len(single) // 200_000 + 1):
        _append(src, dst, *_words(planes, filled, fp, q, word[q]), fp, start, group, first_word)
    for g in np.flatnonzero(words_of > 1):  # at most a tile each
        members = np.arange(start[g], start[g] + sizes[g])
        own_words = np.arange(first_word[g], first_word[g] + words_of[g])
        a, b = _forest(planes, filled, fp, members, own_words)
        src.append(a)
        dst.append(b)
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.empty(0, np.int64), np.empty(0, np.int64))


def _words(planes: np.ndarray, filled: np.ndarray, fp: np.ndarray, q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For query q[i] against the 64 lanes of word w[i]: the lanes within the radius, where there are any."""
    ones = np.zeros(len(q), np.uint64)
    twos = np.zeros(len(q), np.uint64)
    over = ~filled[w]  # four differences or more; empty lanes too
    value = fp[q]
    for b in range(64):
        differs = planes[b][w] ^ (np.uint64(0) - ((value >> np.uint64(b)) & np.uint64(1)))
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7:  # abandon words whose lanes are all beyond the radius
            on = np.flatnonzero(over != _ALL)
            if len(on) < 0.7 * len(q):
                q, w, value, ones, twos, over = q[on], w[on], value[on], ones[on], twos[on], over[on]
    near = ~over
    on = near != 0
    return q[on], w[on], near[on]


def _append(src, dst, q, w, near, fp, start, group, first_word) -> None:
    base = start[group[q]] + (w - first_word[group[q]]) * 64
    for k in range(64):
        on = ((near >> np.uint64(k)) & np.uint64(1)).astype(bool)
        other = base[on] + k
        keep = other > q[on]
        src.append(q[on][keep])
        dst.append(other[keep])


def _forest(planes, filled, fp, members, own_words) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links of one large group: rows of the bit matrix are found as they are reached."""
    n, k = len(members), len(own_words)
    rows: dict[int, int] = {}
    step = max(1, 200_000 // k)
    for a in range(0, n, step):
        q = np.repeat(members[a : a + step], k)
        got_q, got_w, near = _words(planes, filled, fp, q, np.tile(own_words, len(members[a : a + step])))
        for i, w, bits in zip((got_q - members[0]).tolist(), (got_w - own_words[0]).tolist(), near.tolist()):
            rows[i] = rows.get(i, 0) | bits << (64 * w)
    left = (1 << n) - 1
    src, dst = [], []
    for root in range(n):
        if not left >> root & 1:
            continue
        left &= ~(1 << root)
        stack = [root]
        while stack:
            v = stack.pop()
            new = rows.get(v, 0) & left
            left &= ~new
            while new:
                u = (new & -new).bit_length() - 1
                new &= new - 1
                src.append(v)
                dst.append(u)
                stack.append(u)
    return members[0] + np.array(src, np.int64), members[0] + np.array(dst, np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows ``doc_id, fp, component_id``: one per input row; ``component_id`` is the smallest id linked over any path.

    Texts without words, NULL among them, have fingerprint 0 and link like any other. Rows with a NULL id are members of
    their component but never name it (it is NULL if all its ids are). Equal rows each give a row.
    """
    doc_fp = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    fps = materialize(doc_fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = connected_components(close_pairs_forest(fps.select("fp")))
    of = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return doc_fp.join(of.select("fp", "root").join(named, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
