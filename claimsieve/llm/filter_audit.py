"""How filters of documents act on each other: what each removes, repeats and alone catches, in every order.

Each document gets a mask of the filters that it fails. Four look at its text alone. The fifth, whether a smaller id has the
same text, is decided by compressed radix tries over whole texts: texts are dealt out by ranges of adaptive prefixes (as long as
it takes to part the texts of a sample), each task inserts the texts of its ranges into a trie that holds the smallest id at
each terminal, and what the terminals hold are the documents that repeat nothing. A task sends a text that it saw many times
once. Then masks are counted by part, and the counts of all orders follow from the 32 numbers of a part.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm.common import bounded, give_back, portions

FILTERS = "ABCDE"
_DUPLICATE = 1 << FILTERS.index("E")
#: Bytes of texts that one trie is meant to hold, and ranges of prefixes for each task.
TRIE_BYTES, RANGES = 24 << 20, 3
#: Of the sample that places the ranges: texts for each range and at most, characters of a first prefix, characters in all.
SAMPLE, MOST, FIRST, CHARS = 32, 1 << 16, 64, 1 << 22
#: Bytes of texts that a task remembers, to send each of them once.
REMEMBERED = 16 << 20
_UPPER = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]").search


def text_mask(text: str) -> int:
    """Bits of A to D. A: under 50 words; B: under 65 distinct in 100 words; C: over 5 A-Z in 100 code points; D: a mark."""
    raw = text.encode()
    words = raw.split()  # of bytes: at exactly space and \x09-\x0D
    upper = len(raw) - len(raw.translate(None, _UPPER))
    failed = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * upper > 5 * len(text), _MARKS(raw) is not None)
    return sum(1 << i for i, f in enumerate(failed) if f)


class RadixTrie:
    """Compressed trie of byte strings; a terminal holds the least of what was inserted with its string."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [None, {}]  # what the terminal holds, and (label, node) by first byte

    def insert(self, text: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while at < len(text):
            edge = node[1].get(text[at])
            if edge is None:
                leaf = [None, {}]
                node[1][text[at]] = (text[at:], leaf)
                node, at = leaf, len(text)
                break
            label, below = edge
            if not text.startswith(label, at):
                # The edge splits where the text leaves it.
                n = len(commonprefix([label, text[at : at + len(label)]]))
                middle = [None, {label[n]: (label[n:], below)}]
                node[1][text[at]] = (label[:n], middle)
                label, below = label[:n], middle
            node, at = below, at + len(label)
        if node[0] is None or value < node[0]:
            node[0] = value

    def terminals(self) -> Iterator[tuple]:
        """What all terminals hold."""
        todo = [self.root]
        while todo:
            value, below = todo.pop()
            if value is not None:
                yield value
            todo += [n for _, n in below.values()]


def prefix_splits(texts: DataFrame, ranges: int) -> list[bytes]:
    """Prefixes, in order, that part the distinct texts of ``texts(text, h)`` into ranges of about equal bytes.

    They come from a sample by hash of at most ``MOST`` distinct texts. Where many of it share a whole prefix, longer ones of
    those texts are sampled (of at most ``CHARS`` characters in all), until ranges can be told apart or texts end. Which splits
    are found decides only how even the tasks are.
    """
    n = texts.count()
    width, heavy, found = FIRST, None, {}
    while n and ranges > 1:
        want = min(SAMPLE * ranges, MOST, max(ranges, CHARS // width))
        rows = texts if heavy is None else texts.where(F.substring("text", 1, width // 8).isin(heavy))
        share = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1.0, want / n) * (1 << 30))
        one = rows.where(share).groupBy("h").agg(F.min(F.substring("text", 1, width)).alias("p"), F.max(F.length("text").cast("long")).alias("size"))
        got = one.limit(2 * want).collect()
        here: dict[str, int] = {}
        for r in got:
            here[r.p] = here.get(r.p, 0) + r.size
        for p in heavy or ():
            found.pop(p, None)
        found |= here
        limit = 2 * sum(found.values()) / ranges
        count = {}
        for r in got:
            count[r.p] = count.get(r.p, 0) + 1
        heavy = [p for p, size in here.items() if size > limit and len(p) == width and count[p] > 1]
        if not heavy:
            break
        width *= 8
    splits, total, seen, before = [], sum(found.values()), 0, b""
    for p, size in sorted((p.encode(), s) for p, s in found.items()):
        if seen * ranges >= total * (len(splits) + 1) and p != before:
            splits.append(p[: len(commonprefix([p, before])) + 1])
        seen, before = seen + size, p
    return splits


def first_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, h``: of each distinct text (NULL: empty) the smallest id that has it, with the hash of the text."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(1, -(-size // TRIE_BYTES))
    splits = prefix_splits(texts, tasks * RANGES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        held = 0

        def out() -> pa.RecordBatch:
            keys = list(seen)
            return pa.record_batch({"range": pa.array([bisect_right(splits, k) for k in keys], pa.int32()), "text": pa.array(keys, pa.binary()), "doc_id": pa.array([seen[k][0] for k in keys], pa.int64()), "h": pa.array([seen[k][1] for k in keys], pa.int64())})

        for batch, found in portions(batches, "text"):
            for text, i, h in zip(found, batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True):
                raw = text.encode()
                if raw not in seen:
                    seen[raw] = [i, h]
                    held += len(raw) + 200
                elif i < seen[raw][0]:
                    seen[raw][0] = i
            if held > REMEMBERED:
                yield out()
                seen.clear()
                held = 0
        yield out()

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()
        for batch in give_back(batches):
            for text, i, h in zip(batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True):
                trie.insert(text.as_py(), (i, h))
        found = list(trie.terminals())
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.record_batch({"doc_id": pa.array([v[0] for v in part], pa.int64()), "h": pa.array([v[1] for v in part], pa.int64())})

    dealt = bounded(texts).mapInArrow(deal, "range int, text binary, doc_id long, h long")
    return dealt.repartition(tasks, "range").mapInArrow(tries, "doc_id long, h long")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows ``doc_id, part, mask, n``: how many rows of a document fail which filters, as bits in the order of ``FILTERS``.

    A NULL text is empty, a NULL part is the empty string. A NULL id is neither smaller than another nor greater, so it repeats
    nothing. Rows that repeat an id with its text are all kept; none of them is a duplicate of the others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "part": batch.column("part"), "mask": pa.array([text_mask(t) for t in texts], pa.int32())})

    def light(which: str) -> DataFrame:
        got = bounded(rows.where(which).withColumn("h", F.xxhash64("text"))).mapInArrow(own, "doc_id long, h long, part string, mask int")
        return got.groupBy("doc_id", "h", "part", "mask").count()

    known = light("doc_id is not null").join(first_texts(docs, id_col, text_col).withColumn("first", F.lit(True)), ["doc_id", "h"], "left")
    known = known.withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(_DUPLICATE)))
    columns = ["doc_id", "part", "mask", F.col("count").alias("n")]
    return known.select(*columns).unionByName(light("doc_id is null").select(*columns))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit, from rows ``part, mask, n, good, toxic`` (one per part and mask): a row per part, order and step.

    Everything is a sum over the masks of a part: a filter at a step meets the filters before it as a set of bits. Its removals
    over all orders at any step (``shapley``) follow from how many orders put it before the other filters that a mask fails.
    """
    k = len(filters)
    orders = list(permutations(range(k)))
    steps = [(sum(1 << x for x in o[:s]), o[s]) for o in orders for s in range(k)]
    m = np.arange(1 << k)
    before = np.array([b for b, _ in steps])[:, None]
    bit = 1 << np.array([x for _, x in steps])[:, None]
    fails, passed = (m & bit) > 0, (m & before) == 0
    size = np.array([max(1, int(x).bit_count()) for x in m])
    use = {"kept": (m & (before | bit)) == 0, "removed": fails & passed, "redundant": fails & ~passed, "unique_fails": m == bit, "shapley": np.where(fails, len(orders) // size, 0)}
    use = {name: u.astype(np.int64) for name, u in use.items()}
    names = ["".join(filters[x] for x in o) for o in orders for _ in range(k)]
    numbers = [s + 1 for _ in orders for s in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *columns in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "good", "toxic")), strict=True):
                n, good, toxic = (np.array(c, np.int64) for c in columns)
                out = {"part": pa.array([part] * len(steps), pa.string()), "filter_order": pa.array(names), "step": pa.array(numbers, pa.int32())}
                out |= {name: pa.array(u @ n) for name, u in use.items()}
                yield pa.record_batch(out | {"good_lost": pa.array(use["removed"] @ good), "toxic_lost": pa.array(use["removed"] @ toxic)})

    def wide(c: str) -> Column:
        return F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == x, F.col(c))), F.lit(0)) for x in range(1 << k))).alias(c)

    columns = ", ".join(f"{c} long" for c in (*use, "good_lost", "toxic_lost"))
    return counts.groupBy("part").agg(*(wide(c) for c in ("n", "good", "toxic"))).mapInArrow(run, f"part string, filter_order string, step int, {columns}")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (``source``), order of the five filters and step, zeros included.

    ``labels(doc_id, quality, toxic)`` may have several rows for an id: one that says 1 is enough. Ids that are NULL or have no
    label count as neither. See ``masks`` for NULLs and repeated rows; other columns are ignored, an empty table gives no rows.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    lit = F.lit(0).cast("long")
    joined = masks(docs.where("doc_id is not null")).join(said, "doc_id", "left").unionByName(masks(docs.where("doc_id is null")).withColumns({"good": lit, "toxic": lit}))
    counts = joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", lit)).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", lit)).alias("toxic"))
    return interactions(counts)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over ``documents`` in all 120 orders, by source."""
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
flags AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM words),
masks AS (SELECT doc_id, part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed FROM flags),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN said USING (doc_id) GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS x, substr(filter_order, 1, s - 1) AS before FROM orders, range(1, 6) t(s)),
met AS (SELECT part, filter_order, step, x, n, good, toxic, failed, contains(failed, x) AS fails,
    before <> '' AND regexp_matches(failed, '[' || before || '_]') AS gone FROM counts, steps),
base AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM base
"""
