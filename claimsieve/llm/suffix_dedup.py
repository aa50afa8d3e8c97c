"""Removal of byte strings of 200 bytes that occur more than once, over a sparse suffix array.

Sorting a suffix for every byte of a corpus would move each byte two hundred times, so suffixes are sorted at anchors only.
The anchor of a window of 200 bytes is where its least 24-byte gram (by hash, leftmost) starts: equal windows have anchors
at the same place in them. Windows whose anchor gram occurs once cannot repeat and are done. For the others:

* each task sorts the suffixes at its anchors into runs, front-coded: a suffix carries its common prefix with the one before
  it as a number. Equal suffixes with equal left contexts are sent once. Runs are dealt to slots by the gram.
* a merge task combines the runs of a slot by a loser tree. Prefixes known to be common are never compared again, and the tree leaves
  the sorted suffixes with their common prefixes. Left contexts are sorted in the same way, from right to left.
* windows at d bytes before their anchor are equal if their suffixes share 200 - d bytes and their left contexts d bytes:
  both are runs in sorted order, so equal windows are found by numbers, exactly, for each d.
* where the suffixes of a run stand is not merged: a run is told which of them have repeated windows, and marks their places.
  So a passage that very many documents share is one entry of each run, and no task gets all its places. The runs that a task
  sent together mark them together: what they cover of a text is one row, however many of its windows repeat.

A gram that occurs very often (``HOT_GRAM``) is dealt by whole windows instead, so that no task gets all its places.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm.common import bounded, portions, spare
from claimsieve.plans.storage import materialize

LENGTH = 200
GRAM = 24
HOT_GRAM = 50_000
#: Texts are anchored in segments of so many bytes, and runs are sent when they hold so many bytes of suffixes.
SEGMENT = 1 << 22
RUN_BYTES = 24 << 20
#: Slots of each merge task: it merges the runs of one after the other, so that only those of one are in memory.
SLOTS = 16
#: Bits of a run's number that tell runs apart which were sent together, and parts in which these are located.
SENT = 20
PARTS = 4
_WINDOW = LENGTH - GRAM + 1
_LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 24 bytes that start at each position."""
    w = raw.astype(np.uint64)
    for k in (1, 2, 4):  # eight bytes as one number
        w = w[:-k] | (w[k:] << np.uint64(8 * k))
    n = len(raw) - GRAM + 1
    m = np.uint64(0x9E3779B97F4A7C15)
    h = w[:n] * m
    h ^= h >> np.uint64(29)
    h = (h + w[8 : 8 + n]) * m
    h ^= h >> np.uint64(32)
    h = (h + w[16 : 16 + n]) * m
    return h ^ (h >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    more = width - done
    return np.minimum(x[: len(x) - more], x[more:]) if more else x


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: gram hash, position, first and last window start that it is the anchor of."""
    parts = []
    for base in range(0, max(1, len(raw) - LENGTH + 1), SEGMENT):
        seg = np.frombuffer(raw, np.uint8, min(SEGMENT + LENGTH - 1, len(raw) - base), base)
        if len(seg) < LENGTH:
            continue
        h = _gram_hashes(seg)
        least = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), _WINDOW) & _LOW
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        at = least[first].astype(np.int64)
        parts.append((h[at].view(np.int64), at + base, first + base, last + base))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


class Run:
    """A sorted run of distinct (suffix, left context, range of d), and where each of them stands."""

    def __init__(self) -> None:
        self.items: dict[tuple[bytes, bytes, int], list[tuple[int, int]]] = {}

    def add(self, suffix: bytes, left: bytes, d_low: int, rid: int, at: int) -> int:
        """Bytes that this takes, about."""
        key = (suffix, left, d_low)
        if (places := self.items.get(key)) is None:
            self.items[key] = [(rid, at)]
            return len(suffix) + len(left) + 300
        places.append((rid, at))
        return 100

    def blobs(self) -> tuple[bytes, bytes]:
        """What is merged and the places, which stay behind.

        Front-coded: lengths and common prefixes as arrays, then what is new of each suffix, and left contexts.
        """
        keys = sorted(self.items)
        lcp, tails, before = [], [], b""
        for suffix, _, _ in keys:
            n = _common(before, suffix, 0)
            lcp.append(n)
            tails.append(suffix[n:])
            before = suffix
        places = [self.items[k] for k in keys]
        head = (lcp, [len(t) for t in tails], [len(k[1]) for k in keys], [k[2] for k in keys], [len(p) > 1 for p in places])
        blob = b"".join([struct.pack("<I", len(keys)), *map(bytes, head), *tails, *(k[1] for k in keys)])
        times = np.array([len(p) for p in places], "<u4").tobytes()
        return blob, struct.pack("<I", len(keys)) + times + np.array([x for p in places for x in p], "<i8").tobytes()


class RunReader:
    def __init__(self, number: int, blob: bytes):
        self.number = number
        (n,) = struct.unpack_from("<I", blob)
        self.lcp, tail, left, self.d_low, self.many = np.frombuffer(blob, np.uint8, 5 * n, 4).reshape(5, n)
        cut = [4 + 5 * n, *(np.cumsum(np.concatenate([tail, left]).astype(np.int64)) + 4 + 5 * n).tolist()]
        self.tails = [blob[a:b] for a, b in zip(cut[:n], cut[1 : n + 1])]
        self.lefts = [blob[a:b] for a, b in zip(cut[n:-1], cut[n + 1 :])]

    def suffixes(self) -> Iterator[tuple[int, bytes]]:
        """(common prefix with the one before, suffix) in order."""
        before = b""
        for n, tail in zip(self.lcp.tolist(), self.tails, strict=True):
            before = before[:n] + tail
            yield n, before


def found_places(places: bytes, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row id, first byte and end of what the repeated windows of a run cover; hits are rows (item, least d, greatest d)."""
    (n,) = struct.unpack_from("<I", places)
    times = np.frombuffer(places, "<u4", n, 4).astype(np.int64)
    rid, at = np.frombuffer(places, "<i8", -1, 4 + 4 * n).reshape(-1, 2).T
    item, low, high = hits.T.astype(np.int64)
    k = times[item]
    of = np.repeat(np.arange(len(item)), k)
    place = (np.cumsum(times) - times)[item][of] + np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    return rid[place], at[place] - high[of], at[place] - low[of] + LENGTH


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """Merge sorted runs of (common prefix with the one before, string) by a loser tree: (run, common prefix, string).

    Each contender keeps the length of its common prefix with the last winner; the longer one wins without comparison,
    and equal ones are compared from that length on only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    end: tuple[int, bytes | None] = (-1, None)
    head = [next(r, end) for r in runs] + [end] * (k - len(runs))
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        (la, sa), (lb, sb) = head[a], head[b]
        if sb is None or la > lb:
            return a, b
        if sa is None or lb > la:
            return b, a
        n = _common(sa, sb, la)
        if sa[n:] <= sb[n:]:
            head[b] = (n, sb)
            return a, b
        head[a] = (n, sa)
        return b, a

    # First round: nothing is known to be common with a winner, so contenders start at 0.
    winners = list(range(k))
    for i in range(len(head)):
        if head[i][1] is not None:
            head[i] = (0, head[i][1])
    node = k
    while len(winners) > 1:
        node //= 2
        nxt = []
        for i in range(node):
            w, x = play(winners[2 * i], winners[2 * i + 1])
            loser[node + i] = x
            nxt.append(w)
        winners = nxt
    best = winners[0]
    while head[best][1] is not None:
        n, s = head[best]
        yield best, n, s
        head[best] = next(runs[best], end) if best < len(runs) else end
        i = (best + k) // 2
        while i:
            best, loser[i] = play(best, loser[i])
            i //= 2


def _neighbours(sorted_strings: list[bytes]) -> np.ndarray:
    """Common prefix of each string with the one before it."""
    out = np.zeros(len(sorted_strings), np.int64)
    for i in range(1, len(sorted_strings)):
        out[i] = _common(sorted_strings[i - 1], sorted_strings[i], 0)
    return out


def repeated_windows(runs: list[RunReader], batch: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs, and rows (item of the run, least d, greatest d) with a repeated window, about ``batch`` merged items at a time.

    Equal windows have the same gram at their anchors, so they never stand on both sides of a common prefix below it.
    """
    order: list[tuple[int, int, int]] = []
    seen = [0] * len(runs)
    for r, n, _ in merge_runs([x.suffixes() for x in runs]):
        if n < GRAM and len(order) >= batch:
            yield _repeated(runs, order)
            order = []
        order.append((r, n, seen[r]))
        seen[r] += 1
    if order:
        yield _repeated(runs, order)


def _repeated(runs: list[RunReader], order: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    left = [runs[r].lefts[i][::-1] for r, _, i in order]
    d_low = np.array([runs[r].d_low[i] for r, _, i in order], np.int64)
    many = np.array([runs[r].many[i] for r, _, i in order], bool)
    run, lcp, item = np.array(order, np.int64).T
    lcp = lcp.copy()
    lcp[0] = 0
    d_high = np.array([len(s) for s in left], np.int64)
    by_left = np.array(sorted(range(len(left)), key=left.__getitem__), np.int64)
    left_lcp = _neighbours([left[i] for i in by_left.tolist()])
    low, high = np.full(len(item), LENGTH, np.int64), np.full(len(item), -1, np.int64)
    left_class = np.empty(len(item), np.int64)
    for d in range(int(d_high.max()) + 1):
        on = np.flatnonzero((d_low <= d) & (d <= d_high))
        if not len(on):
            continue
        left_class[by_left] = np.cumsum(left_lcp < d) if d else 0
        both = np.cumsum(lcp < LENGTH - d)[on] * (len(item) + 1) + left_class[on]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        again = many[on]
        again[by[1:][same]] = True
        again[by[:-1][same]] = True
        found = on[again]
        low[found] = np.minimum(low[found], d)
        high[found] = d
    hit = np.flatnonzero(high >= 0)
    return run[hit], np.stack([item[hit], low[hit], high[hit]], axis=1)


def _anchor_rows(text_col: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, text_col):
            rids, grams, times = [], [], []
            for rid, t in zip(batch.column("rid").to_pylist(), texts, strict=True):
                h, n = np.unique(anchors(t.encode())[0], return_counts=True)
                rids.append(np.full(len(h), rid, np.int64))
                grams.append(h)
                times.append(n)
            yield pa.record_batch({"rid": pa.array(np.concatenate(rids)), "gram": pa.array(np.concatenate(grams)), "n": pa.array(np.concatenate(times).astype(np.int64))})

    return find


def _run_maker(text_col: str, slots: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, Run] = {}
        size, number = 0, TaskContext.get().partitionId() << 2 * SENT

        def send() -> pa.RecordBatch:
            """A row for the slot of a run, and one with its places, which goes to any slot and on from there."""
            nonlocal number
            blobs = [r.blobs() for r in runs.values()]
            numbers = list(range(number, number + len(runs)))
            number += 1 << SENT
            none = [None] * len(runs)
            slot = pa.array([*runs, *(x % slots for x in numbers)], pa.int32())
            return pa.record_batch({"slot": slot, "run": pa.array(numbers * 2, pa.int64()), "suffixes": pa.array([*(x for x, _ in blobs), *none], pa.binary()), "places": pa.array([*none, *(x for _, x in blobs)], pa.binary())})

        for batch, texts in portions(batches, text_col):
            for rid, t, cold, hot in zip(batch.column("rid").to_pylist(), texts, batch.column("cold").to_pylist(), batch.column("hot").to_pylist(), strict=True):
                raw = t.encode()
                gram, at, first, last = anchors(raw)
                on = np.isin(gram, np.array(cold, np.int64))
                for g, a, p, q in zip(gram[on].tolist(), at[on].tolist(), first[on].tolist(), last[on].tolist()):
                    size += runs.setdefault(g % slots, Run()).add(raw[a : q + LENGTH], raw[p:a], a - q, rid, a)
                on = np.isin(gram, np.array(hot, np.int64))
                for p, q in zip(first[on].tolist(), last[on].tolist()):
                    for x in range(p, q + 1):
                        window = raw[x : x + LENGTH]
                        size += runs.setdefault(zlib.crc32(window) % slots, Run()).add(window, b"", 0, rid, x)
                    if size > RUN_BYTES:
                        yield send()
                        runs.clear()
                        size = 0
                if size > RUN_BYTES:
                    yield send()
                    runs.clear()
                    size = 0
        if runs:
            yield send()

    return make


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their slot: merge the runs of each and name what is repeated by run; places pass through."""

    def merged(runs: list[RunReader]) -> Iterator[pa.RecordBatch]:
        for run, hits in repeated_windows(runs):
            by = np.argsort(run, kind="stable")
            run, hits = run[by], hits[by].astype("<i4")
            cut = np.flatnonzero(np.diff(run, prepend=-1))
            blobs = [hits[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(run)])]
            yield pa.record_batch({"run": pa.array([runs[r].number for r in run[cut].tolist()], pa.int64()), "hits": pa.array(blobs, pa.binary()), "places": pa.nulls(len(blobs), pa.binary())})

    slot, runs = None, []
    for batch in batches:
        kept = batch.filter(batch.column("places").is_valid())
        yield pa.record_batch({"run": kept.column("run"), "hits": pa.nulls(kept.num_rows, pa.binary()), "places": kept.column("places")})
        for s, number, blob in zip(batch.column("slot").to_pylist(), batch.column("run").to_pylist(), batch.column("suffixes").to_pylist(), strict=True):
            if s != slot and runs:
                yield from merged(runs)
                runs = []
            slot = s
            if blob is not None:
                runs.append(RunReader(number, blob))
    if runs:
        yield from merged(runs)


def covered(rid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Rows ``rid, spans``: one for each row id, with the union of its spans in order."""
    by = np.lexsort((start, rid))
    rid, start, stop = rid[by], start[by], stop[by]
    first = np.diff(rid, prepend=-1) != 0
    base = np.cumsum(first) * (stop.max() + 1)  # above all that ends in the row ids before
    reach = np.maximum.accumulate(base + stop)
    new = np.concatenate([[True], base[1:] + start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    ends = (reach - base)[np.concatenate([at[1:], [len(rid)]]) - 1]
    lists = np.concatenate([np.flatnonzero(first[at]), [len(at)]]).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(ends)], ["start", "stop"])
    return pa.record_batch({"rid": pa.array(rid[first]), "spans": pa.ListArray.from_arrays(pa.array(lists), spans)})


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their part and run: from places and hits of the runs of a part to what is covered of each row."""
    run, part, places, hits, found = None, None, None, [], []

    def locate() -> None:
        if places is not None and hits:
            found.append(found_places(places, np.frombuffer(b"".join(hits), "<i4").reshape(-1, 3)))

    def located() -> Iterator[pa.RecordBatch]:
        if found:
            yield covered(*(np.concatenate(x) for x in zip(*found, strict=True)))
            found.clear()

    for batch in batches:
        for k, r, h, p in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist(), batch.column("hits").to_pylist(), batch.column("places").to_pylist(), strict=True):
            if r != run:
                locate()
                run, places, hits = r, None, []
            if k != part:
                yield from located()
                part = k
            if h is None:
                places = p
            else:
                hits.append(h)
    locate()
    yield from located()


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, text_col: str = "text", out_col: str = "spans", stored: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` and ``out_col array<struct<start long, stop long>>``, the byte runs to remove.

    A column that has the name of ``out_col`` already is replaced.

    A byte is in a run if a string of 200 bytes that covers it starts at two places or more, in one text or in several.
    Strings never go over the end of a text. NULL, empty and shorter texts have no spans; NULL stays NULL.

    Spans find their rows by numbers, which must be the same each time the rows are read. The numbered rows are therefore
    written to the shared folder, unless ``stored`` says that ``docs`` is read from files as it is: then a task that is run
    again numbers its part of a file as before.
    """
    spark = docs.sparkSession
    docs = bounded(docs).drop(out_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One exchange of the rows, used three times: each use takes all columns, or pruning would make them differ.
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = names[text_col]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *(F.col(f"`{c}`").alias(x) for c, x in names.items()))
    rows = (rows if stored else materialize(rows, "numbered")).repartition(n, "rid")
    grams = rows.mapInArrow(_anchor_rows(text), "rid long, gram long, n long")
    counts = grams.groupBy("gram").agg(F.sum("n").alias("total")).where("total > 1").select("gram", (F.col("total") > HOT_GRAM).alias("is_hot"))
    repeated = grams.join(counts, "gram").groupBy("rid").agg(F.collect_list(F.when(~F.col("is_hot"), F.col("gram"))).alias("cold"), F.collect_list(F.when(F.col("is_hot"), F.col("gram"))).alias("hot"))
    # In order of the row ids, so that a task that is run again makes the same runs with the same numbers.
    marked = rows.join(repeated.hint("shuffle_hash"), "rid").sortWithinPartitions("rid")
    runs = marked.mapInArrow(_run_maker(text, n * SLOTS), "slot int, run long, suffixes binary, places binary")
    merged = runs.repartition(n, "slot").sortWithinPartitions("slot").mapInArrow(_merge, "run long, hits binary, places binary")
    part = F.shiftright("run", SENT) * PARTS + F.col("run") % PARTS
    found = merged.withColumn("part", part).repartition(n, "part").sortWithinPartitions("part", "run").mapInArrow(_locate, "rid long, spans array<struct<start:bigint,stop:bigint>>")
    spans = found.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return rows.join(spans.hint("shuffle_hash"), "rid", "left").select(*(F.col(x).alias(c) for c, x in names.items()), F.coalesce("spans", none).alias(out_col))


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """Rows ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: one for every row; ``stored`` as in ``repeated_spans``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            rows = []
            for t, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
                raw = t.encode()
                gone = _union([(s["start"], s["stop"]) for s in spans])
                kept = hashlib.sha256(_without(raw, gone)).hexdigest()
                rows.append((len(raw), sum(b - a for a, b in gone), len(gone), kept))
            a, b, c, d = zip(*rows, strict=True)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(a, pa.int64()), "n_removed": pa.array(b, pa.int64()), "n_spans": pa.array(c, pa.int64()), "kept_sha256": pa.array(d)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return repeated_spans(rows, stored=stored).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text_col: str = "text", stored: bool = False) -> DataFrame:
    """All rows and columns with repeated strings cut out of the text; a character that is cut through goes too.

    NULL texts stay NULL. Repeated rows stay rows; what they repeat of each other is cut like any other repetition. Columns of
    any names stay as they are, and an empty table gives an empty one. ``stored`` as in ``repeated_spans``.
    """
    schema, at = docs.schema, docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, text_col):
            new = []
            null = batch.column(at).is_null().to_pylist()
            for t, z, spans in zip(texts, null, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                gone = _union([(s["start"], s["stop"]) for s in spans])
                new.append(None if z else _without(t.encode(), gone).decode(errors="ignore") if gone else t)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])

    return repeated_spans(docs, text_col, spare(docs, "_repeated_spans"), stored).mapInArrow(cut, schema)


def _without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    if not gone:
        return raw
    out, at = [], 0
    for a, b in gone:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes over all ``documents``."""
    return dedup_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
