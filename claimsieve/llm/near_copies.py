"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash first: fingerprints, tables and bit-sliced comparison of operator 2, within 3 bits. Fingerprints of
many similar pairs differ in about 10 of 64 bits and some in twice as many, a radius that no tables of bit blocks can select by.
So what SimHash has not linked is completed by MinHash: 40 keys of six least hashes each, of which a pair at 0.8 shares none
once in 200,000 times, and a closer pair more rarely. Each link is decided on the sets of shingle hashes (64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import bounded, portions
from claimsieve.llm.simhash import close_pairs_forest, fingerprint
from claimsieve.plans.components import connected_components
from claimsieve.plans.storage import materialize

WORDS = 5
#: Similarity as a fraction, for exact comparison.
LEAST = (4, 5)
BANDS, ROWS = 40, 6
#: Members of a key that all others of it are compared with first.
LEADERS = 2
#: Members of a key above which it is worth counting what each has of its own.
CROWD = 16
#: Bits of the bitmap of candidates.
SLOTS = 1 << 24
_RNG = np.random.default_rng(42)
_PLACE = _RNG.integers(0, 2**64, WORDS, np.uint64) | np.uint64(1)
_TIMES = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_FOLD = _RNG.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(w: list[bytes]) -> np.ndarray:
    """The distinct hashes, in order, of the runs of five words; of all words if there are fewer."""
    digest = xxhash.xxh64_intdigest
    if len(w) < WORDS:
        return np.array([digest(b" ".join(w), 42)] if w else [], np.uint64)
    of = np.array([digest(x, 42) for x in w], np.uint64)
    n = len(w) - WORDS + 1
    return np.unique(_mix(sum(of[i : i + n] * _PLACE[i] for i in range(WORDS))))


def band_keys(s: np.ndarray) -> np.ndarray:
    """Forty keys; sets share each with the sixth power of their similarity as probability."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(s), 512):
        np.minimum(least, (s[a : a + 512] * _TIMES).min(axis=1), out=least)
    folded = (_mix(least).reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return _mix(folded + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in portions(batches, "text"):
        same, fp, n, keys = [], [], [], []
        for t in texts:
            w = t.encode().lower().split()
            s = shingles(w)
            same.append(xxhash.xxh64_intdigest(b" ".join(w), 7))
            fp.append(fingerprint(t))
            n.append(len(s))
            keys.append(band_keys(s) if len(s) else np.empty(0, np.int64))
        of = lambda hashes: pa.array(np.array(hashes, np.uint64).view(np.int64))
        yield pa.record_batch({"id": batch.column("id"), "same": of(same), "fp": of(fp), "n": pa.array(n, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})


def _sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows ``id, shingles`` of these ids, and of few others: a bitmap of fixed size selects rows before they are hashed."""
    slot = F.xxhash64("id").bitwiseAND(F.lit(SLOTS - 1))
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 AS int))")).alias("bits")).toArrow()
    bitmap = np.zeros(SLOTS // 32, np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap.astype(np.uint32))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("slot").to_numpy()
            on = (bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)
            for part, texts in portions([batch.filter(pa.array(on.astype(bool)))], "text"):
                sets = [shingles(t.encode().lower().split()).tobytes() for t in texts]
                yield pa.record_batch({"id": part.column("id"), "shingles": pa.array(sets, pa.binary())})

    return materialize(rows.withColumn("slot", slot).mapInArrow(compute, "id long, shingles binary"), "shingles")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        on = [similar(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that are similar enough."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return materialize(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_check, "a long, b long"), "near-links")


def _may_link(n: str, u: str, m: str, v: str):
    """Sets of such sizes can be similar enough; of two of the crowd, ``u`` and ``v`` hashes are in no other set of it."""
    crowd = F.col(u).isNotNull() & F.col(v).isNotNull()
    both = F.least(F.col(n) - F.when(crowd, F.col(u)).otherwise(0), F.col(m) - F.when(crowd, F.col(v)).otherwise(0))
    return both * LEAST[1] >= (F.col(n) + F.col(m) - both) * LEAST[0]


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
        if sets:
            yield pa.record_batch({"id": pa.array(np.repeat(batch.column("id").to_numpy(), [len(x) for x in sets])), "shingle": pa.array(np.concatenate(sets))})


def _shingle_rows(ids: DataFrame, sets: DataFrame) -> DataFrame:
    return sets.join(ids, "id", "left_semi").mapInArrow(_each_shingle, "id long, shingle long")


def _own_shingles(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows ``id, u`` of the crowd, members of keys with very many: how many hashes are in no other set of it."""
    crowd = met.where(F.col("count") > CROWD).select("id").distinct()
    every = _shingle_rows(crowd, sets)
    once = every.groupBy("shingle").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c")).where("c = 1")
    return crowd.join(once.groupBy("id").agg(F.count(F.lit(1)).alias("u")), "id", "left").select("id", F.coalesce("u", F.lit(0)).alias("u"))


def _crowd_pairs(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``crowd`` (id, c, is_rest), one of the rest and in two parts, that can be similar enough.

    Hashes of each set are put in one order, the rarest first. The first hash that two similar sets share stands so early in
    both that what comes after it can still be enough; so sets meet by their rarest hashes, and where they meet tells most
    pairs of one text with different edits apart without a look at the sets.
    """
    every = materialize(_shingle_rows(crowd.select("id"), sets), "crowd-shingles")
    often = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ordered = every.join(often, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("own")).withColumn("n", F.size("own"))
    early = F.col("n") - F.ceil(F.col("n") * LEAST[0] / LEAST[1]).cast("int") + 1
    rows = materialize(ordered.join(crowd, "id").select("id", "c", "is_rest", "n", F.posexplode(F.slice("own", 1, early)).alias("at", "x")).select("id", "c", "is_rest", "n", "at", "x.shingle"), "crowd-prefixes")
    other = rows.select("shingle", F.col("id").alias("o"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("at").alias("to"))
    left = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to"))
    enough = left * LEAST[1] >= (F.col("n") + F.col("m") - left) * LEAST[0]
    return rows.where("is_rest").join(other, "shingle").where((F.col("c") != F.col("d")) & enough).select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()


def _simhash_pairs(own: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``own`` (id, fp, n) that connect all texts with words whose fingerprints differ in at most 3 bits."""
    own = own.where("n > 0").select("id", "fp")
    heads = materialize(own.groupBy("fp").agg(F.min("id").alias("head")), "distinct-fingerprints")
    same = own.join(heads, "fp").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    x, y = (heads.select(F.col("fp").alias(end), F.col("head").alias(to)) for end, to in (("src", "x"), ("dst", "y")))
    close = close_pairs_forest(heads.select("fp")).join(x, "src").join(y, "dst").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return materialize(same.unionByName(close), "simhash-pairs")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, component_id`` of every row (ids are distinct): the smallest id linked over any path of near copies.

    Texts of the same words are one from the start; texts without words, NULL among them, are all the same. Those of close
    fingerprints are linked next. In each key of MinHash all that are not yet linked to them are compared with a few leaders, then what is not yet linked to most of its key with all of the key, in keys of very many
    by their rarest hashes. So pairs are left out only where both are linked already or cannot be similar: many copies of one
    text, and many texts that are one with different edits, do not give the square of them.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_rows = materialize(rows.mapInArrow(_sketch, "id long, same long, fp long, n long, keys array<long>"), "sketches")
    texts = materialize(all_rows.groupBy("same").agg(F.min("id").alias("id")), "distinct-texts")
    own = all_rows.join(texts.select("id"), "id", "left_semi")
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = own.select("id", "n", F.explode("keys").alias("key")).repartition(count, "key")  # one exchange for both uses
    met = materialize(keyed.join(keyed.groupBy("key").count().where("count > 1"), "key").select("key", "id", "n", "count"), "met-keys")
    close = _simhash_pairs(own)
    sets = _sets(rows, met.select("id").unionByName(close.select(F.explode(F.array("a", "b")).alias("id"))))
    of_simhash = _links(close, sets)
    linked = materialize(connected_components(of_simhash, "a", "b").withColumnRenamed("node", "id"), "components")
    met = met.join(_own_shingles(met, sets), "id", "left").join(linked, "id", "left")
    met = materialize(met.select("key", "id", "n", "count", "u", F.coalesce("component", "id").alias("c")), "sized-keys")
    # Leaders have few hashes of their own: of copies of one text with edits, those with the fewest.
    leaders = F.array_distinct(F.array(*(F.min_by(F.struct("id", "n", "u", "c"), F.struct(F.coalesce("u", F.lit(0)) / F.col("n"), F.xxhash64("id", F.lit(s)))) for s in range(LEADERS))))
    heads = met.groupBy("key").agg(leaders.alias("leaders"))
    first = met.join(heads, "key").select("id", "n", "u", "c", F.explode("leaders").alias("o")).select("id", "n", "u", "c", F.col("o.id").alias("o"), F.col("o.n").alias("m"), F.col("o.u").alias("v"), F.col("o.c").alias("d"))
    pairs = first.where("c <> d").where(_may_link("n", "u", "m", "v")).select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
    links = of_simhash.unionByName(_links(pairs, sets))
    found = materialize(connected_components(links, "a", "b"), "components")
    now = met.drop("c").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "u", "count", F.coalesce("component", "id").alias("c"))
    now = materialize(now, "linked-keys")
    parts = now.groupBy("key", "c").agg(F.count(F.lit(1)).alias("count"))
    most = parts.groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    open_keys = materialize(now.join(most, "key"), "open-keys")
    few = open_keys.where(F.col("count") <= CROWD)
    other = few.select("key", F.col("id").alias("o"), F.col("n").alias("m"), F.col("u").alias("v"), F.col("c").alias("d"))
    across = few.where("c <> most").drop("most").join(other, "key").where("c <> d").where(_may_link("n", "u", "m", "v")).select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
    crowd = materialize(open_keys.where(F.col("count") > CROWD).groupBy("id", "c").agg(F.max(F.col("c") != F.col("most")).alias("is_rest")), "crowd")
    more = [_links(across, sets)]
    if not crowd.isEmpty():
        more.append(_links(_crowd_pairs(crowd, sets), sets))
    if any(not x.isEmpty() for x in more):
        found = connected_components(reduce(lambda x, y: x.unionByName(y), more, links), "a", "b")
    linked = found.withColumnRenamed("node", "id")
    of = texts.join(linked, "id", "left").select("same", F.coalesce("component", "id").alias("component_id"))
    return all_rows.select(F.col("id").alias("doc_id"), "same").join(of, "same").select("doc_id", "component_id")
