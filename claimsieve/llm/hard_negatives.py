"""Hard negatives by inner product: candidate lists shared by clusters of anchors, walked until certified.

Vectors become integers, so scores are exact. Candidates are dealt to shards by the nearest of a few directions. In a shard, the
anchors of a cluster share one list: candidates sorted by an upper bound of what they can score with any unit vector as far from
the cluster's centre as its farthest member, ``|x| cos(max(0, angle(x, centre) - spread))``. Every member walks the list in
blocks and stops once the next bound, times its own length, is below all that it still looks for. Whole shards are left out by
the same bound. The first walk finds positives, the second negatives in each positive's range of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from claimsieve.llm.common import bounded, give_back
from claimsieve.llm.vectors import matrix
from claimsieve.plans.storage import materialize

#: Candidates of a shard; anchors that walk together; candidates of a block of the list.
SHARD, TOGETHER, BLOCK = 16384, 1024, 512
#: Directions at most, and anchors that they are fitted on at most. They decide how much work is saved, not what is found.
CLUSTERS, FITTED = 128, 4096
_NONE = np.iinfo(np.int64).min
_TOP = np.iinfo(np.int64).max
_EXACT = 2.0**53


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component; Python integers where 256 x is beyond doubles."""
    with np.errstate(over="ignore"):
        got = np.floor(v * 256)
    if np.isfinite(got).all():
        return got
    return np.array([[floor(x * 256) if isfinite(x * 256) else int(x) * 256 for x in row] for row in v.tolist()], object).reshape(v.shape)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact; those that no long can hold are the largest or smallest long but one."""
    plain = q.dtype != object and x.dtype != object
    if plain and (not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT):
        return (q @ x.T).astype(np.int64)
    exact = [[[int(c) for c in row] for row in m.tolist()] for m in (q, x)]
    return np.array([[min(max(sum(a * b for a, b in zip(r, s, strict=True)), _NONE + 1), _TOP) for s in exact[1]] for r in exact[0]], np.int64).reshape(len(q), len(x))


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (zero for a zero vector) and lengths; lengths beyond 1e150 count as infinite, which ends no walk."""
    if v.dtype == object:
        tops = [max(map(abs, r), default=0) for r in v.tolist()]
        part = np.array([[c / (t or 1) for c in r] for r, t in zip(v.tolist(), tops, strict=True)], float).reshape(v.shape)
        top = np.array([float(min(t, 10**300)) for t in tops])
    else:
        top = np.abs(v).max(axis=1, initial=0)
        part = v / np.where(top > 0, top, 1)[:, None]
    size = np.sqrt((part**2).sum(axis=1))
    return part / np.where(size > 0, size, 1)[:, None], np.where(top > 1e150, np.inf, size * np.minimum(top, 1e150))


def _reach(a: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """What lengths times bounds can come to, a little more against rounding; infinite where either is."""
    with np.errstate(invalid="ignore", over="ignore"):
        got = a * bound
    got = np.where(np.isinf(a) | np.isinf(bound) | np.isnan(got), np.inf, got)
    return np.maximum(got + np.where(np.isinf(got), 0, np.abs(got)) * 1e-9 + 1e-6, float(_NONE))


def fit_directions(sample: np.ndarray, seed: int = 1) -> np.ndarray:
    """Centres of a few rounds of spherical k-means."""
    u = np.unique(_units(whole_numbers(sample))[0].astype(float), axis=0) if len(sample) else sample
    u = u[(u != 0).any(axis=1)]
    k = min(CLUSTERS, int(len(u) ** 0.5))
    if k < 1:
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    centres = u[np.random.default_rng(seed).choice(len(u), k, replace=False)]
    for _ in range(8):
        near = (u @ centres.T).argmax(axis=1)
        for c in range(k):
            total = u[near == c].sum(axis=0)
            if (size := np.sqrt((total**2).sum())) > 0:
                centres[c] = total / size
    return centres


class Best:
    """The k best candidates of each row: largest score first, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _NONE, np.int64)
        self.id = np.full((n, k), _TOP, np.int64)

    def add(self, rows: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of ``rows``; a score of ``_NONE`` is none."""
        new = ((s >= self.score[rows, -1:]) & (s != _NONE)).any(axis=1)
        rows, s = rows[new], s[new]
        if len(rows):
            all_s = np.concatenate([self.score[rows], s], axis=1)
            all_i = np.concatenate([self.id[rows], np.broadcast_to(ids, s.shape)], axis=1)
            by = np.lexsort((all_i, np.invert(all_s)), axis=1)[:, : self.k]  # invert turns the order, of the smallest long too
            self.score[rows] = np.take_along_axis(all_s, by, axis=1)
            self.id[rows] = np.take_along_axis(all_i, by, axis=1)


class Shard:
    """Candidates of one shard: ids, labels, vectors as integers, directions and lengths."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, whole_numbers(v)
        self.unit, self.length = _units(self.x)

    def walk(self, anchors: Shard, k: int, caps: np.ndarray | None) -> list[Best]:
        """Positives of the anchors of a cluster, or for ``caps`` (a row of positive scores for each) negatives for each cap."""
        n = len(anchors.ids)
        centre = anchors.unit.sum(axis=0)
        size = np.sqrt((centre**2).sum())
        cosine = anchors.unit @ (centre / size) if size > 0 and (anchors.length > 0).all() else np.full(n, -1.0)
        spread = np.arccos(np.clip(cosine.min(initial=1), -1, 1))
        angle = np.arccos(np.clip(self.unit @ (centre / size if size > 0 else centre), -1, 1))
        with np.errstate(invalid="ignore"):
            bound = np.where(np.isinf(self.length), np.inf, self.length * np.cos(np.maximum(0, angle - spread - 1e-7)))
        order = np.argsort(-bound, kind="stable")
        found = [Best(n, k) for _ in range(1 if caps is None else caps.shape[1])]
        # The least score that a cap accepts: no less than four fifths of it, rounded up. Negative caps accept none.
        floors = None if caps is None else -((-4 * caps.astype(object)) // 5)
        floors = None if caps is None else np.where(caps >= 0, floors, _TOP).astype(np.int64)
        active = np.arange(n)
        for at in range(0, len(order), BLOCK):
            reach = _reach(anchors.length[active], bound[order[at]])
            if caps is None:
                kth = found[0].score[active, -1]
                needs = np.where(kth == _NONE, -np.inf, kth.astype(float))
            else:
                needs = np.min([np.where(caps[active, p] >= 0, np.maximum(found[p].score[active, -1], floors[active, p]).astype(float), np.inf) for p in range(len(found))], axis=0)
            active = active[reach >= needs]
            if not len(active):
                break
            block = order[at : at + BLOCK]
            s = scores(anchors.x[active], self.x[block])
            same = anchors.labels[active][:, None] == self.labels[block]
            if caps is None:
                fits = same & (anchors.ids[active][:, None] != self.ids[block])
                found[0].add(active, np.where(fits, s, _NONE), self.ids[block])
            else:
                for p, best in enumerate(found):
                    fits = ~same & (s <= caps[active, p, None]) & (s >= floors[active, p, None])
                    best.add(active, np.where(fits, s, _NONE), self.ids[block])
        return found


def labelled_vectors(df: DataFrame) -> DataFrame:
    """Rows ``vec_id, label, v`` that take part: not those with a NULL id, label, vector or component, or a non-finite one.

    Zero vectors take part. Of vectors of several lengths, those of the most frequent length (the longer, if two are equal) do.
    """
    kind = df.schema["embedding"].dataType.elementType
    v = F.col("embedding") if isinstance(kind, FloatType) else F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0").where(F.coalesce(fine, F.lit(False)))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == most[0]["n"]) if most else rows


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """With the nearest direction, the cosine to it, the length, and a number that deals rows of a cell evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = 0
        for batch in give_back(batches):
            if batch.num_rows:
                unit, length = _units(whole_numbers(matrix(batch.column("v"))))
                near = unit @ centres.T
                cell = near.argmax(axis=1)
                new = {"cell": pa.array(cell, pa.int32()), "cosine": pa.array(near.max(axis=1)), "length": pa.array(length), "deal": pa.array(np.arange(dealt, dealt + batch.num_rows))}
                dealt += batch.num_rows
                yield pa.record_batch({c: batch.column(c) for c in ("vec_id", "label", "v")} | new)

    kind = rows.schema["v"].dataType.simpleString()
    return bounded(rows).mapInArrow(run, f"vec_id long, label long, v {kind}, cell int, cosine double, length double, deal long")


def _walks(candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Rows ``anchor_id, slot, vec_id, score``: what each anchor finds in each shard that it is sent to.

    ``asked(vec_id, label, v, cell, caps, shards)`` goes once to each of its shards, candidates to theirs; a task keeps the
    candidates of one shard, and anchors stream past it by cluster. NULL ``caps`` ask for positives.
    """
    left = candidates.select("shard", F.lit(0).alias("kind"), "cell", "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("caps"))
    right = asked.select(F.explode("shards").alias("shard"), F.lit(1).alias("kind"), "cell", "vec_id", "label", "v", "caps")
    both = left.unionByName(right).repartition("shard").sortWithinPartitions("shard", "kind", "cell", "vec_id")

    def found(shard: Shard, anchors: pa.Table) -> Iterator[pa.RecordBatch]:
        caps = anchors["caps"].to_pylist()
        slots = len(caps[0]) if caps[0] is not None else None
        q = Shard(anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["v"].combine_chunks()))
        for slot, best in enumerate(shard.walk(q, k, None if slots is None else np.array(caps, np.int64))):
            on = best.score != _NONE
            yield pa.record_batch({"anchor_id": pa.array(np.repeat(q.ids, k).reshape(-1, k)[on]), "slot": pa.array(np.full(on.sum(), slot, np.int32)), "vec_id": pa.array(best.id[on]), "score": pa.array(best.score[on])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, at = None, None
        for batch in give_back(batches):
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind", "cell")], axis=1).astype(np.int64)
            key[key[:, 1] == 0, 2] = 0
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if key[a, 0] != at:
                    held, shard, at = [], None, key[a, 0]
                if key[a, 1] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if shard is None and held:
                    t = pa.Table.from_batches(held)
                    shard, held = Shard(t["vec_id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"].combine_chunks())), []
                for c in range(a, b, TOGETHER) if shard is not None else ():
                    yield from found(shard, pa.Table.from_batches([batch.slice(c, min(TOGETHER, b - c))]))

    return bounded(both).mapInArrow(run, "anchor_id long, slot int, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 5) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors(vec_id, label, v)`` are the candidates, and those that the SQL condition ``anchors`` selects are anchors (of
    several rows with one id, the smallest label and vector). An anchor's positives are its best rows of its label and another
    id; negatives have another label and at least 0.8 and at most all of the positive's score. Rows of one id are candidates of
    their own and may repeat in a result. Components become floor(256 x); scores that no long holds end at its limits.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    chosen = vectors.where(anchors)
    sample = chosen.orderBy(F.xxhash64("vec_id")).limit(FITTED).select("v").collect()
    centres = fit_directions(np.array([r.v for r in sample], np.float64)) if sample else np.zeros((1, 1))
    if not sample:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    placed = materialize(_placed(vectors, centres), "candidates")
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("cosine"), F.max("length").alias("length")).collect()}  # one row a direction
    first, shares, total = [0] * len(centres), [1] * len(centres), 0
    for c, r in sorted(cells.items()):
        first[c], shares[c] = total, -(-r.n // SHARD)
        total += shares[c]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    candidates = placed.withColumn("shard", (of(first) + F.pmod(F.xxhash64("deal"), of(shares))).cast("int"))
    asked = placed.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v", "cell")).alias("s")).select("vec_id", "s.*")
    asked = materialize(asked, "anchors")
    own, extent = sorted(cells), np.array([[cells[c].cosine, cells[c].length] for c in sorted(cells)])
    radius = np.arccos(np.clip(extent[:, 0], -1, 1))

    def reached(rows: DataFrame) -> DataFrame:
        """With the shards that may hold a score of ``least`` or more."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit, length = _units(whole_numbers(matrix(batch.column("v"))))
                angle = np.arccos(np.clip(unit @ centres[own].T, -1, 1))
                angle[length == 0] = 0
                with np.errstate(invalid="ignore"):
                    cell = np.where(np.isinf(extent[:, 1]), np.inf, extent[:, 1] * np.cos(np.maximum(0, angle - radius - 1e-7)))
                bound = _reach(length[:, None], cell)
                least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)
                least = np.where(least <= float(_NONE), -np.inf, least)
                on = bound >= least[:, None]
                lists = [[s for c, go in zip(own, row, strict=True) if go for s in range(first[c], first[c] + shares[c])] for row in on]
                yield pa.record_batch({c: batch.column(c) for c in batch.schema.names} | {"shards": pa.array(lists, pa.list_(pa.int32()))})

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return bounded(rows).mapInArrow(run, f"{kinds}, shards array<int>")

    none = F.lit(None).cast("array<long>").alias("caps")
    # At home first: the k-th best there is a least score for the walk through all shards.
    home = asked.select("*", none, F.array(of(first).cast("int")).alias("shards"))
    least = _walks(candidates, home, positives).groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).select(F.col("anchor_id").alias("vec_id"), F.when(F.col("n") >= positives, F.col("s")).alias("s"))
    begun = asked.join(least, "vec_id", "left").select("vec_id", "label", "v", "cell", none, F.coalesce("s", F.lit(int(_NONE))).alias("least"))
    near = _top(_walks(candidates, reached(begun), positives), positives)
    near = materialize(near.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    scored = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # a few a row
    fill = lambda i: F.coalesce(F.get("p", F.lit(i))["positive_score"], F.lit(-1))  # noqa: E731  (a negative score accepts none)
    caps = scored.select(F.col("anchor_id").alias("vec_id"), F.array(*(fill(i) for i in range(positives))).alias("caps"))
    lowest = F.array_min(F.transform(F.filter("caps", lambda c: c >= 0), lambda c: c.cast("double") * 0.8))
    hunt = asked.join(caps, "vec_id").select("vec_id", "label", "v", "cell", "caps", lowest.alias("least")).where("least is not null")
    hard = _top(_walks(candidates, reached(hunt), negatives), negatives)
    hard = hard.select("anchor_id", (F.col("slot") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(hard, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector of ``embeddings``, with one label in seven moved on."""
    vectors = labelled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(vectors, "vec_id % 100 = 0")


OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
