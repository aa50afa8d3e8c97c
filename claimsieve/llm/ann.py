"""Nearest neighbours by inner product: vantage-point trees per shard.

A triangle inequality needs a metric, so a vector x becomes (x, sqrt(M² - |x|²)) with M the largest norm of its shard, and
a query (q, 0): then the squared distance is |q|² + M² - 2 q·x, and the nearest vectors are those of largest inner product.
A subtree is left out if it lies further than the best k so far by the triangle inequality, times a factor: one restores
exact search, more prunes more. Shards are trees of bounded size, so a search task needs one tree and one block of queries.

Distances are taken of vectors times a power of two, one for a shard and one for a query, so that no square overflows or
vanishes; scores are those of the vectors as they are. A score that overflows is infinite and ranks so, with ties to smaller
ids; one of which parts overflow both ways is no number and ranks like minus infinity.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimsieve.llm.vectors import matrix, valid_vectors
from claimsieve.plans.storage import materialize

SHARD = 8192
LEAF = 128
QUERY_BLOCK = 1024


def build_tree(ids: np.ndarray, x: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Arrays of a tree: rows in leaf order and, per node, vantage row, radius, children (-1: a leaf) and rows."""
    exponent = int(np.frexp(np.abs(x).max())[1])
    near = np.ldexp(x, -exponent)
    norm2 = (near * near).sum(axis=1)
    top = norm2.max()
    lifted = np.concatenate([near, np.sqrt(np.maximum(top - norm2, 0))[:, None]], axis=1)
    rng = np.random.default_rng(seed)
    order: list[int] = []
    nodes: list[list[float]] = []  # vantage row, radius, inside, outside, first, end

    def build(rows: np.ndarray) -> int:
        me = len(nodes)
        nodes.append([int(rows[0]), 0.0, -1, -1, len(order), 0])
        if len(rows) > LEAF:
            v = int(rows[rng.integers(len(rows))])
            dist = np.sqrt(np.maximum(((lifted[rows] - lifted[v]) ** 2).sum(axis=1), 0))
            mid = np.median(dist)
            inside = dist <= mid
            if inside.any() and not inside.all():
                nodes[me][0], nodes[me][1] = v, float(mid)
                nodes[me][2] = build(rows[inside])
                nodes[me][3] = build(rows[~inside])
                nodes[me][5] = len(order)
                return me
        order.extend(rows.tolist())
        nodes[me][5] = len(order)
        return me

    build(np.arange(len(ids)))
    t = np.array(nodes)
    keep = np.array(order)
    return {"ids": ids[keep], "x": x[keep], "vantage": lifted[t[:, 0].astype(int)], "radius": t[:, 1], "child": t[:, 2:4].astype(np.int64), "span": t[:, 4:6].astype(np.int64), "top": np.array([top]), "exponent": np.array([exponent])}


def search_tree(tree: dict[str, np.ndarray], q_ids: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and inner products of the k best candidates of each query, its own id left out; ties to smaller ids."""
    n, none = len(q), np.iinfo(np.int64).max
    best_id = np.full((n, k), none, np.int64)
    best = np.full((n, k), -np.inf)
    exponent = np.frexp(np.abs(q).max(axis=1))[1].astype(np.int64) if n else np.zeros(0, np.int64)
    near_q = np.ldexp(q, -exponent[:, None])
    lifted = np.concatenate([near_q, np.zeros((n, 1))], axis=1)
    q2 = (near_q * near_q).sum(axis=1)
    top = tree["top"][0]
    slack = 1e-9 * (np.sqrt(q2) + np.sqrt(top) + 1)
    largest, both = np.finfo(float).max, exponent + int(tree["exponent"][0])
    # What products lose that are too small for a double, in the units of the distances.
    lost = np.ldexp(float(q.shape[1]), np.clip(-1074 - both, -2000, 2000).astype(int))

    def reach(rows: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far, a little more against rounding, so that ties are not lost."""
        kth = np.ldexp(np.clip(best[rows, -1], -largest, largest), -both[rows]) - lost[rows]
        return np.where(best_id[rows, -1] == none, np.inf, np.sqrt(np.maximum(q2[rows] + top - 2 * kth, 0))) + slack[rows]

    def rank(s: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(s), -np.inf, s)

    def leaf(node: int, rows: np.ndarray) -> None:
        a, b = tree["span"][node]
        x, ids = tree["x"][a:b], tree["ids"][a:b]
        for c in range(0, len(rows), 64):
            part = rows[c : c + 64]
            s = (q[part][:, None, :] * x[None]).sum(axis=2)  # the same sum for equal vectors wherever they stand
            own = ids[None] == q_ids[part][:, None]
            all_s = np.concatenate([best[part], np.where(own, -np.inf, s)], axis=1)
            all_i = np.concatenate([best_id[part], np.where(own, none, np.broadcast_to(ids, s.shape))], axis=1)
            by = np.lexsort((all_i, -rank(all_s)), axis=1)[:, :k]
            best[part] = np.take_along_axis(all_s, by, axis=1)
            best_id[part] = np.take_along_axis(all_i, by, axis=1)

    def visit(node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        inside, outside = tree["child"][node]
        if inside < 0:
            leaf(node, rows)
            return
        d = np.sqrt(((lifted[rows] - tree["vantage"][node]) ** 2).sum(axis=1))
        near = d <= tree["radius"][node]
        visit(inside, rows[near])
        visit(outside, rows[~near])
        # How far the other side is at least.
        gap = np.abs(d - tree["radius"][node]) * factor
        again = gap <= reach(rows)
        visit(outside, rows[near & again])
        visit(inside, rows[~near & again])

    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        visit(0, np.arange(n))
    return np.where(best_id == none, -1, best_id), best


def _pack(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def build_index(vectors: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """Rows ``shard, tree``: every valid vector (``valid_vectors``) is in one tree of about ``shard_size``."""
    n = vectors.count()
    shards = max(1, -(-n // shard_size))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        tree = build_tree(t["vec_id"].to_numpy(), matrix(t["embedding"].combine_chunks()))
        return pa.table({"shard": t["shard"][:1], "tree": pa.array([_pack(**tree)], pa.binary())})

    return dealt.groupBy("shard").applyInArrow(build, "shard int, tree binary")


def search(index: DataFrame, queries: DataFrame, k: int, factor: float = 1.0) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the k best of each query over all shards, best first, ties to smaller ids.

    ``index`` is a written table. Queries go in blocks to each shard. Rows of one id are one query, with the k best of all of
    them, and each is a candidate of its own; rows with a NULL id must be left out before. Other columns are ignored.
    """
    shards = index.count()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def block(t: pa.Table) -> pa.Table:
        blob = _pack(ids=t["vec_id"].to_numpy(), q=matrix(t["embedding"].combine_chunks()))
        return pa.table({"block": t["block"][:1], "queries": pa.array([blob], pa.binary())})

    blobs = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(block, "block int, queries binary")
    # Each tree meets each block in one exchange by both numbers, which a task that is run again deals in the same way.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    met = blobs.select("block", "queries", every(shards).alias("shard")).join(index.select("shard", "tree", every(blocks).alias("block")), ["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, tree in zip(batch.column("queries"), batch.column("tree"), strict=True):
                asked = _unpack(blob.as_py())
                ids, score = search_tree(_unpack(tree.as_py()), asked["ids"], asked["q"], k, factor)
                on = ids >= 0 if len(ids) else np.zeros((0, k), bool)
                yield pa.record_batch({"query_id": pa.array(np.repeat(asked["ids"], k)[on.ravel()]), "vec_id": pa.array(ids[on]), "score": pa.array(score[on])})

    found = met.select("queries", "tree").mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vantage_point_ann(spark: SparkSession, sf_dir: str, k: int = 20, factor: float = 1.0) -> DataFrame:
    """The 20 nearest of every twentieth vector of ``embeddings``."""
    vectors = valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).where("vec_id is not null")
    index = materialize(build_index(vectors), "vantage-point-trees")
    return search(index, vectors.where("vec_id % 20 = 0"), k, factor)
