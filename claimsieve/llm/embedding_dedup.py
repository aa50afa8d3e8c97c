"""Embedding near-duplicates by cosine: int8 tile products with error bounds, full precision near the threshold only.

Equal vectors become one with a count. Vectors are dealt to cells of a bounded number of pivots; two cells are compared only
if the angle between their pivots less their radii leaves room for a link. A cell is cut into blocks, and a tile is a pair of
blocks: it multiplies the int8 forms and adds a bound for what each vector lost by rounding. Only pairs that may reach the
threshold are computed again in double precision. A tile returns counts and a spanning forest of its links, not pairs.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm.vectors import matrix, scaled, valid_vectors
from claimsieve.plans.components import connected_components
from claimsieve.plans.storage import materialize

BLOCK = 4096
MAX_PIVOTS = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 form, its scale, norm of the form, and norm of what rounding took, both rounded up."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    form = q * scale[:, None]
    up = 1 + 1e-9
    return q, scale, np.sqrt((form**2).sum(axis=1)) * up, np.sqrt(((x - form) ** 2).sum(axis=1)) * up + 1e-12


def tile_links(a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: bool, threshold: float) -> np.ndarray:
    """Boolean matrix of links between two blocks, exact in double precision."""
    links = np.zeros((len(a["x"]), len(b["x"])), bool)
    qa, sa, fa, ea = quantise(a["x"])
    qb, sb, _, eb = quantise(b["x"])
    # Products of int8 fit float32 without rounding up to about a thousand dimensions.
    kind = np.float32 if a["x"].shape[1] <= 1000 else np.float64
    right = qb.T.astype(kind)
    for i in range(0, len(qa), 512):
        rows = slice(i, i + 512)
        near = (qa[rows].astype(kind) @ right).astype(np.float64) * sa[rows, None] * sb[None]
        # |x·y - form·form| <= |form_x| |lost_y| + |lost_x| |y|, and y has norm 1
        bound = fa[rows, None] * eb[None] + ea[rows, None] * (1 + 1e-9)
        r, c = np.nonzero(near + bound >= threshold)
        for k in range(0, len(r), 1 << 17):
            p, s = r[k : k + (1 << 17)] + i, c[k : k + (1 << 17)]
            cos = (a["v"][p] * b["v"][s]).sum(axis=1) / (a["norm"][p] * b["norm"][s])
            links[p, s] = cos >= threshold
    if same:
        np.fill_diagonal(links, False)
    return links


def spanning_forest(links: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of links that connect all that the matrix connects."""
    n, m = links.shape
    left_rows, left_cols = np.ones(n, bool), np.ones(m, bool)
    if same:
        left_cols = left_rows
    src, dst = [], []
    for root in np.flatnonzero(links.any(axis=1)).tolist():
        if not left_rows[root]:
            continue
        left_rows[root] = False
        stack = [(root, True)]
        while stack:
            v, is_row = stack.pop()
            left = left_cols if is_row else left_rows
            new = np.flatnonzero((links[v] if is_row else links[:, v]) & left)
            left[new] = False
            src += [v] * len(new) if is_row else new.tolist()
            dst += new.tolist() if is_row else [v] * len(new)
            stack += [(u, same or not is_row) for u in new.tolist()]
    return np.array(src, np.int64), np.array(dst, np.int64)


def _pack(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _block(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        got = {k: z[k] for k in z.files}
    got["v"] = scaled(got["v"].astype(np.float64))
    got["norm"] = np.sqrt((got["v"] ** 2).sum(axis=1))
    got["x"] = got["v"] / got["norm"][:, None]
    return got


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """Rows ``vec_id, n_links, component_id, kept``: one for every row of ``vectors`` (columns vec_id, embedding).

    Vectors that take no part (``valid_vectors``) link with nothing and are kept. Repeated rows each count as a vector;
    rows with a NULL id take part, but a component has the smallest id that is not NULL. Components of any finite size
    count: vectors are brought to one size before norms are taken, so that squares neither vanish nor overflow.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    groups = materialize(
        valid_vectors(rows).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times")).withColumn("gid", F.monotonically_increasing_id()), "distinct-vectors"
    )
    n = groups.count()
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    wanted = min(MAX_PIVOTS, -(-n // block))
    by_hash = F.pmod(F.xxhash64("embedding"), F.lit(max(1, n // wanted))) == 0
    sample = groups.where(by_hash).limit(2 * wanted).select("embedding").collect()  # at most twice MAX_PIVOTS
    sample = sample or groups.limit(1).select("embedding").collect()
    pivots = scaled(np.array([r["embedding"] for r in sample]))
    pivots /= np.sqrt((pivots**2).sum(axis=1))[:, None]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows == 0:
                continue
            v = scaled(matrix(t.column("embedding")))
            angle = _angles(v / np.sqrt((v**2).sum(axis=1))[:, None], pivots)
            cell = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(v)), cell])], names=[*t.schema.names, "cell", "angle"])

    dealt = materialize(groups.mapInArrow(assign, "embedding array<double>, least long, times long, gid long, cell int, angle double"), "vector-cells")
    cells = {int(r["cell"]): (int(r["n"]), float(r["far"])) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("far")).collect()}
    parts = {c: -(-k // block) for c, (k, _) in cells.items()}
    apart = _angles(pivots, pivots)
    room = np.arccos(threshold) + 1e-6
    # Tiles of each block: its own cell and those it may link with. Cells are at most MAX_PIVOTS; blocks are counted per cell.
    near = {c: [d for d in cells if c == d or not apart[c, d] - cells[c][1] - cells[d][1] > room] for c in cells}
    near_rows = spark.createDataFrame([(c, parts[c], [(d, parts[d]) for d in ds]) for c, ds in near.items()], "cell int, n int, others array<struct<cell:int,n:int>>")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("gid")
        v = matrix(t["embedding"].combine_chunks())
        with np.errstate(over="ignore"):
            half = v.astype(np.float32)  # half the bytes to exchange, where that loses nothing
        blob = _pack(gid=t["gid"].to_numpy(), times=t["times"].to_numpy(), v=half if np.array_equal(half, v) else v)
        return pa.table({"cell": t["cell"][:1], "part": t["part"][:1], "blob": pa.array([blob], pa.binary())})

    part_of = F.pmod(F.xxhash64("gid"), F.col("n")).cast("int").alias("part")
    blocks = dealt.join(F.broadcast(near_rows.select("cell", "n")), "cell").select("cell", part_of, "gid", "times", "embedding").groupBy("cell", "part").applyInArrow(pack, "cell int, part int, blob binary")
    blocks = materialize(blocks, "vector-blocks")
    others = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["n"] - 1), lambda p: F.struct(o["cell"].alias("cell"), p.alias("part")))))
    me = F.struct("cell", "part")
    sides = blocks.join(F.broadcast(near_rows.select("cell", "others")), "cell").select("blob", me.alias("me"), F.explode(others).alias("o"))
    sides = sides.select("blob", F.least("me", "o").alias("a"), F.greatest("me", "o").alias("b"), (F.col("me") <= F.col("o")).alias("first"))

    def compare(t: pa.Table) -> pa.Table:
        first = dict(zip(t["first"].to_pylist(), t["blob"].to_pylist(), strict=True))
        same = t.num_rows == 1
        a = _block(first[True])
        b = a if same else _block(first[False])
        links = tile_links(a, b, same, threshold)
        src, dst = spanning_forest(links, same)
        count_a = links.astype(np.float64) @ b["times"]
        out = [(a["gid"], count_a)] if same else [(a["gid"], count_a), (b["gid"], a["times"] @ links.astype(np.float64))]
        gid, count = (np.concatenate(x) for x in zip(*out, strict=True))
        on = count > 0
        none = np.full(len(src), -1, np.int64)
        return pa.table(
            {
                "gid": pa.array(np.concatenate([gid[on], a["gid"][src]])),
                "links": pa.array(np.concatenate([count[on].astype(np.int64), none])),
                "other": pa.array(np.concatenate([np.full(int(on.sum()), -1, np.int64), b["gid"][dst]])),
            }
        )

    found = materialize(sides.groupBy("a", "b").applyInArrow(compare, "gid long, links long, other long"), "vector-links")
    counts = found.where("links >= 0").groupBy("gid").agg(F.sum("links").alias("links"))
    linked = connected_components(found.where("links < 0").select(F.col("gid").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("node", "gid")
    of = groups.join(counts, "gid", "left").join(linked, "gid", "left").select("embedding", "least", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "gid").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    info = of.join(named, "root").select("embedding", (F.col("links") + F.col("times") - 1).alias("n_links"), "component_id")
    # Equal vectors meet their group by value; rows that take no part match nothing.
    keyed = rows.join(info, "embedding", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return keyed.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all ``embeddings`` at cosine 0.95."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
