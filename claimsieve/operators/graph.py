"""The provider network: typed graph, projection on providers, communities, features and neighbourhoods."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.operators import windows as W
from claimsieve.plans.components import connected_components
from claimsieve.plans.storage import materialize

#: How much a connection of a kind counts in the projection.
MULTIPLIERS = {
    "shared_bank_hash": 10.0, "shared_tin_hash": 10.0, "shared_owner_exact": 8.0, "shared_owner_fuzzy": 5.0, "shared_registered_agent": 7.0, "shared_address_suite": 3.0, "shared_address_no_suite": 2.0, "refers_to": 1.0,
    "shared_members": 0.5, "works_at": 0.3, "shared_facility": 1.5, "shared_ownership": 6.0, "shared_address": 1.5,
}
#: What providers that are linked to one node have in common, by type of node; each node counts once.
SHARED = {"bank": "shared_bank_hash", "owner": "shared_ownership", "address": "shared_address"}
HARD = ("shared_bank_hash", "shared_tin_hash", "shared_owner_exact", "shared_registered_agent")
IDENTITY = ("shared_bank_hash", "shared_tin_hash", "shared_registered_agent")
OWNERSHIP = ("shared_owner_exact", "shared_owner_fuzzy", "shared_ownership")
ADDRESS = ("shared_address_suite", "shared_address_no_suite", "shared_address")
FACILITY = ("works_at", "shared_facility")
#: Links of which the providers of one value are all linked with each other.
VALUED = ("bank_hash", "tin_hash", "owner_exact", "registered_agent", "address_suite")
EDGE = "src string, dst string, edge_type string, weight double"


def build_graph(claims: DataFrame, providers: DataFrame, referrals: DataFrame | None = None, links: DataFrame | None = None, min_shared: int = 2, around: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, node_type)`` and edges ``(src, dst, edge_type, weight)`` of providers and what they have in common.

    Shared members are counted over distinct (provider, member) pairs, in which a member of very many providers meets
    them by pairs of its distinct providers only. With ``around`` (provider_id) only the pairs of these are made: enough where
    the edges of these providers are asked for.
    """
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    have = set(providers.columns)
    p = providers.where("provider_id is not null")
    parts = []

    def attribute(column: str, kind: str, edge: str) -> None:
        if column in have:
            value = C.normal_address(F.col(column)) if kind == "address" else F.col(column)
            found = p.select("provider_id", value.cast("string").alias(column)).where(F.trim(F.col(column)) != "")
            parts.append(found.select(name("provider", "provider_id").alias("src"), name(kind, column).alias("dst"), F.lit(edge).alias("edge_type"), F.lit(1.0).alias("weight")).distinct())

    attribute("bank_hash", "bank", "has_bank")
    attribute("address", "address", "located_at")
    attribute("owner_name", "owner", "owned_by")
    if "facility_id" in claims.columns:
        parts.append(claims.where("provider_id is not null and facility_id is not null").groupBy(name("provider", "provider_id").alias("src"), name("facility", "facility_id").alias("dst")).agg(F.lit("works_at").alias("edge_type"), F.count(F.lit(1)).cast("double").alias("weight")))
    if referrals is not None:
        sent = referrals.where("referring_provider_id is not null and target_provider_id is not null and referring_provider_id <> target_provider_id")
        parts.append(sent.groupBy(name("provider", "referring_provider_id").alias("src"), name("provider", "target_provider_id").alias("dst")).agg(F.lit("refers_to").alias("edge_type"), F.count(F.lit(1)).cast("double").alias("weight")))
    parts.append(shared_member_edges(claims, min_shared, around))
    if links is not None:
        # Links of one value meet in a node for it: the projection gives the pairs of it their weight, however many they are.
        edge = F.concat(F.lit("shared_"), F.col("basis"))
        valued = F.col("basis").isin(*VALUED)
        node = F.concat(edge, F.lit(":"), F.col("detail"))
        ends = links.where(valued).select(F.explode(F.array("provider_a", "provider_b")).alias("p"), node.alias("dst"), edge.alias("edge_type"), "weight")
        parts.append(ends.groupBy(name("provider", "p").alias("src"), "dst", "edge_type").agg(F.max("weight").alias("weight")))
        parts.append(links.where(~valued).groupBy(name("provider", "provider_a").alias("src"), name("provider", "provider_b").alias("dst"), edge.alias("edge_type")).agg(F.max("weight").alias("weight")))
    edges = parts[0]
    for e in parts[1:]:
        edges = edges.unionByName(e)
    return graph_nodes(edges, p), edges


def graph_nodes(edges: DataFrame, providers: DataFrame) -> DataFrame:
    """Nodes ``(id, node_type)`` of edges, and providers without any. Made of written edges, they do not make the graph again."""
    alone = providers.where("provider_id is not null").select(F.concat(F.lit("provider:"), F.col("provider_id").cast("string")))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).union(alone).distinct()
    return ids.select("id", F.split("id", ":")[0].alias("node_type"))


def shared_member_edges(claims: DataFrame, min_shared: int = 2, around: DataFrame | None = None) -> DataFrame:
    """Pairs of providers with so many members in common, all or those that have a provider of ``around`` (provider_id).

    All pairs are counted in tiles of two blocks of providers: of a member a tile gets who sees it in both blocks, as lists, and
    no row is made for a pair and member. Providers are numbered in order, so that those close by share a block.
    """
    pairs = claims.where("provider_id is not null and member_id is not null").select("provider_id", "member_id").distinct()
    if around is None:
        pairs = materialize(pairs, "seen-members")
        ids = numbered(pairs.select("provider_id").distinct().orderBy("provider_id"), "provider-numbers")
        rows = in_tiles(pairs.join(ids, "provider_id").select("id", "member_id"), ["member_id"])
        counts = by_tile(rows).mapInArrow(_tile_counts(TILE, min_shared), "x long, y long, n long")
        met = counts.join(ids.select("provider_id", F.col("id").alias("x")), "x").join(ids.select(F.col("provider_id").alias("b"), F.col("id").alias("y")), "y")
    else:
        mine = pairs.join(F.broadcast(around.select("provider_id").distinct()), "provider_id", "left_semi")
        met = mine.join(pairs.withColumnRenamed("provider_id", "b"), "member_id").where("provider_id <> b").groupBy("provider_id", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_shared)
        met = met.select(F.least("provider_id", "b").alias("provider_id"), F.greatest("provider_id", "b").alias("b"), "n").distinct()
    return met.select(F.concat(F.lit("provider:"), F.col("provider_id").cast("string")).alias("src"), F.concat(F.lit("provider:"), F.col("b").cast("string")).alias("dst"), F.lit("shared_members").alias("edge_type"), F.col("n").cast("double").alias("weight"))


#: Providers of a block. Pairs of providers are made in tiles, a block by another or itself.
TILE = 512
#: Pairs that a task counts at a time.
COUNTED = 4_000_000


def in_tiles(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows ``(i, j, *by, left, right)`` of tiles i <= j: the ids of each block with the same ``by``, as places in the block."""
    place = F.struct(F.expr(f"id div {TILE}").alias("block"), F.expr(f"cast(id % {TILE} as smallint)").alias("place"))
    lists = rows.withColumn("at", place).groupBy(*by, F.col("at.block").alias("i")).agg(F.collect_list("at.place").alias("left"))
    return lists.join(lists.withColumnsRenamed({"i": "j", "left": "right"}), by).where("i <= j").select("i", "j", *by, "left", "right")


def by_tile(rows: DataFrame, *within: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "i", "j").sortWithinPartitions("i", "j", *within)


def _tiles_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The parts of a batch in order of its tiles."""
    if batch.num_rows:
        i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
        cut = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(i)]):
            yield (int(i[a]), int(j[a])), batch.slice(a, b - a)


def _places(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins, with an end, and all values."""
    return lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64)


def _tile_counts(tile: int, least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, np.zeros(tile * tile, np.int64)

        def found() -> Iterator[pa.RecordBatch]:
            on = np.flatnonzero(n >= least)
            if at is not None and at[0] == at[1]:
                on = on[on // tile < on % tile]
            if len(on):
                yield pa.record_batch({"x": pa.array(at[0] * tile + on // tile), "y": pa.array(at[1] * tile + on % tile), "n": pa.array(n[on])})

        for batch in batches:
            for key, part in _tiles_of(batch):
                if key != at:
                    yield from found()
                    at = key
                    n[:] = 0
                (lo, lv), (ro, rv) = _places(part.column("left")), _places(part.column("right"))
                done = np.concatenate([[0], np.cumsum(np.diff(lo) * np.diff(ro))])
                a = 0
                while a < part.num_rows:
                    b = max(a + 1, int(np.searchsorted(done, done[a] + COUNTED, "right")) - 1)
                    of = np.repeat(np.arange(a, b), np.diff(lo[a : b + 1]))
                    k = np.diff(ro)[of]  # each left one meets so many
                    right = np.arange(k.sum()) + np.repeat(ro[of] - (np.cumsum(k) - k), k)
                    n += np.bincount(np.repeat(lv[lo[a] : lo[b]], k) * tile + rv[right], minlength=tile * tile)
                    a = b
        yield from found()

    return count


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("type")).count().unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).count())


@dataclass(frozen=True)
class Projection:
    """The network of providers without its pairs.

    ``nodes(id, provider)`` are all providers. In each class of ``members(id, cls, kind, raw, w)`` every two providers are
    connected, with ``raw`` of a kind and weight ``w``; ``direct(a, b, kind, raw, w)`` has the connections of single pairs. What
    is asked of the network is a sum over classes, so that a class of n providers costs n rows and not n squared.
    """

    nodes: DataFrame
    members: DataFrame
    direct: DataFrame


def project(edges: DataFrame, nodes: DataFrame | None = None, overrides: dict[str, float] | None = None, written: bool = False) -> Projection:
    """The projection of a graph on its providers; with ``nodes`` also those without an edge. Edges are written, unless they are.

    A node of banks, owners, addresses or facilities that providers share counts 1 for each pair of them, whatever the weight of
    its edges; nodes of identity links count the weight of the link; edges between providers count their own.
    """
    factors = MULTIPLIERS | (overrides or {})
    factor = lambda kind: F.coalesce(*(F.when(kind == k, F.lit(float(f))) for k, f in factors.items()), F.lit(1.0))
    if not written:
        edges = materialize(edges.select("src", "dst", "edge_type", "weight"), "edges")
    is_provider = lambda c: F.col(c).startswith("provider:")
    names = edges.select(F.explode(F.array("src", "dst")).alias("provider")).where(is_provider("provider"))
    if nodes is not None:
        names = names.union(nodes.where("node_type = 'provider'").select("id"))
    ids = shuffled(names)
    src, dst = ids.select(F.col("provider").alias("src"), F.col("id").alias("a")), ids.select(F.col("provider").alias("dst"), F.col("id").alias("b"))
    pairs = edges.where(is_provider("src") & is_provider("dst") & (F.col("src") != F.col("dst"))).join(src, "src").join(dst, "dst")
    direct = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("edge_type").alias("kind")).agg(F.sum("weight").alias("raw"))

    node = F.split_part("dst", F.lit(":"), F.lit(1))
    linked = node.startswith("shared_")
    kind = F.when(linked, node)
    for n, k in SHARED.items():
        kind = kind.when(node == n, k)
    half = edges.where(is_provider("src") & ~is_provider("dst")).select("src", "dst", kind.otherwise("shared_facility").alias("kind"), F.when(linked, F.col("weight")).otherwise(1.0).alias("raw"))
    half = half.groupBy("src", "dst", "kind").agg(F.max("raw").alias("raw"))
    classes = half.groupBy("dst", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("raw").alias("raw")).where("n > 1").withColumn("cls", F.monotonically_increasing_id())
    classes = materialize(classes.select("dst", "kind", "raw", "cls"), "shared-values")
    members = half.select("src", "dst", "kind").join(classes, ["dst", "kind"]).join(src, "src").select(F.col("a").alias("id"), "cls", "kind", "raw")
    weigh = lambda df: df.withColumn("w", F.col("raw") * factor(F.col("kind")))
    return Projection(ids, materialize(weigh(members), "members-of-values"), materialize(weigh(direct), "direct"))


def _tile_pairs(tile: int):
    """Rows (i, j, kind, raw, w, left, right) in order of their tile to its pairs ``a, b, weight, edge_types``."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, kinds = None, np.zeros((tile, tile)), {}

        def found() -> Iterator[pa.RecordBatch]:
            if not kinds:
                return
            names = sorted(kinds)
            met = np.any([kinds[k][1] for k in names], axis=0)
            if at[0] == at[1]:
                met = np.triu(met, 1)
            x, y = np.nonzero(met)
            for c in range(0, len(x), 1 << 16):
                l, r = x[c : c + (1 << 16)], y[c : c + (1 << 16)]
                have = np.stack([kinds[k][1][l, r] for k in names], axis=1)
                raw = np.stack([kinds[k][0][l, r] for k in names], axis=1)
                cut = np.concatenate([[0], np.cumsum(have.sum(axis=1))]).astype(np.int32)
                entries = pa.MapArray.from_arrays(pa.array(cut), pa.array(names).take(pa.array(np.nonzero(have)[1])), pa.array(raw[have]))
                yield pa.record_batch({"a": pa.array(at[0] * tile + l), "b": pa.array(at[1] * tile + r), "weight": pa.array(weight[l, r]), "edge_types": entries})

        for batch in batches:
            for key, part in _tiles_of(batch):
                if key != at:
                    yield from found()
                    at = key
                    weight[:] = 0
                    kinds.clear()
                (lo, lv), (ro, rv) = _places(part.column("left")), _places(part.column("right"))
                raw, w = part.column("raw").to_numpy(), part.column("w").to_numpy()
                kind = part.column("kind").to_pylist()
                for k in set(kind) - set(kinds):
                    kinds[k] = np.zeros((tile, tile)), np.zeros((tile, tile), bool)
                one = (np.diff(lo) == 1) & (np.diff(ro) == 1)
                number = {k: i for i, k in enumerate(kinds)}
                codes = np.array([number[k] for k in kind])
                for k in set(kind):
                    on = np.flatnonzero(one & (codes == number[k]))
                    place = lv[lo[on]], rv[ro[on]]
                    np.add.at(kinds[k][0], place, raw[on])
                    kinds[k][1][place] = True
                    np.add.at(weight, place, w[on])
                for t in np.flatnonzero(~one).tolist():
                    place = np.ix_(lv[lo[t] : lo[t + 1]], rv[ro[t] : ro[t + 1]])
                    kinds[kind[t]][0][place] += raw[t]
                    kinds[kind[t]][1][place] = True
                    weight[place] += w[t]
        yield from found()

    return pairs


def connections(p: Projection, asked: DataFrame | None = None) -> DataFrame:
    """Pairs ``(u, v, weight, edge_types)`` of connected providers: all of them, or those of the providers that are asked for.

    All of them are made in tiles of two blocks of providers: what two blocks share is added up in a task, in matrices of a tile
    by kind, so that no row is made for a pair and a value.
    """
    a, b = p.nodes.select(F.col("id").alias("a"), F.col("provider").alias("src")), p.nodes.select(F.col("id").alias("b"), F.col("provider").alias("dst"))
    if asked is None:
        columns = ["i", "j", "kind", "raw", "w", "left", "right"]
        over = in_tiles(p.members, ["cls", "kind", "raw", "w"]).select(*columns, "cls")
        one = lambda c: F.array(F.expr(f"cast({c} % {TILE} as smallint)"))
        direct = p.direct.select(F.expr(f"a div {TILE}").alias("i"), F.expr(f"b div {TILE}").alias("j"), "kind", "raw", "w", one("a").alias("left"), one("b").alias("right"), F.lit(None).cast("long").alias("cls"))
        met = by_tile(over.unionByName(direct), "kind", "cls").drop("cls").mapInArrow(_tile_pairs(TILE), "a long, b long, weight double, edge_types map<string,double>")
    else:
        mine = p.nodes.join(asked.select("provider").distinct(), "provider", "left_semi").select("id")
        left = p.members.join(mine, "id", "left_semi").select("cls", "kind", "raw", "w", F.col("id").alias("x"))
        over = left.join(p.members.select("cls", F.col("id").alias("y")), "cls").where("x <> y").select("kind", "raw", "w", "cls", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        direct = p.direct.join(mine.select(F.col("id").alias("a")), "a", "left_semi").select(*p.direct.columns).union(p.direct.join(mine.select(F.col("id").alias("b")), "b", "left_semi").select(*p.direct.columns)).distinct()
        columns = ["a", "b", "kind", "raw", "w"]
        kinds = direct.select(*columns).unionByName(over.select(*columns)).groupBy("a", "b", "kind").agg(F.sum("raw").alias("raw"), F.sum("w").alias("w"))
        met = kinds.groupBy("a", "b").agg(F.sum("w").alias("weight"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "raw")))).alias("edge_types"))  # one entry a kind
    return met.join(a, "a").join(b, "b").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "weight", "edge_types")


def project_providers(edges: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """All connected pairs of providers ``(u, v, weight, edge_types)``."""
    return connections(project(edges, overrides=overrides))


def of_pairs(pairs: DataFrame) -> Projection:
    """The projection of which ``pairs(u, v, weight, edge_types)`` are all connections."""
    ids = shuffled(pairs.select(F.explode(F.array("u", "v")).alias("provider")))
    a, b = ids.select(F.col("id").alias("a"), F.col("provider").alias("u")), ids.select(F.col("id").alias("b"), F.col("provider").alias("v"))
    direct = pairs.join(a, "u").join(b, "v").select("a", "b", F.lit("pair").alias("kind"), F.lit(1.0).alias("raw"), F.col("weight").cast("double").alias("w"))
    none = ids.limit(0).select("id", F.col("id").alias("cls"), F.lit("").alias("kind"), F.lit(0.0).alias("raw"), F.lit(0.0).alias("w"))
    return Projection(ids, none, materialize(direct, "direct"))


def both_ways(direct: DataFrame) -> DataFrame:
    rest = [c for c in direct.columns if c not in ("a", "b")]
    return direct.select("a", "b", *rest).union(direct.select("b", "a", *rest))


#: Providers of a column of bitmaps; a multiple of ``TILE``.
WIDE = 32_768


def neighbour_counts(members: DataFrame, direct: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Rows ``(id, n)``: with how many different others (of ``marked(id)``, if given) a provider shares a class or an edge.

    A class is a few bitmaps of 32,768 numbers each. They go to blocks of 512 providers, once for all members that a block has
    of the class, and a task unites those of each provider: no pair is made, and no bitmap for each member. Ids should be dense
    (``numbered``). Providers without any are left out. Rows of single edges have an empty list: on its way to a worker each NULL
    list costs a step for every row of its batch.
    """
    block, wide = (lambda c: F.expr(f"{c} div {TILE}")), (lambda c: F.expr(f"{c} div {WIDE}"))
    near = both_ways(direct.select("a", "b"))
    held = members.select("id", "cls")
    if marked is not None:
        marked = marked.select("id").distinct()
        near = near.join(marked.select(F.col("id").alias("b")), "b", "left_semi")
        held = held.join(marked, "id", "left_semi")
    maps = held.groupBy("cls", wide("id").alias("j")).agg(F.bitmap_construct_agg(F.col("id") % WIDE).alias("bits"))
    mine = members.groupBy("cls", block("id").alias("i")).agg(F.collect_list(F.expr(f"cast(id % {TILE} as smallint)")).alias("left"))  # at most a block
    none = lambda kind: F.lit(None).cast(kind)
    over = mine.join(maps, "cls").select("i", "j", "left", "bits", none("smallint").alias("x"), none("smallint").alias("y"))
    single = near.select(block("a").alias("i"), wide("b").alias("j"), F.array().cast("array<smallint>").alias("left"), none("binary").alias("bits"), F.expr(f"cast(a % {TILE} as smallint)").alias("x"), F.expr(f"cast(b % {WIDE} as smallint)").alias("y"))
    return by_tile(over.unionByName(single)).mapInArrow(_united_bits(TILE, WIDE), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _united_bits(tile: int, wide: int):
    """Rows of tiles in order: of each provider of a block, how many of a column it meets by bitmaps or single edges, but itself."""

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, met = None, np.zeros((tile, wide // 8), np.uint8)

        def found() -> Iterator[pa.RecordBatch]:
            own = np.arange(tile) + (at[0] * tile - at[1] * wide)
            if 0 <= own[0] < wide:
                met[np.arange(tile), own >> 3] &= ~(1 << (own & 7)).astype(np.uint8)
            n = np.bitwise_count(met.view(np.uint64)).sum(axis=1, dtype=np.int64)
            on = np.flatnonzero(n)
            yield pa.record_batch({"id": pa.array(at[0] * tile + on), "n": pa.array(n[on])})

        for batch in batches:
            for key, part in _tiles_of(batch):
                if key != at:
                    if at is not None:
                        yield from found()
                    at = key
                    met[:] = 0
                bits, left = part.column("bits"), part.column("left")
                mapped = np.asarray(bits.is_valid())
                for t in np.flatnonzero(mapped).tolist():
                    met[left[t].values.to_numpy()] |= np.frombuffer(bits[t].as_buffer(), np.uint8)
                single = part.filter(pa.array(~mapped))
                x, y = single.column("x").to_numpy().astype(np.int64), single.column("y").to_numpy().astype(np.int64)
                np.bitwise_or.at(met, (x, y >> 3), (1 << (y & 7)).astype(np.uint8))
        if at is not None:
            yield from found()

    return united


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows with an ``id``: dense numbers from 0, in the order of the rows if they are sorted. They are written, so that numbers stay."""
    kept = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    sizes = kept.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # As many rows as partitions.
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(kept.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(base), "_part").select((F.col("_base") + place).alias("id"), *rows.columns), f"{name}-dense")


def shuffled(names: DataFrame) -> DataFrame:
    """Distinct providers with numbers in the order of a hash: one that looks random, and is the same for any partitions."""
    return numbered(materialize(names.distinct(), "provider-names").orderBy(F.xxhash64("provider"), "provider"), "provider-numbers")


def degrees(p: Projection) -> DataFrame:
    """Rows ``(id, k)``: the weighted degree of each provider that has a connection."""
    size = p.members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    over = p.members.join(size, "cls").select("id", (F.col("w") * (F.col("n") - 1)).alias("k"))
    return over.unionByName(both_ways(p.direct.select("a", "b", "w")).select(F.col("a").alias("id"), F.col("w").alias("k"))).groupBy("id").agg(F.sum("k").alias("k"))


#: The least rise by a move that counts, as a share of the node's degree: one of the modularity would pass over all small nodes of a large graph.
LEAST_RISE = 1e-7
#: Edges, both ways, that a task holds while it moves their nodes (12 bytes each). Where there are more, pieces of so many go one after another.
HELD = 32_000_000
#: Bytes for counts of large classes by community; the members of others are looked up.
CLASS_COUNTS = 128 << 20


class _Level:
    """A graph whose nodes are providers, or communities of them.

    ``member(u, cls, w, x)`` has how many of a class each node has; ``direct(u, v, w)`` edges both ways; ``node(u, k)`` weighted
    degrees.
    """

    def __init__(self, member: DataFrame, direct: DataFrame, node: DataFrame, total: float, resolution: float):
        self.node, self.member, self.direct = materialize(node, "level-nodes"), materialize(member, "level-members"), materialize(direct.where("u <> v"), "level-direct")
        self.total, self.resolution = total, resolution

    def pieces(self) -> list[tuple[int | None, int | None, DataFrame]]:
        """Ranges of nodes with their edges, of which a task holds those of one range."""
        n = -(-self.direct.count() // HELD)
        if n < 2:
            return [(None, None, self.direct)]
        cuts = sorted({int(x) for x in self.direct.approxQuantile("u", [i / n for i in range(1, n)], 0.01 / n)})
        ends = [None, *cuts, None]
        inside = lambda lo, hi: F.lit(True) & (F.col("u") >= lo if lo is not None else F.lit(True)) & (F.col("u") < hi if hi is not None else F.lit(True))
        return [(lo, hi, materialize(self.direct.where(inside(lo, hi)), "level-piece")) for lo, hi in zip(ends, ends[1:])]

    def settle(self) -> tuple[DataFrame, bool]:
        """Labels ``(u, c)`` after local moving, and whether any node moved. It ends when no node gains by a move.

        Nodes move one after another, in the order of their numbers, each to the best of all communities that it has an edge or a
        class with. A task holds labels and classes, and the edges of one piece: the moves are the same for any number of pieces.
        """
        label, pieces, turn = self.node.select("u", F.col("u").alias("c")), self.pieces(), 0
        none = F.lit(0.0)
        members = self.member.select(F.lit(1).alias("part"), "u", F.col("cls").alias("v"), "w", "x")
        while True:
            moves = 0
            for lo, hi, direct in pieces:
                nodes = self.node.join(label, "u").select(F.lit(0).alias("part"), "u", F.col("c").alias("v"), F.col("k").alias("w"), none.alias("x"))
                rows = nodes.union(members).union(direct.select(F.lit(2).alias("part"), "u", "v", "w", none.alias("x")))
                found = materialize(rows.coalesce(1).mapInArrow(_moved(lo, hi, len(pieces) == 1, self.total, self.resolution), "u long, c long, moves long"), "level-labels")
                label = found.select("u", "c")
                moves += found.agg(F.max("moves")).first()[0]
            turn += moves > 0
            if not moves or len(pieces) == 1:
                return label, turn > 0

    def contracted(self, label: DataFrame) -> _Level:
        """The graph whose nodes are the communities of ``label``."""
        to = label.select(F.col("u").alias("v"), F.col("c").alias("d"))
        member = self.member.join(label, "u").groupBy(F.col("c").alias("u"), "cls").agg(F.max("w").alias("w"), F.sum("x").alias("x"))
        direct = self.direct.join(label, "u").join(to, "v").groupBy(F.col("c").alias("u"), F.col("d").alias("v")).agg(F.sum("w").alias("w"))
        node = self.node.join(label, "u").groupBy(F.col("c").alias("u")).agg(F.sum("k").alias("k"))
        return _Level(member, direct, node, self.total, self.resolution)


def _grouped(of: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each of n numbers begin in sorted ``of``, with an end."""
    return np.searchsorted(of, np.arange(n + 1))


class _Moving:
    """Local moving with all labels and classes at hand; the edges of a node come with it."""

    def __init__(self, ids: np.ndarray, k: np.ndarray, label: np.ndarray, members: tuple[np.ndarray, ...], total: float, resolution: float):
        self.ids, self.k, self.label, n = ids, k, label, len(ids)
        self.share = resolution * k / total
        u, cls, w, x = members
        u, cls = np.searchsorted(ids, u), np.unique(cls, return_inverse=True)[1]
        by = np.lexsort((cls, u))
        self.of = _grouped(u[by], n)  # classes of a node
        self.cls, self.w, self.x = cls[by], w[by], x[by]
        self.own = np.bincount(u, w * x * x, n)
        by = np.lexsort((u, cls))
        size = np.bincount(cls)
        self.at = _grouped(cls[by], len(size))  # members of a class
        self.mates, self.held = u[by], x[by]
        large = np.argsort(-size, kind="stable")[: CLASS_COUNTS // (8 * n)]
        large = large[size[large] > 32]
        self.row = np.full(len(size), -1)
        self.row[large] = np.arange(len(large))
        self.large = large

    def begin(self) -> None:
        """Sums by community from the labels."""
        self.names, self.lab = np.unique(self.label, return_inverse=True)
        n = len(self.names)
        self.tot, self.size, self.empty = np.bincount(self.lab, self.k, n), np.bincount(self.lab, minlength=n), 0
        self.counts = np.zeros((len(self.large), n))
        for i, c in enumerate(self.large.tolist()):
            mine = slice(self.at[c], self.at[c + 1])
            self.counts[i] = np.bincount(self.lab[self.mates[mine]], self.held[mine], n)

    def end(self) -> None:
        self.label = self.names[self.lab]

    def visit(self, u: int, near: np.ndarray, weight: np.ndarray) -> int:
        """Move a node to its best community; 1 if it did."""
        lab, n = self.lab, len(self.names)
        home, k, share = lab[u], self.k[u], self.share[u]
        to, w, dense = [lab[near]], [weight], []
        for i in range(self.of[u], self.of[u + 1]):
            c, one = self.cls[i], self.w[i] * self.x[i]
            if self.row[c] >= 0:
                dense.append((self.row[c], one))
            else:
                mine = slice(self.at[c], self.at[c + 1])
                to.append(lab[self.mates[mine]])
                w.append(one * self.held[mine])
        to, w = np.concatenate([*to, [home]]), np.concatenate([*w, [0.0]])  # its own is always weighed
        if dense or 4 * len(to) > n:
            some, met = None, np.bincount(to, w, n)
            for row, one in dense:
                met += one * self.counts[row]
            at, gain = home, met - share * self.tot
        else:
            some, place = np.unique(to, return_inverse=True)
            met = np.bincount(place, w)
            at, gain = np.searchsorted(some, home), met - share * self.tot[some]
        stay = gain[at] - self.own[u] + share * k
        gain[at] = -np.inf
        most = gain.max()
        if not most - stay > LEAST_RISE * k:
            return 0
        if (met[gain >= most - 1e-9 * k] <= 0).any():  # communities that it has nothing in common with
            gain[met <= 0] = -np.inf
            most = gain.max()
            if not most - stay > LEAST_RISE * k:
                return 0
        best = int(np.argmax(gain >= most - 1e-9 * k))  # as good up to rounding: the one of the smallest number
        best = best if some is None else int(some[best])
        lab[u] = best
        self.tot[home] -= k
        self.tot[best] += k
        self.size[home] -= 1
        self.size[best] += 1
        for i in range(self.of[u], self.of[u + 1]):
            row = self.row[self.cls[i]]
            if row >= 0:
                self.counts[row, home] -= self.x[i]
                self.counts[row, best] += self.x[i]
        self.empty += self.size[home] == 0
        if 2 * self.empty > n:
            kept = self.size > 0
            self.lab, self.names, self.tot, self.size, self.counts, self.empty = (np.cumsum(kept) - 1)[lab], self.names[kept], self.tot[kept], self.size[kept], self.counts[:, kept], 0
        return 1


def _moved(lo: int | None, hi: int | None, whole: bool, total: float, resolution: float):
    """Rows (part, u, v, w, x) of nodes with labels and degrees, of classes and of edges to labels ``u, c`` and the number of moves.

    Nodes from ``lo`` up to ``hi`` move once; with ``whole``, all of them until none gains.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[tuple[np.ndarray, ...]]] = [[], [], []]
        for batch in batches:
            kind = batch.column("part").to_numpy()
            columns = [batch.column(c).to_numpy() for c in ("u", "v", "w", "x")]
            for i in np.unique(kind).tolist():
                mine = kind == i
                u, v, w, x = (c[mine] for c in columns)
                parts[i].append((u.astype(np.int32), v.astype(np.int32), w) if i == 2 else (u, v, w, x))
        if not parts[0]:
            return
        put = lambda i, j, kind: np.concatenate([p[j] for p in parts[i]]) if parts[i] else np.zeros(0, kind)
        u = put(0, 0, np.int64)
        order = np.argsort(u)
        ids, label, k = u[order], put(0, 1, np.int64)[order], put(0, 2, float)[order]
        state = _Moving(ids, k, label, (put(1, 0, np.int64), put(1, 1, np.int64), put(1, 2, float), put(1, 3, float)), total, resolution)
        src, near, weight = put(2, 0, np.int32), put(2, 1, np.int32), put(2, 2, float)
        parts.clear()
        order = np.lexsort((near, src))
        src, near, weight = src[order], np.searchsorted(ids, near[order]).astype(np.int32), weight[order]
        starts = np.searchsorted(src, np.append(ids, np.iinfo(np.int32).max)).tolist()
        a, b = (0 if lo is None else int(np.searchsorted(ids, lo))), (len(ids) if hi is None else int(np.searchsorted(ids, hi)))
        moves, again = 0, True
        while again:
            state.begin()
            now = sum(state.visit(i, near[starts[i] : starts[i + 1]], weight[starts[i] : starts[i + 1]]) for i in range(a, b))
            state.end()
            moves, again = moves + now, whole and now > 0
        for c in range(0, len(ids), 1 << 16):
            mine = slice(c, c + (1 << 16))
            yield pa.record_batch({"u": pa.array(ids[mine]), "c": pa.array(state.label[mine]), "moves": pa.array(np.full(len(ids[mine]), moves, np.int64))})

    return run


def united(member: DataFrame) -> DataFrame:
    """``member(u, cls, w, x)`` with classes that have the same nodes made one, of which the weight is the sum of theirs.

    Classes are brought together by their size and two hashes; that they are the same is decided by their nodes, of which there
    are then no more than those of one.
    """
    node = lambda seed: F.bit_xor(F.xxhash64("u", F.lit(seed)))
    prints = materialize(member.groupBy("cls").agg(F.struct(F.count(F.lit(1)).alias("n"), node(1).alias("h1"), node(2).alias("h2")).alias("set")), "class-prints")
    alike = prints.groupBy("set").agg(F.min("cls").alias("one"), F.count(F.lit(1)).alias("times")).where("times > 1")
    nodes = member.join(prints.join(alike, "set"), "cls").select("set", "u").distinct().groupBy("set").agg(F.count(F.lit(1)).alias("nodes"))
    same = prints.join(alike, "set").join(nodes, "set").where("nodes = set.n").select("cls", "one")
    return member.join(same, "cls", "left").groupBy("u", F.coalesce("one", "cls").alias("cls")).agg(F.sum("w").alias("w"), F.max("x").alias("x"))


def communities(p: Projection, resolution: float = 1.0, min_size: int = 2) -> DataFrame:
    """Rows ``(provider, community)``: weighted modularity, moved up locally and then on the graph of the communities, and so on.

    Each level is contracted until no node moves; the labels are traced back. Communities are connected in the end: parts that
    hang together by no connection become communities of their own, which never lowers the modularity. A community is named
    after its smallest provider.
    """
    member = united(p.members.select(F.col("id").alias("u"), "cls", "w", F.lit(1.0).alias("x")))
    direct = both_ways(p.direct.groupBy("a", "b").agg(F.sum("w").alias("w"))).select(F.col("a").alias("u"), F.col("b").alias("v"), "w")
    node = degrees(p).select(F.col("id").alias("u"), "k").where("k > 0")
    total = node.agg(F.sum("k")).first()[0]
    if not total:
        return p.nodes.select("provider", F.col("provider").alias("community")).limit(0)
    level = _Level(member, direct, node, total, resolution)
    found = level.node.select(F.col("u").alias("id"), F.col("u").alias("c"))
    while True:
        label, moved = level.settle()
        if not moved:
            break
        found = materialize(found.join(label.select(F.col("u").alias("c"), F.col("c").alias("to")), "c").select("id", F.col("to").alias("c")), "traced")
        level = level.contracted(label)
    named = found.join(p.nodes, "id").select("id", "provider", "c")
    other = found.select(F.col("id").alias("b"), F.col("c").alias("d"))
    text = lambda c: F.col(c).cast("string")
    hub = p.members.join(named, "id").select(F.col("provider").alias("src"), F.concat(F.lit("~"), text("cls"), F.lit(":"), text("c")).alias("dst"))
    pair = p.direct.join(named.withColumnsRenamed({"id": "a", "provider": "src"}), "a").join(other, "b").where("c = d").join(p.nodes.withColumnsRenamed({"id": "b", "provider": "dst"}), "b").select("src", "dst")
    linked = connected_components(hub.unionByName(pair), "src", "dst").where(~F.col("node").startswith("~")).select(F.col("node").alias("provider"), F.col("component").alias("community"))
    return linked.join(linked.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size), "community", "left_semi").select("provider", "community")


def modularity(p: Projection, membership: DataFrame, resolution: float = 1.0) -> float:
    """Weighted modularity of ``membership(provider, community)``; providers that it leaves out are alone."""
    k = degrees(p)
    total = k.agg(F.sum("k")).first()[0]
    label = p.nodes.join(membership, "provider", "left").select("id", F.coalesce("community", "provider").alias("c"))
    counts = p.members.join(label, "id").groupBy("cls", "c").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n"))
    over = counts.agg(F.sum(F.col("w") * F.col("n") * (F.col("n") - 1))).first()[0] or 0.0
    kept = p.direct.join(label.withColumnRenamed("id", "a"), "a").join(label.select(F.col("id").alias("b"), F.col("c").alias("d")), "b").where("c = d").agg(F.sum("w")).first()[0] or 0.0
    squares = k.join(label, "id").groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return (over + 2 * kept) / total - resolution * squares / total**2


def _inside(p: Projection, membership: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members`` and ``direct`` within communities, with the community ``c`` in the class; and ``(id, provider, c)``."""
    of = p.nodes.join(membership.select("provider", F.col("community").alias("c")), "provider").select("id", "provider", "c")
    members = p.members.join(of.select("id", "c"), "id").withColumn("cls", F.struct("cls", "c"))
    ends = of.select(F.col("id").alias("b"), F.col("c").alias("d"))
    direct = p.direct.join(of.select(F.col("id").alias("a"), "c"), "a").join(ends, "b").where("c = d").drop("d")
    return members, direct, of


def community_table(p: Projection, membership: DataFrame) -> DataFrame:
    """Size, hub (greatest weighted degree inside, ties to the smallest name), sums by kind and category of each community."""
    members, direct, of = _inside(p, membership)
    counts = members.groupBy("cls", "c", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("raw").alias("raw"), F.max("w").alias("w"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    kinds = counts.where("n > 1").select("c", "kind", (F.col("raw") * pairs).alias("raw"), (F.col("w") * pairs).alias("w")).unionByName(direct.select("c", "kind", "raw", "w")).groupBy("c", "kind").agg(F.sum("raw").alias("raw"), F.sum("w").alias("w"))
    over = members.join(counts.select("cls", "n"), "cls").select("id", (F.col("w") * (F.col("n") - 1)).alias("degree"))
    inner = over.unionByName(both_ways(direct.select("a", "b", "w")).select(F.col("a").alias("id"), F.col("w").alias("degree"))).groupBy("id").agg(F.sum("degree").alias("degree"))
    hubs = of.join(inner, "id", "left").groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.min_by("provider", F.struct(-F.coalesce("degree", F.lit(0.0)), "provider")).alias("hub"), F.sort_array(F.collect_list("provider")).alias("providers"))
    of_kinds = lambda names: F.sum(F.when(F.col("kind").isin(*names), F.col("raw")).otherwise(0.0))
    totals = kinds.groupBy("c").agg(of_kinds(HARD).alias("hard_links"), of_kinds(("refers_to",)).alias("referrals"), of_kinds(OWNERSHIP).alias("ownership"), F.count(F.lit(1)).alias("edge_type_count"), F.sum("w").alias("total_weight"))
    out = hubs.join(totals, "c", "left").fillna(0.0, ["hard_links", "referrals", "ownership", "total_weight"]).fillna(0, ["edge_type_count"])
    hard, sent = F.col("hard_links"), F.col("referrals")
    category = F.when((hard >= 2) | ((hard >= 1) & (sent >= 2)), "high-risk network").when((hard >= 1) | (sent >= 3), "investigation candidate network").when(F.col("size") >= 3, "connected provider cluster").otherwise("small provider cluster")
    return out.withColumn("category", category).withColumnRenamed("c", "community")


def enrich_communities(membership: DataFrame, claims: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Claims, dollars, rules and suspicious claims of each community."""
    who = membership.select(F.regexp_replace("provider", "^provider:", "").alias("pid"), "community")
    money = claims.select(F.col("provider_id").cast("string").alias("pid"), "paid_amount").join(who, "pid").groupBy("community").agg(F.count(F.lit(1)).alias("claim_count"), F.sum("paid_amount").alias("total_paid"))
    if alerts is None:
        return money
    found = alerts.where("entity_type = 'provider'").select(F.col("entity_id").alias("pid"), "rule_id", F.explode_outer("claim_ids").alias("claim_id")).join(who, "pid")
    return money.join(found.groupBy("community").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"), F.countDistinct("claim_id").alias("suspicious_claims")), "community", "left")


def network_features(p: Projection, membership: DataFrame, suspicious: DataFrame, edges: DataFrame | None = None, claims: DataFrame | None = None, betweenness: DataFrame | None = None) -> DataFrame:
    """Network features of every provider: degrees, community, suspicious neighbours, connections by kind, exposure, scores.

    ``suspicious(provider)`` are those with an alert. ``edges`` of the graph give the number of relationships, ``claims`` the
    exposure, ``betweenness`` the referral centrality; without them these are 0. Each connection counts the whole number in its
    raw weight. A provider without a community has -1 in its place, of size 1.
    """
    mark = p.nodes.join(suspicious.select("provider").distinct(), "provider", "left_semi").select("id")
    size = p.members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    raw = F.floor("raw").cast("long")
    links = p.members.join(size, "cls").select("id", "kind", (raw * (F.col("n") - 1)).alias("n")).unionByName(both_ways(p.direct.select("a", "b", "kind", "raw")).select(F.col("a").alias("id"), "kind", raw.alias("n")))
    of = lambda kinds, name: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0)).alias(name)
    groups = {"shared_identity_count": IDENTITY, "shared_ownership_count": OWNERSHIP, "shared_address_count": ADDRESS, "referral_connection_count": ("refers_to",), "facility_connection_count": FACILITY}
    by_kind = links.groupBy("id").agg(*(of(k, n) for n, k in groups.items()))
    members, direct, inside = _inside(p, membership)
    sizes = inside.groupBy("c").agg(F.count(F.lit(1)).alias("community_size"))
    met = neighbour_counts(members, direct).join(inside.select("id", "c"), "id").groupBy("c").agg((F.sum("n") / 2).alias("met"))
    density = F.when(F.col("community_size") > 1, 2 * F.coalesce("met", F.lit(0.0)) / (F.col("community_size") * (F.col("community_size") - 1))).otherwise(0.0)
    place = inside.select("id", "c").join(sizes, "c").join(met, "c", "left").select("id", F.col("c").alias("community"), "community_size", F.round(density, 4).alias("network_density"))
    out = p.nodes.join(neighbour_counts(p.members, p.direct).withColumnRenamed("n", "network_degree"), "id", "left").join(degrees(p), "id", "left").join(neighbour_counts(p.members, p.direct, mark).withColumnRenamed("n", "suspicious_neighbor_count"), "id", "left").join(by_kind, "id", "left").join(place, "id", "left")
    zero = F.lit(0).cast("long")
    if edges is not None:
        out = out.join(relationships(edges), "provider", "left")
    if claims is not None:
        out = out.join(claims.groupBy(F.concat(F.lit("provider:"), F.col("provider_id").cast("string")).alias("provider")).agg(F.sum("paid_amount").alias("network_exposure")), "provider", "left")
    if betweenness is not None:
        out = out.join(betweenness.select("provider", F.col("betweenness").alias("referral_centrality")), "provider", "left")
    given = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in out.columns else F.lit(0.0)
    count = lambda c: F.coalesce(F.col(c).cast("long"), zero)
    whole = ["network_degree", "suspicious_neighbor_count", *groups]
    out = out.select(
        "provider", F.coalesce("community", F.lit("-1")).alias("community"), F.coalesce("community_size", F.lit(1)).alias("community_size"), F.round(F.coalesce("k", F.lit(0.0)), 2).alias("weighted_degree"), F.coalesce("network_density", F.lit(0.0)).alias("network_density"),
        *(count(c).alias(c) for c in whole), F.round(given("network_exposure"), 2).alias("network_exposure"), (count("network_relationship_count") if edges is not None else zero).alias("network_relationship_count"), F.round(given("referral_centrality"), 4).alias("referral_centrality"),
    )
    most = F.greatest(F.col("network_degree"), F.lit(1))
    risk = (0.4 * F.col("shared_identity_count") + 0.3 * F.col("suspicious_neighbor_count") + 0.3 * F.col("referral_connection_count")) / 5
    return out.withColumns({"suspicious_neighbor_ratio": F.round(F.col("suspicious_neighbor_count") / most, 4), "ownership_centrality": F.round(F.least(F.col("shared_ownership_count") / most, F.lit(1.0)), 4), "community_risk_score": F.round(F.least(risk, F.lit(1.0)), 4)})


def relationships(edges: DataFrame) -> DataFrame:
    """Rows ``(provider, network_relationship_count)``: edges of the graph at each provider; those of an identity value are its pairs."""
    value = F.col("dst").startswith("shared_")
    pairs = edges.where(value).select("src", "dst").join(edges.where(value).groupBy("dst").agg((F.count(F.lit(1)) - 1).alias("n")), "dst").select(F.col("src").alias("provider"), "n")
    ends = edges.where(~value).select(F.explode(F.array("src", "dst")).alias("provider"), F.lit(1).cast("long").alias("n"))
    return pairs.unionByName(ends).where(F.col("provider").startswith("provider:")).groupBy("provider").agg(F.sum("n").alias("network_relationship_count"))


def betweenness_centrality(projection: DataFrame, pivots: int | None = None) -> DataFrame:
    """Weighted betweenness, normalised; weights are distances. All nodes are sources; with ``pivots`` an estimate from so many.

    Sources whose edges to all others are shorter than any detour are on no path of others and are left out (``_detours``). Up to
    ``ADJACENCY_EDGES`` edges, whose number is checked, tasks get the adjacency and a part of the rest. Beyond it paths grow
    along edges by joins (``_over_joins``), with the same result at any size.
    """
    spark = projection.sparkSession
    edges = materialize(projection.select("u", "v", "weight"), "network-edges")
    names = edges.select(F.explode(F.array("u", "v")).alias("provider")).distinct()
    nodes = materialize(names.withColumn("id", F.monotonically_increasing_id()), "network-nodes")
    n = nodes.count()
    sources = nodes if pivots is None or pivots >= n else nodes.orderBy(F.xxhash64("provider"), "provider").limit(pivots)
    used = n if pivots is None else min(pivots, n)
    a, b = nodes.select(F.col("provider").alias("u"), F.col("id").alias("a")), nodes.select(F.col("provider").alias("v"), F.col("id").alias("b"))
    numbered = edges.join(a, "u").join(b, "v").select("a", "b", F.col("weight").cast("double").alias("weight"))
    both = materialize(numbered.unionByName(numbered.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "network-both-ways")
    sources = materialize(sources.join(_detours(both, n), "id", "left_semi"), "sources")
    if sources.isEmpty():
        summed = sources.select("id", F.lit(0.0).alias("b"))
    elif both.limit(2 * ADJACENCY_EDGES + 1).count() <= 2 * ADJACENCY_EDGES:
        summed = _over_adjacency(spark, both, sources)
    else:
        summed = _over_joins(both, sources.select(F.col("id").alias("s")))
    scale = (n / used) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.join(summed, "id", "left").select("provider", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


#: Edges of which the adjacency (two numbers an edge and way) is sent to each executor.
ADJACENCY_EDGES = 2_000_000
#: Distances that differ by less are the same.
SAME = 1e-9


def _detours(both: DataFrame, n: int) -> DataFrame:
    """Rows ``(id)``: sources from which a shortest path may have more than one edge. The weights are not negative.

    A path of more edges is at least as long as its first edge with the lightest one at its end. If a source has edges to all
    others and none is as long as the least such sum, each of them is its only shortest path, and no node lies between.
    """
    light = both.groupBy(F.col("a").alias("b")).agg(F.min("weight").alias("light"))
    at = both.where("a <> b").join(light, "b").groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("near"), F.max("weight").alias("longest"), F.min(F.col("weight") + F.col("light")).alias("least"))
    return at.where((F.col("near") < n - 1) | (F.col("least") <= F.col("longest") + SAME)).select("id")


def _over_adjacency(spark, both: DataFrame, sources: DataFrame) -> DataFrame:
    got = both.toArrow()  # at most 2 * ADJACENCY_EDGES rows of three numbers
    ids, index = np.unique(np.concatenate([got["a"].to_numpy(), got["b"].to_numpy()]), return_inverse=True)
    src, dst = index[: got.num_rows], index[got.num_rows :]
    order = np.argsort(src, kind="stable")
    starts = np.searchsorted(src[order], np.arange(len(ids) + 1))
    shared = spark.sparkContext.broadcast((ids, starts, dst[order].astype(np.int32), got["weight"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, near, weight = shared.value
        total = np.zeros(len(ids))
        for batch in batches:
            for s in np.searchsorted(ids, batch.column("id").to_numpy()).tolist():
                total += _dependencies(starts, near, weight, s)
        on = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(ids[on]), "b": pa.array(total[on])})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sources.select("id").repartition(parts, "id").mapInArrow(run, "id long, b double").groupBy("id").agg(F.sum("b").alias("b"))


def _dependencies(starts: np.ndarray, near: np.ndarray, weight: np.ndarray, s: int) -> np.ndarray:
    """How many shortest paths from s go through each node (Brandes, 2001), a node's neighbours at a time."""
    n = len(starts) - 1
    dist, sigma, closed, done = np.full(n, np.inf), np.zeros(n), np.zeros(n, bool), []
    dist[s], sigma[s] = 0.0, 1.0
    heap = [(0.0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if closed[v]:
            continue
        closed[v] = True
        done.append(v)
        own = slice(starts[v], starts[v + 1])
        to, nd = near[own], dist[v] + weight[own]
        less = nd < dist[to] - SAME
        same = ~less & (np.abs(nd - dist[to]) <= SAME) & ~closed[to]
        sigma[to[same]] += sigma[v]
        dist[to[less]] = nd[less]
        sigma[to[less]] = sigma[v]
        for x, w in zip(nd[less].tolist(), to[less].tolist()):
            heapq.heappush(heap, (x, w))
    delta = np.zeros(n)
    for w in reversed(done):
        own = slice(starts[w], starts[w + 1])
        to = near[own]
        before = np.abs(dist[to] + weight[own] - dist[w]) <= SAME  # neighbours that come before w on shortest paths
        delta[to[before]] += sigma[to[before]] / sigma[w] * (1 + delta[w])
    delta[s] = 0.0
    return delta


def _over_joins(both: DataFrame, sources: DataFrame) -> DataFrame:
    """The same on edges that no task holds: rows (source, node, distance, paths) grow by joins, a step of edges at a time.

    Distances first, until none falls; then paths along edges that lie on shortest ones, by number of steps, and back. A node
    that is so far from the source that its lightest edge leads beyond the farthest node goes no further.
    """
    edge = both.select(F.col("a").alias("v"), F.col("b").alias("w"), "weight")
    light = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("weight").alias("light")), "lightest-edges")
    n = light.count()
    dist = materialize(sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("new")), "distances")
    while True:
        reach = dist.groupBy("s").agg(F.when(F.count(F.lit(1)) == n, F.max("d")).alias("far"))  # NULL: there may be nodes not seen yet
        ahead = dist.where("new").join(light, "v").join(reach, "s").where(F.col("far").isNull() | (F.col("d") + F.col("light") <= F.col("far") + SAME))
        reached = ahead.join(edge, "v").select("s", F.col("w").alias("v"), (F.col("d") + F.col("weight")).alias("d"), F.lit(True).alias("new"))
        # Of each node the least distance, and whether it is less than before.
        old = F.min(F.when(F.col("old"), F.col("d")))
        best = dist.withColumn("old", F.lit(True)).unionByName(reached.withColumn("old", F.lit(False))).groupBy("s", "v").agg(F.min("d").alias("d"), old.alias("was"))
        dist = materialize(best.select("s", "v", F.when(F.col("was") - F.col("d") <= SAME, F.col("was")).otherwise(F.col("d")).alias("d"), (F.col("was").isNull() | (F.col("was") - F.col("d") > SAME)).alias("new")), "distances")
        if dist.where("new").isEmpty():
            break
    d = dist.select("s", "v", "d")
    ahead = d.select("s", F.col("v").alias("w"), F.col("d").alias("e"))
    from_ = d.join(light, "v").join(d.groupBy("s").agg(F.max("d").alias("far")), "s").where(F.col("d") + F.col("light") <= F.col("far") + SAME).select("s", "v", "d")
    tight = materialize(from_.join(edge, "v").join(ahead, ["s", "w"]).where(F.abs(F.col("d") + F.col("weight") - F.col("e")) <= SAME).select("s", "v", "w"), "tight-edges")
    # A node is settled when all edges into it are: rounds of counting what still comes in.
    into = tight.groupBy("s", F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("wait"))
    state = materialize(d.select("s", "v").join(into, ["s", "v"], "left").select("s", "v", F.coalesce("wait", F.lit(0)).alias("wait"), F.when(F.col("s") == F.col("v"), 1.0).otherwise(0.0).alias("sigma"), F.when(F.col("wait").isNull(), 0).alias("step")), "paths")
    step = 0
    while not state.where(F.col("step") == step).isEmpty():
        sent = state.where(F.col("step") == step).join(tight, ["s", "v"]).groupBy("s", F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("came"), F.sum("sigma").alias("more"))
        left = F.col("wait") - F.coalesce("came", F.lit(0))
        got = state.join(sent, ["s", "v"], "left").select("s", "v", left.alias("wait"), (F.col("sigma") + F.coalesce("more", F.lit(0.0))).alias("sigma"), F.when(F.col("step").isNull() & (left == 0), step + 1).otherwise(F.col("step")).alias("step"))
        state, step = materialize(got, "paths"), step + 1
    sigma = state.select("s", "v", "sigma", "step")
    delta = sigma.select("s", "v", F.lit(0.0).alias("delta"))
    behind = sigma.select("s", F.col("v").alias("w"), F.col("sigma").alias("sw"), "step")
    for k in range(step - 1, 0, -1):
        share = behind.where(F.col("step") == k).join(delta.select("s", F.col("v").alias("w"), "delta"), ["s", "w"]).join(tight, ["s", "w"]).join(sigma.select("s", "v", "sigma"), ["s", "v"])
        more = share.groupBy("s", "v").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("delta"))).alias("more"))
        delta = materialize(delta.join(more, ["s", "v"], "left").select("s", "v", (F.col("delta") + F.coalesce("more", F.lit(0.0))).alias("delta")), "dependencies")
    return delta.where("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("b"))


def network_table(table: DataFrame, enriched: DataFrame, betweenness: DataFrame | None = None) -> DataFrame:
    """Communities, the largest first, with their figures in [0, 1]; ``betweenness`` gives the centrality of hubs."""
    out = table.join(enriched, "community", "left")
    if betweenness is not None:
        out = out.join(betweenness.select(F.col("provider").alias("hub"), F.col("betweenness").alias("hub_centrality")), "hub", "left")
    centrality = F.coalesce("hub_centrality", F.lit(0.0)) if betweenness is not None else F.lit(0.0)
    share = lambda c, by: F.round(F.least(F.col(c) / by, F.lit(1.0)), 4)
    scores = {"hard_link_score": share("hard_links", F.col("size")), "referral_score": share("referrals", 5 * F.col("size")), "concentration_score": share("edge_type_count", F.lit(5.0)), "ownership_score": share("ownership", F.col("size")), "hub_centrality": F.round(centrality, 4), "documented_group": F.lit(False)}
    numbers = W.ranked(out.select("community", "size"), [F.desc("size"), F.col("community")], "_rank")
    return out.join(numbers.select("community", "_rank"), "community").withColumns(scores | {"network_id": F.format_string("NET-%04d", F.col("_rank"))}).drop("_rank")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, edge_types: tuple[str, ...] = (), min_weight: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` steps of the seeds (column ``id``) with their distance, and the edges among them."""
    kept = edges.where(F.col("weight") >= min_weight)
    if edge_types:
        kept = kept.where(F.col("edge_type").isin(list(edge_types)))
    both = kept.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(kept.select("dst", "src")).distinct()
    seen = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    for k in range(1, depth + 1):
        front = seen.where(F.col("hops") == k - 1).join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.lit(k).alias("hops"))
        seen = materialize(seen.unionByName(front).groupBy("id").agg(F.min("hops").alias("hops")), "frontier")
    ids = seen.select("id")
    return seen, kept.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def community_subgraph(edges: DataFrame, communities: DataFrame, community: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around the hub of one community (table with ``community`` and ``hub``); an unknown one gives none."""
    return neighbourhood(edges, communities.where(F.col("community") == community).select(F.col("hub").alias("id")), depth)


def member_cohorts(claims: DataFrame, provider_ids: DataFrame, least: int = 5) -> DataFrame:
    """Members of these providers by the set of them that they see; one row if there are more than ``least`` members."""
    rows = claims.join(provider_ids, "provider_id", "left_semi").where("member_id is not null")
    sets = rows.groupBy("member_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("provider_id").cast("string"))), ",").alias("providers"))
    return sets.groupBy("providers").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > least)


def narratives(edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """Rows ``(provider, text)``: what connects each provider that has an edge of the graph with others, in a sentence.

    ``communities(provider, number, size, category)`` adds a second one.
    """
    focal = lambda c: F.col(c).startswith("provider:")
    value = F.col("dst").startswith("shared_")
    named = numbered(edges.select(F.explode(F.array("src", "dst")).alias("provider")).where(focal("provider")).distinct(), "provider-numbers")
    src, dst = named.select(F.col("provider").alias("src"), F.col("id").alias("a")), named.select(F.col("provider").alias("dst"), F.col("id").alias("b"))
    members = edges.where(value).join(src, "src").select(F.col("a").alias("id"), F.col("dst").alias("cls"), F.col("edge_type").alias("kind"))
    direct = edges.where(focal("dst") & (F.col("src") != F.col("dst"))).join(src, "src").join(dst, "dst").select("a", "b", F.col("edge_type").alias("kind"))
    size = members.groupBy("cls").agg((F.count(F.lit(1)) - 1).alias("n"))
    one = F.lit(1).cast("long").alias("n")
    works = edges.where("edge_type = 'works_at'").join(src, "src").select(F.col("a").alias("id"), F.lit("works_at").alias("kind"), one)
    kinds = members.join(size, "cls").select("id", "kind", "n").unionByName(both_ways(direct).select(F.col("a").alias("id"), "kind", one)).unionByName(works)
    groups = {"shared bank account link(s)": ("shared_bank_hash",), "shared TIN hash link(s)": ("shared_tin_hash",), "shared ownership relationship(s)": OWNERSHIP, "referral relationship(s)": ("refers_to",), "facility connection(s)": FACILITY, "shared address link(s)": ADDRESS}
    of = lambda names: F.sum(F.when(F.col("kind").isin(*names), F.col("n")).otherwise(0))
    counts = kinds.groupBy("id").agg(*(of(k).alias(f"_{i}") for i, k in enumerate(groups.values())), of(("works_at",)).alias("facilities"))
    met = neighbour_counts(members, direct)
    phrases = [F.when(F.col(f"_{i}") > 0, F.concat(F.col(f"_{i}").cast("string"), F.lit(f" {name}"))) for i, name in enumerate(groups)]
    said = F.concat_ws(", ", *phrases)
    id_ = F.regexp_replace("provider", "^provider:", "")
    text = F.concat(F.lit("Provider "), id_, F.lit(" is connected to "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" provider(s)"), F.when(F.col("facilities") > 0, F.concat(F.lit(" and "), F.col("facilities").cast("string"), F.lit(" facility(ies)"))).otherwise(""), F.when(said != "", F.concat(F.lit(" via "), said)).otherwise(""), F.lit("."))
    out = named.join(counts, "id", "left").join(met, "id", "left").fillna(0, ["facilities"]).withColumn("text", text)
    if communities is not None:
        more = F.format_string(" Provider belongs to Community C%02d (%d providers), classified as a %s.", F.col("number").cast("int"), F.col("size").cast("int"), F.col("category"))
        out = out.join(communities.select("provider", "number", "size", "category"), "provider", "left").withColumn("text", F.concat("text", F.coalesce(F.when(F.col("number").isNotNull(), more), F.lit(""))))
    return out.select("provider", "text")
