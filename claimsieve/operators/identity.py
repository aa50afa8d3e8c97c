"""Provider identity: links over shared attributes and clusters of linked providers.

All pairs of a value that very many providers share (a common agent, a large building) would be the square of them, so a value
links each of its providers to its smallest one, at every size. The clusters are those of all pairs, and ``links`` says how many
pairs of providers a row stands for: those of its value, split evenly over its rows, so that sums of it count all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.operators import rules as R
from claimsieve.operators.graph import numbered
from claimsieve.plans.components import connected_components
from claimsieve.plans.storage import materialize
from claimsieve.sources.config import RuleConfig

#: How much a link of a kind counts.
WEIGHTS = {"bank_hash": 1.0, "tin_hash": 1.0, "owner_exact": 0.9, "owner_fuzzy": 0.7, "address_suite": 0.6, "address_no_suite": 0.4, "registered_agent": 0.8}
LINK_COLUMNS = ["provider_a", "provider_b", "basis", "confidence", "weight", "detail", "links"]


def value_members(providers: DataFrame, value: Column) -> DataFrame:
    """Rows ``(value, provider_id, n, least)`` of values that ``n`` > 1 providers share; ``least`` is the smallest of them."""
    rows = providers.select("provider_id", value.alias("value")).where("value is not null").distinct()
    return rows.join(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("provider_id").alias("least")).where("n > 1"), "value")


def _stars(providers: DataFrame, value: Column) -> DataFrame:
    """Each provider of a value with the smallest one of it; ``n`` is how many share it."""
    met = value_members(providers, value).where("provider_id > least")
    return met.select(F.col("least").alias("provider_a"), F.col("provider_id").alias("provider_b"), "value", "n", (F.col("n") / 2).alias("links"))


def _links(pairs: DataFrame, basis: str | Column, confidence: float | Column, weight: float | Column, detail: Column) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return pairs.select("provider_a", "provider_b", as_col(basis).alias("basis"), as_col(confidence).cast("double").alias("confidence"), as_col(weight).cast("double").alias("weight"), detail.alias("detail"), F.col("links").cast("double").alias("links"))


def exact_links(providers: DataFrame, column: str) -> DataFrame:
    """Providers with the same bank or tax hash."""
    return _links(_stars(providers, F.col(column)), column, 1.0, WEIGHTS[column], F.col("value").cast("string"))


def address_links(providers: DataFrame, building: int = 5) -> DataFrame:
    """Same address and suite, and same address only; a building with many providers counts little and is tagged.

    Of an address only, those are linked to its smallest provider that do not share its suite: the pairs that they stand for
    are all of the address less those within a suite.
    """
    base, own = C.split_suite(F.col("address"))
    suite = F.coalesce(F.lower("suite"), own) if "suite" in providers.columns else own
    rows = providers.select("provider_id", C.normal_address(base).alias("addr"), suite.alias("unit")).where("addr is not null").distinct()
    with_suite = _stars(rows, F.when(F.col("unit").isNotNull(), F.concat_ws("|", "addr", "unit")))
    square = F.col("s") * (F.col("s") - 1) / 2
    suites = rows.groupBy("addr", "unit").agg(F.count(F.lit(1)).alias("s"), F.min("provider_id").alias("low"))
    sizes = suites.groupBy("addr").agg(
        F.sum("s").alias("n"), F.sum(F.when(F.col("unit").isNotNull(), square).otherwise(0.0)).alias("within"), F.min("low").alias("least"), F.min_by(F.struct("unit", "s"), "low").alias("of")
    )
    sizes = sizes.withColumn("rows", F.when(F.col("of.unit").isNotNull(), F.col("n") - F.col("of.s")).otherwise(F.col("n") - 1)).where("n > 1 and rows > 0")
    met = rows.join(sizes, "addr").where("provider_id <> least and not coalesce(unit = of.unit, false)")
    only = met.select(
        F.col("least").alias("provider_a"), F.col("provider_id").alias("provider_b"), F.col("addr").alias("value"), "n", ((F.col("n") * (F.col("n") - 1) / 2 - F.col("within")) / F.col("rows")).alias("links")
    )
    mob = F.col("n") >= building
    tag = F.when(mob, F.concat(F.lit("[MOB] "), F.col("value"))).otherwise(F.col("value"))
    weight = WEIGHTS["address_no_suite"]
    return _links(with_suite, "address_suite", 0.9, WEIGHTS["address_suite"], F.col("value")).unionByName(_links(only, "address_no_suite", F.when(mob, 0.3).otherwise(0.6), F.when(mob, weight / 2).otherwise(weight), tag))


#: Names of a block; what a task compares at a time are the names of two blocks.
NAMES = 1024
#: Letters are counted in so many kinds.
_KINDS = 64


def _by_words(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(owner, other)`` of which the shared words alone score the threshold or more against one of the texts.

    A text is looked up by its rarest words, so many that without them too little of it would be left.
    """
    shared = threshold / (200 - threshold)  # of a text's letters, those of shared words: 2 s / (s + 1) >= threshold / 100
    texts = names.select("owner", F.array_distinct(F.split("text", " ")).alias("words")).withColumn("size", F.length(F.array_join("words", " ")))
    words = texts.select("owner", "words", "size", F.explode("words").alias("word"))
    words = words.join(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word")
    w = Window.partitionBy("owner").orderBy("n", "word").rowsBetween(Window.unboundedPreceding, -1)
    rare = words.withColumn("before", F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0))).where(F.col("before") <= (1 - shared) * (F.col("size") + 1))
    other = words.select(F.col("owner").alias("other"), F.col("words").alias("theirs"), F.col("size").alias("length"), "word")
    both = F.length(F.array_join(F.array_intersect("words", "theirs"), " "))
    enough = 200 * both >= threshold * (both + F.least("size", "length"))
    return rare.join(other, "word").where((F.col("owner") != F.col("other")) & enough).select("owner", "other")


def _by_letters(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(owner, other)`` of which the letters of both texts, in any order, leave room for the threshold.

    A letter that one text has more often than the other has to be added or taken away. All names of two blocks, in order of
    their length, are compared by how often each has each letter; blocks of which the lengths alone are too far apart never meet.
    """
    differ = 1 - threshold / 100  # of the letters of both
    texts = names.select("owner", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("text")).withColumn("size", F.length("text"))
    at = numbered(texts.orderBy("size", "owner"), "names-by-length").withColumn("block", F.expr(f"id div {NAMES}"))
    ends = at.groupBy("block").agg(F.min("size").alias("low"), F.max("size").alias("high"))  # a row for so many names
    i, j = ends.select(F.col("block").alias("i"), "high"), ends.select(F.col("block").alias("j"), "low")
    tiles = materialize(i.join(j, F.col("i") <= F.col("j")).where(F.col("low") * (1 - differ) <= F.col("high") * (1 + differ) + 1e-6).select("i", "j"), "tiles-of-names")
    left = tiles.join(at.withColumnRenamed("block", "i"), "i").select("i", "j", "id", "owner", "text")
    right = tiles.join(at.withColumnRenamed("block", "j"), "j").select(*(F.col(c).alias(f"to_{c}") for c in ("i", "j", "id", "owner", "text")))
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work
    left, right = left.repartition(n, "i", "j"), right.repartition(n, "to_i", "to_j")
    return left.groupBy("i", "j").cogroup(right.groupBy("to_i", "to_j")).applyInArrow(_tile_names(differ), "owner string, other string")


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text has letters of each kind, a row a kind."""
    of = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) % _KINDS
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(of.astype(np.int64) * len(texts) + row, minlength=_KINDS * len(texts)).reshape(_KINDS, len(texts)).astype(np.int32)


def _tile_names(differ: float):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = _letters(left.column("text").to_pylist()), _letters(right.column("to_text").to_pylist())
        apart = np.zeros((x.shape[1], y.shape[1]), np.int32)
        for k in np.flatnonzero(x.any(axis=1) | y.any(axis=1)):
            apart += np.abs(x[k][:, None] - y[k][None, :])
        room = differ * (x.sum(axis=0)[:, None] + y.sum(axis=0)[None, :]) + 1e-6
        once = left.column("id").to_numpy()[:, None] < right.column("to_id").to_numpy()[None, :]
        a, b = np.nonzero((apart <= room) & once)
        return pa.table({"owner": left.column("owner").take(pa.array(a)), "other": right.column("to_owner").take(pa.array(b))})

    return compare


def similar_names(names: DataFrame, threshold: float = 88.0) -> DataFrame:
    """Pairs ``(owner, owner_b, score)`` of distinct names (``owner``, ``plain``) with ``owner`` < ``owner_b``.

    Two names score that much only if the words they share make up most of one of them, or if they are much the same letter
    by letter. For the first, a name is looked up by its rarest words, and words are compared where names meet. For the second,
    names of much the same letters are found in tiles of two blocks, so that no row is made for a pair of other letters.
    """
    names = materialize(names, "names")
    texts = [names.select("owner", F.col(c).alias("text")) for c in ("owner", "plain")]
    found = reduce(DataFrame.unionByName, (by(t, threshold) for t in texts for by in (_by_words, _by_letters)))
    found = materialize(found.select(F.least("owner", "other").alias("owner"), F.greatest("owner", "other").alias("owner_b")).distinct(), "names-to-score")
    plain = found.join(names, "owner").join(names.select(F.col("owner").alias("owner_b"), F.col("plain").alias("plain_b")), "owner_b")
    plain = plain.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # scoring takes longer than moving
    return plain.select("owner", "owner_b", "plain", "plain_b").mapInArrow(_scored(threshold), "owner string, owner_b string, score double")


def _scored(threshold: float):
    """Pairs of names with their score, once each, of those that reach the threshold."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(c).to_pylist() for c in ("owner", "owner_b", "plain", "plain_b")]
            found = [max(C.token_set(a, b), -1.0 if p is None or q is None else C.token_set(p, q)) for a, b, p, q in zip(*texts)]
            rows = pa.record_batch({"owner": batch.column("owner"), "owner_b": batch.column("owner_b"), "score": pa.array(found, pa.float64())})
            yield rows.filter(pa.array([x >= threshold for x in found], pa.bool_()))

    return score


def owner_links(providers: DataFrame, threshold: float = 88.0) -> DataFrame:
    """Owners of the same name without corporate endings, and of similar names (``similar_names``).

    Two similar names link the smallest providers of both and stand for all pairs of one's providers with the other's.
    """
    rows = providers.select("provider_id", C.normal_name(F.col("owner_name")).alias("plain"), C.normal_name(F.col("owner_name"), True).alias("owner")).where("owner is not null")
    exact = _links(_stars(rows, F.col("owner")), "owner_exact", 0.95, WEIGHTS["owner_fuzzy"] + 0.2, F.col("value"))
    names = rows.groupBy("owner").agg(F.min("plain").alias("plain"), F.countDistinct("provider_id").alias("n"), F.min("provider_id").alias("least"))
    a = names.select("owner", F.col("n").alias("na"), F.col("least").alias("pa"))
    b = names.select(F.col("owner").alias("owner_b"), F.col("n").alias("nb"), F.col("least").alias("pb"))
    pairs = similar_names(names.select("owner", "plain"), threshold).join(a, "owner").join(b, "owner_b").where("pa <> pb")
    pairs = pairs.select(F.least("pa", "pb").alias("provider_a"), F.greatest("pa", "pb").alias("provider_b"), "score", F.concat_ws(" ~ ", "owner", "owner_b").alias("value"), (F.col("na") * F.col("nb")).alias("links"))
    return exact.unionByName(_links(pairs, "owner_fuzzy", F.col("score") / 100, WEIGHTS["owner_fuzzy"], F.col("value")))


def agent_links(providers: DataFrame) -> DataFrame:
    return _links(_stars(providers, C.normal_name(F.col("registered_agent"))), "registered_agent", 0.85, WEIGHTS["registered_agent"], F.col("value"))


def identity_links(providers: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """All links that the columns of the table allow."""
    have = set(providers.columns)
    parts = [exact_links(providers, c) for c in ("bank_hash", "tin_hash") if c in have]
    if "address" in have:
        parts.append(address_links(providers, cfg.office_building))
    if "owner_name" in have:
        parts.append(owner_links(providers, cfg.fuzzy_owner))
    if "registered_agent" in have:
        parts.append(agent_links(providers))
    if not parts:
        return providers.sparkSession.createDataFrame([], "provider_a string, provider_b string, basis string, confidence double, weight double, detail string, links double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def identity_clusters(links: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """Clusters of linked providers: members, bases, confidence, and whether all are of one documented group."""
    members = connected_components(links, "provider_a", "provider_b").select(F.col("node").alias("provider_id"), F.col("component").alias("cluster_id"))
    of_links = links.join(members.withColumnRenamed("provider_id", "provider_a"), "provider_a").groupBy("cluster_id").agg(
        F.sort_array(F.collect_set("basis")).alias("bases"), F.max("confidence").alias("confidence"), F.round(F.sum("links")).cast("long").alias("link_count")
    )
    if providers is not None and "group_id" in providers.columns:
        members = members.join(providers.select("provider_id", "group_id"), "provider_id", "left")
        documented = (F.countDistinct("group_id") == 1) & (F.count("group_id") == F.count(F.lit(1)))
    else:
        documented = F.lit(False)
    sized = members.groupBy("cluster_id").agg(F.sort_array(F.collect_set("provider_id")).alias("provider_ids"), F.countDistinct("provider_id").alias("size"), documented.alias("documented"))
    return sized.join(of_links, "cluster_id")


def shared_identity(tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Clusters of two or more that are linked by more than addresses."""
    return _suspicious(identity_clusters(identity_links(tables["providers"], cfg), tables["providers"]))


def _suspicious(clusters: DataFrame) -> DataFrame:
    return clusters.where(F.exists("bases", lambda b: ~b.startswith("address"))).where("size >= 2")


def cluster_links(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """All links within the given clusters, one a row, with ``cluster_id`` and ``n``, their number in the cluster."""
    members = clusters.select("cluster_id", F.explode("provider_ids").alias("provider_a"))
    return links.join(members, "provider_a").withColumn("n", F.row_number().over(Window.partitionBy("cluster_id").orderBy("provider_a", "provider_b", "basis", "detail")))


def identity_findings(tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """``shared_identity`` and, as ``more_evidence``, one evidence for each link, of which an alert nests the first ones."""
    links = materialize(identity_links(tables["providers"], cfg), "identity-links")
    clusters = materialize(_suspicious(identity_clusters(links, tables["providers"])), "identity-clusters")
    told = F.format_string("Providers %s and %s share %s: '%s' (confidence: %s).", F.col("provider_a").cast("string"), F.col("provider_b").cast("string"), "basis", F.coalesce("detail", F.lit("")), F.format_number("confidence", 2))
    fields = F.array("basis", *map(F.lit, ("source_id", "target_id", "matched_value")))
    rows = cluster_links(clusters, links).where(F.col("n") <= cfg.listed_links)
    rows = rows.select("cluster_id", F.struct("n", *R._more(F.array().cast("array<string>"), fields, told, F.lit("MEDIUM"))).alias("e"))
    return clusters.join(rows.groupBy("cluster_id").agg(F.sort_array(F.collect_list("e")).alias("more_evidence")), "cluster_id", "left")


def register() -> None:
    R.register_rule(
        "R09",
        lambda t, c: R.to_alerts(
            identity_findings(t, c), "R09", "provider", "cluster_id", F.format_string("%s providers share %s.", F.col("size").cast("string"), F.array_join("bases", ", ")), "MEDIUM", note="Members of a documented group may share these.", cfg=c
        ),
        {"providers": ("provider_id",)},
    )
