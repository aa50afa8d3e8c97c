"""Queries of investigators over stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.operators import windows as W


def summary(claims: DataFrame, alerts: DataFrame, cases: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of counts from claims to queued cases."""
    parts = [
        claims.agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("provider_id").alias("providers"), F.countDistinct("member_id").alias("members"), F.sum("paid_amount").alias("paid")),
        alerts.agg(F.count(F.lit(1)).alias("alerts"), F.countDistinct("entity_id").alias("alerted_entities")),
        cases.agg(F.count(F.lit(1)).alias("cases"), F.sum(F.when(F.col("priority").isin("HIGH", "CRITICAL"), 1).otherwise(0)).alias("high_cases"), F.sum("exposure_high").alias("exposure_high")),
        queue.agg(F.sum(F.when(F.col("queue_status") == "QUEUED", 1).otherwise(0)).alias("queued")),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each


#: What a listing is sorted by, and then by; the case id comes last.
_QUEUE_ORDER = {"priority": (F.asc, ("queue_rank",)), "value": (F.desc, ("value_per_hour", "risk_score")), "risk": (F.desc, ("risk_score", "value_per_hour"))}


def queue_page(queue: DataFrame, sort_by: str = "priority", capacity_hours: float | None = None, status: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """A page of the queue with ``queue_status``, ``capacity_rank`` and ``slot``.

    With hours, items that fit are taken in order and the others are deferred (rank 0, slot 999), but stay in the queue; ``status``
    (QUEUED, also called ADDRESSABLE, or DEFERRED) chooses after that. Without hours every item is queued.
    """
    if sort_by not in _QUEUE_ORDER:
        raise ValueError(f"sort_by {sort_by!r}")
    way, columns = _QUEUE_ORDER[sort_by]
    order = [*(way(c) for c in columns if c in queue.columns), F.asc("case_id")]
    rows = W.ranked(queue, order, "_place")
    if capacity_hours is None:
        rows = rows.withColumns({"selected": F.lit(True), "capacity_rank": F.col("_place")})
    else:
        rows = W.greedy_capacity(rows, capacity_hours, "_place")
        taken = W.ranked(rows.where("selected").select("case_id", "_place"), [F.asc("_place")], "capacity_rank")
        rows = rows.join(taken.select("case_id", "capacity_rank"), "case_id", "left").withColumn("capacity_rank", F.coalesce("capacity_rank", F.lit(0)))
    rows = rows.withColumns({"queue_status": F.when(F.col("selected"), "QUEUED").otherwise("DEFERRED"), "slot": F.when(F.col("selected"), F.col("capacity_rank")).otherwise(999)})
    wanted = (status or "").strip().upper()
    if wanted in ("QUEUED", "ADDRESSABLE"):
        rows = rows.where("selected")
    elif wanted == "DEFERRED":
        rows = rows.where("not selected")
    rows = rows.orderBy("_place").drop("_place").offset(offset)
    return rows if limit is None else rows.limit(limit)


def case_detail(case_id: str, cases: DataFrame, evidence: DataFrame, alerts: DataFrame, claims: DataFrame, most: int = 50) -> dict[str, DataFrame]:
    """The case, its evidence by amount, its alerts and up to fifty of its claims."""
    case = cases.where(F.col("case_id") == case_id)
    ids = case.select(F.explode("case_claims").alias("claim_id")).distinct()
    mine = claims.withColumn("claim_id", F.col("claim_id").cast("string")).join(ids, "claim_id").orderBy(F.desc("service_date"), "claim_id").limit(most)
    own = alerts.join(case.select(F.explode("case_alerts").alias("alert_id")), "alert_id", "left_semi")
    return {"case": case, "evidence": evidence.where(F.col("case_id") == case_id).orderBy(F.desc_nulls_last("amount"), "source"), "alerts": own, "claims": mine}


def evidence_ledger(evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """Evidence of each case; shared-identity rows must name the provider, and some rules carry no amount."""
    rows = evidence.join(cases.select("case_id", "provider_id"), "case_id")
    named = (F.coalesce("rule_id", F.lit("")) != "R09") | F.contains("text", F.col("provider_id"))
    amount = F.when(F.coalesce("rule_id", F.lit("")).isin("R06", "R08", "R09") & (F.col("amount") == 0), F.lit(None)).otherwise(F.col("amount"))
    return rows.where(named).withColumn("amount", amount)


def timeline(provider_id, claims: DataFrame, alerts: DataFrame, dates: int = 20) -> DataFrame:
    """The last service days of a provider and its alerts, newest first."""
    days = claims.where(F.col("provider_id") == provider_id).groupBy(F.col("service_date").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("paid_amount").alias("amount"))
    last = days.orderBy(F.desc("date")).limit(dates).select("date", F.lit("claims").alias("kind"), "n", "amount", F.lit(None).cast("string").alias("text"))
    found = alerts.where((F.col("entity_type") == "provider") & (F.col("entity_id") == str(provider_id))).select(
        F.try_to_date(F.try_element_at("metadata", F.lit("service_date"))).alias("date"), F.lit("alert").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("est_dollars").alias("amount"), F.col("evidence")[0]["plain_text"].alias("text")
    )
    return last.unionByName(found).orderBy(F.desc_nulls_last("date"), "kind", "text")


def ego_network(provider: str, edges: DataFrame, hubs: DataFrame, membership: DataFrame, most: int = 15) -> DataFrame:
    """Up to fifteen referral edges of a provider and the edge to the hub of its community."""
    ref = edges.where((F.col("edge_type") == "refers_to") & ((F.col("src") == provider) | (F.col("dst") == provider))).orderBy(F.desc("weight"), "src", "dst").limit(most).select("src", "dst", "edge_type", "weight")
    hub = membership.where(F.col("provider") == provider).join(hubs.select("community", "hub"), "community").where(F.col("hub") != provider).select(F.col("provider").alias("src"), F.col("hub").alias("dst"), F.lit("hub").alias("edge_type"), F.lit(1.0).alias("weight"))
    return ref.unionByName(hub)


def audit_page(audit: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return audit.orderBy(F.desc("decided_at"), "case_id").offset(offset).limit(limit)


def networks_page(networks: DataFrame, hard_only: bool = False, network_id: str | None = None, limit: int = 50) -> DataFrame:
    rows = networks.where("hard_links > 0") if hard_only else networks
    if network_id is not None:
        rows = rows.where(F.col("network_id") == network_id)
    return rows.orderBy(F.desc_nulls_last("total_paid"), "network_id").limit(limit)


def claims_page(claims: DataFrame, provider_id=None, member_id=None, procedure_code=None, limit: int = 50, offset: int = 0) -> DataFrame:
    for c, v in (("provider_id", provider_id), ("member_id", member_id), ("procedure_code", procedure_code)):
        if v is not None:
            claims = claims.where(F.col(c) == v)
    return claims.orderBy(F.desc("service_date"), "claim_id").offset(offset).limit(limit)


def providers_page(providers: DataFrame, specialty: str | None = None, county: str | None = None, provider_id=None, limit: int = 50, offset: int = 0) -> DataFrame:
    for c, v in (("specialty", specialty), ("county", county)):
        if v is not None:
            providers = providers.where(F.lower(c) == v.lower())
    if provider_id is not None:
        providers = providers.where(F.col("provider_id") == provider_id)
    return providers.orderBy("provider_id").offset(offset).limit(limit)


def risk_info(scores: DataFrame, provider_id: str | None = None, top: int = 50) -> DataFrame:
    return scores.where(F.col("provider_id") == provider_id) if provider_id is not None else scores.orderBy(F.desc("risk_score"), "provider_id").limit(top)


def evidence_packets(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """One nested row for each case: ids that a text about it may name, and its facts."""
    rules = evidence.groupBy("case_id").agg(F.sort_array(F.collect_set("rule_id")).alias("rule_ids"), F.count(F.lit(1)).alias("evidence_count"))
    facts = F.struct("risk_score", "evidence_strength", "confidence", "estimated_exposure", "exposure_low", "exposure_high", "claim_count").alias("facts")
    return cases.join(rules, "case_id", "left").select("case_id", F.array("provider_id").alias("provider_ids"), F.col("case_claims").alias("claim_ids"), F.coalesce("rule_ids", F.array().cast("array<string>")).alias("rule_ids"), F.array_compact(F.array("community_id")).alias("network_ids"), facts)


def audit_narratives(briefs: DataFrame, packets: DataFrame, claim_pattern: str = r"CLM[A-Z0-9-]+", provider_pattern: str = r"PRV[A-Z0-9-]+") -> DataFrame:
    """Ids and amounts that a brief (case_id, text) must not hold: unknown ids, dollars over 1.15 of the high exposure, wording."""
    found = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)))
    met = briefs.join(packets, "case_id", "left")
    none = F.array().cast("array<string>")
    dollars = F.transform(F.regexp_extract_all("text", F.lit(r"\$([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").cast("double"))
    limit = F.greatest(1.15 * F.coalesce(F.col("facts.exposure_high"), F.lit(0.0)), F.lit(1000.0))
    out = met.withColumns(
        {
            "unknown_claims": F.array_except(found(claim_pattern), F.coalesce("claim_ids", none)), "unknown_providers": F.array_except(found(provider_pattern), F.coalesce("provider_ids", none)),
            "unknown_rules": F.array_except(found(r"\bR(?:0[1-9]|10)\b"), F.coalesce("rule_ids", none)), "unknown_networks": F.array_except(found(r"NET-[0-9]+"), F.coalesce("network_ids", none)),
            "excess_dollars": F.filter(dollars, lambda x: x > limit), "prohibited": C.has_prohibited(F.col("text")),
        }
    )
    bad = reduce(lambda a, b: a | b, (F.size(c) > 0 for c in ("unknown_claims", "unknown_providers", "unknown_rules", "unknown_networks", "excess_dollars")))
    return out.withColumn("passes", ~(bad | F.col("prohibited"))).select("case_id", "unknown_claims", "unknown_providers", "unknown_rules", "unknown_networks", "excess_dollars", "prohibited", "passes")
