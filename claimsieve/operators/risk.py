"""Fusion of seven signal families into one provider score in [0, 1], with contributions, evidence, confidence and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.sources.config import RiskConfig

FAMILIES = ("rules", "ml", "anomaly", "network", "temporal", "future", "historical")


def rule_signal(alerts: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """From provider alerts: number, mean severity, share of HIGH and above, distinct rules and dollars."""
    weight = F.lit(0.0)
    for s, w in cfg.severity.items():
        weight = F.when(F.col("severity") == s, w).otherwise(weight)
    own = alerts.where("entity_type = 'provider' and entity_id is not null")
    per = own.groupBy(F.col("entity_id").alias("provider_id")).agg(
        F.count(F.lit(1)).alias("alert_count"), F.avg(weight).alias("mean_severity"), F.avg(F.col("severity").isin("HIGH", "CRITICAL").cast("double")).alias("high_share"), F.sum(F.col("severity").isin("HIGH", "CRITICAL").cast("int")).alias("high_count"),
        F.countDistinct("rule_id").alias("distinct_rules"), C.exact_sum(F.col("est_dollars")).alias("exposure"), F.sort_array(F.collect_set("rule_id")).alias("rules"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("claim_ids")))).alias("claim_ids"), F.sort_array(F.collect_set("alert_id")).alias("alert_ids"),
    )
    score = (
        0.30 * F.least(F.col("alert_count") / cfg.alert_cap, F.lit(1.0)) + 0.25 * F.col("mean_severity") + 0.20 * F.col("high_share") + 0.15 * F.least(F.col("distinct_rules") / cfg.rule_cap, F.lit(1.0)) + 0.10 * C.log_dollars(F.col("exposure"), cfg.dollar_cap)
    )
    return per.withColumn("rules_signal", C.clip01(score))


def ml_signal(claim_ml: DataFrame, cut: float = 0.5) -> DataFrame:
    """Share of claims at or over the cut and mean probability; calibrated where there is one."""
    p = F.coalesce("calibrated_probability", "ml_probability") if "calibrated_probability" in claim_ml.columns else F.col("ml_probability")
    per = claim_ml.where("provider_id is not null").withColumn("_p", C.finite(p)).groupBy(F.col("provider_id").cast("string").alias("provider_id")).agg(
        F.avg((F.col("_p") >= cut).cast("double")).alias("ml_share"), (C.exact_sum(F.col("_p"), 12) / F.count(F.lit(1))).alias("ml_mean"), F.count(F.lit(1)).alias("ml_claims"), F.sum((F.col("_p") >= cut).cast("int")).alias("ml_high_claims"),
        F.sort_array(F.collect_set(F.when(F.col("_p") >= cut, F.col("claim_id").cast("string")))).alias("ml_claim_ids"),
    )
    return per.withColumn("ml_signal", C.clip01(0.6 * F.col("ml_share") + 0.4 * F.col("ml_mean")))


def anomaly_signal(anomaly: DataFrame) -> DataFrame:
    kept = [c for c in ("anomaly_score", "anomaly_percentile") if c in anomaly.columns]
    return anomaly.select(F.col("provider_id").cast("string").alias("provider_id"), C.clip01(F.col("anomaly_percentile") / 100).alias("anomaly_signal"), F.col("anomaly_flag").cast("int").alias("anomaly_flag"), *kept)


def future_signal(future: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Weighted horizons; weights of missing ones go to the others."""
    cols = ("risk_30d", "risk_60d", "risk_90d")
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in zip(cols, cfg.future)))
    weight = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in zip(cols, cfg.future)))
    return future.select(F.col("provider_id").cast("string").alias("provider_id"), C.clip01(F.when(weight > 0, total / weight)).alias("future_signal"), *cols)


def network_signal(networks: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """From communities (providers array, hub, hard_links, referrals, size, hub_centrality), the same for all of a community.

    ``hub_centrality`` of a provider beside the hub is half of the hub's; the signal counts it in full.
    """
    rows = networks.select(F.explode("providers").alias("node"), "community", "hub", "hard_links", "referrals", "size", "hub_centrality")
    is_hub = F.col("node") == F.col("hub")
    hard, ref = F.least(F.col("hard_links") / F.col("size"), F.lit(1.0)), F.least(F.col("referrals") / (5.0 * F.col("size")), F.lit(1.0))
    score = 0.35 * hard + 0.25 * ref + 0.20 * C.finite(F.col("hub_centrality")) + 0.20 * F.least(F.col("size") / cfg.size_cap, F.lit(1.0))
    columns = {"community_id": F.col("community"), "is_hub": is_hub, "network_signal": C.clip01(score), "hard_links": F.col("hard_links"), "hard_link_score": hard, "community_size": F.col("size"), "hub_centrality": F.col("hub_centrality") * F.when(is_hub, 1.0).otherwise(0.5)}
    out = rows.select(F.regexp_replace("node", "^provider:", "").alias("provider_id"), *(c.alias(n) for n, c in columns.items()))
    return out.groupBy("provider_id").agg(F.max(F.struct("network_signal", *(c for c in columns if c != "network_signal"))).alias("s")).select("provider_id", *(F.col(f"s.{c}").alias(c) for c in columns))


def temporal_signal(burst: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    return burst.select(F.col("provider_id").cast("string").alias("provider_id"), C.clip01(F.col("burst_cv") / cfg.burst_cap).alias("temporal_signal"))


def historical_signal(history: DataFrame) -> DataFrame:
    return history.select(F.col("provider_id").cast("string").alias("provider_id"), C.clip01(F.col("historical_score")).alias("historical_signal"))


def provider_universe(*tables: DataFrame) -> DataFrame:
    """All provider ids of the inputs."""
    return reduce(lambda a, b: a.union(b), (t.select(F.col("provider_id").cast("string").alias("provider_id")).where("provider_id is not null") for t in tables)).distinct()


def _sum(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def fuse(signals: dict[str, DataFrame], universe: DataFrame | None = None, cfg: RiskConfig = RiskConfig(), network_covers_all: bool = True) -> DataFrame:
    """Scores of all providers from the given families (see ``FAMILIES``).

    A family without a value for a provider gives its weight to the others, and its absence lowers the confidence.
    Scores, strength and contributions are rounded to four places, halves up (``C.places``), and contributions are made to sum to
    the score: what is left goes to the largest. Dollars and probabilities are summed as decimals, so in any order.
    """
    base = universe if universe is not None else provider_universe(*signals.values())
    base = base.select(F.col("provider_id").cast("string").alias("provider_id")).distinct()
    for f in FAMILIES:
        base = base.join(signals[f], "provider_id", "left") if f in signals else base.withColumn(f"{f}_signal", F.lit(None).cast("double"))
    if "network" in signals and network_covers_all:
        base = base.fillna(0.0, ["network_signal"])
    more = {"alert_count": "bigint", "claim_ids": "array<string>", "alert_ids": "array<string>", "rules": "array<string>", "exposure": "double", "high_count": "bigint", "distinct_rules": "bigint", "ml_claims": "bigint", "ml_high_claims": "bigint", "hard_links": "double", "hard_link_score": "double", "community_size": "bigint", "ml_share": "double", "ml_mean": "double", "ml_claim_ids": "array<string>", "community_id": "string", "is_hub": "boolean", "anomaly_flag": "int", "anomaly_score": "double", "anomaly_percentile": "double", "risk_30d": "double", "risk_60d": "double", "risk_90d": "double"}
    base = base.withColumns({c: F.lit(None).cast(t) for c, t in more.items() if c not in base.columns})
    have = {f: F.col(f"{f}_signal").isNotNull() for f in FAMILIES}
    value = {f: C.clip01(F.col(f"{f}_signal")) for f in FAMILIES}
    weight = _sum(F.when(have[f], w).otherwise(0.0) for f, w in cfg.weights.items())
    part = {f: F.when(have[f] & (weight > 0), value[f] * w / weight).otherwise(0.0) for f, w in cfg.weights.items()}
    out = base.withColumn("available_weight", weight).withColumn("risk_score", C.places(C.clip01(_sum(part.values())), 4)).withColumns({f"raw_{f}": C.places(p, 4) for f, p in part.items()})
    rest = F.round(F.col("risk_score") - _sum(F.col(f"raw_{f}") for f in FAMILIES), 4)
    largest = F.array_max(F.array(*(F.col(f"raw_{f}") for f in FAMILIES)))
    first = F.array_position(F.array(*(F.col(f"raw_{f}") for f in FAMILIES)), largest)
    out = out.withColumns({"_rest": rest, "_first": first}).withColumns({f"{f}_contribution": F.round(F.col(f"raw_{f}") + F.when(F.col("_first") == i + 1, F.col("_rest")).otherwise(0.0), 4) for i, f in enumerate(FAMILIES)})
    active = _sum((have[f] & (value[f] >= cfg.active)).cast("int") for f in FAMILIES if f != "historical")
    e, one = cfg.evidence, F.lit(1.0)
    none = F.array().cast("array<string>")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    depth = 0.40 * F.least(count("distinct_rules") / 3.0, one) + 0.35 * F.least(count("high_count") / 3.0, one) + 0.25 * C.log_dollars(count("exposure"), 50000.0)
    support = F.least(F.size(F.array_union(F.coalesce("claim_ids", none), F.coalesce("ml_claim_ids", none))) / 15.0, one)
    net = F.least(0.60 * count("hard_link_score") + 0.40 * F.least(count("community_size") / 10.0, one), one)
    strength = e["corroboration"] * F.least(active / 3.0, one) + e["depth"] * depth + e["ml"] * support + e["network"] * net
    values = F.filter(F.array(*(F.when(have[f], value[f]) for f in FAMILIES)), lambda x: x.isNotNull())
    n = F.size("_values")
    mean = F.aggregate("_values", F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(F.aggregate("_values", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n)
    agreement = F.when(n >= 2, F.greatest(F.lit(0.0), 1 - 2 * F.col("_std"))).otherwise(0.5)
    a, g, s = cfg.confidence
    seen = count("ml_high_claims") + F.size(F.coalesce("claim_ids", none))
    sample = F.when(seen > 0, F.least(seen / cfg.claim_cap, one)).otherwise(0.40)
    out = out.withColumns({"active_families": active, "evidence_strength": C.places(C.clip01(strength), 4), "_values": values})
    out = out.withColumn("_mean", F.when(n > 0, mean)).withColumn("_std", F.when(n > 0, std))
    out = out.withColumn("confidence", F.when(F.col("available_weight") > 0, C.places(C.clip01(a * F.col("available_weight") / sum(cfg.weights.values()) + g * agreement + s * sample), 4)).otherwise(0.0))
    out = out.withColumns({"risk_tier": C.risk_tier(F.col("risk_score")), "evidence_tier": C.evidence_tier(F.col("evidence_strength")), "confidence_tier": C.confidence_tier(F.col("confidence")), "reasons": _reasons()})
    return out.drop("_rest", "_first", "_values", "_mean", "_std", *(f"raw_{f}" for f in FAMILIES))


def _reasons(most: int = 4) -> Column:
    """What drives the score, by contribution, with the figures behind it; a text of its own where nothing does."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    number = lambda c, places=0: F.format_number(F.coalesce(c, F.lit(0.0)).cast("double"), places)
    dollars = number(F.col("exposure"))
    community = F.concat(F.lit(" (Community #"), F.col("community_id"), F.lit(", "), count("community_size").cast("string"), F.lit(" providers)"))
    text = {
        "rules": F.when(count("high_count") >= 2, F.concat(F.lit("Multiple high-severity billing rule alerts ("), F.col("high_count").cast("string"), F.lit(" alerts, $"), dollars, F.lit(" est. exposure)")))
        .when(count("distinct_rules") >= 2, F.concat(F.lit("Triggered multiple detection rules ("), F.array_join(F.slice("rules", 1, 3), ", "), F.lit(")")))
        .when(count("alert_count") > 0, F.concat(F.lit("Billing anomalies detected ("), F.col("alert_count").cast("string"), F.lit(" alert(s), $"), dollars, F.lit(" est. exposure)"))),
        "ml": F.when((count("ml_share") >= 0.25) & (count("ml_high_claims") >= 3), F.concat(F.lit("High concentration of suspicious claims ("), number(100 * F.col("ml_share"), 1), F.lit("% rate, "), F.col("ml_high_claims").cast("string"), F.lit(" flagged claims)")))
        .otherwise(F.concat(F.lit("Elevated claim-level ML risk score (mean calibrated probability: "), number(F.col("ml_mean"), 2), F.lit(")"))),
        "network": F.when(count("hard_link_score") >= 0.5, F.lit("Hard identity links with affiliated entities (shared bank/TIN/owner overlap)"))
        .when(F.coalesce("is_hub", F.lit(False)), F.concat(F.lit("Central hub provider in multi-provider network"), community))
        .when(count("community_size") >= 2, F.concat(F.lit("Connected to elevated-risk provider community"), community)),
        "anomaly": F.when((count("anomaly_percentile") >= 90) | (count("anomaly_flag") == 1), F.concat(F.lit("Statistically anomalous macro billing behavior ("), number(F.col("anomaly_percentile")), F.lit("th percentile among peer providers)")))
        .otherwise(F.lit("Elevated behavioral anomaly profile compared to peer specialty baseline")),
        "future": F.concat(F.lit("Elevated near-term forward risk forecast ("), number(F.col("risk_30d"), 2), F.lit(" 30-day forecast probability)")),
        "temporal": F.lit("Billing volume surge / velocity spike exceeding historical baseline"),
    }
    items = [F.when((F.col(f"{f}_contribution") > (0.01 if f == "temporal" else 0.02)) & t.isNotNull(), F.struct((-F.col(f"{f}_contribution")).alias("c"), F.lit(i).alias("i"), t.alias("t"))) for i, (f, t) in enumerate(text.items())]
    found = F.transform(F.slice(F.array_sort(F.filter(F.array(*items), lambda x: x.isNotNull())), 1, most), lambda x: x["t"])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Baseline risk profile with no elevated indicators")))
