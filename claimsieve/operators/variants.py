"""The second set of rules: other thresholds and further checks on the same tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.operators import features as X
from claimsieve.operators import rules as R
from claimsieve.operators import windows as W
from claimsieve.plans.storage import materialize
from claimsieve.sources.config import RuleConfig
from claimsieve.sources.tables import has_columns

Tables = Mapping[str, DataFrame]
#: Laboratory panels and their components.
PANELS = {"80053": ("80048", "80076", "82040", "84075"), "80048": ("82310", "82374", "82435", "82565"), "80061": ("82465", "83718", "84478"), "85025": ("85027", "85004")}
#: Procedures of one sex only, and minutes of procedures.
FEMALE_ONLY = ("59400", "59510", "58150", "76801")
MALE_ONLY = ("55866", "55700", "54150", "84153")
MINUTES = {"99211": 5, "99212": 10, "99213": 15, "99214": 25, "99215": 40, "90837": 60, "90834": 45, "97110": 15}


def group_duplicates(claims: DataFrame) -> DataFrame:
    """One row for each repeated service: the amount times the repeats."""
    key = ["member_id", "procedure_code", "provider_id", "service_date", "billed_amount"]
    return claims.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("claim_id")).alias("claim_ids")).where("n > 1").withColumn("est_dollars", F.col("billed_amount") * (F.col("n") - 1))


def upcoding_among_large(claims: DataFrame, providers: DataFrame, min_visits: int = 50, z: float = 3.0, high_z: float = 4.5) -> DataFrame:
    """Upcoding against peers that have many visits too."""
    rows = claims.withColumn("_level", C.em_level_variant(F.col("procedure_code")) if "em_level" not in claims.columns else F.col("em_level")).where("_level > 0 and provider_id is not null")
    stats = rows.groupBy("provider_id").agg(F.count(F.lit(1)).alias("total_em"), F.avg((F.col("_level") >= 4).cast("double")).alias("high_share"), F.sum("billed_amount").alias("billed")).where(F.col("total_em") >= min_visits)
    scored = W.with_mad_z(stats.join(providers.select("provider_id", "peer_group"), "provider_id"), "high_share", "peer_group")
    return scored.where(F.col("mad_z") > z).withColumns({"severity": F.when(F.col("mad_z") > high_z, "HIGH").otherwise("MEDIUM"), "est_dollars": F.greatest(F.lit(0.0), F.round(F.col("billed") * 0.35 * (F.col("high_share") - F.col("peer_median")) * 100) / 100)})


def panel_unbundling(claims: DataFrame, panels: Mapping[str, tuple[str, ...]] = PANELS, high_rate: float = 0.20) -> DataFrame:
    """Panels billed with their components, and three or more components without a panel; HIGH for frequent unbundlers."""
    key = ["member_id", "provider_id", "service_date"]
    rows = claims.dropna(subset=key)
    told = F.col("procedure_code").isin(sorted({*panels, *(x for c in panels.values() for x in c)}))  # other codes make no finding
    days = rows.groupBy(*key).agg(F.collect_set(F.when(told, F.col("procedure_code"))).alias("codes"), F.collect_list(F.when(told, F.struct("procedure_code", "billed_amount"))).alias("lines"))
    table = rows.sparkSession.createDataFrame([(p, list(c)) for p, c in panels.items()], "panel string, components array<string>")  # a fixed code table
    met = days.join(F.broadcast(table)).withColumn("found", F.array_intersect("codes", "components"))
    with_panel = F.array_contains("codes", F.col("panel"))
    hit = met.where((with_panel & (F.size("found") >= 1)) | (~with_panel & (F.size("found") >= 3))).withColumn("with_panel", with_panel)
    billed = F.aggregate(F.filter("lines", lambda x: F.array_contains("found", x["procedure_code"])), F.lit(0.0), lambda a, x: a + x["billed_amount"])
    rates = days.groupBy("provider_id").agg(F.count(F.lit(1)).alias("encounters")).join(hit.where("with_panel").select(*key).distinct().groupBy("provider_id").agg(F.count(F.lit(1)).alias("unbundled")), "provider_id", "left")
    often = rates.select("provider_id", (F.coalesce("unbundled", F.lit(0)) / F.col("encounters") > high_rate).alias("often"))
    out = hit.join(often, "provider_id").withColumn("est_dollars", F.when(F.col("with_panel"), billed).otherwise(0.0))
    return out.withColumn("severity", F.when(~F.col("with_panel"), "LOW").when(F.col("often"), "HIGH").otherwise("MEDIUM")).select(*key, "panel", F.array_join(F.sort_array("found"), ",").alias("components"), "with_panel", "est_dollars", "severity")


def phantom_claims(claims: DataFrame, members: DataFrame, providers: DataFrame, inactive: tuple[str, ...] = ("inactive", "suspended", "revoked", "terminated"), female: tuple[str, ...] = FEMALE_ONLY, male: tuple[str, ...] = MALE_ONLY) -> DataFrame:
    """Claims after death or termination, for the other sex, or of a provider that isn't active; one row per reason."""
    rows = claims.join(members.select("member_id", "death_date", "termination_date", F.upper("gender").alias("_g")), "member_id", "left").join(providers.select("provider_id", F.lower("status").alias("_s")), "provider_id", "left")
    reasons = F.array(
        F.when(F.col("service_date") > F.col("death_date"), F.struct(F.lit("after_death").alias("reason"), F.lit("CRITICAL").alias("severity"))),
        F.when(F.col("service_date") > F.col("termination_date"), F.struct(F.lit("after_termination").alias("reason"), F.lit("HIGH").alias("severity"))),
        F.when((F.col("_g") == "M") & F.col("procedure_code").isin(list(female)) | (F.col("_g") == "F") & F.col("procedure_code").isin(list(male)), F.struct(F.lit("gender").alias("reason"), F.lit("CRITICAL").alias("severity"))),
        F.when(F.col("_s").isin(list(inactive)), F.struct(F.lit("provider_status").alias("reason"), F.lit("HIGH").alias("severity"))),
    )
    return rows.withColumn("r", F.explode(F.filter(reasons, lambda x: x.isNotNull()))).select("claim_id", "member_id", "provider_id", "r.reason", "r.severity", "billed_amount")


def impossible_days(claims: DataFrame, minutes: Mapping[str, int] = MINUTES, default: int = 15, most: int = 960) -> DataFrame:
    """Days of a provider whose procedures take more minutes than the day has for work."""
    table = F.create_map(*(F.lit(x) for kv in minutes.items() for x in kv))
    each = F.coalesce(F.try_element_at(table, F.col("procedure_code")), F.lit(default))
    return claims.where("provider_id is not null and service_date is not null").groupBy("provider_id", "service_date").agg(F.sum(each).alias("minutes"), F.count(F.lit(1)).alias("claim_count")).where(F.col("minutes") > most)


def volume_against_baseline(claims: DataFrame, providers: DataFrame | None = None, times: float = 3.0, high: float = 6.0) -> DataFrame:
    """Daily claims against the provider's own history (``historical_daily`` of ``providers``, above 0), else the median of all."""
    daily = claims.where("provider_id is not null and service_date is not null").groupBy("provider_id", "service_date").count().groupBy("provider_id").agg(F.avg("count").alias("avg_daily"))
    daily = daily.join(F.broadcast(daily.agg(W.median_of("avg_daily").alias("median"))))
    if providers is not None and "historical_daily" in providers.columns:
        daily = daily.join(providers.select("provider_id", "historical_daily"), "provider_id", "left")
    else:
        daily = daily.withColumn("historical_daily", F.lit(None).cast("double"))
    base = daily.withColumn("baseline", F.when(F.col("historical_daily") > 0, F.col("historical_daily")).otherwise(F.col("median"))).drop("historical_daily", "median")
    return base.where((F.col("baseline") > 0) & (F.col("avg_daily") > times * F.col("baseline"))).withColumn("severity", F.when(F.col("avg_daily") > high * F.col("baseline"), "HIGH").otherwise("MEDIUM"))


def impossible_places(claims: DataFrame) -> DataFrame:
    """Member days in several states, or inpatient with outpatient or office: a row for each claim of the day."""
    w = Window.partitionBy("member_id", "service_date")
    kinds = F.collect_set(F.lower("claim_type")).over(w)
    rows = claims.where("member_id is not null and service_date is not null").withColumns({"_states": F.size(F.collect_set("state").over(w)), "_kinds": kinds, "_total": F.sum("billed_amount").over(w), "_n": F.count(F.lit(1)).over(w)})
    mixed = F.array_contains("_kinds", "inpatient") & F.arrays_overlap("_kinds", F.array(F.lit("outpatient"), F.lit("office")))
    return rows.where((F.col("_states") > 1) | mixed).select("claim_id", "member_id", "provider_id", "service_date", (F.col("_states") > 1).alias("states"), mixed.alias("mixed"), (F.col("_total") / F.col("_n")).alias("est_dollars"))


def referral_anomalies(claims: DataFrame, least: int = 20, share: float = 0.80, back: int = 10, back_share: float = 0.5) -> DataFrame:
    """Referrals in claims (not to oneself) that go to one provider; HIGH if that one sends more than ``back`` and much of it here."""
    sent = claims.where("referring_provider_id is not null and provider_id is not null and referring_provider_id <> provider_id").groupBy(F.col("referring_provider_id").alias("a"), F.col("provider_id").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    totals = sent.groupBy("a").agg(F.sum("n").alias("total"))
    one = sent.join(totals, "a").where((F.col("total") > least) & (F.col("n") / F.col("total") > share))
    their = totals.select(F.col("a").alias("b"), F.col("total").alias("b_total"))
    loop = sent.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("n_back")).join(their, "b")
    out = one.join(loop, ["a", "b"], "left")
    high = (F.col("b_total") > back) & (F.col("n_back") / F.col("b_total") > back_share)
    return out.select(F.col("a").alias("provider_id"), F.col("b").alias("target_id"), "n", "total", (F.col("n") / F.col("total")).alias("share"), F.coalesce("n_back", F.lit(0)).alias("n_back"), F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"))


def out_of_state_routine(claims: DataFrame, members: DataFrame, codes: tuple[str, ...] = ("99211", "99212", "99213", "99214", "99215")) -> DataFrame:
    rows = claims.where(F.col("procedure_code").isin(list(codes))).join(members.select("member_id", F.col("state").alias("member_state")), "member_id")
    return rows.where("state <> member_state").select("claim_id", "member_id", "provider_id", "member_state", "state", F.col("billed_amount").alias("est_dollars"))


def shared_members(claims: DataFrame, most: int = 15) -> DataFrame:
    """Members with more providers than allowed: a row for each of their providers."""
    pairs = claims.where("member_id is not null and provider_id is not null").groupBy("member_id", "provider_id").agg(F.count(F.lit(1)).alias("claim_count"))
    many = pairs.groupBy("member_id").agg(F.count(F.lit(1)).alias("provider_count")).where(F.col("provider_count") > most)
    return pairs.join(many, "member_id")


def weekly_billing_bursts(claims: DataFrame, providers: DataFrame | None = None, default: float = 5000, times: float = 10, floor: float = 50000) -> DataFrame:
    """ISO weeks billed far over the provider's historical week (5,000 where it has none above 0)."""
    weekly = claims.where("provider_id is not null and service_date is not null").groupBy("provider_id", C.iso_week(F.col("service_date")).alias("iso_week")).agg(F.sum("billed_amount").alias("billed"))
    if providers is not None and "historical_weekly" in providers.columns:
        weekly = weekly.join(providers.select("provider_id", "historical_weekly"), "provider_id", "left").withColumn("baseline", F.when(F.col("historical_weekly") > 0, F.col("historical_weekly").cast("double")).otherwise(float(default))).drop("historical_weekly")
    else:
        weekly = weekly.withColumn("baseline", F.lit(float(default)))
    return weekly.where((F.col("billed") > times * F.col("baseline")) & (F.col("billed") > floor)).withColumns({"severity": F.lit("CRITICAL"), "est_dollars": F.col("billed") - F.col("baseline")})


def run_detection(tables: Tables) -> dict[str, DataFrame]:
    """All variant rules for which tables are there, and the behaviour features: findings by name, lazily, over claims written once."""
    return _findings({**tables, "claims": materialize(tables["claims"], "claims")})


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of which another may have the same key, by a hash of it: the first exchange has hashes only."""
    found = F.xxhash64(*key)
    many = rows.groupBy(found.alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    return rows.join(materialize(many, "repeated-keys"), found == F.col("_hash"), "left_semi")


def _findings(tables: Tables) -> dict[str, DataFrame]:
    """Findings over claims that are written."""
    c, m, p = tables["claims"], tables.get("members"), tables.get("providers")
    service = ["member_id", "provider_id", "procedure_code"]
    out = {"duplicates": group_duplicates(repeated(c, [*service, "service_date"])), "near_duplicates": R.near_duplicates({"claims": repeated(c, service)}, RuleConfig()), "panels": panel_unbundling(c), "days": impossible_days(c), "shared": shared_members(c), "bursts": weekly_billing_bursts(c, p)}
    if m is not None and p is not None and {"death_date", "termination_date", "gender"} <= set(m.columns) and "status" in p.columns:
        out["phantom"] = phantom_claims(c, m, p)
    if p is not None:
        out |= {"upcoding": upcoding_among_large(c, p), "volume": volume_against_baseline(c, p)}
    if "state" in c.columns and "claim_type" in c.columns:
        out["places"] = impossible_places(c)
        if m is not None and "state" in m.columns:
            out["out_of_state"] = out_of_state_routine(c, m)
    if "referring_provider_id" in c.columns:
        out["referrals"] = referral_anomalies(c)
        if "state" in c.columns:
            out["behaviour"] = X.behaviour(c)
    return out


#: Rule, severity, what it says, and the columns that identify a finding of each variant.
_FINDINGS = {
    "duplicates": ("R01", "HIGH", "Claims bill the same service."), "near_duplicates": ("R01", "MEDIUM", "Claims bill the same service within days."), "upcoding": ("R02", "HIGH", "High visit levels stand out among peers."), "panels": ("R03", "MEDIUM", "Panel components are billed apart."),
    "phantom": ("R04", "CRITICAL", "A claim contradicts the member's or provider's status."), "days": ("R05", "HIGH", "More service time than a day allows."), "volume": ("R05", "HIGH", "Volume is far over the baseline."), "places": ("R06", "HIGH", "Services at places too far apart."),
    "referrals": ("R07", "MEDIUM", "Referrals concentrate on one target."), "out_of_state": ("R08", "MEDIUM", "Routine visits of members from other states."), "shared": ("R09", "LOW", "A member sees very many providers."), "bursts": ("R10", "CRITICAL", "A week is billed far over the usual."),
}


def weekly_features(claims: DataFrame) -> DataFrame:
    """Active weeks of each provider with the most claims, the mean and the most dollars; dollars are summed as decimals."""
    weekly = claims.where("provider_id is not null and service_date is not null").groupBy("provider_id", C.iso_week(F.col("service_date")).alias("w")).agg(F.count(F.lit(1)).alias("n"), C.exact_sum(F.col("paid_amount")).alias("paid"))
    return weekly.groupBy("provider_id").agg(F.count(F.lit(1)).alias("active_weeks"), F.max("n").alias("most_weekly_claims"), (C.exact_sum(F.col("paid")) / F.count("paid")).alias("mean_weekly_paid"), F.max("paid").alias("most_weekly_paid"))


def detection_output(tables: Tables) -> dict[str, DataFrame]:
    """Findings of all variants as ``alerts`` and ``evidence``, and feature tables ``(entity_id, features map)``.

    Ids are digests of what was found, so a run over the same tables gives the same. Features are those of providers,
    referrals, time and place that the tables allow. Claims and the findings of each variant are written once for all tables.
    """
    tables = {**tables, "claims": materialize(tables["claims"], "claims")}
    found = _findings(tables)
    alerts, evidence = [], []
    for name, (rule, severity, text) in _FINDINGS.items():
        if name not in found:
            continue
        df = found[name]
        plain = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
        what = F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 16)
        who = F.col("provider_id").cast("string") if "provider_id" in df.columns else F.lit("UNKNOWN")
        claims = F.array_compact(F.array(*(F.col(c).cast("string") for c in plain if c.startswith("claim_id")))) if any(c.startswith("claim_id") for c in plain) else F.transform("claim_ids", lambda x: x.cast("string")) if "claim_ids" in df.columns else F.array().cast("array<string>")
        sev = F.col("severity") if "severity" in df.columns else F.lit(severity)
        est = F.coalesce(F.col("est_dollars").cast("double"), F.lit(0.0)) if "est_dollars" in df.columns else F.lit(0.0)
        base = df.select(F.concat(F.lit(f"{rule}-{name}-"), what).alias("k"), who.alias("provider_id"), claims.alias("claims"), sev.alias("severity"), est.alias("est"))
        base = materialize(base, f"finding-{name}")
        alerts.append(base.select(F.concat(F.lit("al-"), "k").alias("alert_id"), "provider_id", F.lit(rule).alias("rule_id"), "severity", F.array(F.concat(F.lit("ev-"), "k")).alias("evidence_ids")))
        evidence.append(base.select(F.concat(F.lit("ev-"), "k").alias("evidence_id"), F.lit(rule).alias("rule_id"), F.lit(text).alias("description"), F.col("est").alias("estimated_overpayment"), F.col("claims").alias("claim_level_traceability")))
    out = {"alerts": reduce(lambda a, b: a.unionByName(b), alerts), "evidence": reduce(lambda a, b: a.unionByName(b), evidence)}
    c = tables["claims"]
    out["provider_features"] = _as_map(X.provider_features(c), "provider_id")
    out["temporal_features"] = _as_map(weekly_features(c), "provider_id")
    if "behaviour" in found:
        out["behaviour_features"] = _as_map(found["behaviour"], "provider_id")
    if has_columns(tables.get("members"), "county"):
        place = c.select("provider_id", "member_id").join(tables["members"].select("member_id", "county"), "member_id")
        out["geographic_features"] = _as_map(place.where("provider_id is not null").groupBy("provider_id").agg(F.countDistinct("county").alias("counties"), F.countDistinct("member_id").alias("members")), "provider_id")
    if tables.get("referrals") is not None:
        sent = tables["referrals"].where("referring_provider_id is not null").groupBy(F.col("referring_provider_id").alias("provider_id")).agg(F.count(F.lit(1)).alias("sent"), F.countDistinct("target_provider_id").alias("targets"))
        out["referral_features"] = _as_map(sent, "provider_id")
    return out


def _as_map(df: DataFrame, key: str) -> DataFrame:
    cols = [c for c, t in df.dtypes if c != key and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    return df.select(F.col(key).cast("string").alias("entity_id"), F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*(F.col(c).cast("double") for c in cols))).alias("features"))
