"""Detection rules. Each core function returns typed measures of its findings; ``to_alerts`` adds ids, text and evidence.

A table or column that a rule needs and that is missing gives no findings. NULL keys take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.operators import windows as W
from claimsieve.plans.storage import delete_since, mark, materialize, new_path
from claimsieve.sources.config import RuleConfig
from claimsieve.sources.tables import canonical, has_columns

Tables = Mapping[str, DataFrame]
_AMOUNTS = {"billed_amount": "double", "allowed_amount": "double", "paid_amount": "double"}
_CLAIM_OPTIONAL = {**_AMOUNTS, "status": "string", "modifier": "string", "service_minutes": "double", "facility_id": "string", "pos_code": "string", "em_level": "int", "dx_complexity": "int", "latitude": "double", "longitude": "double", "service_start_ts": "timestamp"}


def prepared_claims(tables: Tables) -> DataFrame:
    return canonical(tables["claims"], _CLAIM_OPTIONAL)


def _amount(*order: str) -> Column:
    return F.coalesce(*order, F.lit(0.0))


# -- duplicates


def _countable(claims: DataFrame, cfg: RuleConfig) -> DataFrame:
    return claims.where(~C.is_any(F.col("status"), [*cfg.void_statuses, *cfg.corrected_statuses]) & ~C.has_modifier(F.col("modifier"), cfg.legitimate_modifiers)).select(
        "claim_id", "member_id", "provider_id", "procedure_code", "service_date", F.coalesce("billed_amount", "allowed_amount", "paid_amount").alias("amount")
    )


_PAIR_KEY = ["member_id", "provider_id", "procedure_code"]


def exact_duplicates(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Pairs of claims with the same member, provider, procedure, day and amount.

    Groups of one claim are dropped by a count before pairs are made.
    """
    key = [*_PAIR_KEY, "service_date", "amount"]
    rows = _countable(prepared_claims(tables), cfg).dropna(subset=key)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("n > 1").drop("n")
    other = rows.select(*key, F.col("claim_id").alias("claim_id_b"))
    return rows.join(other, key).where("claim_id < claim_id_b").select("provider_id", F.col("claim_id").alias("claim_id_a"), "claim_id_b", F.col("amount").alias("est_dollars"))


def near_duplicates(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Pairs of the same member, provider, procedure and amount (both NULL is the same) some days apart."""
    rows = _countable(prepared_claims(tables), cfg).dropna(subset=[*_PAIR_KEY, "service_date"])
    # A day range becomes an equi-join: a row meets the days after it.
    later = rows.select(*_PAIR_KEY, F.col("service_date").alias("day_b"), F.col("claim_id").alias("claim_b"), F.col("amount").alias("amount_b"))
    first = rows.withColumn("gap", F.explode(F.array(*map(F.lit, range(1, cfg.near_duplicate_days + 1))))).withColumn("day_b", F.date_add("service_date", F.col("gap")))
    pairs = first.join(later, [*_PAIR_KEY, "day_b"]).where(F.col("amount").eqNullSafe(F.col("amount_b")))
    return pairs.select("provider_id", F.least("claim_id", "claim_b").alias("claim_id_a"), F.greatest("claim_id", "claim_b").alias("claim_id_b"), "gap", F.coalesce("amount", F.lit(0.0)).alias("est_dollars"))


# -- coding


def provider_levels(claims: DataFrame) -> DataFrame:
    """Visits by level 1-5 of a provider, shares, and the share of levels 4 and 5."""
    rows = claims.withColumn("level", C.em_level(F.col("procedure_code"), F.col("em_level"))).where("level is not null and provider_id is not null")
    n = {k: F.sum((F.col("level") == k).cast("int")) for k in range(1, 6)}
    out = rows.groupBy("provider_id").agg(F.count(F.lit(1)).alias("total_em"), *(v.alias(f"em_{k}") for k, v in n.items()), F.sum(F.when(F.col("level") >= 4, _amount("allowed_amount", "paid_amount", "billed_amount")).otherwise(0.0)).alias("high_amount"))
    return out.withColumn("high_share", (F.col("em_4") + F.col("em_5")) / F.col("total_em"))


def upcoding(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Providers whose share of high levels stands out among peers."""
    shares = provider_levels(prepared_claims(tables))
    peers = tables.get("providers")
    if has_columns(peers, "provider_id", "peer_group"):
        shares = shares.join(peers.select("provider_id", "peer_group"), "provider_id", "left").fillna("all", ["peer_group"])
    else:
        shares = shares.withColumn("peer_group", F.lit("all"))
    scored = W.with_mad_z(shares, "high_share", "peer_group")
    return scored.where((F.col("total_em") >= cfg.min_em_claims) & (F.col("mad_z") > cfg.mad_z) & (F.col("high_share") >= cfg.share_multiplier * F.col("peer_median"))).select(
        "provider_id", "peer_group", "total_em", "high_share", "peer_median", "mad_z", (F.col("high_amount") * cfg.recoverable_share).alias("est_dollars")
    )


def low_complexity_visits(tables: Tables, flagged: DataFrame, cfg: RuleConfig = RuleConfig(), top: int = 10) -> DataFrame:
    """Level-5 claims of low complexity of flagged providers, the first ten each, and whether they were short for their code."""
    claims = prepared_claims(tables).withColumn("level", C.em_level(F.col("procedure_code"), F.col("em_level")))
    short = W.quantiles(claims, ["procedure_code"], "service_minutes", {"p25": 0.25}).drop("n_values")
    rows = claims.where((F.col("level") == 5) & (F.col("dx_complexity") <= cfg.low_complexity)).join(flagged.select("provider_id"), "provider_id", "left_semi").join(short, "procedure_code", "left")
    w = Window.partitionBy("provider_id").orderBy("claim_id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).select("provider_id", "claim_id", "dx_complexity", "service_minutes", "n", (F.col("service_minutes") < F.col("p25")).alias("short"))


def upcoding_findings(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """``upcoding`` with its claims and, as ``more_evidence``, one evidence for each of the first low-complexity visits."""
    flagged = materialize(with_claims(upcoding(tables, cfg), em_claims(tables), ["provider_id"], cfg.listed_claims), "upcoding")
    told = F.format_string("Claim %s billed Level 5 for dx_complexity=%s", F.col("claim_id").cast("string"), F.col("dx_complexity").cast("int").cast("string"))
    short = F.coalesce("short", F.lit(False))
    told = F.when(short, F.concat(told, F.format_string(" with service duration %s min below peer p25.", F.format_number("service_minutes", 0)))).otherwise(F.concat(told, F.lit(".")))
    fields = F.when(short, F.array(*map(F.lit, ("em_level", "dx_complexity", "service_minutes")))).otherwise(F.array(*map(F.lit, ("em_level", "dx_complexity"))))
    visits = low_complexity_visits(tables, flagged, cfg).select("provider_id", F.struct("n", *_more(F.array(F.col("claim_id").cast("string")), fields, told, F.lit("MEDIUM"))).alias("e"))
    listed = visits.groupBy("provider_id").agg(F.sort_array(F.collect_list("e")).alias("more_evidence"))  # ten a provider at most
    return flagged.join(listed, "provider_id", "left")


def _more(claim_ids: Column, fields: Column, text: Column, severity: Column) -> tuple[Column, ...]:
    """Fields that ``to_alerts`` reads of each entry of ``more_evidence``, behind those that order them."""
    return claim_ids.alias("claim_ids"), fields.alias("fields_matched"), text.alias("plain_text"), severity.alias("severity")


def bundled_days(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """A member's days at a provider with a bundling code: whether they hold a pair (``hit``; a whole modifier must be allowed), and
    ``found``, the pairs with the claims of both codes, unless a modifier allows them. Claims are grouped once for both.
    """
    claims, pairs = prepared_claims(tables), tables["bundling_pairs"]
    key = ["member_id", "provider_id", "service_date"]
    codes = pairs.select(F.explode(F.array("comprehensive_cpt", "component_cpt")).alias("procedure_code")).distinct()
    rows = claims.dropna(subset=key).join(codes, "procedure_code", "left_semi").withColumn("amount", _amount("allowed_amount", "paid_amount", "billed_amount"))
    days = rows.groupBy(*key).agg(
        F.collect_set("procedure_code").alias("codes"), F.max(F.coalesce(F.col("modifier").isin(list(cfg.override_modifiers)), F.lit(False))).alias("override"),
        F.max(C.has_modifier(F.col("modifier"), cfg.override_modifiers)).alias("allowed"), F.collect_list(F.struct("procedure_code", "claim_id", "amount")).alias("rows"),
    )
    listed = pairs.agg(F.collect_list(F.struct("comprehensive_cpt", "component_cpt")).alias("pairs"))  # a code table of fixed size
    both = F.filter("pairs", lambda p: F.array_contains("codes", p["comprehensive_cpt"]) & F.array_contains("codes", p["component_cpt"]))
    of = lambda code: F.filter("rows", lambda r: r["procedure_code"] == code)
    ids = lambda code: F.sort_array(F.filter(F.transform(of(code), lambda r: r["claim_id"]), lambda c: c.isNotNull()))
    found = F.transform("both", lambda p: F.struct(
        p["comprehensive_cpt"].alias("comprehensive_cpt"), p["component_cpt"].alias("component_cpt"), F.aggregate(of(p["component_cpt"]), F.lit(0.0), lambda x, r: x + r["amount"]).alias("est_dollars"),
        F.concat(ids(p["comprehensive_cpt"]), ids(p["component_cpt"])).alias("claim_ids"),
    ))
    return days.join(F.broadcast(listed)).withColumn("both", both).select(*key, ((F.size("both") > 0) & ~F.col("override")).alias("hit"), F.when(~F.col("allowed") & (F.size("both") > 0), found).alias("found"))


def unbundled_pairs(tables: Tables, cfg: RuleConfig = RuleConfig(), days: DataFrame | None = None) -> DataFrame:
    """Component codes billed beside their comprehensive code for one member, provider and day."""
    days = bundled_days(tables, cfg) if days is None else days
    return days.select("member_id", "provider_id", "service_date", F.inline("found"))


def unbundling_rates(tables: Tables, cfg: RuleConfig = RuleConfig(), days: DataFrame | None = None) -> DataFrame:
    """Share of a provider's member-days with a bundling code that hold a pair; here a whole modifier must be allowed."""
    days = bundled_days(tables, cfg) if days is None else days
    return days.groupBy("provider_id").agg(F.count(F.lit(1)).alias("total_days"), F.sum(F.col("hit").cast("int")).alias("unbundled_days")).withColumn("rate", F.col("unbundled_days") / F.col("total_days"))


def unbundling(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Unbundled pairs, HIGH for providers whose rate is beyond the percentile of all."""
    days = materialize(bundled_days(tables, cfg), "bundled-days")
    rates = materialize(unbundling_rates(tables, cfg, days), "unbundling-rates")
    cut = rates.agg(F.percentile("rate", F.lit(cfg.unbundling_percentile)).alias("cut"))
    marked = rates.join(F.broadcast(cut)).select("provider_id", "rate", (F.col("rate") > F.col("cut")).alias("high"))
    return unbundled_pairs(tables, cfg, days).join(marked, "provider_id", "left").withColumn("severity", F.when(F.col("high"), "HIGH").otherwise("MEDIUM")).drop("high")


# -- phantom services


def _per_claim(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("claim_id", "member_id", "provider_id", "service_date", *more, _amount("billed_amount", "allowed_amount").alias("est_dollars"))


def after_death(tables: Tables) -> DataFrame:
    m = tables["members"].where("death_date is not null").select("member_id", "death_date")
    return _per_claim(prepared_claims(tables).join(m, "member_id").where("service_date > death_date"), "death_date")


def after_enrollment(tables: Tables) -> DataFrame:
    m = tables["members"]
    end = "enrollment_end" if "enrollment_end" in m.columns else "termination_date"
    m = m.where(F.col(end).isNotNull()).select("member_id", F.col(end).alias("end_date"))
    return _per_claim(prepared_claims(tables).join(m, "member_id").where("service_date > end_date"), "end_date")


def during_stay(tables: Tables) -> DataFrame:
    """Services within the member's stay in another facility, both days included."""
    stays = tables["inpatient_stays"].withColumnsRenamed({"admit_date": "admission_date", "disch_date": "discharge_date"})
    stays = stays.select("member_id", F.col("facility_id").alias("stay_facility_id"), "admission_date", "discharge_date")
    rows = prepared_claims(tables).join(stays, "member_id").where("service_date between admission_date and discharge_date and facility_id <> stay_facility_id")
    return _per_claim(rows, "facility_id", "stay_facility_id")


def closed_facility(tables: Tables) -> DataFrame:
    f = tables["facilities"].select("facility_id", "open_date", "close_date").where("open_date is not null or close_date is not null")
    return _per_claim(prepared_claims(tables).join(f, "facility_id").where("service_date > close_date or service_date < open_date"), "facility_id")


def non_operating_day(tables: Tables) -> DataFrame:
    f = tables["facilities"].where("operating_days is not null").select("facility_id", "operating_days")
    rows = prepared_claims(tables).where("service_date is not null").join(f, "facility_id")
    return _per_claim(rows.where(~C.operates_on(F.col("service_date"), F.col("operating_days"))), "facility_id")


def orphan_ambulance(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Ambulance claims without another service of the member within some days: an anti-join on exploded days."""
    claims = prepared_claims(tables).where("member_id is not null and service_date is not null")
    is_ride = C.has_prefix(F.col("procedure_code"), [cfg.ambulance_prefix])
    days = F.array(*(F.date_add("service_date", d) for d in range(-cfg.ambulance_days, cfg.ambulance_days + 1)))
    near = claims.where(~is_ride).select("member_id", F.explode(days).alias("service_date")).distinct()
    return _per_claim(claims.where(is_ride).join(near, ["member_id", "service_date"], "left_anti"))


def ghost_members(claims: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Members without a claim until a year before the last day, and then many with one provider."""
    rows = claims.where("member_id is not null and service_date is not null")
    cut = rows.agg(F.add_months(F.max("service_date"), -cfg.ghost_months).alias("cut"))
    dated = rows.join(F.broadcast(cut))
    first = dated.groupBy("member_id").agg(F.min("service_date").alias("first"), F.max("cut").alias("cut")).where("first > cut").select("member_id")
    by_provider = dated.where("service_date > cut and provider_id is not null").groupBy("member_id", "provider_id").agg(F.count(F.lit(1)).alias("claim_count"), F.sort_array(F.collect_list("claim_id")).alias("claim_ids"))
    return by_provider.where(F.col("claim_count") >= cfg.ghost_claims).join(first, "member_id", "left_semi")


# -- utilisation


def _over(tables: Tables, cfg: RuleConfig) -> DataFrame:
    claims = prepared_claims(tables)
    group, cap = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, (prefixes, most) in cfg.caps.items():
        on = C.has_prefix(F.col("procedure_code"), prefixes)
        group, cap = F.when(on, F.lit(name)).otherwise(group), F.when(on, F.lit(most)).otherwise(cap)
    rows = claims.withColumns({"code_group": group, "cap": cap}).where("code_group is not null")
    return W.rolling_days_count(rows, ["member_id", "code_group"]).where("rolling_count > cap")


def over_caps(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Members over the visits of a code group in 30 days: the peak and its first day."""
    over = _over(tables, cfg).withColumn("amount", _amount("paid_amount", "allowed_amount", "billed_amount"))
    return over.groupBy("member_id", "code_group", "cap").agg(
        F.max("rolling_count").alias("peak"), F.min_by("service_date", F.struct(-F.col("rolling_count"), F.col("service_date"))).alias("peak_date"), F.avg("amount").alias("mean_amount"), F.count(F.lit(1)).alias("over_rows")
    ).withColumn("est_dollars", F.col("mean_amount") * (F.col("peak") - F.col("cap")))


def utilisation(claims: DataFrame) -> DataFrame:
    return claims.where("provider_id is not null").groupBy("provider_id").agg(F.count(F.lit(1)).alias("total_claims"), F.countDistinct("member_id").alias("unique_members"), F.sum("paid_amount").alias("total_paid")).withColumn(
        "visits_per_member", F.when(F.col("unique_members") > 0, F.col("total_claims") / F.col("unique_members")).otherwise(0.0)
    )


def excessive_providers(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    stats = utilisation(prepared_claims(tables))
    peers = tables.get("providers")
    stats = stats.join(peers.select("provider_id", "peer_group"), "provider_id", "left").fillna("all", ["peer_group"]) if has_columns(peers, "peer_group") else stats.withColumn("peer_group", F.lit("all"))
    return W.with_quantiles(materialize(stats, "visits"), ["peer_group"], "visits_per_member", {"peer_median": 0.5}).where((F.col("peer_median") > 0) & (F.col("visits_per_member") > cfg.peer_multiplier * F.col("peer_median")))


# -- timing


def overloaded_days(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    return W.daily_summary(prepared_claims(tables)).where(F.col("total_minutes") > cfg.day_minutes)


def _in_person(claims: DataFrame, cfg: RuleConfig) -> DataFrame:
    return claims.where(~F.coalesce(F.col("pos_code").isin(list(cfg.telehealth_pos)), F.lit(False)) & F.col("service_start_ts").isNotNull())


def impossible_travel(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Consecutive services of a provider that need more than a speed; coordinates of the claim, else of the provider."""
    p = tables["providers"].select("provider_id", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    rows = _in_person(prepared_claims(tables), cfg).join(p, "provider_id", "left").withColumns({"lat": F.coalesce("latitude", "p_lat"), "lon": F.coalesce("longitude", "p_lon"), "ts": F.col("service_start_ts").cast("timestamp")})
    pairs = W.next_in(rows, "provider_id", ["ts", "claim_id"], ["claim_id", "ts", "lat", "lon"])
    hours = (F.unix_micros("next_ts") - F.unix_micros("ts")) / 3.6e9
    miles = C.haversine_miles(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon"))
    return pairs.withColumns({"gap_hours": hours, "miles": miles}).withColumn("mph", C.required_mph(F.col("miles"), F.col("gap_hours"))).where(F.col("mph") > cfg.travel_mph).select(
        "provider_id", F.col("claim_id").alias("claim_id_a"), F.col("next_claim_id").alias("claim_id_b"), "miles", "gap_hours", "mph"
    )


def member_overlaps(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Adjacent services of a member that overlap at another provider and another or unknown facility."""
    rows = _in_person(prepared_claims(tables), cfg).withColumns({"ts": F.col("service_start_ts").cast("timestamp"), "end_ts": F.timestamp_micros(F.unix_micros(F.col("service_start_ts").cast("timestamp")) + (F.coalesce("service_minutes", F.lit(0.0)) * 6e7).cast("long"))})
    pairs = W.next_in(rows, "member_id", ["ts", "claim_id"], ["claim_id", "ts", "provider_id", "facility_id"])
    other = F.col("facility_id").isNull() | F.col("next_facility_id").isNull() | (F.col("facility_id") != F.col("next_facility_id"))
    return pairs.where((F.col("next_ts") < F.col("end_ts")) & (F.col("provider_id") != F.col("next_provider_id")) & other).select(
        "member_id", F.col("claim_id").alias("claim_id_a"), F.col("next_claim_id").alias("claim_id_b"), "provider_id", "next_provider_id"
    )


# -- referrals


def concentration(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Providers that send most of many referrals to one target; ties go to the smaller target. Peers are those that send many, too."""
    _, pairs = W.referral_history(tables["referrals"])
    best = pairs.groupBy("referring_provider_id").agg(F.sum("n").alias("total"), F.max("n").alias("top_n"), F.min_by("target_provider_id", F.struct(-F.col("n"), F.col("target_provider_id"))).alias("top_target"))
    best = best.withColumn("share", F.col("top_n") / F.col("total"))
    enough = best.where(F.col("total") >= cfg.min_referrals)
    median = enough.agg(W.median_of("share").alias("peer_median"))
    return enough.where(F.col("share") > cfg.concentration).join(F.broadcast(median))


def reciprocal_loops(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    _, pairs = W.referral_history(tables["referrals"])
    many = pairs.where(F.col("n") >= cfg.reciprocal)
    back = many.select(F.col("referring_provider_id").alias("target_provider_id"), F.col("target_provider_id").alias("referring_provider_id"), F.col("n").alias("n_back"))
    return many.join(back, ["referring_provider_id", "target_provider_id"]).where("referring_provider_id < target_provider_id").select(F.col("referring_provider_id").alias("provider_a"), F.col("target_provider_id").alias("provider_b"), F.col("n").alias("n_out"), "n_back")


def lab_claims(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Claims of a laboratory for a member on the day of a referral to it."""
    labs = tables["providers"].where(C.is_any(F.col("specialty"), cfg.lab_specialties)).select(F.col("provider_id").alias("target_provider_id"))
    r = tables["referrals"].join(labs, "target_provider_id", "left_semi").select("referring_provider_id", "target_provider_id", "member_id", F.col("referral_date").alias("service_date"))
    c = prepared_claims(tables).select(F.col("provider_id").alias("target_provider_id"), "member_id", "service_date", "claim_id", "paid_amount")
    return r.join(c, ["target_provider_id", "member_id", "service_date"])


def same_day_labs(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    return lab_claims(tables, cfg).groupBy("referring_provider_id", "target_provider_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("paid_amount", F.lit(0.0))).alias("est_dollars"))


def referral_spikes(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    return W.weekly_zscore(tables["referrals"], cfg.referral_weeks).where(F.col("z") > cfg.referral_z)


# -- geography


def claim_distances(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Miles between member and provider of each claim that isn't telehealth, with its threshold."""
    p = tables["providers"].select("provider_id", "specialty", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    m = tables["members"].select("member_id", F.col("latitude").alias("m_lat"), F.col("longitude").alias("m_lon"))
    claims = prepared_claims(tables).where(~F.coalesce(F.col("pos_code").isin(list(cfg.telehealth_pos)), F.lit(False)))
    rows = claims.join(p, "provider_id").join(m, "member_id").withColumn("miles", C.haversine_miles(F.col("m_lat"), F.col("m_lon"), F.col("p_lat"), F.col("p_lon"))).where("miles is not null")
    by = W.quantiles(rows, ["specialty"], "miles", {"p99": 0.99}).withColumnRenamed("n_values", "n")
    far = F.when(F.col("n") >= cfg.distance_min_rows, F.greatest(F.col("p99"), F.lit(float(cfg.other_miles)))).otherwise(float(cfg.other_miles))
    cuts = by.select("specialty", F.when(C.is_any(F.col("specialty"), cfg.routine_specialties), float(cfg.routine_miles)).otherwise(far).alias("threshold"))
    return rows.join(cuts, "specialty").select("claim_id", "member_id", "provider_id", "specialty", "miles", "threshold")


def distance_anomalies(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    far = claim_distances(tables, cfg).where("miles > threshold")
    refs = tables.get("referrals")
    if refs is not None:
        known = refs.select("member_id", F.col("target_provider_id").alias("provider_id"), F.lit(1).alias("referred")).distinct()
        far = far.join(known, ["member_id", "provider_id"], "left")
    else:
        far = far.withColumn("referred", F.lit(None).cast("int"))
    return far.groupBy("provider_id").agg(F.count(F.lit(1)).alias("n"), F.avg("miles").alias("avg_miles"), F.max("miles").alias("max_miles"), F.sum(F.coalesce("referred", F.lit(0))).alias("referred"))


def many_counties(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    pairs = prepared_claims(tables).select("provider_id", "member_id").distinct()
    met = pairs.join(tables["members"].select("member_id", "county"), "member_id").where("county is not null")
    return met.groupBy("provider_id").agg(F.countDistinct("county").alias("county_count"), F.array_join(F.sort_array(F.collect_set("county")), ",").alias("counties")).where(F.col("county_count") >= cfg.counties)


def suspicious_facilities(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    return tables["facilities"].where(C.is_any(F.col("facility_type"), cfg.facility_types)).select("facility_id", F.lower("facility_type").alias("facility_type"))


# -- bursts


def weekly_bursts(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Weeks of a provider that pay more than a floor and several times the median of the weeks before."""
    panel = W.trailing_median(W.weekly_panel(prepared_claims(tables)), cfg.burst_weeks)
    hit = (F.col("weekly_amount") > cfg.burst_floor) & (F.col("history_weeks") >= cfg.burst_history) & (F.col("trailing_median") > 0) & (F.col("weekly_amount") > cfg.burst_ratio * F.col("trailing_median"))
    return panel.where(hit).withColumns(
        {
            "ratio": F.col("weekly_amount") / F.col("trailing_median"),
            "severity": F.when(F.col("weekly_amount") < 1.5 * cfg.burst_ratio * F.col("trailing_median"), "LOW").otherwise("MEDIUM"),
            "est_dollars": F.greatest(F.lit(0.0), F.col("weekly_amount") - F.col("trailing_median")),
        }
    )


# -- claims behind findings of groups


def em_claims(tables: Tables) -> DataFrame:
    return prepared_claims(tables).where(C.em_level(F.col("procedure_code"), F.col("em_level")).isNotNull()).select("provider_id", "claim_id")


def over_cap_claims(tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    return _over(tables, cfg).select("member_id", "code_group", "claim_id")


def provider_claims(tables: Tables, *more: str) -> DataFrame:
    return prepared_claims(tables).select("provider_id", *more, "claim_id")


def referral_claims(tables: Tables) -> DataFrame:
    rows = canonical(tables["referrals"], {"claim_id": "string"}, {})
    return rows.select("referring_provider_id", F.col("target_provider_id").alias("top_target"), "claim_id")


def loop_claims(tables: Tables) -> DataFrame:
    """Claims of referrals between two providers, those of the smaller one first."""
    rows = referral_claims(tables).withColumnRenamed("top_target", "target")
    return rows.select(
        F.least("referring_provider_id", "target").alias("provider_a"), F.greatest("referring_provider_id", "target").alias("provider_b"), (F.col("referring_provider_id") > F.col("target")).alias("back"), "claim_id"
    )


def county_claims(tables: Tables) -> DataFrame:
    return prepared_claims(tables).select("provider_id", "member_id", "claim_id").join(tables["members"].where("county is not null").select("member_id"), "member_id").select("provider_id", "claim_id")


def with_claims(core: DataFrame, rows: DataFrame, keys: list[str], most: int, first: tuple[str, ...] = ()) -> DataFrame:
    """A core with ``claim_ids``: the ids of its claims in order, of which an alert lists at most ``most``.

    ``rows`` has all of them at any size, one claim a row; the list is chosen by a partial rank in each task before any
    exchange, so a provider with a third of all claims fills no task.
    """
    known = rows.where("claim_id is not null").select(*keys, *first, F.col("claim_id").cast("string").alias("_claim"))
    met = core.join(known, keys, "left")  # a finding without claims keeps its row
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*first, "_claim"))
    own = [c for c in core.columns]
    listed = met.withColumn("_n", rank).where(F.col("_n") <= most).groupBy(*own).agg(F.array_sort(F.collect_list(F.when(F.col("_claim").isNotNull(), F.struct("_n", "_claim")))).alias("_listed"))
    return listed.select(*own, F.col("_listed._claim").alias("claim_ids"))


def _long_lists() -> tuple[tuple[str, str, str, tuple[str, ...], Callable[[Tables, RuleConfig], DataFrame]], ...]:
    """Findings that list many claims: rule, kind of entity, a measure that only they have, their keys, their claims as rows."""
    return (
        ("R02", "provider", "high_share", ("provider_id",), lambda t, c: em_claims(t)),
        ("R05", "member", "peak", ("member_id", "code_group"), over_cap_claims),
        ("R05", "provider", "visits_per_member", ("provider_id",), lambda t, c: provider_claims(t)),
        ("R06", "provider", "total_minutes", ("provider_id", "service_date"), lambda t, c: provider_claims(t, "service_date")),
    )


def alert_claims(alerts: DataFrame, tables: Tables, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Rows ``alert_id, rule_id, entity_type, entity_id, claim_id``: every claim of every alert, also beyond the list it shows.

    Lists shorter than ``listed_claims`` are whole and are taken as they are. The rest is joined from the claims by the keys that
    the alert's measures tell, one claim a row, so no task holds the claims of a provider. An alert without claims has no row.
    """
    head = ["alert_id", "rule_id", "entity_type", "entity_id"]
    rows, cut = [], F.lit(False)
    for rule, kind, measure, keys, claims_of in _long_lists() if "claims" in tables else ():
        mine = F.coalesce((F.col("rule_id") == rule) & (F.col("entity_type") == kind) & F.map_contains_key("metadata", F.lit(measure)) & (F.size("claim_ids") >= cfg.listed_claims), F.lit(False))
        cut = cut | mine
        found = alerts.where(mine).select(*head, *(F.col("metadata")[k].alias(k) for k in keys))
        own = claims_of(tables, cfg).where("claim_id is not null").select(*(F.col(k).cast("string").alias(k) for k in keys), F.col("claim_id").cast("string").alias("claim_id"))
        rows.append(found.join(own, list(keys)).select(*head, "claim_id"))
    return reduce(lambda a, b: a.unionByName(b), rows, alerts.where(~cut).select(*head, F.explode("claim_ids").alias("claim_id")))


# -- alerts


def to_alerts(core: DataFrame, rule_id: str, entity_type: str, entity: str, text: Column, severity: str | Column, claim_ids: Column | None = None, fields: tuple[str, ...] = (), note: str = "", cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Alert rows of a core: deterministic ids, one evidence with its text, and the measures as metadata.

    Where the core has ``more_evidence``, each of its entries follows as an evidence of its own, without an amount.
    """
    claims = F.array().cast("array<string>") if claim_ids is None else claim_ids
    est = F.coalesce("est_dollars", F.lit(0.0)).cast("double") if "est_dollars" in core.columns else F.lit(0.0)
    sev = F.lit(severity) if isinstance(severity, str) else severity
    key = F.concat(claims, F.array(F.substring(F.sha2(text, 256), 1, 16)))
    base = core.withColumns({"_claims": claims, "_sev": sev, "_text": text, "_est": est, "_id": C.alert_id(rule_id, F.col(entity), key)})
    evidence = F.struct(
        F.concat(F.lit("E-"), F.col("_id")).alias("evidence_id"), F.lit(rule_id).alias("rule_id"), F.lit(cfg.version).alias("rule_version"), F.col("_claims").alias("claim_ids"), F.array(*map(F.lit, fields or (entity,))).alias("fields_matched"),
        F.col("_text").alias("plain_text"), F.col("_est").alias("est_overpay"), F.col("_sev").alias("severity"), F.lit(note).alias("fp_notes"),
    )
    listed = F.array(evidence)
    if "more_evidence" in core.columns:
        further = F.transform(
            "more_evidence",
            lambda e, i: F.struct(
                F.concat(F.lit("E-"), F.col("_id"), F.lit("-"), (i + 1).cast("string")).alias("evidence_id"), F.lit(rule_id).alias("rule_id"), F.lit(cfg.version).alias("rule_version"), e["claim_ids"].alias("claim_ids"),
                e["fields_matched"].alias("fields_matched"), e["plain_text"].alias("plain_text"), F.lit(0.0).alias("est_overpay"), e["severity"].alias("severity"), F.lit(note).alias("fp_notes"),
            ),
        )
        listed = F.when(F.col("more_evidence").isNull(), listed).otherwise(F.concat(listed, further))
    measures = [c for c, t in core.dtypes if not t.startswith(("array", "map", "struct"))]
    return base.select(
        F.col("_id").alias("alert_id"), F.lit(rule_id).alias("rule_id"), F.lit(cfg.version).alias("rule_version"), F.lit(entity_type).alias("entity_type"), F.col(entity).cast("string").alias("entity_id"), F.col("_claims").alias("claim_ids"),
        F.col("_sev").alias("severity"), F.col("_est").alias("est_dollars"), listed.alias("evidence"), F.lit(note).alias("fp_notes"),
        F.map_from_arrays(F.array(*map(F.lit, measures)), F.array(*(F.col(c).cast("string") for c in measures))).alias("metadata"),
    )


def _two(a: str, b: str) -> Column:
    return F.array(F.col(a).cast("string"), F.col(b).cast("string"))


def _one() -> Column:
    return F.array(F.col("claim_id").cast("string"))


def _fmt(template: str, *cols: str | Column) -> Column:
    return F.format_string(template, *(F.col(c).cast("string") if isinstance(c, str) else c for c in cols))


Rule = Callable[[Tables, RuleConfig], DataFrame]
_REGISTRY: dict[str, tuple[Rule, dict[str, tuple[str, ...]]]] = {}


def register_rule(name: str, rule: Rule, needs: Mapping[str, tuple[str, ...]] | None = None) -> None:
    """Add a rule ``fn(tables, cfg) -> alerts``; ``needs`` names tables and columns without which it finds nothing."""
    _REGISTRY[name] = (rule, dict(needs or {}))


def _defaults() -> None:
    add = register_rule
    claim = ("claim_id", "member_id", "provider_id", "procedure_code", "service_date")
    add("R01a", lambda t, c: to_alerts(exact_duplicates(t, c), "R01", "provider", "provider_id", _fmt("Claims %s and %s bill the same service, day and amount (%s).", "claim_id_a", "claim_id_b", C.money(F.col("est_dollars"))), "HIGH", _two("claim_id_a", "claim_id_b"), claim[1:], cfg=c), {"claims": claim})
    add("R01b", lambda t, c: to_alerts(near_duplicates(t, c), "R01", "provider", "provider_id", _fmt("Claims %s and %s bill the same service and amount %s day(s) apart.", "claim_id_a", "claim_id_b", "gap"), "MEDIUM", _two("claim_id_a", "claim_id_b"), claim[1:], cfg=c), {"claims": claim})
    add("R02", lambda t, c: to_alerts(upcoding_findings(t, c), "R02", "provider", "provider_id", _fmt("%s of %s visits are at the top two levels; peers' median is %s.", F.format_number(F.col("high_share"), 3), "total_em", F.format_number(F.col("peer_median"), 3)), "HIGH", fields=("procedure_code",), claim_ids=F.col("claim_ids"), cfg=c), {"claims": claim})
    add("R03", lambda t, c: to_alerts(unbundling(t, c), "R03", "provider", "provider_id", _fmt("Component %s billed beside %s on %s.", "component_cpt", "comprehensive_cpt", "service_date"), F.col("severity"), F.col("claim_ids"), ("procedure_code",), cfg=c), {"claims": claim, "bundling_pairs": ("comprehensive_cpt", "component_cpt")})
    add("R04a", lambda t, c: to_alerts(after_death(t), "R04", "provider", "provider_id", _fmt("Claim %s is for %s, after the member's death on %s.", "claim_id", "service_date", "death_date"), "CRITICAL", _one(), ("service_date", "death_date"), cfg=c), {"claims": claim, "members": ("death_date",)})
    add("R04b", lambda t, c: to_alerts(after_enrollment(t), "R04", "provider", "provider_id", _fmt("Claim %s is for %s, after enrolment ended on %s.", "claim_id", "service_date", "end_date"), "CRITICAL", _one(), ("service_date",), cfg=c), {"claims": claim, "members": ("enrollment_end",)})
    add("R04c", lambda t, c: to_alerts(during_stay(t), "R04", "provider", "provider_id", _fmt("Claim %s at %s falls in a stay at %s.", "claim_id", "facility_id", "stay_facility_id"), "HIGH", _one(), ("service_date", "facility_id"), cfg=c), {"claims": (*claim, "facility_id"), "inpatient_stays": ("member_id", "facility_id")})
    add("R04d", lambda t, c: to_alerts(closed_facility(t), "R04", "facility", "facility_id", _fmt("Claim %s on %s is outside the facility's open dates.", "claim_id", "service_date"), "HIGH", _one(), ("service_date",), cfg=c), {"claims": (*claim, "facility_id"), "facilities": ("open_date", "close_date")})
    add("R04e", lambda t, c: to_alerts(non_operating_day(t), "R04", "facility", "facility_id", _fmt("Claim %s on %s is on a day without operation.", "claim_id", "service_date"), "HIGH", _one(), ("service_date",), cfg=c), {"claims": (*claim, "facility_id"), "facilities": ("operating_days",)})
    add("R04f", lambda t, c: to_alerts(orphan_ambulance(t, c), "R04", "provider", "provider_id", _fmt("Ambulance claim %s has no other service near %s.", "claim_id", "service_date"), "MEDIUM", _one(), ("procedure_code",), cfg=c), {"claims": claim})
    add("R04g", lambda t, c: to_alerts(ghost_members(prepared_claims(t), c), "R04", "member", "member_id", _fmt("First claims of the member within a year: %s with provider %s.", "claim_count", "provider_id"), "LOW", F.col("claim_ids"), note="Never opens a case alone.", cfg=c), {"claims": claim})
    add("R05a", lambda t, c: to_alerts(with_claims(over_caps(t, c), over_cap_claims(t, c), ["member_id", "code_group"], c.listed_claims), "R05", "member", "member_id", _fmt("%s visits of %s in 30 days; the cap is %s.", "peak", "code_group", "cap"), "MEDIUM", claim_ids=F.col("claim_ids"), cfg=c), {"claims": claim})
    add("R05b", lambda t, c: to_alerts(with_claims(excessive_providers(t, c), provider_claims(t), ["provider_id"], c.listed_claims), "R05", "provider", "provider_id", _fmt("%s visits per member; peers' median is %s.", F.format_number(F.col("visits_per_member"), 2), F.format_number(F.col("peer_median"), 2)), "HIGH", claim_ids=F.col("claim_ids"), cfg=c), {"claims": claim})
    add("R06a", lambda t, c: to_alerts(with_claims(overloaded_days(t, c), provider_claims(t, "service_date"), ["provider_id", "service_date"], c.listed_claims), "R06", "provider", "provider_id", _fmt("%s service minutes on %s.", F.format_number(F.col("total_minutes"), 0), "service_date"), "HIGH", claim_ids=F.col("claim_ids"), cfg=c), {"claims": (*claim, "service_minutes")})
    add("R06b", lambda t, c: to_alerts(impossible_travel(t, c), "R06", "provider", "provider_id", _fmt("Claims %s and %s need %s miles an hour.", "claim_id_a", "claim_id_b", F.format_number(F.col("mph"), 0)), "HIGH", _two("claim_id_a", "claim_id_b"), cfg=c), {"claims": (*claim, "service_start_ts"), "providers": ("latitude", "longitude")})
    add("R06c", lambda t, c: to_alerts(member_overlaps(t, c), "R06", "member", "member_id", _fmt("Claims %s and %s overlap in time at different places.", "claim_id_a", "claim_id_b"), "HIGH", _two("claim_id_a", "claim_id_b"), cfg=c), {"claims": (*claim, "service_start_ts")})
    ref = ("referring_provider_id", "target_provider_id", "member_id", "referral_date")
    add("R07a", lambda t, c: to_alerts(with_claims(concentration(t, c), referral_claims(t), ["referring_provider_id", "top_target"], c.listed_samples), "R07", "provider", "referring_provider_id", _fmt("%s of %s referrals go to %s.", "top_n", "total", "top_target"), "MEDIUM", claim_ids=F.col("claim_ids"), cfg=c), {"referrals": ref})
    add("R07b", lambda t, c: to_alerts(with_claims(reciprocal_loops(t, c), loop_claims(t), ["provider_a", "provider_b"], c.listed_samples, ("back",)), "R07", "provider", "provider_a", _fmt("%s referrals to %s and %s back.", "n_out", "provider_b", "n_back"), "MEDIUM", claim_ids=F.col("claim_ids"), cfg=c), {"referrals": ref})
    add("R07c", lambda t, c: to_alerts(with_claims(same_day_labs(t, c), lab_claims(t, c), ["referring_provider_id", "target_provider_id"], c.listed_samples), "R07", "provider", "referring_provider_id", _fmt("%s referrals to laboratory %s with a claim on the same day.", "n", "target_provider_id"), "MEDIUM", claim_ids=F.col("claim_ids"), cfg=c), {"referrals": ref, "claims": claim, "providers": ("specialty",)})
    add("R07d", lambda t, c: to_alerts(referral_spikes(t, c), "R07", "provider", "referring_provider_id", _fmt("%s referrals in the week of %s.", "n", "week_start"), "MEDIUM", cfg=c), {"referrals": ref})
    add("R08a", lambda t, c: to_alerts(with_claims(distance_anomalies(t, c), claim_distances(t, c).where("miles > threshold"), ["provider_id"], c.listed_samples), "R08", "provider", "provider_id", _fmt("%s claims from members beyond the distance, up to %s miles.", "n", F.format_number(F.col("max_miles"), 0)), "MEDIUM", claim_ids=F.col("claim_ids"), cfg=c), {"claims": claim, "providers": ("latitude", "specialty"), "members": ("latitude",)})
    add("R08b", lambda t, c: to_alerts(with_claims(many_counties(t, c), county_claims(t), ["provider_id"], c.listed_samples), "R08", "provider", "provider_id", _fmt("Members from %s counties.", "county_count"), "LOW", claim_ids=F.col("claim_ids"), cfg=c), {"claims": claim, "members": ("county",)})
    add("R08c", lambda t, c: to_alerts(suspicious_facilities(t, c), "R08", "facility", "facility_id", _fmt("Facility of type %s.", "facility_type"), "MEDIUM", cfg=c), {"facilities": ("facility_type",)})
    add("R10", lambda t, c: to_alerts(weekly_bursts(t, c), "R10", "provider", "provider_id", _fmt("%s in the week of %s; the median before is %s.", C.money(F.col("weekly_amount")), "week_start", C.money(F.col("trailing_median"))), F.col("severity"), cfg=c), {"claims": (*claim, "paid_amount")})


def run_rules(spark: SparkSession, tables: Tables, cfg: RuleConfig = RuleConfig(), only: list[str] | None = None, disabled: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Alerts of all enabled rules and a status row for each: ``ok``, ``skipped`` (a table or column is missing) or ``failed``.

    Claims and referrals are written once, until all rules are done, and each rule writes its alerts to the shared folder in its own try: one that
    fails, be it while it runs, leaves the others' alerts as they are.
    """
    if not _REGISTRY:
        _defaults()
    from claimsieve.operators.identity import register as identity_rule

    identity_rule()
    have = {k: canonical(v, {}) if k == "claims" else v for k, v in tables.items()}
    todo, status = [], {}
    for name, (rule, needs) in _REGISTRY.items():
        if only is not None and not any(name.startswith(o) for o in only) or name in disabled:
            continue
        missing = [k for k, cols in needs.items() if not has_columns(have.get(k), *cols)]
        if missing:
            status[name] = ("skipped", ", ".join(missing))
        else:
            todo.append(name)
    at = mark()
    if "claims" in tables and sum("claims" in _REGISTRY[name][1] for name in todo) > 2:
        tables = {**tables, "claims": materialize(tables["claims"], "claims")}
    if "referrals" in tables and sum("referrals" in _REGISTRY[name][1] for name in todo) > 1:
        tables = {**tables, "referrals": materialize(tables["referrals"], "referrals")}

    def run(name: str) -> tuple[str, str, str | None]:
        path = new_path(spark, f"alerts-{name}")
        try:
            _REGISTRY[name][0](tables, cfg).write.parquet(path)
        except Exception as e:  # shown in the status, and other rules go on
            return "failed", str(e)[:500], None
        return "ok", "", path

    with ThreadPoolExecutor(RULES_AT_ONCE) as pool:
        paths = []
        for name, (state, detail, path) in zip(todo, pool.map(inheritable_thread_target(spark)(run), todo), strict=True):
            status[name] = (state, detail)
            paths += [path] if path else []
    delete_since(spark, at)  # alerts are written, by other threads
    reader = spark.read.schema(_ALERT_SCHEMA)
    out = reader.parquet(*paths) if paths else spark.createDataFrame([], _ALERT_SCHEMA)
    return out, spark.createDataFrame([(n, *status[n]) for n in _REGISTRY if n in status], "rule string, status string, detail string")


def alerts_of(spark: SparkSession, tables: Tables, cfg: RuleConfig = RuleConfig(), only: list[str] | None = None) -> DataFrame:
    """The alerts of ``run_rules`` where every rule that is asked for must have run: one that failed or was skipped raises."""
    alerts, status = run_rules(spark, tables, cfg, only)
    lost = [f"{r.rule} {r.status}: {r.detail}" for r in status.where("status <> 'ok'").collect()]
    if lost:
        raise RuntimeError("rules without a result: " + "; ".join(lost))
    return alerts


#: Rules that write their alerts at the same time.
RULES_AT_ONCE = 4
_ALERT_SCHEMA = (
    "alert_id string, rule_id string, rule_version string, entity_type string, entity_id string, claim_ids array<string>, severity string, est_dollars double, "
    "evidence array<struct<evidence_id:string,rule_id:string,rule_version:string,claim_ids:array<string>,fields_matched:array<string>,plain_text:string,est_overpay:double,severity:string,fp_notes:string>>, fp_notes string, metadata map<string,string>"
)
