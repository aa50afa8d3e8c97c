"""Feature tables of claims, members and providers, and behaviour variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.operators import windows as W
from claimsieve.plans.storage import materialize

#: What tells the answer and must never be a feature.
LEAKAGE = ("status", "is_suspicious", "scenario_id", "label_reason")


def claim_frequency(claims: DataFrame) -> DataFrame:
    return claims.withColumn("claim_frequency", F.count(F.lit(1)).over(Window.partitionBy("member_id", "provider_id")))


def level_distribution(claims: DataFrame, level: Column) -> DataFrame:
    """Counts and shares of levels 1-5 by provider, zeros filled."""
    rows = claims.withColumn("_level", level).where("_level between 1 and 5 and provider_id is not null")
    out = rows.groupBy("provider_id").agg(F.count(F.lit(1)).alias("total_em"), *(F.sum((F.col("_level") == k).cast("int")).alias(f"em_{k}") for k in range(1, 6)))
    shares = {f"share_{k}": F.col(f"em_{k}") / F.col("total_em") for k in range(1, 6)}
    return out.withColumns({**shares, "high_share": (F.col("em_4") + F.col("em_5")) / F.col("total_em")})


def member_utilisation(claims: DataFrame, days: int = 365, reference: str | None = None) -> DataFrame:
    """Claims, providers and procedures of a member in the days up to a reference day (the last one by default)."""
    rows = claims.where("member_id is not null and service_date is not null")
    ref = rows.agg(F.max("service_date").alias("_ref")) if reference is None else rows.sparkSession.range(1).select(F.to_date(F.lit(reference)).alias("_ref"))
    near = rows.join(F.broadcast(ref)).where((F.col("service_date") <= F.col("_ref")) & (F.col("service_date") >= F.date_sub("_ref", days)))
    return near.groupBy("member_id").agg(
        F.count(F.lit(1)).alias("claim_count"), F.countDistinct("provider_id").alias("provider_count"), F.countDistinct("procedure_code").alias("procedure_count"), F.datediff(F.first("_ref"), F.max("service_date")).alias("days_since_last")
    )


def peer_stats(metrics: DataFrame, value: str, peer: str = "peer_group") -> DataFrame:
    """Median, 95th percentile, MAD and robust z of a metric among peers."""
    return W.with_quantiles(W.with_mad_z(metrics, value, peer), [peer], value, {"peer_p95": 0.95})


def duration_stats(claims: DataFrame, peer: str | None = None) -> DataFrame:
    keys = ["procedure_code", *([peer] if peer else [])]
    return W.quantiles(claims.where("procedure_code is not null"), keys, "service_minutes", {"p25": 0.25, "median": 0.5}).withColumnRenamed("n_values", "n")


#: Columns of the claim matrix with what stands for a missing value (fixed values), and categories as text.
CLAIM_DEFAULTS = {
    "paid_amount": 0.0, "billed_amount": 0.0, "allowed_amount": 0.0, "paid_to_billed_ratio": 1.0, "log_paid_amount": 0.0, "service_minutes": 30.0, "em_level": 0.0, "has_facility": 0.0, "has_referring_provider": 0.0,
    "service_day_of_week": 0.0, "is_weekend": 0.0, "rolling_7d_claims": 0.0, "rolling_30d_claims": 0.0, "rolling_90d_claims": 0.0, "rolling_30d_dollars": 0.0, "provider_total_claims": 0.0, "provider_unique_members": 0.0,
    "provider_total_paid": 0.0, "provider_visits_per_member": 1.0, "provider_em_45_share": 0.0, "member_total_claims": 0.0, "member_unique_providers": 1.0, "member_unique_cpts": 0.0, "member_days_since_last_claim": 999.0,
    "dist_member_provider_miles": 0.0,
}
CLAIM_NUMERIC = tuple(CLAIM_DEFAULTS)
CLAIM_CATEGORIES = ("pos_code", "claim_type", "provider_specialty")


def claim_features(claims: DataFrame, providers: DataFrame, members: DataFrame, snapshot: str | None = None, as_of: str = "all") -> DataFrame:
    """One row per claim: keys, numbers as float with defaults for NULL, and categories ("unknown" for NULL).

    ``as_of="snapshot"`` counts totals of providers over claims up to the snapshot only; ``"all"`` counts all claims. Members are
    counted over the 365 days up to the snapshot (by default the last day). Rolling panels never look ahead. A column that
    ``claims`` lacks counts as NULL.
    """
    if as_of not in ("all", "snapshot"):
        raise ValueError(f"as_of {as_of!r}")
    kinds = {"allowed_amount": "double", "facility_id": "string", "referring_provider_id": "string", "claim_type": "string", "pos_code": "string"}
    claims = claims.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in claims.columns})
    rows = claims.where("claim_id is not null")
    if snapshot:
        rows = rows.where(F.col("service_date") <= F.to_date(F.lit(snapshot)))
    base = rows if as_of == "snapshot" else claims
    level = C.em_level(F.col("procedure_code"))
    seen = base.where("provider_id is not null")
    by_provider = seen.groupBy("provider_id").agg(F.count("claim_id").alias("provider_total_claims"), F.countDistinct("member_id").alias("provider_unique_members"), F.sum("paid_amount").alias("provider_total_paid"))
    by_provider = by_provider.withColumn("provider_visits_per_member", F.col("provider_total_claims") / F.greatest(F.col("provider_unique_members"), F.lit(1)))
    levels = level_distribution(seen, level).select("provider_id", F.col("high_share").alias("provider_em_45_share"))
    use = member_utilisation(claims, reference=snapshot).select("member_id", F.col("claim_count").alias("member_total_claims"), F.col("provider_count").alias("member_unique_providers"), F.col("procedure_count").alias("member_unique_cpts"), F.col("days_since_last").alias("member_days_since_last_claim"))
    panel = W.dense_panel(claims, snapshot).select("provider_id", "service_date", F.col("claims_7d").alias("rolling_7d_claims"), F.col("claims_30d").alias("rolling_30d_claims"), F.col("claims_90d").alias("rolling_90d_claims"), F.col("amount_30d").alias("rolling_30d_dollars"))
    p = providers.select("provider_id", F.col("specialty").alias("provider_specialty"), F.col("latitude").alias("_pa"), F.col("longitude").alias("_po"))
    m = members.select("member_id", F.col("latitude").alias("_ma"), F.col("longitude").alias("_mo"))
    out = rows.join(by_provider, "provider_id", "left").join(levels, "provider_id", "left").join(use, "member_id", "left").join(panel, ["provider_id", "service_date"], "left").join(p, "provider_id", "left").join(m, "member_id", "left")
    out = out.withColumns(
        {
            "paid_to_billed_ratio": C.paid_ratio(F.coalesce("paid_amount", F.lit(0.0)), F.coalesce("billed_amount", F.lit(0.0))),
            "log_paid_amount": F.log1p(F.greatest(F.col("paid_amount"), F.lit(0.0))),
            "em_level": level,
            "has_facility": F.col("facility_id").isNotNull().cast("int"),
            "has_referring_provider": F.col("referring_provider_id").isNotNull().cast("int"),
            "service_day_of_week": F.weekday("service_date"),
            "is_weekend": C.is_weekend(F.col("service_date")),
            "dist_member_provider_miles": C.haversine_miles(F.col("_ma"), F.col("_mo"), F.col("_pa"), F.col("_po")),
        }
    )
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(d)).cast("float").alias(c) for c, d in CLAIM_DEFAULTS.items()]
    return out.select("claim_id", "provider_id", *numbers, *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in CLAIM_CATEGORIES))


PROVIDER_NUMERIC = (
    "total_claims", "unique_members", "claims_per_member", "unique_procedures", "total_paid", "mean_paid", "median_paid", "std_paid", "max_paid", "total_billed", "paid_ratio", "em_claims", "high_level_share", "mean_minutes",
    "max_minutes", "weekend_rate", "active_days", "daily_mean", "daily_std", "daily_cv", "max_daily", "members_per_day",
)


def provider_features(claims: DataFrame, providers: DataFrame | None = None, snapshot: str | None = None, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Twenty-two behaviour features of each provider from claims up to the snapshot; NULL becomes the column's median."""
    rows = claims.where("provider_id is not null")
    if snapshot:
        rows = rows.where(F.col("service_date") <= F.to_date(F.lit(snapshot)))
    keys = [*extra_keys, "provider_id"]
    level = C.em_level_behaviour(F.col("procedure_code"))
    main = rows.withColumn("_level", level).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_claims"), F.countDistinct("member_id").alias("unique_members"), F.countDistinct("procedure_code").alias("unique_procedures"), F.sum("paid_amount").alias("total_paid"), F.avg("paid_amount").alias("mean_paid"),
        F.stddev_samp("paid_amount").alias("std_paid"), F.max("paid_amount").alias("max_paid"), F.sum("billed_amount").alias("total_billed"), F.sum((F.col("_level") > 0).cast("int")).alias("em_claims"),
        F.sum((F.col("_level") >= 4).cast("int")).alias("_high"), F.avg("service_minutes").alias("mean_minutes"), F.max("service_minutes").alias("max_minutes"), F.avg(C.is_weekend(F.col("service_date")).cast("double")).alias("weekend_rate"),
    )
    daily = rows.where("service_date is not null").groupBy(*keys, "service_date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("member_id").alias("m"))
    by_day = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("active_days"), F.avg("n").alias("daily_mean"), F.stddev_samp("n").alias("daily_std"), F.max("n").alias("max_daily"), F.avg("m").alias("members_per_day"))
    middle = W.quantiles(rows, keys, "paid_amount", {"median_paid": 0.5}).drop("n_values")
    out = main.join(by_day, keys, "left").join(middle, keys, "left").withColumns(
        {
            "claims_per_member": F.when(F.col("unique_members") > 0, F.col("total_claims") / F.col("unique_members")),
            "paid_ratio": F.when(F.col("total_billed") > 0, F.col("total_paid") / F.col("total_billed")),
            "high_level_share": F.when(F.col("em_claims") > 0, F.col("_high") / F.col("em_claims")).otherwise(0.0),
            "daily_cv": F.when(F.col("daily_mean") > 0, F.col("daily_std") / F.col("daily_mean")),
        }
    )
    out = materialize(out, "provider-features")
    names = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in PROVIDER_NUMERIC))
    middles = W.quantiles(out.select(F.inline(names)), ["name"], "value", {"m": 0.5})
    medians = middles.agg(*(F.max(F.when(F.col("name") == c, F.col("m"))).alias(f"_m_{c}") for c in PROVIDER_NUMERIC))
    filled = out.join(F.broadcast(medians)).select(*keys, *(F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)).alias(c) for c in PROVIDER_NUMERIC))
    if providers is None:
        return filled
    return providers.select("provider_id").distinct().join(filled, "provider_id")


def behaviour(claims: DataFrame, profile_average: float = 100.0) -> DataFrame:
    """Runs of activity, utilisation, referral and place features of each provider, as the second rule package has them."""
    runs = W.activity_runs(claims)
    rows = claims.where("provider_id is not null")
    out = rows.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("claim_count"), F.avg("paid_amount").alias("avg_amount"), F.countDistinct("member_id").alias("unique_patients"), F.countDistinct("state").alias("unique_states"), F.count("referring_provider_id").alias("referral_total"), F.countDistinct("referring_provider_id").alias("referral_unique")
    )
    return out.join(runs, "provider_id", "left").withColumns(
        {
            "volume_ratio": F.col("claim_count") / F.lit(profile_average),
            "claims_per_patient": F.when(F.col("unique_patients") > 0, F.col("claim_count") / F.col("unique_patients")).otherwise(0.0),
            "multi_state": (F.col("unique_states") > 1).cast("int"),
            "referral_repeat": F.when(F.col("referral_total") > 0, (F.col("referral_total") - F.col("referral_unique")) / F.col("referral_total")).otherwise(0.0),
        }
    )
