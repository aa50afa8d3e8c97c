"""Feature tables over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.operators import features as X
from claimsieve.operators import rules as R
from claimsieve.queries.common import EVENT_CLAIMS, R2, R6, event_claims, miles_sql, r2, r6, tables
from claimsieve.sources import views as V


def x01(spark, d):
    return X.claim_frequency(V.claims(spark, d)).select("claim_id", "claim_frequency")


X01 = f"{V.with_views('claims')} SELECT claim_id, count(*) OVER (PARTITION BY member_id, provider_id) AS claim_frequency FROM claims"


def x02(spark, d):
    out = X.level_distribution(V.claims(spark, d), F.least(F.lit(5), F.floor(F.col("service_minutes") / 10).cast("int") + 1))
    return out.select("provider_id", "total_em", *(f"em_{k}" for k in range(1, 6)), *(r6(f"share_{k}").alias(f"share_{k}") for k in range(1, 6)), r6("high_share").alias("high_share"))


_LEVELS = ", ".join(f"CAST(sum(CASE WHEN level = {k} THEN 1 ELSE 0 END) AS BIGINT) AS em_{k}, {R6(f'sum(CASE WHEN level = {k} THEN 1 ELSE 0 END) / count(*)')} AS share_{k}" for k in range(1, 6))
X02 = f"{V.with_views('claims')}, l AS (SELECT provider_id, least(5, CAST(floor(service_minutes / 10) AS INTEGER) + 1) AS level FROM claims) SELECT provider_id, count(*) AS total_em, {_LEVELS}, {R6('sum(CASE WHEN level >= 4 THEN 1 ELSE 0 END) / count(*)')} AS high_share FROM l GROUP BY 1"


def x03(spark, d):
    return R.utilisation(V.claims(spark, d)).select("provider_id", "total_claims", "unique_members", r2("total_paid").alias("total_paid"), r6("visits_per_member").alias("visits_per_member"))


X03 = f"{V.with_views('claims')} SELECT provider_id, count(*) AS total_claims, count(DISTINCT member_id) AS unique_members, {R2('sum(paid_amount)')} AS total_paid, {R6('count(*) / count(DISTINCT member_id)')} AS visits_per_member FROM claims GROUP BY 1"


def x05(spark, d):
    return X.member_utilisation(V.claims(spark, d))


X05 = f"""{V.with_views('claims')}, r AS (SELECT max(service_date) AS ref FROM claims) SELECT member_id, count(*) AS claim_count, count(DISTINCT provider_id) AS provider_count, count(DISTINCT procedure_code) AS procedure_count,
 CAST(max(ref) - max(service_date) AS INTEGER) AS days_since_last FROM claims CROSS JOIN r WHERE service_date <= ref AND service_date >= ref - 365 GROUP BY 1"""


def x07(spark, d):
    return X.duration_stats(V.claims(spark, d)).select("procedure_code", r6("p25").alias("p25"), r6("median").alias("median"), "n")


X07 = f"{V.with_views('claims')} SELECT procedure_code, {R6('quantile_cont(service_minutes, 0.25)')} AS p25, {R6('median(service_minutes)')} AS median, count(*) AS n FROM claims GROUP BY 1"


def _event_tables(spark, d):
    c = event_claims(spark, d).withColumns({"billed_amount": F.col("service_minutes"), "modifier": F.lit(None).cast("string"), "member_id": F.col("claim_id") % 500})
    return c, V.providers(spark, d), V.members(spark, d)


def x08(spark, d):
    """All columns, from events of which some lack an amount, minutes, a facility or a place; procedures are visits of all levels."""
    c, p, m = _event_tables(spark, d)
    k = F.col("claim_id")
    gone = lambda by, x: F.when(k % by == 0, None).otherwise(x)
    c = c.withColumns({"procedure_code": F.concat(F.lit("9921"), (k % 7).cast("string")), "paid_amount": gone(11, F.col("paid_amount")), "service_minutes": gone(5, F.col("service_minutes")), "allowed_amount": gone(3, F.col("paid_amount")), "facility_id": gone(4, F.col("facility_id")), "referring_provider_id": F.when(k % 6 == 0, "x"), "claim_type": F.when(k % 8 < 6, F.concat(F.lit("t"), (k % 2).cast("string"))), "pos_code": gone(9, F.col("pos_code"))})
    out = X.claim_features(c, p, m)
    return out.select("claim_id", "provider_id", *(F.round(F.col(n).cast("double") * 100).alias(n) for n in X.CLAIM_NUMERIC), *X.CLAIM_CATEGORIES)


_X08 = {
    "paid_amount": "coalesce(paid, 0)", "billed_amount": "billed", "allowed_amount": "coalesce(allowed, 0)", "paid_to_billed_ratio": "CASE WHEN billed > 0 THEN greatest(0, least(2, coalesce(paid, 0) / billed)) ELSE 1 END", "log_paid_amount": "ln(1 + coalesce(paid, 0))", "service_minutes": "coalesce(minutes, 30)",
    "em_level": "coalesce(lvl, 0)", "has_facility": "CASE WHEN fac IS NULL THEN 0 ELSE 1 END", "has_referring_provider": "CASE WHEN claim_id % 6 = 0 THEN 1 ELSE 0 END", "service_day_of_week": "isodow(service_date) - 1", "is_weekend": "CASE WHEN isodow(service_date) >= 6 THEN 1 ELSE 0 END",
    "rolling_7d_claims": "coalesce(c7, 0)", "rolling_30d_claims": "coalesce(c30, 0)", "rolling_90d_claims": "coalesce(c90, 0)", "rolling_30d_dollars": "coalesce(d30, 0)", "provider_total_claims": "pc", "provider_unique_members": "pm", "provider_total_paid": "coalesce(pp, 0)", "provider_visits_per_member": "pc / greatest(pm, 1)",
    "provider_em_45_share": "coalesce(hs, 0)", "member_total_claims": "coalesce(mc, 0)", "member_unique_providers": "coalesce(mp, 1)", "member_unique_cpts": "coalesce(mk, 0)", "member_days_since_last_claim": "coalesce(ml, 999)", "dist_member_provider_miles": "coalesce(" + miles_sql("m.latitude", "m.longitude", "p.latitude", "p.longitude") + ", 0)",
}
_X08_OUT = ", ".join(f"round(CAST(CAST({e} AS FLOAT) AS DOUBLE) * 100) AS {n}" for n, e in _X08.items())
X08 = f"""WITH {EVENT_CLAIMS}, providers AS ({V.SQL['providers']}), members AS ({V.SQL['members']}),
 c AS (SELECT claim_id, provider_id, claim_id % 500 AS member_id, service_date, service_minutes AS billed, CASE WHEN claim_id % 11 <> 0 THEN paid_amount END AS paid, CASE WHEN claim_id % 5 <> 0 THEN service_minutes END AS minutes, CASE WHEN claim_id % 3 <> 0 THEN paid_amount END AS allowed,
  CASE WHEN claim_id % 4 <> 0 THEN facility_id END AS fac, CASE WHEN claim_id % 8 < 6 THEN 't' || (claim_id % 2) END AS claim_type, CASE WHEN claim_id % 9 <> 0 THEN pos_code END AS place, CASE WHEN claim_id % 7 BETWEEN 1 AND 5 THEN claim_id % 7 END AS lvl, claim_id % 7 AS proc FROM event_claims),
 dd AS (SELECT provider_id, service_date, count(*) AS n, sum(paid) AS s FROM c GROUP BY 1, 2),
 pan AS (SELECT a.provider_id, a.service_date, sum(b.n) FILTER (WHERE b.service_date > a.service_date - 7) AS c7, sum(b.n) FILTER (WHERE b.service_date > a.service_date - 30) AS c30, sum(b.n) AS c90, sum(b.s) FILTER (WHERE b.service_date > a.service_date - 30) AS d30 FROM dd a JOIN dd b ON a.provider_id = b.provider_id AND b.service_date <= a.service_date AND b.service_date > a.service_date - 90 GROUP BY 1, 2),
 bp AS (SELECT provider_id, count(*) AS pc, count(DISTINCT member_id) AS pm, sum(paid) AS pp, avg(CASE WHEN lvl >= 4 THEN 1.0 ELSE 0.0 END) FILTER (WHERE lvl IS NOT NULL) AS hs FROM c GROUP BY 1), r AS (SELECT max(service_date) AS ref FROM c),
 bm AS (SELECT member_id, count(*) AS mc, count(DISTINCT provider_id) AS mp, count(DISTINCT proc) AS mk, max(ref) - max(service_date) AS ml FROM c CROSS JOIN r WHERE service_date >= ref - 365 GROUP BY 1)
 SELECT c.claim_id, c.provider_id, {_X08_OUT}, coalesce(place, 'unknown') AS pos_code, coalesce(claim_type, 'unknown') AS claim_type, coalesce(specialty, 'unknown') AS provider_specialty
 FROM c LEFT JOIN pan USING (provider_id, service_date) LEFT JOIN bp USING (provider_id) LEFT JOIN bm USING (member_id) LEFT JOIN providers p USING (provider_id) LEFT JOIN members m USING (member_id)"""


def x09(spark, d):
    f = X.provider_features(V.claims(spark, d), snapshot="2000-12-31")
    return f.select("provider_id", "total_claims", "unique_members", "unique_procedures", r2("total_paid").alias("total_paid"), r6("median_paid").alias("median_paid"), r6("weekend_rate").alias("weekend_rate"), "active_days", r6("daily_mean").alias("daily_mean"), r6("daily_std").alias("daily_std"), r6("daily_cv").alias("daily_cv"), "max_daily")


X09 = f"""{V.with_views('claims')}, c AS (SELECT * FROM claims WHERE service_date <= DATE '2000-12-31'), k AS (SELECT provider_id, service_date, count(*) AS n FROM c GROUP BY 1, 2), y AS (SELECT provider_id, count(*) AS active_days, avg(n) AS dm, stddev_samp(n) AS ds, max(n) AS md FROM k GROUP BY 1)
 SELECT c.provider_id, CAST(count(*) AS DOUBLE) AS total_claims, CAST(count(DISTINCT member_id) AS DOUBLE) AS unique_members, CAST(count(DISTINCT procedure_code) AS DOUBLE) AS unique_procedures, {R2('sum(paid_amount)')} AS total_paid, {R6('median(paid_amount)')} AS median_paid,
 {R6('avg(CASE WHEN isodow(service_date) >= 6 THEN 1.0 ELSE 0.0 END)')} AS weekend_rate, CAST(any_value(active_days) AS DOUBLE) AS active_days, {R6('any_value(dm)')} AS daily_mean, {R6('any_value(ds)')} AS daily_std, {R6('any_value(ds / dm)')} AS daily_cv, CAST(any_value(md) AS DOUBLE) AS max_daily FROM c JOIN y USING (provider_id) GROUP BY 1"""


def d11(spark, d):
    c = V.claims(spark, d).withColumns({"state": F.col("modifier"), "referring_provider_id": F.col("member_id") % 10})
    out = X.behaviour(c)
    return out.select("provider_id", "claim_count", r6("avg_amount").alias("avg_amount"), "unique_patients", "unique_states", "referral_total", "referral_unique", "longest_run", r6("weekend_ratio").alias("weekend_ratio"), "active_days", r6("volume_ratio").alias("volume_ratio"), r6("claims_per_patient").alias("claims_per_patient"), "multi_state", r6("referral_repeat").alias("referral_repeat"))


D11 = f"""{V.with_views('claims')}, d AS (SELECT DISTINCT provider_id, service_date FROM claims), i AS (SELECT *, service_date - CAST(row_number() OVER (PARTITION BY provider_id ORDER BY service_date) AS INTEGER) AS island FROM d),
 r AS (SELECT provider_id, island, count(*) AS run, sum(CASE WHEN isodow(service_date) >= 6 THEN 1 ELSE 0 END) AS weekend FROM i GROUP BY 1, 2), q AS (SELECT provider_id, max(run) AS longest_run, sum(weekend) / sum(run) AS wr, CAST(sum(run) AS BIGINT) AS active_days FROM r GROUP BY 1)
 SELECT c.provider_id, count(*) AS claim_count, {R6('avg(paid_amount)')} AS avg_amount, count(DISTINCT member_id) AS unique_patients, count(DISTINCT modifier) AS unique_states, count(member_id) AS referral_total, count(DISTINCT member_id % 10) AS referral_unique, any_value(longest_run) AS longest_run, {R6('any_value(wr)')} AS weekend_ratio,
 any_value(active_days) AS active_days, {R6('count(*) / 100')} AS volume_ratio, {R6('count(*) / count(DISTINCT member_id)')} AS claims_per_patient, CASE WHEN count(DISTINCT modifier) > 1 THEN 1 ELSE 0 END AS multi_state, {R6('(count(*) - count(DISTINCT member_id % 10)) / count(*)')} AS referral_repeat FROM claims c JOIN q USING (provider_id) GROUP BY 1"""
ENTRIES = {"x01_claim_frequency": (x01, X01), "x02_level_distribution": (x02, X02), "x03_utilisation": (x03, X03), "x05_member_utilisation": (x05, X05), "x07_duration_stats": (x07, X07), "x08_claim_features": (x08, X08), "x09_provider_features": (x09, X09), "d11_behaviour": (d11, D11)}
