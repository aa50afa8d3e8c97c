"""Windows, panels and aggregates over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.operators import windows as W
from claimsieve.queries.common import EVENT_CLAIMS, R2, R6, event_claims, r2, r6, tables
from claimsieve.queries.rules import _SPIKE, WEEKLY
from claimsieve.sources import views as V


def w01(spark, d):
    return W.rolling_days_count(V.claims(spark, d), ["member_id", "procedure_code"]).select("claim_id", "rolling_count")


W01 = f"{V.with_views('claims')} SELECT claim_id, count(*) OVER (PARTITION BY member_id, procedure_code ORDER BY service_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS rolling_count FROM claims"


def w02(spark, d):
    return W.daily_summary(V.claims(spark, d))


W02 = f"{V.with_views('claims')} SELECT provider_id, service_date, sum(service_minutes) AS total_minutes, count(*) AS claim_count FROM claims GROUP BY 1, 2"


def w03(spark, d):
    return W.weekly_panel(V.claims(spark, d)).withColumn("weekly_amount", r2("weekly_amount"))


W03 = f"{WEEKLY} SELECT provider_id, week_start, weekly_amount, weekly_claims FROM w"


def w04(spark, d):
    return W.trailing_median(W.weekly_panel(V.claims(spark, d))).select("provider_id", "week_start", r6("trailing_median").alias("trailing_median"), "history_weeks")


W04 = f"{WEEKLY} SELECT provider_id, week_start, {R6('trailing_median')} AS trailing_median, history_weeks FROM t"


def w05(spark, d):
    out = W.dense_panel(event_claims(spark, d))
    return out.withColumns({c: r2(c) for c in ("amount_7d", "amount_30d", "amount_90d")})


_SPANS = ", ".join(f"CAST(sum(n) OVER (PARTITION BY provider_id ORDER BY service_date RANGE BETWEEN INTERVAL {k - 1} DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS claims_{k}d, {R2(f'sum(amount) OVER (PARTITION BY provider_id ORDER BY service_date RANGE BETWEEN INTERVAL {k - 1} DAY PRECEDING AND CURRENT ROW)')} AS amount_{k}d" for k in (7, 30, 90))
W05 = f"""WITH {EVENT_CLAIMS}, s AS (SELECT provider_id, service_date, count(*) AS n, sum(paid_amount) AS amount FROM event_claims GROUP BY 1, 2),
 g AS (SELECT provider_id, CAST(unnest(generate_series(min(service_date), max(service_date), INTERVAL 1 DAY)) AS DATE) AS service_date FROM s GROUP BY 1),
 x AS (SELECT g.provider_id, g.service_date, coalesce(n, 0) AS n, coalesce(amount, 0) AS amount FROM g LEFT JOIN s USING (provider_id, service_date)) SELECT provider_id, service_date, {_SPANS} FROM x"""


def w06(spark, d):
    out = W.next_in(event_claims(spark, d).withColumn("ts", F.col("service_start_ts").cast("timestamp")), "provider_id", ["ts", "claim_id"], ["claim_id", "ts"])
    return out.where("next_claim_id is not null").select("provider_id", "claim_id", "next_claim_id", ((F.unix_micros("next_ts") - F.unix_micros("ts")) / 1e6).alias("gap_seconds"))


W06 = f"""WITH {EVENT_CLAIMS}, n AS (SELECT provider_id, claim_id, ts, lead(claim_id) OVER w AS next_claim_id, lead(ts) OVER w AS nt FROM event_claims WINDOW w AS (PARTITION BY provider_id ORDER BY ts, claim_id))
 SELECT provider_id, claim_id, next_claim_id, (epoch_us(nt) - epoch_us(ts)) / 1e6 AS gap_seconds FROM n WHERE nt IS NOT NULL"""


def w08(spark, d):
    return W.weekly_zscore(V.referrals(spark, d)).select("referring_provider_id", "week_start", "n", r6("mean").alias("mean"), r6("std").alias("std"), r6("z").alias("z"))


W08 = f"{_SPIKE} SELECT referring_provider_id, week_start, n, {R6('mean')} AS mean, {R6('std')} AS std, CASE WHEN k > 12 AND std > 0 THEN {R6('(n - mean) / std')} END AS z FROM s"


def w09(spark, d):
    return W.activity_runs(event_claims(spark, d)).withColumn("weekend_ratio", r6("weekend_ratio"))


W09 = f"""WITH {EVENT_CLAIMS}, d AS (SELECT DISTINCT provider_id, service_date FROM event_claims), i AS (SELECT *, service_date - CAST(row_number() OVER (PARTITION BY provider_id ORDER BY service_date) AS INTEGER) AS island FROM d),
 r AS (SELECT provider_id, island, count(*) AS run, CAST(sum(CASE WHEN isodow(service_date) >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS weekend FROM i GROUP BY 1, 2)
 SELECT provider_id, max(run) AS longest_run, {R6('sum(weekend) / sum(run)')} AS weekend_ratio, CAST(sum(run) AS BIGINT) AS active_days FROM r GROUP BY 1"""


def w10(spark, d):
    from claimsieve.operators.features import peer_stats
    from claimsieve.operators.rules import utilisation

    t = tables(spark, d)
    m = utilisation(t["claims"]).join(t["providers"].select("provider_id", "peer_group"), "provider_id")
    return peer_stats(m, "visits_per_member").select("provider_id", "peer_group", *(r6(c).alias(c) for c in ("visits_per_member", "peer_median", "peer_mad", "mad_z", "peer_p95")))


W10 = f"""{V.with_views('claims', 'providers')}, u AS (SELECT provider_id, count(*) / count(DISTINCT member_id) AS v FROM claims GROUP BY 1), p AS (SELECT u.*, peer_group, median(v) OVER (PARTITION BY peer_group) AS med, quantile_cont(v, 0.95) OVER (PARTITION BY peer_group) AS p95 FROM u JOIN providers USING (provider_id)),
 m AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY peer_group) AS mad FROM p) SELECT provider_id, peer_group, {R6('v')} AS visits_per_member, {R6('med')} AS peer_median, {R6('mad')} AS peer_mad, {R6('CASE WHEN mad > 0 THEN (v - med) / (1.4826 * mad) ELSE 0 END')} AS mad_z, {R6('p95')} AS peer_p95 FROM m"""


def w11(spark, d):
    e = event_claims(spark, d).select("claim_id", "paid_amount")
    return W.percent_rank_average(e, "paid_amount").select("claim_id", r6("percentile").alias("percentile"))


W11 = f"WITH {EVENT_CLAIMS} SELECT claim_id, {R6('(rank() OVER (ORDER BY paid_amount) + (count(*) OVER (PARTITION BY paid_amount) - 1) / 2) / count(*) OVER () * 100')} AS percentile FROM event_claims"


def w13(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("case_id"), F.col("s_suppkey").alias("queue_rank"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("effort_hours"))
    return W.greedy_capacity(s, 40.0).select("case_id", "selected", "hours_used")


W13 = """WITH RECURSIVE s AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) AS r, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS e FROM supplier),
 f AS (SELECT k, r, CASE WHEN e <= 40 THEN e ELSE 0.0 END AS used, e <= 40 AS sel FROM s WHERE r = 1 UNION ALL SELECT s.k, s.r, CASE WHEN f.used + s.e <= 40 THEN f.used + s.e ELSE f.used END, f.used + s.e <= 40 FROM f JOIN s ON s.r = f.r + 1)
 SELECT k AS case_id, sel AS selected, CASE WHEN sel THEN used END AS hours_used FROM f"""


def w14(spark, d):
    return W.same_day_events(event_claims(spark, d)).withColumn("total_paid", r2("total_paid"))


W14 = f"WITH {EVENT_CLAIMS} SELECT member_id, service_date, count(*) AS claim_count, count(DISTINCT provider_id) AS provider_count, {R2('sum(paid_amount)')} AS total_paid FROM event_claims GROUP BY 1, 2 HAVING count(*) > 1"


def w15(spark, d):
    return W.referral_history(V.referrals(spark, d))[0]


W15 = f"{V.with_views('referrals')} SELECT referring_provider_id, count(*) AS total_sent, min(referral_date) AS first_date, max(referral_date) AS last_date FROM referrals GROUP BY 1"


def w15b(spark, d):
    return W.referral_history(V.referrals(spark, d))[1]


W15B = f"{V.with_views('referrals')} SELECT referring_provider_id, target_provider_id, count(*) AS n FROM referrals GROUP BY 1, 2"


def a01(spark, d):
    """Plain aggregates with exact quantiles and conditional sums by provider."""
    c = V.claims(spark, d)
    return c.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("member_id").alias("members"), r6(F.percentile("service_minutes", F.lit(0.25))).alias("p25"), r6(F.percentile("service_minutes", F.lit(0.99))).alias("p99"), r6(F.stddev_samp("service_minutes")).alias("std"),
        F.sum(F.when(F.col("modifier") == "R", 1).otherwise(0)).alias("returned"), F.bool_or(F.col("status") == "F").alias("any_f"), F.array_join(F.sort_array(F.collect_set("modifier")), ",").alias("modifiers"),
    )


A01 = f"""{V.with_views('claims')} SELECT provider_id, count(*) AS n, count(DISTINCT member_id) AS members, {R6('quantile_cont(service_minutes, 0.25)')} AS p25, {R6('quantile_cont(service_minutes, 0.99)')} AS p99, {R6('stddev_samp(service_minutes)')} AS std,
 CAST(sum(CASE WHEN modifier = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, bool_or(status = 'F') AS any_f, string_agg(DISTINCT modifier, ',' ORDER BY modifier) AS modifiers FROM claims GROUP BY 1"""
ENTRIES = {
    "w01_rolling_30d": (w01, W01), "w02_daily_summary": (w02, W02), "w03_weekly_panel": (w03, W03), "w04_trailing_median": (w04, W04), "w05_dense_panel": (w05, W05), "w06_next_service": (w06, W06), "w08_weekly_zscore": (w08, W08), "w09_activity_runs": (w09, W09),
    "w10_peer_stats": (w10, W10), "w11_percent_rank": (w11, W11), "w13_greedy_capacity": (w13, W13), "w14_same_day_events": (w14, W14), "w15_referrals_sent": (w15, W15), "w15_referral_pairs": (w15b, W15B), "a01_aggregates": (a01, A01),
}
