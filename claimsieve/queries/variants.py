"""The second set of rules over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.operators import variants as D
from claimsieve.queries.common import R2, R6, r2, r6, tables
from claimsieve.sources import views as V


def d01(spark, d):
    c = V.claims(spark, d).select("claim_id", F.col("provider_id").alias("member_id"), "provider_id", "procedure_code", "service_date", F.col("service_minutes").alias("billed_amount"))
    return D.group_duplicates(c).select("provider_id", "procedure_code", "service_date", "n", F.array_join("claim_ids", ",").alias("claim_ids"), "est_dollars")


D01 = f"{V.with_views('claims')} SELECT provider_id, procedure_code, service_date, count(*) AS n, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids, service_minutes * (count(*) - 1) AS est_dollars FROM claims GROUP BY provider_id, procedure_code, service_date, service_minutes HAVING count(*) > 1"


def d02(spark, d):
    t = tables(spark, d)
    c = t["claims"].withColumn("em_level", F.least(F.lit(5), F.floor(F.col("service_minutes") / 10).cast("int") + 1))
    return D.upcoding_among_large(c, t["providers"], 20, 0.5, 1.0).select("provider_id", "total_em", r6("high_share").alias("high_share"), r6("mad_z").alias("mad_z"), "severity", r2("est_dollars").alias("est_dollars"))


D02 = f"""{V.with_views('claims', 'providers')}, s AS (SELECT provider_id, count(*) AS total_em, sum(CASE WHEN service_minutes >= 30 THEN 1 ELSE 0 END) / count(*) AS hs, sum(billed_amount) AS billed FROM claims GROUP BY 1 HAVING count(*) >= 20), p AS (SELECT s.*, peer_group, median(hs) OVER (PARTITION BY peer_group) AS pm FROM s JOIN providers USING (provider_id)),
 m AS (SELECT *, median(abs(hs - pm)) OVER (PARTITION BY peer_group) AS mad FROM p), z AS (SELECT *, CASE WHEN mad > 0 THEN (hs - pm) / (1.4826 * mad) ELSE 0 END AS z FROM m)
 SELECT provider_id, total_em, {R6('hs')} AS high_share, {R6('z')} AS mad_z, CASE WHEN z > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, {R2('greatest(0, round(billed * 0.35 * (hs - pm) * 100) / 100)')} AS est_dollars FROM z WHERE z > 0.5"""
_PANELS = {"Brand#1": ("Brand#2", "Brand#3", "Brand#4"), "Brand#5": ("Brand#6", "Brand#7", "Brand#8", "Brand#9")}


def d03(spark, d):
    c = V.claims(spark, d).withColumns({"member_id": F.col("member_id") % 50, "service_date": F.to_date(F.date_trunc("month", "service_date"))})
    return D.panel_unbundling(c, _PANELS).withColumn("est_dollars", r2("est_dollars"))


D03 = f"""{V.with_views('claims')}, b AS (SELECT member_id % 50 AS member_id, provider_id, CAST(date_trunc('month', service_date) AS DATE) AS service_date, procedure_code, billed_amount FROM claims),
 panels AS (SELECT * FROM (VALUES ('Brand#1', ['Brand#2', 'Brand#3', 'Brand#4']), ('Brand#5', ['Brand#6', 'Brand#7', 'Brand#8', 'Brand#9'])) t(panel, parts)), days AS (SELECT member_id, provider_id, service_date, list(DISTINCT procedure_code) AS cs FROM b GROUP BY ALL),
 m AS (SELECT days.*, panel, list_sort(list_filter(parts, lambda x: list_contains(cs, x))) AS f, list_contains(cs, panel) AS wp FROM days CROSS JOIN panels), h AS (SELECT * FROM m WHERE (wp AND len(f) >= 1) OR (NOT wp AND len(f) >= 3)),
 r AS (SELECT days.provider_id, count(*) AS enc, count(u.k) AS unb FROM days LEFT JOIN (SELECT DISTINCT member_id, provider_id, service_date, 1 AS k FROM h WHERE wp) u USING (member_id, provider_id, service_date) GROUP BY 1)
 SELECT h.member_id, h.provider_id, h.service_date, panel, array_to_string(f, ',') AS components, wp AS with_panel, {R2('CASE WHEN wp THEN (SELECT sum(billed_amount) FROM b WHERE b.member_id = h.member_id AND b.provider_id = h.provider_id AND b.service_date = h.service_date AND list_contains(h.f, b.procedure_code)) ELSE 0 END')} AS est_dollars,
 CASE WHEN NOT wp THEN 'LOW' WHEN unb / enc > 0.2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM h JOIN r ON r.provider_id = h.provider_id"""


def d04(spark, d):
    t = tables(spark, d)
    m = t["members"].withColumns({"termination_date": F.col("enrollment_end"), "gender": F.when(F.col("member_id") % 2 == 0, "M").otherwise("F")})
    p = t["providers"].withColumn("status", F.when(F.col("provider_id") % 11 == 0, "Suspended").otherwise("active"))
    return D.phantom_claims(t["claims"], m, p, female=("Brand#1",), male=("Brand#2",))


D04 = f"""{V.with_views('claims', 'members')}, c AS (SELECT * FROM claims LEFT JOIN members USING (member_id)) SELECT claim_id, member_id, provider_id, 'after_death' AS reason, 'CRITICAL' AS severity, billed_amount FROM c WHERE service_date > death_date
 UNION ALL SELECT claim_id, member_id, provider_id, 'after_termination', 'HIGH', billed_amount FROM c WHERE service_date > enrollment_end
 UNION ALL SELECT claim_id, member_id, provider_id, 'gender', 'CRITICAL', billed_amount FROM c WHERE (member_id % 2 = 0 AND procedure_code = 'Brand#1') OR (member_id % 2 <> 0 AND procedure_code = 'Brand#2')
 UNION ALL SELECT claim_id, member_id, provider_id, 'provider_status', 'HIGH', billed_amount FROM c WHERE provider_id % 11 = 0"""


def d05(spark, d):
    return D.impossible_days(V.claims(spark, d), {"Brand#1": 60, "Brand#2": 45}, 15, 60)


D05 = f"{V.with_views('claims')} SELECT provider_id, service_date, CAST(sum(CASE procedure_code WHEN 'Brand#1' THEN 60 WHEN 'Brand#2' THEN 45 ELSE 15 END) AS BIGINT) AS minutes, count(*) AS claim_count FROM claims GROUP BY 1, 2 HAVING sum(CASE procedure_code WHEN 'Brand#1' THEN 60 WHEN 'Brand#2' THEN 45 ELSE 15 END) > 60"


def d05b(spark, d):
    """Every third provider has a history, of which some is 0."""
    t = tables(spark, d)
    p = t["providers"].withColumn("historical_daily", F.when(F.col("provider_id") % 3 == 0, F.col("provider_id") % 4 * 0.5))
    return D.volume_against_baseline(t["claims"], p, 1.01, 1.05).select("provider_id", r6("avg_daily").alias("avg_daily"), r6("baseline").alias("baseline"), "severity")


D05B = f"""{V.with_views('claims')}, a AS (SELECT provider_id, avg(n) AS ad FROM (SELECT provider_id, service_date, count(*) AS n FROM claims GROUP BY 1, 2) GROUP BY 1), b AS (SELECT *, CASE WHEN provider_id % 3 = 0 AND provider_id % 4 > 0 THEN provider_id % 4 * 0.5 ELSE (SELECT median(ad) FROM a) END AS base FROM a)
 SELECT provider_id, {R6('ad')} AS avg_daily, {R6('base')} AS baseline, CASE WHEN ad > 1.05 * base THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM b WHERE ad > 1.01 * base"""


def d06(spark, d):
    c = V.claims(spark, d).withColumns({"member_id": F.col("member_id") % 100, "state": F.col("modifier"), "claim_type": F.when(F.col("provider_id") % 3 == 0, "Inpatient").otherwise("Office")})
    return D.impossible_places(c).withColumn("est_dollars", r2("est_dollars"))


D06 = f"""{V.with_views('claims')}, c AS (SELECT claim_id, member_id % 100 AS member_id, provider_id, service_date, modifier, billed_amount, provider_id % 3 = 0 AS inp FROM claims), s AS (SELECT member_id, service_date, count(DISTINCT modifier) > 1 AS st, bool_or(inp) AND bool_or(NOT inp) AS mx, sum(billed_amount) / count(*) AS e FROM c GROUP BY 1, 2)
 SELECT claim_id, member_id, provider_id, service_date, st AS states, mx AS mixed, {R2('e')} AS est_dollars FROM c JOIN s USING (member_id, service_date) WHERE st OR mx"""


def d07(spark, d):
    r = V.referrals(spark, d).select(F.col("referring_provider_id"), F.col("target_provider_id").alias("provider_id"))
    return D.referral_anomalies(r, 20, 0.02, 40, 0.02).withColumn("share", r6("share"))


D07 = f"""{V.with_views('referrals')}, s AS (SELECT referring_provider_id AS a, target_provider_id AS b, count(*) AS n FROM referrals GROUP BY 1, 2), t AS (SELECT a, CAST(sum(n) AS BIGINT) AS total FROM s GROUP BY 1)
 SELECT s.a AS provider_id, s.b AS target_id, s.n, t.total, {R6('s.n / t.total')} AS share, coalesce(k.n, 0) AS n_back, CASE WHEN tb.total > 40 AND k.n / tb.total > 0.02 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
 FROM s JOIN t USING (a) LEFT JOIN s k ON k.a = s.b AND k.b = s.a LEFT JOIN t tb ON tb.a = s.b WHERE t.total > 20 AND s.n / t.total > 0.02"""


def d08(spark, d):
    t = tables(spark, d)
    return D.out_of_state_routine(t["claims"].withColumn("state", (F.col("provider_id") % 5).cast("string")), t["members"].withColumn("state", (F.col("member_id") % 5).cast("string")), ("Brand#1", "Brand#2"))


D08 = f"{V.with_views('claims')} SELECT claim_id, member_id, provider_id, CAST(member_id % 5 AS VARCHAR) AS member_state, CAST(provider_id % 5 AS VARCHAR) AS state, billed_amount AS est_dollars FROM claims WHERE procedure_code IN ('Brand#1', 'Brand#2') AND provider_id % 5 <> member_id % 5"


def d09(spark, d):
    return D.shared_members(V.claims(spark, d), 40)


D09 = f"{V.with_views('claims')}, p AS (SELECT member_id, provider_id, count(*) AS claim_count FROM claims GROUP BY 1, 2) SELECT member_id, provider_id, claim_count, count(*) OVER (PARTITION BY member_id) AS provider_count FROM p QUALIFY count(*) OVER (PARTITION BY member_id) > 40"


def d10(spark, d):
    """Every second provider has a history, of which some is 0 or less."""
    p = V.providers(spark, d).select("provider_id", F.when(F.col("provider_id") % 2 == 0, (F.col("provider_id") % 7 - 1) * 4000).alias("historical_weekly"))
    return D.weekly_billing_bursts(V.claims(spark, d), p, floor=100000).withColumns({"billed": r2("billed"), "est_dollars": r2("est_dollars")})


D10 = f"""{V.with_views('claims')}, w AS (SELECT provider_id, strftime(service_date, '%G-W%V') AS iso_week, sum(billed_amount) AS billed, CASE WHEN provider_id % 2 = 0 AND provider_id % 7 > 1 THEN (provider_id % 7 - 1) * 4000.0 ELSE 5000.0 END::DOUBLE AS baseline FROM claims GROUP BY 1, 2)
 SELECT provider_id, iso_week, {R2('billed')} AS billed, baseline, 'CRITICAL' AS severity, {R2('billed - baseline')} AS est_dollars FROM w WHERE billed > 100000 AND billed > 10 * baseline"""


def d12(spark, d):
    """Rows by finding of the whole second package."""
    t = tables(spark, d)
    found = D.run_detection({"claims": t["claims"], "providers": t["providers"], "members": t["members"]})
    out = None
    for name, df in sorted(found.items()):
        part = df.agg(F.lit(name).alias("finding"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def d12b(spark, d):
    """Feature tables of the second package, a row for each feature; and its alerts and evidence, which must match."""
    t = tables(spark, d)
    out = D.detection_output(t)
    parts = [out[f"{n}_features"].select(F.lit(n).alias("kind"), "entity_id", F.explode("features").alias("feature", "value")) for n in ("temporal", "geographic", "referral")]
    lost = out["alerts"].join(out["evidence"], F.col("evidence_ids")[0] == F.col("evidence_id"), "full").where("alert_id is null or evidence_id is null")
    parts.append(lost.agg(F.lit("alerts").alias("kind"), F.lit("").alias("entity_id"), F.lit("without evidence").alias("feature"), F.count(F.lit(1)).cast("double").alias("value")))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return rows.withColumn("value", r6("value"))


D12B = f"""{V.with_views('claims', 'members', 'referrals')}, w AS (SELECT provider_id, strftime(service_date, '%G-W%V') AS w, count(*) AS n, sum(CAST(paid_amount AS DECIMAL(24, 6))) AS paid FROM claims GROUP BY 1, 2), t AS (SELECT provider_id, count(*) AS a, max(n) AS b, CAST(sum(paid) AS DOUBLE) / count(paid) AS c, max(paid) AS e FROM w GROUP BY 1),
 g AS (SELECT provider_id, count(DISTINCT county) AS a, count(DISTINCT member_id) AS b FROM claims JOIN members USING (member_id) GROUP BY 1), r AS (SELECT referring_provider_id AS provider_id, count(*) AS a, count(DISTINCT target_provider_id) AS b FROM referrals GROUP BY 1),
 l AS (SELECT 'temporal' AS kind, provider_id, unnest([struct_pack(f := 'active_weeks', v := a::DOUBLE), struct_pack(f := 'most_weekly_claims', v := b::DOUBLE), struct_pack(f := 'mean_weekly_paid', v := c::DOUBLE), struct_pack(f := 'most_weekly_paid', v := e::DOUBLE)]) AS x FROM t
 UNION ALL SELECT 'geographic', provider_id, unnest([struct_pack(f := 'counties', v := a::DOUBLE), struct_pack(f := 'members', v := b::DOUBLE)]) FROM g UNION ALL SELECT 'referral', provider_id, unnest([struct_pack(f := 'sent', v := a::DOUBLE), struct_pack(f := 'targets', v := b::DOUBLE)]) FROM r)
 SELECT kind, CAST(provider_id AS VARCHAR) AS entity_id, x.f AS feature, {R6('x.v')} AS value FROM l UNION ALL SELECT 'alerts', '', 'without evidence', 0.0"""


ENTRIES = {
    "d01_group_duplicates": (d01, D01), "d02_upcoding_large": (d02, D02), "d03_panels": (d03, D03), "d04_phantom": (d04, D04), "d05_impossible_days": (d05, D05), "d05_volume_baseline": (d05b, D05B), "d06_impossible_places": (d06, D06), "d07_referral_anomalies": (d07, D07),
    "d08_out_of_state": (d08, D08), "d09_shared_members": (d09, D09), "d10_billing_bursts": (d10, D10), "d12_detection": (d12, None), "d12_output_tables": (d12b, D12B),
}
