"""The detection rules over the test tables, with thresholds at which they find something."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.operators import rules as R
from claimsieve.queries.common import EVENT_CLAIMS, R2, R6, event_claims, miles_sql, r2, r6, tables
from claimsieve.sources import views as V
from claimsieve.sources.config import RuleConfig


def _dup_claims(spark, d):
    return {"claims": V.claims(spark, d).select("claim_id", F.col("provider_id").alias("member_id"), "provider_id", "procedure_code", "service_date", F.col("service_minutes").alias("billed_amount"), "modifier", "status")}


_DUP_CFG = RuleConfig(legitimate_modifiers=("R",), void_statuses=("x",), corrected_statuses=("y",))
_DUP = f"{V.with_views('claims')}, c AS (SELECT claim_id, provider_id, procedure_code, service_date, service_minutes AS amount FROM claims WHERE modifier <> 'R')"


def r01a(spark, d):
    return R.exact_duplicates(_dup_claims(spark, d), _DUP_CFG)


R01A = f"{_DUP} SELECT a.provider_id, a.claim_id AS claim_id_a, b.claim_id AS claim_id_b, a.amount AS est_dollars FROM c a JOIN c b USING (provider_id, procedure_code, service_date, amount) WHERE a.claim_id < b.claim_id"


def r01b(spark, d):
    return R.near_duplicates(_dup_claims(spark, d), R.RuleConfig(legitimate_modifiers=("R",), near_duplicate_days=2))


R01B = f"""{_DUP} SELECT a.provider_id, least(a.claim_id, b.claim_id) AS claim_id_a, greatest(a.claim_id, b.claim_id) AS claim_id_b, CAST(b.service_date - a.service_date AS INTEGER) AS gap, a.amount AS est_dollars
 FROM c a JOIN c b USING (provider_id, procedure_code, amount) WHERE b.service_date - a.service_date BETWEEN 1 AND 2"""


def r02(spark, d):
    t = tables(spark, d)
    level = F.least(F.lit(5), F.floor(F.col("service_minutes") / 10).cast("int") + 1)
    t["claims"] = t["claims"].withColumn("em_level", level)
    found = R.upcoding(t, RuleConfig(mad_z=1.0, share_multiplier=1.02, min_em_claims=20))
    return found.select("provider_id", "peer_group", "total_em", r6("high_share").alias("high_share"), r6("peer_median").alias("peer_median"), r6("mad_z").alias("mad_z"), r2("est_dollars").alias("est_dollars"))


R02 = f"""{V.with_views('claims', 'providers')}, l AS (SELECT provider_id, least(5, CAST(floor(service_minutes / 10) AS INTEGER) + 1) AS level, paid_amount FROM claims),
 s AS (SELECT provider_id, count(*) AS total_em, sum(CASE WHEN level >= 4 THEN 1 ELSE 0 END) / count(*) AS high_share, sum(CASE WHEN level >= 4 THEN paid_amount ELSE 0 END) AS amount FROM l GROUP BY 1),
 p AS (SELECT s.*, peer_group, median(high_share) OVER (PARTITION BY peer_group) AS peer_median FROM s JOIN providers USING (provider_id)),
 m AS (SELECT *, median(abs(high_share - peer_median)) OVER (PARTITION BY peer_group) AS mad FROM p), z AS (SELECT *, CASE WHEN mad > 0 THEN (high_share - peer_median) / (1.4826 * mad) ELSE 0 END AS mad_z FROM m)
 SELECT provider_id, peer_group, total_em, {R6('high_share')} AS high_share, {R6('peer_median')} AS peer_median, {R6('mad_z')} AS mad_z, {R2('amount * 0.35')} AS est_dollars FROM z WHERE total_em >= 20 AND mad_z > 1 AND high_share >= 1.02 * peer_median"""


def _bundles(spark, d):
    t = tables(spark, d)
    pairs = [(f"Brand#{i}", f"Brand#{i + 1}") for i in range(1, 8)]
    t["claims"] = t["claims"].withColumns({"member_id": F.col("member_id") % 50, "service_date": F.to_date(F.date_trunc("month", "service_date"))})
    t["bundling_pairs"] = spark.createDataFrame(pairs, "comprehensive_cpt string, component_cpt string")
    return t, RuleConfig(override_modifiers=("R",))


_BUNDLE = f"""{V.with_views('claims')}, pairs AS (SELECT 'Brand#' || i AS comprehensive_cpt, 'Brand#' || (i + 1) AS component_cpt FROM range(1, 8) t(i)),
 codes AS (SELECT comprehensive_cpt AS code FROM pairs UNION SELECT component_cpt FROM pairs),
 b AS (SELECT claim_id, member_id % 50 AS member_id, provider_id, CAST(date_trunc('month', service_date) AS DATE) AS service_date, procedure_code, modifier, paid_amount FROM claims WHERE procedure_code IN (SELECT code FROM codes)),
 days AS (SELECT member_id, provider_id, service_date, max(CASE WHEN modifier = 'R' THEN 1 ELSE 0 END) AS o, list(DISTINCT procedure_code) AS cs FROM b GROUP BY ALL),
 rates AS (SELECT provider_id, count(*) AS total_days, CAST(sum(CASE WHEN o = 0 AND EXISTS (SELECT 1 FROM pairs WHERE list_contains(cs, comprehensive_cpt) AND list_contains(cs, component_cpt)) THEN 1 ELSE 0 END) AS BIGINT) AS unbundled_days FROM days GROUP BY 1)"""


def r03(spark, d):
    t, cfg = _bundles(spark, d)
    return R.unbundling(t, cfg).select("member_id", "provider_id", "service_date", "comprehensive_cpt", "component_cpt", r2("est_dollars").alias("est_dollars"), "severity", F.size("claim_ids").alias("n_claims"))


R03 = f"""{_BUNDLE}, c AS (SELECT member_id, provider_id, service_date, procedure_code, sum(coalesce(billed, 0)) AS amount, count(*) AS n FROM (SELECT b.*, paid_amount AS billed FROM b JOIN days USING (member_id, provider_id, service_date) WHERE o = 0) GROUP BY ALL),
 cut AS (SELECT quantile_cont(unbundled_days / total_days, 0.95) AS cut FROM rates)
 SELECT x.member_id, x.provider_id, x.service_date, comprehensive_cpt, component_cpt, {R2('y.amount')} AS est_dollars, CASE WHEN unbundled_days / total_days > cut THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(x.n + y.n AS INTEGER) AS n_claims
 FROM c x JOIN pairs ON x.procedure_code = comprehensive_cpt JOIN c y ON y.procedure_code = component_cpt AND x.member_id = y.member_id AND x.provider_id = y.provider_id AND x.service_date = y.service_date
 JOIN rates ON rates.provider_id = x.provider_id CROSS JOIN cut"""


def x04(spark, d):
    t, cfg = _bundles(spark, d)
    return R.unbundling_rates(t, cfg).select("provider_id", "total_days", "unbundled_days", r6("rate").alias("rate"))


X04 = f"{_BUNDLE} SELECT provider_id, total_days, unbundled_days, {R6('unbundled_days / total_days')} AS rate FROM rates"


def r04a(spark, d):
    return R.after_death(tables(spark, d))


R04A = f"{V.with_views('claims', 'members')} SELECT claim_id, member_id, provider_id, service_date, death_date, billed_amount AS est_dollars FROM claims JOIN members USING (member_id) WHERE service_date > death_date"


def r04b(spark, d):
    return R.after_enrollment(tables(spark, d))


R04B = f"{V.with_views('claims', 'members')} SELECT claim_id, member_id, provider_id, service_date, enrollment_end AS end_date, billed_amount AS est_dollars FROM claims JOIN members USING (member_id) WHERE service_date > enrollment_end"


def _facility_claims(spark, d):
    t = tables(spark, d)
    t["claims"] = t["claims"].withColumn("facility_id", F.col("provider_id"))
    return t


def r04c(spark, d):
    t = tables(spark, d)
    t["claims"] = t["claims"].withColumn("facility_id", F.col("provider_id") % 10)
    o = spark.read.parquet(f"{d}/orders.parquet")
    t["inpatient_stays"] = o.select(F.col("o_custkey").alias("member_id"), (F.col("o_orderkey") % 10).alias("facility_id"), F.to_date("o_orderdate").alias("admit_date"), F.date_add(F.to_date("o_orderdate"), 30).alias("disch_date"))
    return R.during_stay(t)


R04C = f"""{V.with_views('claims')}, stays AS (SELECT o_custkey AS member_id, o_orderkey % 10 AS stay_facility_id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 30 AS b FROM orders)
 SELECT claim_id, c.member_id, provider_id, service_date, provider_id % 10 AS facility_id, stay_facility_id, billed_amount AS est_dollars FROM claims c JOIN stays s ON c.member_id = s.member_id AND service_date BETWEEN a AND b AND provider_id % 10 <> stay_facility_id"""


def r04d(spark, d):
    return R.closed_facility(_facility_claims(spark, d))


R04D = f"{V.with_views('claims', 'facilities')} SELECT claim_id, member_id, provider_id, service_date, facility_id, billed_amount AS est_dollars FROM claims JOIN facilities ON facility_id = provider_id WHERE service_date > close_date OR service_date < open_date"


def r04e(spark, d):
    return R.non_operating_day(_facility_claims(spark, d))


R04E = f"""{V.with_views('claims', 'facilities')} SELECT claim_id, member_id, provider_id, service_date, facility_id, billed_amount AS est_dollars FROM claims JOIN facilities ON facility_id = provider_id
 WHERE operating_days IS NOT NULL AND NOT contains(operating_days, strftime(service_date, '%a'))"""


def r04f(spark, d):
    return R.orphan_ambulance(tables(spark, d), RuleConfig(ambulance_prefix="Brand#1"))


R04F = f"""{V.with_views('claims')} SELECT claim_id, member_id, provider_id, service_date, billed_amount AS est_dollars FROM claims c WHERE procedure_code LIKE 'Brand#1%'
 AND NOT EXISTS (SELECT 1 FROM claims o WHERE o.member_id = c.member_id AND o.procedure_code NOT LIKE 'Brand#1%' AND abs(o.service_date - c.service_date) <= 1)"""


def r04g(spark, d):
    return R.ghost_members(tables(spark, d)["claims"], RuleConfig(ghost_months=66, ghost_claims=2)).select("member_id", "provider_id", "claim_count", F.array_join("claim_ids", ",").alias("claim_ids"))


R04G = f"""{V.with_views('claims')}, cut AS (SELECT max(service_date) - INTERVAL 66 MONTH AS cut FROM claims), g AS (SELECT member_id FROM claims CROSS JOIN cut GROUP BY member_id, cut HAVING min(service_date) > cut)
 SELECT member_id, provider_id, count(*) AS claim_count, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids FROM claims CROSS JOIN cut WHERE member_id IN (SELECT member_id FROM g) AND service_date > cut GROUP BY 1, 2 HAVING count(*) >= 2"""


def r05a(spark, d):
    found = R.over_caps(tables(spark, d), RuleConfig(caps={"ones": (("Brand#1",), 2), "twos": (("Brand#2",), 1)}))
    return found.select("member_id", "code_group", "cap", "peak", "peak_date", "over_rows", r2("est_dollars").alias("est_dollars"))


R05A = f"""{V.with_views('claims')}, g AS (SELECT *, CASE WHEN procedure_code LIKE 'Brand#1%' THEN 'ones' ELSE 'twos' END AS code_group, CASE WHEN procedure_code LIKE 'Brand#1%' THEN 2 ELSE 1 END AS cap
 FROM claims WHERE procedure_code LIKE 'Brand#1%' OR procedure_code LIKE 'Brand#2%'), r AS (SELECT *, count(*) OVER (PARTITION BY member_id, code_group ORDER BY service_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS n FROM g)
 SELECT member_id, code_group, cap, max(n) AS peak, arg_min(service_date, (-n) * 1000000.0 + (service_date - DATE '1990-01-01')) AS peak_date, count(*) AS over_rows, {R2('avg(paid_amount) * (max(n) - cap)')} AS est_dollars FROM r WHERE n > cap GROUP BY 1, 2, 3"""


def r05b(spark, d):
    found = R.excessive_providers(tables(spark, d), RuleConfig(peer_multiplier=1.01))
    return found.select("provider_id", "total_claims", "unique_members", r2("total_paid").alias("total_paid"), r6("visits_per_member").alias("visits_per_member"), "peer_group", r6("peer_median").alias("peer_median"))


_UTIL = "u AS (SELECT provider_id, count(*) AS total_claims, count(DISTINCT member_id) AS unique_members, sum(paid_amount) AS total_paid, count(*) / count(DISTINCT member_id) AS vpm FROM claims GROUP BY 1)"
R05B = f"""{V.with_views('claims', 'providers')}, {_UTIL}, m AS (SELECT u.*, peer_group, median(vpm) OVER (PARTITION BY peer_group) AS pm FROM u JOIN providers USING (provider_id))
 SELECT provider_id, total_claims, unique_members, {R2('total_paid')} AS total_paid, {R6('vpm')} AS visits_per_member, peer_group, {R6('pm')} AS peer_median FROM m WHERE vpm > 1.01 * pm"""


def r06a(spark, d):
    return R.overloaded_days(tables(spark, d), RuleConfig(day_minutes=100))


R06A = f"{V.with_views('claims')} SELECT provider_id, service_date, sum(service_minutes) AS total_minutes, count(*) AS claim_count FROM claims GROUP BY 1, 2 HAVING sum(service_minutes) > 100"


def r06b(spark, d):
    t = {"claims": event_claims(spark, d), "providers": V.providers(spark, d)}
    found = R.impossible_travel(t, RuleConfig(travel_mph=60))
    return found.select("provider_id", "claim_id_a", "claim_id_b", r6("miles").alias("miles"), r6("gap_hours").alias("gap_hours"), r2("mph").alias("mph"))


R06B = f"""WITH {EVENT_CLAIMS}, n AS (SELECT *, lead(claim_id) OVER w AS nc, lead(ts) OVER w AS nt, lead(latitude) OVER w AS nlat, lead(longitude) OVER w AS nlon FROM event_claims WHERE pos_code <> '02' WINDOW w AS (PARTITION BY provider_id ORDER BY ts, claim_id)),
 g AS (SELECT provider_id, claim_id, nc, {miles_sql('latitude', 'longitude', 'nlat', 'nlon')} AS miles, (epoch_us(nt) - epoch_us(ts)) / 3.6e9 AS h FROM n WHERE nc IS NOT NULL)
 SELECT provider_id, claim_id AS claim_id_a, nc AS claim_id_b, {R6('miles')} AS miles, {R6('h')} AS gap_hours, {R2('miles / h')} AS mph FROM g WHERE h > 0 AND miles / h > 60"""


def r06c(spark, d):
    c = event_claims(spark, d).withColumn("provider_id", F.col("claim_id") % 3)
    return R.member_overlaps({"claims": c})


R06C = f"""WITH {EVENT_CLAIMS}, n AS (SELECT member_id, claim_id, claim_id % 3 AS provider_id, facility_id, epoch_us(ts) + CAST(trunc(service_minutes * 6e7) AS BIGINT) AS e, lead(claim_id) OVER w AS nc, lead(epoch_us(ts)) OVER w AS nt, lead(facility_id) OVER w AS nf
 FROM event_claims WHERE pos_code <> '02' WINDOW w AS (PARTITION BY member_id ORDER BY ts, claim_id))
 SELECT member_id, claim_id AS claim_id_a, nc AS claim_id_b, provider_id, nc % 3 AS next_provider_id FROM n WHERE nt < e AND provider_id <> nc % 3 AND facility_id <> nf"""


def r07a(spark, d):
    found = R.concentration(tables(spark, d), RuleConfig(concentration=0.02, min_referrals=100))
    return found.select("referring_provider_id", "total", "top_n", "top_target", r6("share").alias("share"), r6("peer_median").alias("peer_median"))


_PAIRS = f"{V.with_views('referrals')}, p AS (SELECT referring_provider_id AS a, target_provider_id AS b, count(*) AS n FROM referrals GROUP BY 1, 2)"
R07A = f"""{_PAIRS}, t AS (SELECT a, CAST(sum(n) AS BIGINT) AS total, max(n) AS top_n, arg_max(b, n * 1000000 - b) AS top_target FROM p GROUP BY a), m AS (SELECT median(top_n / total) AS pm FROM t WHERE total >= 100)
 SELECT a AS referring_provider_id, total, top_n, top_target, {R6('top_n / total')} AS share, {R6('pm')} AS peer_median FROM t CROSS JOIN m WHERE total >= 100 AND top_n / total > 0.02"""


def r07b(spark, d):
    return R.reciprocal_loops(tables(spark, d), RuleConfig(reciprocal=8))


R07B = f"{_PAIRS} SELECT x.a AS provider_a, x.b AS provider_b, x.n AS n_out, y.n AS n_back FROM p x JOIN p y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.n >= 8 AND y.n >= 8"


def r07c(spark, d):
    t = tables(spark, d)
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("service_date"))
    t["claims"] = t["claims"].drop("service_date").join(o, F.col("order_id") == F.col("o_orderkey"))
    return R.same_day_labs(t, RuleConfig(lab_specialties=("1", "2", "3"))).select("referring_provider_id", "target_provider_id", "n", r2("est_dollars").alias("est_dollars"))


R07C = f"""{V.with_views('claims', 'providers', 'referrals')}, c AS (SELECT provider_id, member_id, CAST(o_orderdate AS DATE) AS service_date, paid_amount FROM claims JOIN orders ON order_id = o_orderkey)
 SELECT referring_provider_id, target_provider_id, count(*) AS n, {R2('sum(paid_amount)')} AS est_dollars FROM referrals r JOIN providers p ON p.provider_id = target_provider_id AND specialty IN ('1', '2', '3')
 JOIN c ON c.provider_id = target_provider_id AND c.member_id = r.member_id AND c.service_date = referral_date GROUP BY 1, 2"""


def r07d(spark, d):
    return R.referral_spikes(tables(spark, d), RuleConfig(referral_z=2.0)).select("referring_provider_id", "week_start", "n", r6("mean").alias("mean"), r6("std").alias("std"), r6("z").alias("z"))


_SENT = f"""{V.with_views('referrals')}, w AS (SELECT referring_provider_id, CAST(date_trunc('week', referral_date) AS DATE) AS week_start, count(*) AS n FROM referrals GROUP BY 1, 2)"""
_SPIKE = f"""{_SENT},
 s AS (SELECT *, avg(n) OVER f AS mean, stddev_pop(n) OVER f AS std, row_number() OVER (PARTITION BY referring_provider_id ORDER BY week_start) AS k FROM w WINDOW f AS (PARTITION BY referring_provider_id ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"""
# From whole sums, as the query: z at a limit and a deviation of 0 are exact.
R07D = f"""{_SENT},
 b AS (SELECT *, count(n) OVER f AS c, CAST(sum(n) OVER f AS BIGINT) AS t, CAST(sum(n * n) OVER f AS BIGINT) AS q, row_number() OVER (PARTITION BY referring_provider_id ORDER BY week_start) AS k FROM w WINDOW f AS (PARTITION BY referring_provider_id ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
 v AS (SELECT *, c * q - t * t AS var FROM b) SELECT referring_provider_id, week_start, n, {R6('t / c')} AS mean, {R6('sqrt(var) / c')} AS std, {R6('(c * n - t) / sqrt(var)')} AS z FROM v WHERE k > 12 AND var > 0 AND (c * n - t) / sqrt(var) > 2"""


def r08a(spark, d):
    found = R.distance_anomalies(tables(spark, d), RuleConfig(routine_specialties=("1", "2", "3"), routine_miles=1000))
    return found.select("provider_id", "n", r6("avg_miles").alias("avg_miles"), r6("max_miles").alias("max_miles"), "referred")


R08A = f"""{V.with_views('claims', 'providers', 'members', 'referrals')}, m AS (SELECT claim_id, member_id, provider_id, specialty, {miles_sql('m.latitude', 'm.longitude', 'p.latitude', 'p.longitude')} AS miles FROM claims JOIN providers p USING (provider_id) JOIN members m USING (member_id)),
 s AS (SELECT specialty, CASE WHEN specialty IN ('1', '2', '3') THEN 1000 WHEN count(*) >= 20 THEN greatest(quantile_cont(miles, 0.99), 150) ELSE 150 END AS cut FROM m GROUP BY 1), k AS (SELECT DISTINCT member_id, target_provider_id AS provider_id, 1 AS referred FROM referrals)
 SELECT provider_id, count(*) AS n, {R6('avg(miles)')} AS avg_miles, {R6('max(miles)')} AS max_miles, CAST(sum(coalesce(referred, 0)) AS BIGINT) AS referred FROM m JOIN s USING (specialty) LEFT JOIN k USING (member_id, provider_id) WHERE miles > cut GROUP BY 1"""


def r08b(spark, d):
    return R.many_counties(tables(spark, d))


R08B = f"{V.with_views('claims', 'members')} SELECT provider_id, count(DISTINCT county) AS county_count, string_agg(DISTINCT county, ',' ORDER BY county) AS counties FROM claims JOIN members USING (member_id) GROUP BY 1 HAVING count(DISTINCT county) >= 5"


def r08c(spark, d):
    return R.suspicious_facilities(tables(spark, d))


R08C = f"{V.with_views('facilities')} SELECT facility_id, lower(facility_type) AS facility_type FROM facilities WHERE lower(facility_type) IN ('residential', 'virtual_office', 'po_box')"


def r10(spark, d):
    found = R.weekly_bursts(tables(spark, d))
    return found.select("provider_id", "week_start", r2("weekly_amount").alias("weekly_amount"), "weekly_claims", r6("trailing_median").alias("trailing_median"), "history_weeks", r6("ratio").alias("ratio"), "severity", r6("est_dollars").alias("est_dollars"))


WEEKLY = f"""{V.with_views('claims')}, w AS (SELECT provider_id, CAST(date_trunc('week', service_date) AS DATE) AS week_start, {R2('sum(paid_amount)')} AS weekly_amount, count(*) AS weekly_claims FROM claims GROUP BY 1, 2),
 t AS (SELECT *, quantile_cont(weekly_amount, 0.5) OVER (PARTITION BY provider_id ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS trailing_median, CAST(least(row_number() OVER (PARTITION BY provider_id ORDER BY week_start) - 1, 12) AS INTEGER) AS history_weeks FROM w)"""
R10 = f"""{WEEKLY} SELECT provider_id, week_start, weekly_amount, weekly_claims, {R6('trailing_median')} AS trailing_median, history_weeks, {R6('weekly_amount / trailing_median')} AS ratio,
 CASE WHEN weekly_amount < 4.5 * trailing_median THEN 'LOW' ELSE 'MEDIUM' END AS severity, {R6('greatest(0, weekly_amount - trailing_median)')} AS est_dollars
 FROM t WHERE weekly_amount > 5000 AND history_weeks >= 4 AND trailing_median > 0 AND weekly_amount > 3 * trailing_median"""


def r00(spark, d):
    """Alerts of the runner by rule and severity."""
    t = tables(spark, d)
    alerts = R.alerts_of(spark, t, only=["R04a", "R04b", "R08b", "R08c", "R10"])
    return alerts.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("alert_id").alias("ids"), F.round(F.sum("est_dollars")).alias("est_dollars"))


R00 = f"""{WEEKLY.replace('WITH ', f"WITH members AS ({V.SQL['members']}), facilities AS ({V.SQL['facilities']}), ", 1)}, a AS (
 SELECT 'R04' AS rule_id, 'CRITICAL' AS severity, billed_amount AS e FROM claims JOIN members USING (member_id) WHERE service_date > death_date
 UNION ALL SELECT 'R04', 'CRITICAL', billed_amount FROM claims JOIN members USING (member_id) WHERE service_date > enrollment_end
 UNION ALL SELECT 'R08', 'LOW', 0 FROM (SELECT provider_id FROM claims JOIN members USING (member_id) GROUP BY 1 HAVING count(DISTINCT county) >= 5)
 UNION ALL SELECT 'R08', 'MEDIUM', 0 FROM facilities WHERE lower(facility_type) = 'residential'
 UNION ALL SELECT 'R10', CASE WHEN weekly_amount < 4.5 * trailing_median THEN 'LOW' ELSE 'MEDIUM' END, greatest(0, weekly_amount - trailing_median) FROM t WHERE weekly_amount > 5000 AND history_weeks >= 4 AND trailing_median > 0 AND weekly_amount > 3 * trailing_median)
 SELECT rule_id, severity, count(*) AS n, count(*) AS ids, round(sum(e)) AS est_dollars FROM a GROUP BY 1, 2"""


def r00_claims(spark, d):
    """Claims that alerts of groups list: their number and a digest of the ids in order."""
    t = tables(spark, d)
    t["claims"] = t["claims"].withColumn("em_level", F.least(F.lit(5), F.floor(F.col("service_minutes") / 10).cast("int") + 1))
    t["referrals"] = t["referrals"].withColumn("claim_id", F.when(F.col("referring_provider_id") % 5 != 0, F.concat(F.lit("C"), "referral_id")))
    cfg = RuleConfig(
        mad_z=1.0, share_multiplier=1.02, min_em_claims=20, caps={"ones": (("Brand#1",), 2), "twos": (("Brand#2",), 1)}, peer_multiplier=1.01, day_minutes=100, concentration=0.02, reciprocal=8,
        routine_specialties=("1", "2", "3"), routine_miles=1000, lab_specialties=("1", "2", "3"),
    )
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("service_date"))
    labs = {**t, "claims": t["claims"].drop("service_date").join(o, F.col("order_id") == F.col("o_orderkey"))}
    a = R.alerts_of(spark, t, cfg, only=["R02", "R05", "R06a", "R07a", "R07b", "R08a", "R08b"])
    b = R.alerts_of(spark, labs, cfg, only=["R07c"])
    return a.unionByName(b).select("rule_id", "entity_type", "entity_id", "severity", F.size("claim_ids").alias("n_claims"), F.md5(F.array_join("claim_ids", ",")).alias("ids"))


_LISTED = "coalesce(CAST(len({x}) AS INTEGER), 0) AS n_claims, md5(coalesce(array_to_string({x}, ','), '')) AS ids"


def _alert(rule: str, kind: str, entity: str, severity: str, ids: str) -> str:
    return f"SELECT '{rule}' AS rule_id, '{kind}' AS entity_type, CAST({entity} AS VARCHAR) AS entity_id, '{severity}' AS severity, {_LISTED.format(x=ids)}"


def r00_rows(spark, d):
    """Alerts list three claims at most here; their claims as rows are all there."""
    t = tables(spark, d)
    t["claims"] = t["claims"].withColumn("em_level", F.least(F.lit(5), F.floor(F.col("service_minutes") / 10).cast("int") + 1))
    cfg = RuleConfig(listed_claims=3, mad_z=1.0, share_multiplier=1.02, min_em_claims=20, caps={"ones": (("Brand#1",), 2), "twos": (("Brand#2",), 1)}, peer_multiplier=1.01, day_minutes=100)
    found = R.alerts_of(spark, t, cfg, only=["R02", "R05", "R06a"])
    return R.alert_claims(found, t, cfg).groupBy("rule_id", "entity_type", "entity_id").agg(F.countDistinct("alert_id").alias("n_alerts"), F.count(F.lit(1)).alias("n_claims"), F.min("claim_id").alias("first_claim"), F.max("claim_id").alias("last_claim"))


R00_ROWS = f"""{V.with_views('claims')}, g AS (SELECT *, CASE WHEN procedure_code LIKE 'Brand#1%' THEN 'ones' ELSE 'twos' END AS code_group, CASE WHEN procedure_code LIKE 'Brand#1%' THEN 2 ELSE 1 END AS cap FROM claims WHERE procedure_code LIKE 'Brand#1%' OR procedure_code LIKE 'Brand#2%'),
 r AS (SELECT *, count(*) OVER (PARTITION BY member_id, code_group ORDER BY service_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS n FROM g),
 e AS (SELECT 'R02' AS rule_id, 'provider' AS entity_type, CAST(provider_id AS VARCHAR) AS entity_id, '' AS part, claim_id FROM claims WHERE provider_id IN (SELECT provider_id FROM ({R02})) UNION ALL SELECT 'R05', 'member', CAST(member_id AS VARCHAR), code_group, claim_id FROM r WHERE n > cap
  UNION ALL SELECT 'R05', 'provider', CAST(provider_id AS VARCHAR), '', claim_id FROM claims WHERE provider_id IN (SELECT provider_id FROM ({R05B})) UNION ALL SELECT 'R06', 'provider', CAST(provider_id AS VARCHAR), CAST(service_date AS VARCHAR), claim_id FROM claims JOIN ({R06A}) USING (provider_id, service_date))
 SELECT rule_id, entity_type, entity_id, count(DISTINCT part) AS n_alerts, count(*) AS n_claims, min(claim_id) AS first_claim, max(claim_id) AS last_claim FROM e GROUP BY 1, 2, 3"""


R00_CLAIMS = f"""{V.with_views('claims', 'providers', 'members', 'referrals')}, own AS (SELECT provider_id, list(claim_id ORDER BY claim_id) AS ids FROM claims GROUP BY 1), day AS (SELECT provider_id, service_date, list(claim_id ORDER BY claim_id) AS ids FROM claims GROUP BY 1, 2),
 g AS (SELECT *, CASE WHEN procedure_code LIKE 'Brand#1%' THEN 'ones' ELSE 'twos' END AS code_group, CASE WHEN procedure_code LIKE 'Brand#1%' THEN 2 ELSE 1 END AS cap FROM claims WHERE procedure_code LIKE 'Brand#1%' OR procedure_code LIKE 'Brand#2%'),
 r AS (SELECT *, count(*) OVER (PARTITION BY member_id, code_group ORDER BY service_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS n FROM g), over AS (SELECT member_id, code_group, list(claim_id ORDER BY claim_id) AS ids FROM r WHERE n > cap GROUP BY 1, 2),
 ref AS (SELECT referring_provider_id AS a, target_provider_id AS b, 'C' || referral_id AS claim_id FROM referrals WHERE referring_provider_id % 5 <> 0), sent AS (SELECT a, b, list(claim_id ORDER BY claim_id)[1:50] AS ids FROM ref GROUP BY 1, 2),
 loops AS (SELECT least(a, b) AS a, greatest(a, b) AS b, list(claim_id ORDER BY a > b, claim_id)[1:50] AS ids FROM ref GROUP BY 1, 2),
 lab AS (SELECT referring_provider_id AS a, target_provider_id AS b, list(claim_id ORDER BY claim_id)[1:50] AS ids FROM referrals r JOIN providers p ON p.provider_id = target_provider_id AND specialty IN ('1', '2', '3')
  JOIN (SELECT claim_id, provider_id, member_id, CAST(o_orderdate AS DATE) AS day FROM claims JOIN orders ON order_id = o_orderkey) c ON c.provider_id = target_provider_id AND c.member_id = r.member_id AND c.day = referral_date GROUP BY 1, 2),
 m AS (SELECT claim_id, provider_id, specialty, {miles_sql('m.latitude', 'm.longitude', 'p.latitude', 'p.longitude')} AS miles FROM claims JOIN providers p USING (provider_id) JOIN members m USING (member_id)),
 s AS (SELECT specialty, CASE WHEN specialty IN ('1', '2', '3') THEN 1000 WHEN count(*) >= 20 THEN greatest(quantile_cont(miles, 0.99), 150) ELSE 150 END AS cut FROM m GROUP BY 1), far AS (SELECT provider_id, list(claim_id ORDER BY claim_id)[1:50] AS ids FROM m JOIN s USING (specialty) WHERE miles > cut GROUP BY 1)
 {_alert('R02', 'provider', 'f.provider_id', 'HIGH', 'ids')} FROM ({R02}) f LEFT JOIN own USING (provider_id)
 UNION ALL {_alert('R05', 'member', 'member_id', 'MEDIUM', 'ids')} FROM over
 UNION ALL {_alert('R05', 'provider', 'f.provider_id', 'HIGH', 'ids')} FROM ({R05B}) f LEFT JOIN own USING (provider_id)
 UNION ALL {_alert('R06', 'provider', 'f.provider_id', 'HIGH', 'ids')} FROM ({R06A}) f LEFT JOIN day USING (provider_id, service_date)
 UNION ALL {_alert('R07', 'provider', 'referring_provider_id', 'MEDIUM', 'ids')} FROM ({R07A}) f LEFT JOIN sent ON a = referring_provider_id AND b = top_target
 UNION ALL {_alert('R07', 'provider', 'provider_a', 'MEDIUM', 'ids')} FROM ({R07B}) f LEFT JOIN loops ON a = provider_a AND b = provider_b
 UNION ALL {_alert('R07', 'provider', 'a', 'MEDIUM', 'ids')} FROM lab
 UNION ALL {_alert('R08', 'provider', 'provider_id', 'MEDIUM', 'ids')} FROM far
 UNION ALL {_alert('R08', 'provider', 'f.provider_id', 'LOW', 'own.ids[1:50]')} FROM ({R08B}) f LEFT JOIN own USING (provider_id)"""

ENTRIES = {
    "r00_rule_runner": (r00, R00), "r00_claim_ids": (r00_claims, R00_CLAIMS), "r00_claim_rows": (r00_rows, R00_ROWS), "r01a_exact_duplicates": (r01a, R01A), "r01b_near_duplicates": (r01b, R01B), "r02_upcoding": (r02, R02), "r03_unbundling": (r03, R03), "r04a_after_death": (r04a, R04A),
    "r04b_after_enrollment": (r04b, R04B), "r04c_during_stay": (r04c, R04C), "r04d_closed_facility": (r04d, R04D), "r04e_non_operating_day": (r04e, R04E), "r04f_orphan_ambulance": (r04f, R04F), "r04g_ghost_members": (r04g, R04G),
    "r05a_over_caps": (r05a, R05A), "r05b_excessive_providers": (r05b, R05B), "r06a_overloaded_days": (r06a, R06A), "r06b_impossible_travel": (r06b, R06B), "r06c_member_overlaps": (r06c, R06C), "r07a_concentration": (r07a, R07A),
    "r07b_reciprocal_loops": (r07b, R07B), "r07c_same_day_labs": (r07c, R07C), "r07d_referral_spikes": (r07d, R07D), "r08a_distance": (r08a, R08A), "r08b_many_counties": (r08b, R08B), "r08c_facility_type": (r08c, R08C), "r10_weekly_burst": (r10, R10),
    "x04_unbundling_rates": (x04, X04),
}
