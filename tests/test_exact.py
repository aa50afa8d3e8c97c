"""Figures that do not depend on the order of rows, and limits that are met exactly."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.operators import cases as K
from claimsieve.operators import graph as N
from claimsieve.operators import risk as U
from claimsieve.operators import variants as D
from claimsieve.operators import windows as W
from claimsieve.queries import work


def test_exposure_is_a_sum_of_decimals(spark):
    """Ten alerts of ten cents are a dollar."""
    rows = [(f"a{i}", "R01", "provider", "1", [f"c{i}"], "LOW", 0.1) for i in range(10)]
    alerts = spark.createDataFrame(rows, "alert_id string, rule_id string, entity_type string, entity_id string, claim_ids array<string>, severity string, est_dollars double").coalesce(1)
    assert [r.exposure for r in U.rule_signal(alerts).collect()] == [1.0]
    claims = spark.createDataFrame([(f"c{i}", "1", p) for i, p in enumerate((0.1, 0.2, 0.3))], "claim_id string, provider_id string, ml_probability double").coalesce(1)
    assert [r.ml_mean for r in U.ml_signal(claims).collect()] == [0.6 / 3]


def test_halves_go_up(spark):
    rows = spark.createDataFrame([(0.00044999999999999996, 0.0005), (0.00044, 0.0004), (0.0, 0.0), (1.0, 1.0)], "x double, want double")
    assert rows.where(C.places(F.col("x"), 4) != F.col("want")).count() == 0


def test_equal_priorities_are_ranked_by_id(spark):
    """what differs in the seventeenth place only is equal."""
    rows = [("CASE-2", "2", 0.30000000000000004), ("CASE-1", "1", 0.3)]
    given = spark.createDataFrame(rows, "case_id string, provider_id string, q_risk double").withColumns({f"q_{k}": F.lit(None).cast("double") for k in ("evidence", "exposure", "network", "anomaly", "future", "behaviour")})
    more = {"risk_score": 0.3, "evidence_strength": 0.5, "estimated_exposure": 1.0, "high_risk_claim_count": 0, "distinct_rules": 0, "alert_count": 0, "anomaly_flag": 0}
    given = given.withColumns({k: F.lit(v) for k, v in more.items()}).withColumn("community_id", F.lit(None).cast("string"))
    assert {r.priority_score for r in K.priority(given).collect()} == {0.3}


def test_what_fills_the_room_fits(spark):
    """three times a tenth of an hour fit into three tenths."""
    q = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.1), ("c", 3, 0.1), ("d", 4, 0.1)], "case_id string, queue_rank int, effort_hours double")
    got = {r.case_id: r.hours_used for r in W.greedy_capacity(q, 0.3).where("selected").collect()}
    assert got == {"a": 0.1, "b": 0.2, "c": 0.3}


def test_spike_at_the_limit(spark):
    """a week of exactly two deviations over the mean has a z of 2."""
    weeks = [3, 3, 3, 3, 4, 3, 5, 4, 1, 2, 2, 3, 5]
    rows = [("p", dt.date(2024, 1, 1) + dt.timedelta(weeks=i)) for i, n in enumerate(weeks) for _ in range(n)]
    got = W.weekly_zscore(spark.createDataFrame(rows, "referring_provider_id string, referral_date date"))
    assert [r.z for r in got.where("z is not null").collect()] == [2.0]


def test_weekly_dollars(spark):
    """sums of a week and their mean as decimals."""
    rows = [("1", dt.date(2024, 1, 1), p) for p in (0.1, 0.2, 0.3)]
    got = D.weekly_features(spark.createDataFrame(rows, "provider_id string, service_date date, paid_amount double").coalesce(1)).first()
    assert (got.most_weekly_paid, got.mean_weekly_paid) == (0.6, 0.6)


def test_long_network_ids(spark, tmp_path):
    """numbers of more than four digits stay whole in the SQL too."""
    f, sql = work.ENTRIES["q08_networks"]
    spark.createDataFrame([(123456, 5.0), (123457, 5.0), (7, 4.0)], "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(sql).fetchall()
    assert [tuple(r) for r in f(spark, str(tmp_path)).select("network_id", "total_paid", "hard_links").collect()] == [tuple(r) for r in want]
    assert {r[0] for r in want} == {"NET-123457", "NET-0007"}


def test_shared_members_around_some(spark):
    """pairs of some providers are those that all pairs have, and no others are made."""
    rows = [(p, m) for p in range(1, 7) for m in range(12) if (p * m) % 5 < 3]
    claims = spark.createDataFrame(rows, "provider_id int, member_id int")
    some = spark.createDataFrame([(1,), (4,)], "provider_id int")
    want = {tuple(r) for r in N.shared_member_edges(claims).collect() if {r.src, r.dst} & {"provider:1", "provider:4"}}
    got = [tuple(r) for r in N.shared_member_edges(claims, around=some).collect()]
    assert set(got) == want and len(got) == len(want) > 0
