"""Rounding that gives the same in both engines, and test tables in the shape of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.sources import views as V


def r6(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c * 1e6) / 1e6


def r2(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c * 100) / 100


def R6(sql: str) -> str:
    return f"round(({sql}) * 1e6) / 1e6"


def R2(sql: str) -> str:
    return f"round(({sql}) * 100) / 100"


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as services with a time: by user as provider and member, with made-up places."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("claim_id"), F.col("user_id").alias("provider_id"), F.col("user_id").alias("member_id"), F.lit("X").alias("procedure_code"), F.to_date("ts").alias("service_date"), F.col("ts").alias("service_start_ts"),
        (F.round(F.col("value") * 100) / 100).alias("paid_amount"), F.col("value").alias("service_minutes"), F.when(F.col("event_type") == "error", F.lit("02")).otherwise(F.lit("11")).alias("pos_code"),
        (F.col("event_id") % 17 + 30).cast("double").alias("latitude"), (-(F.col("event_id") % 23) - 80).cast("double").alias("longitude"), (F.col("event_id") % 2).cast("string").alias("facility_id"),
    )


EVENT_CLAIMS = """event_claims AS (SELECT event_id AS claim_id, user_id AS provider_id, user_id AS member_id, CAST(ts AS DATE) AS service_date, ts, round(value * 100) / 100 AS paid_amount, value AS service_minutes,
 CASE WHEN event_type = 'error' THEN '02' ELSE '11' END AS pos_code, CAST(event_id % 17 + 30 AS DOUBLE) AS latitude, CAST(-(event_id % 23) - 80 AS DOUBLE) AS longitude, CAST(event_id % 2 AS VARCHAR) AS facility_id FROM events)"""
MILES = "3958.8 * 2 * atan2(sqrt({a}), sqrt(1 - {a}))"


def miles_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return MILES.format(a=a)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"claims": V.claims(spark, sf_dir), "providers": V.providers(spark, sf_dir), "members": V.members(spark, sf_dir), "referrals": V.referrals(spark, sf_dir), "facilities": V.facilities(spark, sf_dir)}
