"""The domain tables over the star-schema test tables, as DataFrames and as SQL with the same meaning.

Amounts are whole cents divided by a hundred, so that sums agree to the cent whatever the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cents(x):
    return F.round(x * 100) / 100


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type")
    day = F.to_date("l_shipdate")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day.cast("string")).alias("claim_id"),
        F.col("o_custkey").alias("member_id"),
        F.col("l_suppkey").alias("provider_id"),
        F.col("p_brand").alias("procedure_code"),
        day.alias("service_date"),
        cents(F.col("l_extendedprice")).alias("billed_amount"),
        cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid_amount"),
        F.col("l_quantity").alias("service_minutes"),
        F.col("l_returnflag").alias("modifier"),
        F.col("l_linestatus").alias("status"),
        F.col("p_type").alias("pos_code"),
        F.col("l_orderkey").alias("order_id"),
    )


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("provider_id"),
        F.col("s_nationkey").cast("string").alias("peer_group"),
        F.col("s_nationkey").cast("string").alias("specialty"),
        (F.col("s_suppkey") % 17 + 30).cast("double").alias("latitude"),
        (-(F.col("s_suppkey") % 23) - 80).cast("double").alias("longitude"),
        F.concat(F.lit("B"), (F.col("s_suppkey") % 20).cast("string")).alias("bank_hash"),
        F.col("s_name").alias("owner_name"),
        F.concat(F.col("n_name"), F.lit(" Street "), (F.col("s_suppkey") % 7).cast("string")).alias("address"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("1")).alias("suite"),
        F.col("n_name").alias("county"),
        (F.col("s_suppkey") % 2).cast("string").alias("group_id"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("member_id"),
        (F.col("c_custkey") % 17 + 30).cast("double").alias("latitude"),
        (-(F.col("c_custkey") % 23) - 80).cast("double").alias("longitude"),
        F.col("n_name").alias("county"),
        F.col("c_mktsegment").alias("plan_type"),
        F.when(F.col("c_custkey") % 5 == 0, F.to_date(F.lit("1999-01-01"))).alias("death_date"),
        F.when(F.col("c_custkey") % 7 == 0, F.to_date(F.lit("2000-01-01"))).alias("enrollment_end"),
    )


def referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier of an order refers to each other one of it, on the day of the order."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey")).alias("first"), F.collect_set("l_suppkey").alias("all"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sent = line.select("l_orderkey", F.col("first.l_suppkey").alias("referring_provider_id"), F.explode("all").alias("target_provider_id")).where("referring_provider_id <> target_provider_id")
    return sent.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "target_provider_id").alias("referral_id"), "referring_provider_id", "target_provider_id", F.col("o_custkey").alias("member_id"), F.to_date("o_orderdate").alias("referral_date")
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A facility for each procedure place of a claim's type, with opening dates and days."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("facility_id"),
        F.when(F.col("s_suppkey") % 9 == 0, F.to_date(F.lit("2001-06-01"))).alias("close_date"),
        F.when(F.col("s_suppkey") % 8 == 0, F.to_date(F.lit("1996-01-01"))).alias("open_date"),
        F.when(F.col("s_suppkey") % 4 == 0, F.lit("Mon,Tue,Wed,Thu,Fri")).alias("operating_days"),
        F.when(F.col("s_suppkey") % 10 == 0, F.lit("Residential")).otherwise(F.lit("clinic")).alias("facility_type"),
    )


SQL = {
    "claims": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS claim_id, o_custkey AS member_id, l_suppkey AS provider_id,
 p_brand AS procedure_code, CAST(l_shipdate AS DATE) AS service_date, round(l_extendedprice * 100) / 100 AS billed_amount, round(l_extendedprice * (1 - l_discount) * 100) / 100 AS paid_amount,
 l_quantity AS service_minutes, l_returnflag AS modifier, l_linestatus AS status, p_type AS pos_code, l_orderkey AS order_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "providers": """SELECT s_suppkey AS provider_id, CAST(s_nationkey AS VARCHAR) AS peer_group, CAST(s_nationkey AS VARCHAR) AS specialty, CAST(s_suppkey % 17 + 30 AS DOUBLE) AS latitude,
 CAST(-(s_suppkey % 23) - 80 AS DOUBLE) AS longitude, 'B' || (s_suppkey % 20) AS bank_hash, s_name AS owner_name, n_name || ' Street ' || (s_suppkey % 7) AS address,
 CASE WHEN s_suppkey % 3 = 0 THEN '1' END AS suite, n_name AS county, CAST(s_suppkey % 2 AS VARCHAR) AS group_id FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "members": """SELECT c_custkey AS member_id, CAST(c_custkey % 17 + 30 AS DOUBLE) AS latitude, CAST(-(c_custkey % 23) - 80 AS DOUBLE) AS longitude, n_name AS county, c_mktsegment AS plan_type,
 CASE WHEN c_custkey % 5 = 0 THEN DATE '1999-01-01' END AS death_date, CASE WHEN c_custkey % 7 = 0 THEN DATE '2000-01-01' END AS enrollment_end FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "referrals": """SELECT l_orderkey || '-' || t.l_suppkey AS referral_id, f.l_suppkey AS referring_provider_id, t.l_suppkey AS target_provider_id, o_custkey AS member_id, CAST(o_orderdate AS DATE) AS referral_date
 FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) t
 JOIN (SELECT l_orderkey AS k, l_suppkey FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1) f ON t.l_orderkey = f.k
 JOIN orders ON t.l_orderkey = o_orderkey WHERE f.l_suppkey <> t.l_suppkey""",
    "facilities": """SELECT s_suppkey AS facility_id, CASE WHEN s_suppkey % 9 = 0 THEN DATE '2001-06-01' END AS close_date, CASE WHEN s_suppkey % 8 = 0 THEN DATE '1996-01-01' END AS open_date,
 CASE WHEN s_suppkey % 4 = 0 THEN 'Mon,Tue,Wed,Thu,Fri' END AS operating_days, CASE WHEN s_suppkey % 10 = 0 THEN 'Residential' ELSE 'clinic' END AS facility_type FROM supplier""",
}


def with_views(*names: str) -> str:
    """The WITH clause of these views, to put before a query (end it with a comma and more, or go on with SELECT)."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
