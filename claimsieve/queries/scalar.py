"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.queries.common import R6, miles_sql, r6
from claimsieve.sources import views as V


def f01(spark, d):
    """Miles and required speed for each claim of a supplier to its customer."""
    c = V.claims(spark, d).join(V.providers(spark, d).select("provider_id", F.col("latitude").alias("a"), F.col("longitude").alias("o")), "provider_id").join(V.members(spark, d).select("member_id", F.col("latitude").alias("ma"), F.col("longitude").alias("mo")), "member_id")
    miles = C.haversine_miles(F.col("a"), F.col("o"), F.col("ma"), F.col("mo"))
    return c.select("claim_id", r6(miles).alias("miles"), r6(C.required_mph(miles, F.col("service_minutes") - 10)).alias("mph"))


F01 = f"""{V.with_views('claims', 'providers', 'members')}, x AS (SELECT claim_id, {miles_sql('p.latitude', 'p.longitude', 'm.latitude', 'm.longitude')} AS miles, service_minutes - 10 AS h FROM claims JOIN providers p USING (provider_id) JOIN members m USING (member_id))
 SELECT claim_id, {R6('miles')} AS miles, CASE WHEN h > 0 THEN {R6('miles / h')} END AS mph FROM x"""


def f03(spark, d):
    """Levels of codes made from order lines, by the three codings."""
    n = (99195 + F.col("l_orderkey") % 25).cast("string")
    code = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("CPT "), n)).otherwise(n)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(code.alias("code"))
    return rows.groupBy("code").agg(F.first(C.em_level(F.col("code"))).alias("a"), F.first(C.em_level_behaviour(F.col("code"))).alias("b"), F.first(C.em_level_variant(F.col("code"))).alias("c"), F.count(F.lit(1)).alias("n"))


F03 = """WITH x AS (SELECT CAST(99195 + l_orderkey % 25 AS INTEGER) AS k, l_linenumber = 7 AS p FROM lineitem), y AS (SELECT CASE WHEN p THEN 'CPT ' ELSE '' END || k AS code, k, p, count(*) AS n FROM x GROUP BY 1, 2, 3)
 SELECT code, CASE WHEN p THEN NULL WHEN k BETWEEN 99201 AND 99205 THEN k - 99200 WHEN k BETWEEN 99211 AND 99215 THEN k - 99210 END AS a, CASE WHEN k IN (99201, 99202, 99211) THEN 1 WHEN k IN (99203, 99212) THEN 2 WHEN k IN (99204, 99213) THEN 3 WHEN k IN (99205, 99214) THEN 4 WHEN k = 99215 THEN 5 ELSE 0 END AS b,
 CASE WHEN p THEN 0 WHEN k BETWEEN 99201 AND 99205 THEN k - 99200 WHEN k BETWEEN 99211 AND 99215 THEN k - 99210 ELSE 0 END AS c, n FROM y"""


def f10(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.select("o_orderkey", C.week_start(F.col("day")).alias("week_start"), C.iso_week(F.col("day")).alias("iso_week"), F.weekday("day").alias("weekday"), C.is_weekend(F.col("day")).alias("is_weekend"))


F10 = "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, strftime(o_orderdate, '%G-W%V') AS iso_week, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM orders"


#: Long forms of addresses and their short ones, and endings of company names, as the contract has them (fixed values).
_LONG = "street st|avenue ave|boulevard blvd|drive dr|lane ln|road rd|court ct|circle cir|place pl|suite ste|apartment apt|building bldg|floor fl|unit unit|# unit|north n|south s|east e|west w|northeast ne|northwest nw|southeast se|southwest sw".split("|")
_ENDINGS = "llc inc corp corporation co company ltd limited pc pa pllc group holdings associates md do np".split()


def f15(spark, d):
    """Addresses and names made from customers with every long form and ending, in their normal forms."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    stop = F.when(k % 2 == 0, ".").otherwise("")
    address = F.concat((k % 90).cast("string"), F.lit(" "), F.initcap(pick([x.split()[0] for x in _LONG])), stop, F.lit(" North Main Street,  Suite "), (k % 12).cast("string"))
    base, suite = C.split_suite(address)
    name = F.concat(F.col("c_mktsegment"), F.lit(" & Sons, "), F.upper(pick(_ENDINGS)), stop)
    return c.select("c_custkey", C.normal_address(address).alias("address"), C.normal_address(base).alias("base"), suite.alias("suite"), C.normal_name(name, True).alias("name"), C.normal_name(name).alias("plain"))


_SHORT = "[" + ", ".join(f"'{x.split()[1]}'" for x in _LONG) + "]"
F15 = f"""WITH c AS (SELECT c_custkey, (c_custkey % 90) || ' ' || {_SHORT}[c_custkey % {len(_LONG)} + 1] || ' n main st' AS base, lower(c_mktsegment) || ' sons' AS name, {_ENDINGS}[c_custkey % {len(_ENDINGS)} + 1] AS ending FROM customer)
 SELECT c_custkey, base || ' ste ' || (c_custkey % 12) AS address, base, CAST(c_custkey % 12 AS VARCHAR) AS suite, name, name || ' ' || ending AS plain FROM c"""


def f19(spark, d):
    x = F.col("l_discount") * 10
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(x.alias("x"), F.col("l_extendedprice").alias("e"))
    return rows.groupBy(C.risk_tier(F.col("x")).alias("risk"), C.confidence_tier(F.col("x")).alias("confidence"), C.queue_tier(F.col("x")).alias("queue")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(C.log_dollars(F.col("e"), 50000.0) * 1e6))).alias("log_sum"))


F19 = """WITH r AS (SELECT l_discount * 10 AS x, round(least(ln(1 + l_extendedprice) / ln(50001), 1) * 1e6) AS g FROM lineitem) SELECT CASE WHEN x >= 0.75 THEN 'CRITICAL' WHEN x >= 0.5 THEN 'HIGH' WHEN x >= 0.25 THEN 'MODERATE' ELSE 'LOW' END AS risk, CASE WHEN x >= 0.7 THEN 'HIGH' WHEN x >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
 CASE WHEN x >= 0.8 THEN 'CRITICAL' WHEN x >= 0.6 THEN 'HIGH' WHEN x >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS queue, count(*) AS n, round(sum(g)) AS log_sum FROM r GROUP BY 1, 2, 3"""


def f06(spark, d):
    """Modifier lists, prefixes and operating days of order lines."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    mods = F.concat_ws(",", "l_returnflag", "l_linestatus")
    return rows.groupBy(C.has_modifier(mods, ["A", "O"]).alias("modifier"), C.operates_on(F.to_date("l_shipdate"), F.lit("Mon,Wed,Fri")).alias("operates"), C.is_any(F.col("l_returnflag"), ["a", "r"]).alias("member")).agg(F.count(F.lit(1)).alias("n"))


F06 = "SELECT l_returnflag = 'A' OR l_linestatus = 'O' AS modifier, isodow(l_shipdate) IN (1, 3, 5) AS operates, l_returnflag IN ('A', 'R') AS member, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"


def f21(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('", "x"]'))).when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit(", y"))).otherwise(F.lit(None))
    return e.groupBy(F.array_join(C.list_of(text), "|").alias("items")).agg(F.count(F.lit(1)).alias("n"))


F21 = "SELECT CASE event_id % 3 WHEN 0 THEN event_type || '|x' WHEN 1 THEN event_type || '|y' ELSE '' END AS items, count(*) AS n FROM events GROUP BY 1"
ENTRIES = {"f01_distance_speed": (f01, F01), "f03_visit_levels": (f03, F03), "f06_membership": (f06, F06), "f10_weeks": (f10, F10), "f15_normal_forms": (f15, F15), "f19_tiers": (f19, F19), "f21_lists": (f21, F21)}
