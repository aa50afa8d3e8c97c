"""Identity and network operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.operators import graph as N
from claimsieve.operators import identity as E
from claimsieve.operators import rules as R
from claimsieve.plans.storage import materialize
from claimsieve.queries.common import R2, R6, r2, r6, tables
from claimsieve.sources import views as V


LINK = ["provider_a", "provider_b", "basis", "confidence", "weight", "links"]


def e01(spark, d):
    return E.exact_links(V.providers(spark, d), "bank_hash").select(*LINK, "detail")


# A value links each of its providers to the smallest; `links` of its rows add up to its n (n - 1) / 2 pairs.
_STAR = "(SELECT {v} AS v, count(*) AS n, min(provider_id) AS least FROM {t} WHERE {v} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"


def _star_sql(table: str, value: str, basis: str, confidence: float, weight: float, detail: str = "") -> str:
    more = f", {detail} AS detail" if detail else ""
    return f"SELECT least AS provider_a, provider_id AS provider_b, '{basis}' AS basis, {confidence}::DOUBLE AS confidence, {weight}::DOUBLE AS weight, n / 2 AS links{more} FROM {table} JOIN {_STAR.format(v=value, t=table)} s ON s.v = {value} WHERE provider_id > least"


E01 = f"{V.with_views('providers')} {_star_sql('providers', 'bank_hash', 'bank_hash', 1.0, 1.0, 'bank_hash')}"


def e02(spark, d):
    return E.address_links(V.providers(spark, d)).select("provider_a", "provider_b", "basis", "confidence", "weight", r6("links").alias("links"))


_ADDR = f"""{V.with_views('providers')}, a AS (SELECT provider_id, replace(lower(address), 'street', 'st') AS addr, suite, CASE WHEN suite IS NOT NULL THEN replace(lower(address), 'street', 'st') || '|' || suite END AS key FROM providers)"""
E02 = f"""{_ADDR}, t AS (SELECT x.addr, count(*) AS total FROM a x JOIN a y ON x.addr = y.addr AND x.provider_id < y.provider_id AND NOT coalesce(x.suite = y.suite, false) GROUP BY 1),
 z AS (SELECT addr, count(*) AS n, min(provider_id) AS least, arg_min(struct_pack(s := suite), provider_id).s AS of FROM a GROUP BY 1), r AS (SELECT a.*, n, least FROM a JOIN z USING (addr) WHERE provider_id <> least AND NOT coalesce(suite = of, false)), k AS (SELECT addr, count(*) AS k FROM r GROUP BY 1)
 SELECT provider_a, provider_b, basis, confidence, weight, {R6('links')} AS links FROM ({_star_sql('a', 'key', 'address_suite', 0.9, 0.6)})
 UNION ALL SELECT least, provider_id, 'address_no_suite', CASE WHEN n >= 5 THEN 0.3 ELSE 0.6 END::DOUBLE, CASE WHEN n >= 5 THEN 0.2 ELSE 0.4 END::DOUBLE, {R6('total / k')} FROM r JOIN t USING (addr) JOIN k USING (addr)"""

#: Parts of made-up owner names: the number of a provider gives one of each, and every fifth is spelt a letter short.
_FIRST = "johnson petersen alvarez lindqvist okafor montgomery takahashi rosenberg delacroix abernathy".split()
_SECOND = "family harbor valley summit lakeside".split()


def _owners(spark, d):
    """Owners made from providers, so that their number grows with the table."""
    k = F.col("provider_id")
    pick = lambda items, i: F.element_at(F.array(*map(F.lit, items)), (i % len(items) + 1).cast("int"))
    first = pick(_FIRST, k)
    spelt = F.when(k % 5 == 0, F.concat(F.substring(first, 1, 3), F.substring(first, 5, 20))).otherwise(first)
    number = F.when(k % 7 == 0, F.concat(F.lit(" "), F.floor(k / 35).cast("string"))).otherwise("")
    return V.providers(spark, d).withColumn("owner_name", F.concat(F.initcap(spelt), F.lit(" "), F.initcap(pick(_SECOND, F.floor(k / 10))), F.lit(" Care"), number, F.when(k % 2 == 0, ", Inc.").otherwise(" L.L.C.")))


_OWNERS = f"""{V.with_views('providers')}, f AS (SELECT provider_id, {_FIRST}[provider_id % 10 + 1] AS f, {_SECOND}[(provider_id // 10) % 5 + 1] AS s FROM providers),
 o AS (SELECT provider_id, CASE WHEN provider_id % 5 = 0 THEN f[1:3] || f[5:] ELSE f END || ' ' || s || ' care' || CASE WHEN provider_id % 7 = 0 THEN ' ' || (provider_id // 35) ELSE '' END AS owner FROM f)"""


def e04(spark, d):
    return E.owner_links(_owners(spark, d)).where("basis = 'owner_exact'").select("provider_a", "provider_b", "basis", "confidence", r6("weight").alias("weight"), "links", "detail")


E04 = f"{_OWNERS} {_star_sql('o', 'owner', 'owner_exact', 0.95, 0.9, 'owner')}"


def e05(spark, d):
    return E.owner_links(_owners(spark, d)).where("basis = 'owner_fuzzy'").select("provider_a", "provider_b", r6("confidence").alias("confidence"), "links", "detail")


def e06(spark, d):
    p = V.providers(spark, d).withColumn("registered_agent", F.concat(F.lit("Agent, No. "), (F.col("provider_id") % 9).cast("string")))
    return E.agent_links(p).select(*LINK)


E06 = f"{V.with_views('providers')}, g AS (SELECT *, provider_id % 9 AS k FROM providers) {_star_sql('g', 'k', 'registered_agent', 0.85, 0.8)}"


def e07(spark, d):
    p = V.providers(spark, d)
    return E.identity_clusters(E.exact_links(p, "bank_hash"), p).select("cluster_id", "size", F.array_join("bases", ",").alias("bases"), "confidence", "link_count", "documented", F.array_join("provider_ids", ",").alias("provider_ids"))


# All pairs of a bank are counted as they are.
E07 = f"""{V.with_views('providers')}, c AS (SELECT bank_hash, min(provider_id) AS cluster_id, count(*) AS size, count(DISTINCT group_id) = 1 AS documented, string_agg(provider_id, ',' ORDER BY provider_id) AS provider_ids FROM providers GROUP BY 1 HAVING count(*) > 1),
 p AS (SELECT a.bank_hash, count(*) AS link_count FROM providers a JOIN providers b ON a.bank_hash = b.bank_hash AND a.provider_id < b.provider_id GROUP BY 1) SELECT cluster_id, size, 'bank_hash' AS bases, 1.0::DOUBLE AS confidence, link_count, documented, provider_ids FROM c JOIN p USING (bank_hash)"""


def r09(spark, d):
    """Clusters over banks, tax hashes, addresses, owners (same names; similar ones as e05 has them) and agents."""
    k = F.col("provider_id")
    p = _owners(spark, d).withColumns({"tin_hash": F.when(k % 11 == 0, F.concat(F.lit("T"), F.floor(k / 44).cast("string"))), "registered_agent": F.when(k % 13 == 0, F.concat(F.lit("Agent "), F.floor(k / 39).cast("string"))), "bank_hash": F.concat(F.lit("B"), F.floor(k / 3).cast("string"))})
    p = p.withColumn("address", F.concat_ws(" ", (k % 97).cast("string"), "address")).drop("owner_name")
    return E.shared_identity({"providers": p}).select("cluster_id", "size", F.array_join("bases", ",").alias("bases"), "documented", "link_count")


_R09_VALUES = """v AS (SELECT provider_id, 'bank_hash' AS basis, 'B' || (provider_id // 3) AS v FROM providers UNION ALL SELECT provider_id, 'tin_hash', 'T' || (provider_id // 44) FROM providers WHERE provider_id % 11 = 0
 UNION ALL SELECT provider_id, 'registered_agent', 'agent ' || (provider_id // 39) FROM providers WHERE provider_id % 13 = 0 UNION ALL SELECT provider_id, 'address', (provider_id % 97) || ' ' || lower(address) FROM providers),
 p AS (SELECT x.provider_id AS a, y.provider_id AS b, CASE WHEN x.basis <> 'address' THEN x.basis WHEN coalesce(sx.suite = sy.suite, false) THEN 'address_suite' ELSE 'address_no_suite' END AS basis
  FROM v x JOIN v y ON x.basis = y.basis AND x.v = y.v AND x.provider_id < y.provider_id JOIN providers sx ON sx.provider_id = x.provider_id JOIN providers sy ON sy.provider_id = y.provider_id)"""
R09 = f"""{V.with_views('providers').replace('WITH ', 'WITH RECURSIVE ', 1)}, {_R09_VALUES}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen),
 m AS (SELECT node, min(seen) AS cluster_id FROM reach GROUP BY 1), s AS (SELECT cluster_id, count(*) AS size, count(DISTINCT group_id) = 1 AS documented FROM m JOIN providers ON node = provider_id GROUP BY 1),
 l AS (SELECT cluster_id, count(*) AS link_count, string_agg(DISTINCT basis, ',' ORDER BY basis) AS bases, bool_or(basis NOT LIKE 'address%') AS hard FROM p JOIN m ON node = a GROUP BY 1) SELECT cluster_id, size, bases, documented, link_count FROM s JOIN l USING (cluster_id) WHERE hard"""


def _graph(spark, d, around=None):
    t = tables(spark, d)
    c = t["claims"].withColumn("facility_id", F.col("order_id") % 50)
    k = F.col("provider_id")
    p = t["providers"].withColumns({"owner_name": F.concat(F.lit("Owner "), (k % 30).cast("string")), "registered_agent": F.concat(F.lit("Agent "), (k % 13).cast("string"))})
    links = E.exact_links(p, "bank_hash").unionByName(E.agent_links(p))
    return N.build_graph(c, p, t["referrals"], links, around=around)


def n01(spark, d):
    _, e = _graph(spark, d)
    return e.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight")).alias("weight"))


_GRAPH = f"""{V.with_views('claims', 'providers', 'referrals')}, pv AS (SELECT provider_id, 'provider:' || provider_id AS p, bank_hash, 'Owner ' || (provider_id % 30) AS owner, 'agent ' || (provider_id % 13) AS agent, replace(lower(address), 'street', 'st') AS addr FROM providers),
 pm AS (SELECT DISTINCT provider_id, member_id FROM claims), sm AS (SELECT a.provider_id AS x, b.provider_id AS y, count(*) AS n FROM pm a JOIN pm b ON a.member_id = b.member_id AND a.provider_id < b.provider_id GROUP BY 1, 2 HAVING count(*) >= 2),
 plain AS (SELECT p AS src, 'bank:' || bank_hash AS dst, 'has_bank' AS edge_type, 1.0::DOUBLE AS weight FROM pv UNION ALL SELECT p, 'address:' || addr, 'located_at', 1.0 FROM pv UNION ALL SELECT p, 'owner:' || owner, 'owned_by', 1.0 FROM pv
 UNION ALL SELECT 'provider:' || provider_id, 'facility:' || (order_id % 50), 'works_at', count(*) FROM claims GROUP BY 1, 2 UNION ALL SELECT 'provider:' || referring_provider_id, 'provider:' || target_provider_id, 'refers_to', count(*) FROM referrals GROUP BY 1, 2
 UNION ALL SELECT 'provider:' || x, 'provider:' || y, 'shared_members', n FROM sm),
 edges AS (SELECT * FROM plain UNION ALL SELECT p, 'shared_bank_hash:' || bank_hash, 'shared_bank_hash', 1.0 FROM pv WHERE bank_hash IN (SELECT bank_hash FROM pv GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT p, 'shared_registered_agent:' || agent, 'shared_registered_agent', 0.8 FROM pv WHERE agent IN (SELECT agent FROM pv GROUP BY 1 HAVING count(*) > 1))"""
N01 = f"{_GRAPH} SELECT edge_type, count(*) AS n, {R6('sum(weight)')} AS weight FROM edges GROUP BY 1"


def n02(spark, d):
    return N.graph_summary(*_graph(spark, d))


N02 = f"{_GRAPH}, ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges UNION SELECT p FROM pv) SELECT 'node' AS kind, split_part(id, ':', 1) AS type, count(*) AS count FROM ids GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2"


def _projection(spark, d):
    """The projection without its pairs, and the edges of the graph."""
    edges = materialize(_graph(spark, d)[1], "graph-edges")
    return N.project(edges, N.graph_nodes(edges, V.providers(spark, d)), written=True), edges


def n03(spark, d):
    e = N.connections(_projection(spark, d)[0])
    return e.select("u", "v", r6("weight").alias("weight"), F.array_join(F.transform(F.map_entries("edge_types"), lambda x: F.concat(x["key"], F.lit("="), F.format_number(x["value"], 2))), ";").alias("kinds"))


def n03b(spark, d):
    """Connections of a few providers only."""
    edges = materialize(_graph(spark, d, spark.createDataFrame([(1,), (3,)], "provider_id long"))[1], "graph-edges")  # their pairs only: others are not asked for
    p = N.project(edges, N.graph_nodes(edges, V.providers(spark, d)), written=True)
    return N.connections(p, p.nodes.where("provider in ('provider:1', 'provider:3')").select("provider")).select("u", "v", r6("weight").alias("weight"))


# By pairs: edges between providers count their weight, links of an identity theirs, and a node that two share counts one.
_PROJECTION = f"""{_GRAPH}, h AS (SELECT DISTINCT src, dst FROM plain WHERE dst NOT LIKE 'provider:%'), raw AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, edge_type, weight FROM plain WHERE dst LIKE 'provider:%'
 UNION ALL SELECT least(a.p, b.p), greatest(a.p, b.p), 'shared_bank_hash', 1.0 FROM pv a JOIN pv b ON a.bank_hash = b.bank_hash AND a.provider_id < b.provider_id
 UNION ALL SELECT least(a.p, b.p), greatest(a.p, b.p), 'shared_registered_agent', 0.8 FROM pv a JOIN pv b ON a.agent = b.agent AND a.provider_id < b.provider_id
 UNION ALL SELECT a.src, b.src, CASE split_part(a.dst, ':', 1) WHEN 'bank' THEN 'shared_bank_hash' WHEN 'owner' THEN 'shared_ownership' WHEN 'address' THEN 'shared_address' ELSE 'shared_facility' END, 1.0 FROM h a JOIN h b ON a.dst = b.dst AND a.src < b.src),
 kinds AS (SELECT u, v, edge_type, sum(weight) AS raw FROM raw WHERE u <> v GROUP BY 1, 2, 3),
 proj AS (SELECT u, v, sum(raw * CASE edge_type WHEN 'shared_bank_hash' THEN 10 WHEN 'shared_registered_agent' THEN 7 WHEN 'shared_ownership' THEN 6 WHEN 'shared_address' THEN 1.5 WHEN 'shared_facility' THEN 1.5 WHEN 'refers_to' THEN 1 WHEN 'shared_members' THEN 0.5 END) AS weight FROM kinds GROUP BY 1, 2)"""
N03 = f"{_PROJECTION} SELECT u, v, {R6('weight')} AS weight, kinds FROM proj JOIN (SELECT u, v, string_agg(edge_type || '=' || format('{{:,.2f}}', raw), ';' ORDER BY edge_type) AS kinds FROM kinds GROUP BY 1, 2) USING (u, v)"
N03B = f"{_PROJECTION} SELECT u, v, {R6('weight')} AS weight FROM proj WHERE u IN ('provider:1', 'provider:3') OR v IN ('provider:1', 'provider:3')"


#: Communities of a session and folder: n04 to n07 read the same table.
_FOUND: dict[tuple[str, str], DataFrame] = {}


def _communities(spark, d, projection):
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOUND:
        _FOUND[key] = materialize(N.communities(projection), "membership")
    return _FOUND[key]


def n04(spark, d):
    p = _projection(spark, d)[0]
    return N.community_table(p, _communities(spark, d, p)).select("community", "size", "hub", r6("hard_links").alias("hard_links"), "category", F.array_join("providers", ",").alias("providers"))


def n05(spark, d):
    p = _projection(spark, d)[0]
    t = tables(spark, d)
    alerts = R.alerts_of(spark, t, only=["R10"])
    e = N.enrich_communities(_communities(spark, d, p), t["claims"], alerts)
    return e.select("community", "claim_count", F.round("total_paid").alias("total_paid"), "rules", "suspicious_claims")


def n06(spark, d):
    p, e = _projection(spark, d)
    bad = p.nodes.where(F.pmod(F.xxhash64("provider"), F.lit(5)) == 0).select("provider")
    return N.network_features(p, _communities(spark, d, p), bad, e, V.claims(spark, d))


def n07(spark, d):
    p = _projection(spark, d)[0]
    m = _communities(spark, d, p)
    out = N.network_table(N.community_table(p, m), N.enrich_communities(m, V.claims(spark, d)))
    return out.select("network_id", "community", "size", "hub", "hard_link_score", "referral_score", "concentration_score", "ownership_score", "hub_centrality", "documented_group", F.round("total_paid").alias("total_paid"), "claim_count", "category")


def _banks(spark, d):
    """Banks as communities, for SQL that says the same."""
    return V.providers(spark, d).select(F.concat(F.lit("provider:"), F.col("provider_id").cast("string")).alias("provider"), F.col("bank_hash").alias("community"))


def n07b(spark, d):
    p, m = _projection(spark, d)[0], _banks(spark, d)
    out = N.network_table(N.community_table(p, m), N.enrich_communities(m, V.claims(spark, d)))
    columns = ["network_id", "community", "size", "hub", "hard_link_score", "referral_score", "concentration_score", "ownership_score", "category", "claim_count"]
    return out.select(*columns, r6("hard_links").alias("hard_links"), "referrals", r6("total_weight").alias("total_weight"), r2("total_paid").alias("total_paid"))


_BANKS = """mem AS (SELECT p, bank_hash AS c FROM pv), sz AS (SELECT c, count(*) AS n FROM mem GROUP BY 1), ins AS (SELECT x.c, k.* FROM kinds k JOIN mem x ON x.p = u JOIN mem y ON y.p = v WHERE x.c = y.c),
 inw AS (SELECT x.c, proj.* FROM proj JOIN mem x ON x.p = u JOIN mem y ON y.p = v WHERE x.c = y.c)"""
N07B = f"""{_PROJECTION}, {_BANKS}, deg AS (SELECT p, sum(weight) AS w FROM (SELECT u AS p, weight FROM inw UNION ALL SELECT v, weight FROM inw) GROUP BY 1),
 hub AS (SELECT c, p AS hub FROM mem LEFT JOIN deg USING (p) QUALIFY row_number() OVER (PARTITION BY c ORDER BY round(coalesce(w, 0), 9) DESC, p) = 1),
 tot AS (SELECT c, sum(CASE WHEN edge_type IN ('shared_bank_hash', 'shared_registered_agent') THEN raw ELSE 0 END) AS hard, sum(CASE WHEN edge_type = 'refers_to' THEN raw ELSE 0 END) AS ref, sum(CASE WHEN edge_type = 'shared_ownership' THEN raw ELSE 0 END) AS own, count(DISTINCT edge_type) AS kinds FROM ins GROUP BY 1),
 wt AS (SELECT c, sum(weight) AS w FROM inw GROUP BY 1), money AS (SELECT bank_hash AS c, count(*) AS k, sum(paid_amount) AS paid FROM claims JOIN providers USING (provider_id) GROUP BY 1),
 t AS (SELECT c, n, hub, coalesce(hard, 0) AS hard, coalesce(ref, 0) AS ref, coalesce(own, 0) AS own, coalesce(kinds, 0) AS kinds, coalesce(w, 0) AS w, k, paid FROM sz JOIN hub USING (c) LEFT JOIN tot USING (c) LEFT JOIN wt USING (c) LEFT JOIN money USING (c))
 SELECT 'NET-' || lpad(CAST(row_number() OVER (ORDER BY n DESC, c) AS VARCHAR), 4, '0') AS network_id, c AS community, n AS size, hub, round(least(hard / n, 1), 4) AS hard_link_score, round(least(ref / (5 * n), 1), 4) AS referral_score, round(least(kinds / 5, 1), 4) AS concentration_score,
 round(least(own / n, 1), 4) AS ownership_score, CASE WHEN hard >= 2 OR (hard >= 1 AND ref >= 2) THEN 'high-risk network' WHEN hard >= 1 OR ref >= 3 THEN 'investigation candidate network' WHEN n >= 3 THEN 'connected provider cluster' ELSE 'small provider cluster' END AS category,
 k AS claim_count, {R6('hard')} AS hard_links, ref AS referrals, {R6('w')} AS total_weight, {R2('paid')} AS total_paid FROM t"""


def n08(spark, d):
    return N.betweenness_centrality(N.connections(_projection(spark, d)[0])).select("provider", r6("betweenness").alias("betweenness"))


def n09(spark, d):
    _, e = _graph(spark, d)
    seeds = spark.createDataFrame([("provider:1",)], "id string")
    return N.neighbourhood(e, seeds, 2, ("has_bank", "located_at"))[0]


N09 = f"""{_GRAPH}, b AS (SELECT src AS a, dst AS b FROM edges WHERE edge_type IN ('has_bank', 'located_at') UNION SELECT dst, src FROM edges WHERE edge_type IN ('has_bank', 'located_at')),
 h AS (SELECT 'provider:1' AS id, 0 AS hops UNION ALL SELECT b, 1 FROM b WHERE a = 'provider:1' UNION ALL SELECT y.b, 2 FROM b x JOIN b y ON y.a = x.b WHERE x.a = 'provider:1') SELECT id, min(hops) AS hops FROM h GROUP BY 1"""


def n09b(spark, d):
    ids = spark.range(1, 4).select(F.col("id").alias("provider_id"))
    return N.member_cohorts(V.claims(spark, d), ids)


N09B = f"{V.with_views('claims')}, s AS (SELECT member_id, string_agg(DISTINCT CAST(provider_id AS VARCHAR), ',' ORDER BY CAST(provider_id AS VARCHAR)) AS providers FROM claims WHERE provider_id BETWEEN 1 AND 3 GROUP BY 1) SELECT providers, count(*) AS members FROM s GROUP BY 1 HAVING count(*) > 5"


def n11(spark, d):
    _, e = _graph(spark, d)
    banks = _banks(spark, d)
    table = banks.groupBy("community").agg(F.count(F.lit(1)).alias("size")).withColumn("number", F.regexp_extract("community", r"\d+", 0).cast("int")).withColumn("category", F.lit("connected provider cluster"))
    return N.narratives(materialize(e, "graph-edges"), banks.join(table, "community"))


# By pairs: an identity value links every two of its providers, a referral or shared members the two of its edge.
N11 = f"""{_GRAPH}, pr AS (SELECT a.p AS x, b.p AS y, 'shared_bank_hash' AS t FROM pv a JOIN pv b ON a.bank_hash = b.bank_hash AND a.p <> b.p UNION ALL SELECT a.p, b.p, 'shared_registered_agent' FROM pv a JOIN pv b ON a.agent = b.agent AND a.p <> b.p
 UNION ALL SELECT src, dst, edge_type FROM plain WHERE dst LIKE 'provider:%' AND src <> dst UNION ALL SELECT dst, src, edge_type FROM plain WHERE dst LIKE 'provider:%' AND src <> dst),
 n AS (SELECT x AS p, count(DISTINCT y) AS n, count(*) FILTER (WHERE t = 'shared_bank_hash') AS bank, count(*) FILTER (WHERE t = 'refers_to') AS sent FROM pr GROUP BY 1), f AS (SELECT src AS p, count(*) AS f FROM plain WHERE edge_type = 'works_at' GROUP BY 1),
 z AS (SELECT bank_hash, count(*) AS size FROM pv GROUP BY 1), s AS (SELECT pv.p, provider_id, bank_hash, size, coalesce(n, 0) AS n, coalesce(f, 0) AS f, list_filter([CASE WHEN bank > 0 THEN bank || ' shared bank account link(s)' END, CASE WHEN sent > 0 THEN sent || ' referral relationship(s)' END, CASE WHEN f > 0 THEN f || ' facility connection(s)' END], lambda x: x IS NOT NULL) AS said
  FROM pv JOIN z USING (bank_hash) LEFT JOIN n ON n.p = pv.p LEFT JOIN f ON f.p = pv.p)
 SELECT p AS provider, 'Provider ' || provider_id || ' is connected to ' || n || ' provider(s)' || CASE WHEN f > 0 THEN ' and ' || f || ' facility(ies)' ELSE '' END || CASE WHEN len(said) > 0 THEN ' via ' || array_to_string(said, ', ') ELSE '' END || '. Provider belongs to Community C'
 || lpad(bank_hash[2:], 2, '0') || ' (' || size || ' providers), classified as a connected provider cluster.' AS text FROM s"""


def n06b(spark, d):
    """Features of providers with their banks as communities; every fifth provider counts as suspicious."""
    p, e = _projection(spark, d)
    bad = V.providers(spark, d).where("provider_id % 5 = 0").select(F.concat(F.lit("provider:"), F.col("provider_id").cast("string")).alias("provider"))
    return N.network_features(p, _banks(spark, d), bad, e, V.claims(spark, d)).drop("referral_centrality")


N06B = f"""{_PROJECTION}, {_BANKS}, e AS (SELECT u AS p, v AS o, weight FROM proj UNION ALL SELECT v, u, weight FROM proj), kk AS (SELECT u AS p, v AS o, edge_type, raw FROM kinds UNION ALL SELECT v, u, edge_type, raw FROM kinds),
 near AS (SELECT p, count(*) AS degree, sum(weight) AS wd, sum(CASE WHEN CAST(split_part(o, ':', 2) AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END) AS sus FROM e GROUP BY 1),
 bykind AS (SELECT p, o, floor(sum(CASE WHEN edge_type IN ('shared_bank_hash', 'shared_registered_agent') THEN raw ELSE 0 END)) AS ident, floor(sum(CASE WHEN edge_type = 'shared_ownership' THEN raw ELSE 0 END)) AS own, floor(sum(CASE WHEN edge_type = 'shared_address' THEN raw ELSE 0 END)) AS addr,
  floor(sum(CASE WHEN edge_type = 'refers_to' THEN raw ELSE 0 END)) AS ref, floor(sum(CASE WHEN edge_type = 'shared_facility' THEN raw ELSE 0 END)) AS fac FROM kk GROUP BY 1, 2), cnt AS (SELECT p, sum(ident) AS ident, sum(own) AS own, sum(addr) AS addr, sum(ref) AS ref, sum(fac) AS fac FROM bykind GROUP BY 1),
 rel AS (SELECT p, count(*) AS k FROM (SELECT src AS p FROM plain UNION ALL SELECT dst FROM plain UNION ALL SELECT a.p FROM pv a JOIN pv b ON a.bank_hash = b.bank_hash AND a.p <> b.p UNION ALL SELECT a.p FROM pv a JOIN pv b ON a.agent = b.agent AND a.p <> b.p) GROUP BY 1),
 dens AS (SELECT c, count(*) AS m FROM inw GROUP BY 1), money AS (SELECT 'provider:' || provider_id AS p, sum(paid_amount) AS paid FROM claims GROUP BY 1)
 SELECT p AS provider, c AS community, n AS community_size, round(coalesce(wd, 0), 2) AS weighted_degree, round(CASE WHEN n > 1 THEN coalesce(m, 0) / (n * (n - 1) / 2) ELSE 0 END, 4) AS network_density, CAST(coalesce(degree, 0) AS BIGINT) AS network_degree, CAST(coalesce(sus, 0) AS BIGINT) AS suspicious_neighbor_count,
 CAST(coalesce(ident, 0) AS BIGINT) AS shared_identity_count, CAST(coalesce(own, 0) AS BIGINT) AS shared_ownership_count, CAST(coalesce(addr, 0) AS BIGINT) AS shared_address_count, CAST(coalesce(ref, 0) AS BIGINT) AS referral_connection_count, CAST(coalesce(fac, 0) AS BIGINT) AS facility_connection_count,
 round(coalesce(paid, 0), 2) AS network_exposure, coalesce(k, 0) AS network_relationship_count, round(coalesce(sus / greatest(degree, 1), 0), 4) AS suspicious_neighbor_ratio, round(least(coalesce(own, 0) / greatest(coalesce(degree, 0), 1), 1), 4) AS ownership_centrality,
 round(least((0.4 * coalesce(ident, 0) + 0.3 * coalesce(sus, 0) + 0.3 * coalesce(ref, 0)) / 5, 1), 4) AS community_risk_score
 FROM mem JOIN sz USING (c) LEFT JOIN near USING (p) LEFT JOIN cnt USING (p) LEFT JOIN rel USING (p) LEFT JOIN dens USING (c) LEFT JOIN money USING (p)"""


def n10(spark, d):
    """Nodes around the hub of the community that holds provider 1; banks are the communities, their smallest provider the hub."""
    first = V.providers(spark, d).groupBy(F.col("bank_hash").alias("community")).agg(F.min("provider_id").alias("provider_id"))
    _, e = _graph(spark, d, first.where("community = 'B1'"))  # one step from the hub needs no pairs of others
    hubs = first.select("community", F.concat(F.lit("provider:"), F.col("provider_id").cast("string")).alias("hub"))
    return N.community_subgraph(materialize(e, "graph-edges"), hubs, "B1")[0]


N10 = f"""{_GRAPH}, hub AS (SELECT 'provider:' || min(provider_id) AS h FROM providers WHERE bank_hash = 'B1') SELECT h AS id, 0 AS hops FROM hub WHERE h IS NOT NULL
 UNION ALL SELECT DISTINCT CASE WHEN src = h THEN dst ELSE src END, 1 FROM edges JOIN hub ON src = h OR dst = h WHERE src <> dst"""

ENTRIES = {
    "e01_exact_links": (e01, E01), "e02_address_links": (e02, E02), "e04_owner_exact": (e04, E04), "e05_owner_fuzzy": (e05, None), "e06_agent_links": (e06, E06), "e07_clusters": (e07, E07), "r09_shared_identity": (r09, R09), "n01_graph": (n01, N01), "n02_graph_summary": (n02, N02),
    "n03_projection": (n03, N03), "n03_connections_of": (n03b, N03B), "n04_communities": (n04, None), "n05_enriched": (n05, None), "n06_features": (n06, None), "n07_networks": (n07, None), "n07_bank_networks": (n07b, N07B), "n08_betweenness": (n08, None), "n09_neighbourhood": (n09, N09), "n09_member_cohorts": (n09b, N09B), "n06_bank_features": (n06b, N06B), "n10_community_subgraph": (n10, N10), "n11_narratives": (n11, N11),
}
