"""Networks and identity: what the queries take into communities, candidates, betweenness, tiles."""

import random

import pytest
from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.operators import graph as N
from claimsieve.operators import identity as E
from claimsieve.queries import network as Q


def test_communities_of_all_kinds_of_edges(spark):
    groups = [["a1", "a2", "a3"], ["b1", "b2", "b3"]]
    edges = [(u, v, 3.0, {"located_at": 1.0}) for g in groups for u in g for v in g if u < v]
    edges.append(("a3", "b1", 0.5, {"shared_members": 1.0}))
    # A bank across both does not outweigh the other ties.
    edges.append(("a1", "b2", 1.0, {"has_bank": 0.1}))
    p = spark.createDataFrame(edges, "u string, v string, weight double, edge_types map<string, double>")
    got = N.communities(N.of_pairs(p)).groupBy("community").agg(F.sort_array(F.collect_list("provider")).alias("g")).collect()
    assert sorted(r.g for r in got) == groups


def test_similar_names_finds_all_that_score(spark):
    """Against all pairs of names, among them words that very many have, slips of the pen and changed orders."""
    r = random.Random(6)
    parts = ["johnson", "petersen", "alvarez", "care", "care", "care", "medical", "clinic", "st", "mary", "of", "harbor"]
    names = set()
    while len(names) < 260:
        words = [r.choice(parts) for _ in range(r.randrange(1, 4))]
        if r.random() < 0.6:
            i = r.randrange(len(words))
            w = list(words[i])
            for _ in range(r.randrange(1, 3)):
                k = r.randrange(len(w) + 1)
                if r.random() < 0.5:
                    w.insert(k, r.choice("aeiost"))
                elif len(w) > 2:
                    del w[min(k, len(w) - 1)]
            words[i] = "".join(w)
        names.add(" ".join(words))
    df = spark.createDataFrame([(n, n + r.choice(["", " inc", " llc holdings"])) for n in sorted(names)], "owner string, plain string")
    other = df.select(F.col("owner").alias("owner_b"), F.col("plain").alias("plain_b"))
    score = F.greatest(C.token_set_ratio("plain", "plain_b"), C.token_set_ratio("owner", "owner_b"))
    every = df.crossJoin(other).where("owner < owner_b").select("owner", "owner_b", score.alias("score")).where("score >= 88")
    want = {(x.owner, x.owner_b): x.score for x in every.collect()}
    got = {(x.owner, x.owner_b): x.score for x in E.similar_names(df).collect()}
    assert len(want) > 300
    missed = [k for k in want if k not in got]
    assert len(missed) <= 0.01 * len(want), missed
    assert all(got[k] == want.get(k) for k in got)


def test_betweenness_is_exact_both_ways(spark):
    """Against counting all shortest paths, over the adjacency and over joins."""
    r = random.Random(2)
    edges = {(f"p{a}", f"p{b}"): float(r.randrange(1, 4)) for a in range(14) for b in range(a) if r.random() < 0.3}
    edges |= {("x", "y"): 1.0, ("y", "z"): 1.0}
    df = spark.createDataFrame([(*sorted(k), w) for k, w in edges.items()], "u string, v string, weight double")
    nodes = sorted({x for k in edges for x in k})
    near = {a: {} for a in nodes}
    for (a, b), w in edges.items():
        near[a][b] = near[b][a] = w
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        best = {}

        def walk(path, length, best=best):
            t = path[-1]
            if length <= best.get(t, (1e9,))[0]:
                if length < best.get(t, (1e9,))[0]:
                    best[t] = (length, [])
                best[t][1].append(path)
                for x, w in near[t].items():
                    if x not in path:
                        walk([*path, x], length + w)

        walk([s], 0.0)
        for t, (_, paths) in best.items():
            for p in paths:
                for x in p[1:-1]:
                    want[x] += 1 / len(paths)
    scale = 1 / ((len(nodes) - 1) * (len(nodes) - 2))
    want = {k: pytest.approx(x * scale, abs=1e-9) for k, x in want.items()}
    assert {x.provider: x.betweenness for x in N.betweenness_centrality(df).collect()} == want
    numbered = spark.createDataFrame([(nodes.index(a), nodes.index(b), w) for (a, b), w in edges.items()] + [(nodes.index(b), nodes.index(a), w) for (a, b), w in edges.items()], "a long, b long, weight double")
    joined = {nodes[x.id]: x.b * scale for x in N._over_joins(numbered, spark.range(len(nodes)).withColumnRenamed("id", "s")).collect()}
    assert {k: joined.get(k, 0.0) for k in nodes} == want


def test_betweenness_without_detours(spark, monkeypatch):
    """Where each edge is shorter than any detour no source is walked, at any number of edges; one long edge makes its ends count."""
    names = [f"n{i}" for i in range(7)]
    edges = {(a, b): 10.0 + i % 3 for i, (a, b) in enumerate((a, b) for a in names for b in names if a < b)}
    frame = lambda e: spark.createDataFrame([(*k, w) for k, w in e.items()], "u string, v string, weight double")
    monkeypatch.setattr(N, "ADJACENCY_EDGES", 3)
    with monkeypatch.context() as m:
        m.setattr(N, "_over_joins", None)
        assert {r.betweenness for r in N.betweenness_centrality(frame(edges)).collect()} == {0.0}
    edges["n2", "n5"] = 50.0
    joined = {r.provider: r.betweenness for r in N.betweenness_centrality(frame(edges)).collect()}
    assert sum(joined.values()) > 0 and joined["n2"] == joined["n5"] == 0.0
    monkeypatch.setattr(N, "ADJACENCY_EDGES", 1000)
    assert {r.provider: pytest.approx(r.betweenness) for r in N.betweenness_centrality(frame(edges)).collect()} == joined


def test_neighbours_over_columns(spark):
    """Neighbours in other columns of bitmaps count, once each, and are not made as pairs or rows of a bitmap for each member."""
    n = N.WIDE + 700
    members = spark.range(n).selectExpr("id", "id % 2 as cls").union(spark.range(N.WIDE - 1, N.WIDE + 2).selectExpr("id", "9 as cls"))
    direct = spark.createDataFrame([(0, N.WIDE + 1), (0, 2), (3, N.WIDE + 3)], "a long, b long")
    got = {r.id: r.n for r in N.neighbour_counts(members, direct).where(f"id in (0, 2, 3, {N.WIDE}, {N.WIDE + 1}, {N.WIDE + 3})").collect()}
    even, odd = (n + 1) // 2 - 1, n // 2 - 1
    assert got == {0: even + 1, 2: even, 3: odd, N.WIDE: even + 2, N.WIDE + 1: odd + 2, N.WIDE + 3: odd}


def test_no_missing_lists_on_the_way_to_workers(spark, monkeypatch):
    """rows of single edges have an empty list; with a NULL each took a step for every row of its batch."""
    seen = []
    real = N.by_tile
    monkeypatch.setattr(N, "by_tile", lambda rows, *a: seen.append(rows) or real(rows, *a))
    direct = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    got = {r.id: r.n for r in N.neighbour_counts(spark.createDataFrame([(0, 9), (3, 9)], "id long, cls long"), direct).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 3: 1}
    assert seen[0].where("left is null").count() == 0 and seen[0].where("bits is null").count() == 4


def test_projection_in_tiles(spark, monkeypatch):
    """A shared node gives all pairs once, whatever the size of a tile."""
    rows = [(f"provider:{i}", "facility:1", "works_at", float(i % 3 + 1)) for i in range(23)] + [("provider:1", "provider:2", "refers_to", 2.0), ("provider:2", "provider:1", "refers_to", 1.0)]
    df = spark.createDataFrame(rows, N.EDGE)
    got = {}
    for tile in (4, 2000):
        monkeypatch.setattr(N, "TILE", tile)
        got[tile] = sorted((r.u, r.v, round(r.weight, 9)) for r in N.project_providers(df).collect())
    assert got[4] == got[2000] and len(got[4]) == 23 * 22 // 2


def louvain(near):
    """Sequential local moving with contraction, the plain method: labels of the nodes of ``near[u][v] = weight``."""
    k = {u: sum(x.values()) for u, x in near.items()}
    total, top = sum(k.values()), {u: u for u in near}
    while True:
        c, tot, moved, again = {u: u for u in near}, dict(k), False, True
        while again:
            again = False
            for u in near:
                w = {}
                for v, x in near[u].items():
                    if v != u:
                        w[c[v]] = w.get(c[v], 0) + x
                tot[c[u]] -= k[u]
                best = max([c[u], *sorted(w)], key=lambda t: (round(w.get(t, 0) - k[u] * tot[t] / total, 9), t == c[u]))
                again |= best != c[u]
                c[u] = best
                tot[best] += k[u]
            moved |= again
        if not moved:
            return top
        top = {u: c[t] for u, t in top.items()}
        new, sums = {}, {}
        for u, x in near.items():
            sums[c[u]] = sums.get(c[u], 0) + k[u]
            for v, y in x.items():
                row = new.setdefault(c[u], {})
                row[c[v]] = row.get(c[v], 0) + y
        near, k = new, sums


def test_class_nodes_against_pairs(spark):
    """Degrees, neighbours and modularity of class nodes are those of all pairs; communities are as good as the plain method's."""
    r = random.Random(1)
    rows = [(f"provider:{i}", x, t, 1.0) for i in range(90) for x, t in ((f"bank:{i // 5}", "has_bank"), (f"address:{i // 15}", "located_at"), (f"facility:{r.randrange(5)}", "works_at"), (f"shared_registered_agent:{i % 30}", "shared_registered_agent"))]
    rows += [(f"provider:{a}", f"provider:{b}", "refers_to", 2.0) for a, b in {(r.randrange(90), r.randrange(90)) for _ in range(80)}]
    p = N.project(spark.createDataFrame(rows, N.EDGE))
    near, pairs = {}, N.connections(p).collect()
    for x in pairs:
        near.setdefault(x.u, {})[x.v] = x.weight
        near.setdefault(x.v, {})[x.u] = x.weight
    names = {x.id: x.provider for x in p.nodes.collect()}
    assert {names[x.id]: round(x.k, 6) for x in N.degrees(p).collect()} == {u: round(sum(x.values()), 6) for u, x in near.items()}
    assert {names[x.id]: x.n for x in N.neighbour_counts(p.members, p.direct).collect()} == {u: len(x) for u, x in near.items()}
    some = [i for i in names if i % 3 == 0]
    marked = {names[x.id]: x.n for x in N.neighbour_counts(p.members, p.direct, spark.createDataFrame([(i,) for i in some], "id long")).collect()}
    assert all(marked.get(u, 0) == sum(v in {names[i] for i in some} for v in x) for u, x in near.items())
    asked = N.connections(p, spark.createDataFrame([("provider:7",)], "provider string")).collect()
    assert {x.v if x.u == "provider:7" else x.u: (x.weight, x.edge_types) for x in asked} == {x.v if x.u == "provider:7" else x.u: (x.weight, x.edge_types) for x in pairs if "provider:7" in (x.u, x.v)}

    def quality(label):
        k = {u: sum(x.values()) for u, x in near.items()}
        total, size = sum(k.values()), {}
        for u in k:
            size[label[u]] = size.get(label[u], 0) + k[u]
        return sum(w for u, x in near.items() for v, w in x.items() if label[u] == label[v]) / total - sum((s / total) ** 2 for s in size.values())

    found = N.communities(p)
    of = {x.provider: x.community for x in found.collect()}
    label = {u: of.get(u, u) for u in near}
    assert N.modularity(p, found) == pytest.approx(quality(label), abs=1e-9)
    assert quality(label) >= quality(louvain(near)) - 0.005


def test_tiles_make_no_row_for_a_pair_and_value(spark, monkeypatch):
    """a value of all providers is a row for each two blocks; counts of members are those of plain pairs."""
    monkeypatch.setattr(N, "TILE", 100)
    rows = spark.range(1000).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("cls"))
    assert N.in_tiles(rows, ["cls"]).count() == 2 * 10 * 11 // 2
    r = random.Random(4)
    monkeypatch.setattr(N, "COUNTED", 50)
    monkeypatch.setattr(N, "TILE", 3)
    seen = {(r.randrange(40), r.randrange(15)) for _ in range(260)} | {(p, 99) for p in range(40)}
    of = lambda p: {m for x, m in seen if x == p}
    want = {(f"provider:{a}", f"provider:{b}"): float(len(of(a) & of(b))) for a in range(40) for b in range(a + 1, 40)}
    got = N.shared_member_edges(spark.createDataFrame([*seen, *seen, (None, 1), (1, None)], "provider_id int, member_id int")).collect()
    assert {(x.src, x.dst): x.weight for x in got} == {k: n for k, n in want.items() if n >= 2} and len({(x.src, x.dst) for x in got}) == len(got)


def test_small_communities_beside_heavy_ones(spark):
    """A move counts by what it gives its node, however much weight the rest of the graph has."""
    edges = [("x", "y", 1e9), ("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)]
    got = N.communities(N.of_pairs(spark.createDataFrame([(*e, {"pair": 1.0}) for e in edges], "u string, v string, weight double, edge_types map<string, double>"))).collect()
    assert {(r.provider, r.community) for r in got} == {("x", "x"), ("y", "x"), ("a", "a"), ("b", "a"), ("c", "a")}


def test_each_community_of_a_class_is_weighed(spark):
    """a light node joins the community that has most of its class, though a mean member is drawn more by 13 others."""
    large, pairs = list(range(1, 11)), [(11 + 2 * i, 12 + 2 * i) for i in range(12)]
    classes = [(u, 1, 1.0) for u in [0, *large, *(s for s, _ in pairs)]] + [(u, 2, 50.0) for u in large]
    direct = [(*p, 100.0) for p in pairs] + [(35, 36, 20000.0)]
    p = N.Projection(
        spark.createDataFrame([(i, f"p{i:02}") for i in range(37)], "id long, provider string"), spark.createDataFrame([(u, c, "k", 1.0, w) for u, c, w in classes], "id long, cls long, kind string, raw double, w double"),
        spark.createDataFrame([(a, b, "k", 1.0, w) for a, b, w in direct], "a long, b long, kind string, raw double, w double"),
    )
    found = N.communities(p).groupBy("community").agg(F.sort_array(F.collect_list("provider")).alias("of")).collect()
    assert sorted(r.of for r in found) == sorted([[f"p{i:02}" for i in [0, *large]], *([f"p{a:02}", f"p{b:02}"] for a, b in [*pairs, (35, 36)])])


def of_classes(members, direct, n, label, one):
    """Rises by all moves of a node, over plain pairs."""
    near = [[0.0] * n for _ in range(n)]
    for cls in {c for _, c, _ in members}:
        us = [(u, w) for u, c, w in members if c == cls]
        for u, w in us:
            for v, _ in us:
                near[u][v] += w if u != v else 0
    for a, b, w in direct:
        near[a][b] += w
        near[b][a] += w
    k = [sum(x) for x in near]
    total = sum(k)
    gain = {c: sum(near[one][v] for v in range(n) if label[v] == c and v != one) - k[one] * sum(k[v] for v in range(n) if label[v] == c and v != one) / total for c in {label[v] for v in range(n) if near[one][v] > 0} | {label[one]}}
    return max(gain.values()) - gain[label[one]], k[one]


def test_no_node_gains_by_a_move(spark, monkeypatch):
    """Local moving ends where no node gains in any community it meets; pieces, counts and looked up members give the same."""
    r = random.Random(7)
    n = 60
    members = sorted({(r.randrange(n), c, 1.0 + c % 3) for c in range(14) for _ in range(4 + 3 * c)} | {(u, 99, 0.5) for u in range(n)})
    direct = [(a, b, float(r.randrange(1, 5))) for a in range(n) for b in range(a + 1, n) if r.random() < 0.05]
    m = spark.createDataFrame([(*x, 1.0) for x in members], "u long, cls long, w double, x double")
    d = spark.createDataFrame(direct + [(b, a, w) for a, b, w in direct], "u long, v long, w double")
    k = [of_classes(members, direct, n, list(range(n)), u)[1] for u in range(n)]
    node = spark.createDataFrame(list(enumerate(k)), "u long, k double")
    got = []
    for held, counts in ((1 << 20, 1 << 20), (len(direct) // 2, 1 << 20), (1 << 20, 0), (len(direct) // 2, 8 * n)):
        monkeypatch.setattr(N, "HELD", held)
        monkeypatch.setattr(N, "CLASS_COUNTS", counts)
        level = N._Level(m, d, node, sum(k), 1.0)
        assert len(level.pieces()) == (1 if held > 1000 else 4)
        label, moved = level.settle()
        got.append([x.c for x in label.orderBy("u").collect()])
        assert moved and len(got[-1]) == n
    assert got[0] == got[1] == got[2] == got[3]
    for u in range(n):
        rise, own = of_classes(members, direct, n, got[0], u)
        assert rise <= 1.1 * N.LEAST_RISE * own


def test_equal_classes_are_united(spark):
    """Classes of the same nodes are one of their weights together, others stay."""
    rows = [(u, c, w, 1.0) for us, c, w in (((1, 2, 3), 1, 1.0), ((1, 2, 3), 2, 0.5), ((1, 2), 3, 4.0), ((1, 2, 4), 4, 2.0)) for u in us]
    got = N.united(spark.createDataFrame(rows, "u long, cls long, w double, x double")).collect()
    assert {tuple(r) for r in got} == {(u, c, w, 1.0) for us, c, w in (((1, 2, 3), 1, 1.5), ((1, 2), 3, 4.0), ((1, 2, 4), 4, 2.0)) for u in us}


def test_names_meet_by_letters_in_tiles(spark, monkeypatch):
    """F1: names of the same common words make no candidates by pieces of them; none that scores is missed, whatever the block."""
    r = random.Random(8)
    plain = lambda: "".join(r.choice("abcdefghiklmnoprstuw") for _ in range(9))
    names = sorted({f"{plain()} family harbor care" for _ in range(150)} | {"ab cd", "ba cd", "abc de", "abd de", "abcdefghi k", "k abcdefghj"})
    df = spark.createDataFrame([(n, n) for n in names], "owner string, plain string")
    want = {(a, b): x for a in names for b in names if a < b and (x := C.token_set(a, b)) >= 75}
    assert len(want) > 200
    texts = df.select("owner", F.col("owner").alias("text"))
    for size in (1024, 16):
        monkeypatch.setattr(E, "NAMES", size)
        assert {(x.owner, x.owner_b): x.score for x in E.similar_names(df, 75.0).collect()} == want
    assert E._by_letters(texts, 88.0).count() < 300  # 149 * 150 / 2 pairs share three of four words
