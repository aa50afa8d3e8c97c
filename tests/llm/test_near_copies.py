"""Near copies against all pairs: planted at similarities around the bound, and a large group."""

import random

import corpus_pipeline as c
from claimsieve.llm import near_copies as nc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=3, groups=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(100_000)}"
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(base))
        for changes in (0.002, 0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(word() if rng.random() < changes else w for w in base))
    base = [word() for _ in range(200)]  # a large group, most pairs of which are near the bound
    for _ in range(300):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(200)] = word()
        texts.append(" ".join(copy))
    return texts + ["", None, "few words", "Few  words"]


def brute(texts):
    words = [(t or "").lower().split() for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([()]) for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, by = [], {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for a, b in {(a, b) for m in by.values() for a in m for b in m if a < b}:
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b, both / (len(sets[a]) + len(sets[b]) - both)))
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], links


def test_all_near_copies_are_linked_and_nothing_else(spark):
    texts = planted()
    want, links = brute(texts)
    assert sum(0.8 <= j < 0.85 for *_, j in links) > 100 and sum(0.9 <= j < 0.95 for *_, j in links) > 100
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in nc.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = c.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_simhash_links_come_first(spark, monkeypatch):
    """close fingerprints select candidates and give links; MinHash takes only what they have not linked."""
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(100_000)}" for _ in range(400)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base[:200], "other", *base[201:]])]
    want, links = brute(texts)
    asked, given = [], []

    def seen(pairs, sets, plain=nc._links):
        got = plain(pairs, sets)
        asked.append({(r.a, r.b) for r in pairs.collect()})
        given.append({(r.a, r.b) for r in got.collect()})
        return got

    monkeypatch.setattr(nc, "_links", seen)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in nc.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(given[0]) > 20 and given[0] <= {(a, b) for a, b, _ in links}
    assert not any(given[0] & later for later in asked[1:])
