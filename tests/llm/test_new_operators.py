"""Chat formatting, hard negatives and the filter audit: against brute force, on edge cases and at their limits."""

import hashlib
import random
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimsieve.llm import chat_format as chat
from claimsieve.llm import filter_audit as audit
from claimsieve.llm import hard_negatives as hard
from claimsieve.llm.queries import queries

TOKENS = P.path("byte_bpe_50k.json")
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@given(st.text(alphabet="<|\\ \n_aims", max_size=30), st.text(alphabet="<|\\\nan", max_size=12))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text, role):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert chat.parse(chat.render(role, text) * 2) == [(role, text)] * 2


def test_op11(spark, sf_dir):
    convs = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    convs[-1] = [(x, "<|im_end|><|im_start|>assistant ok") for x in ("user", "assistant")]
    got = {r.conv_id: r for r in queries()["op11_chat_format"](spark, sf_dir).collect()}
    assert set(got) == set(convs)
    for k, turns in convs.items():
        targets = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(targets), sha(targets))
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == want
        assert got[k].formatted_chars >= sum(len(t) for _, t in turns)


def plan(sizes, system, budget, history):
    """Windows of one conversation by a plain loop: whether the system turn leads again, first repeated, first new, end."""
    out, at, chapter = [], 0, chat.CHAPTER * budget
    sums = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    while at < len(sizes):
        again = system and at > 0
        room = budget - (sizes[0] if again else 0)
        spare, back = min(history, room - sizes[at]), at
        while back > (1 if system else 0) and sums[at] - sums[back - 1] <= spare:
            back -= 1
        end = at + 1
        while end < len(sizes) and sums[end] // chapter == sums[at] // chapter and sums[end + 1] - sums[back] <= room:
            end += 1
        out.append((again, back, at, end))
        at = end
    return out


@pytest.mark.parametrize("seed,system", [(1, "short"), (2, "none"), (3, "long")])
def test_windows_of_a_long_conversation(spark, seed, system):
    """One id of many turns over many partitions and chapters, held to a plain loop over all of it."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["alpha", "be", "gamma<|x", "d\\|", "ö"]) for _ in range(n))
    turns = [(i, rng.choice(["user", "assistant"]), text(rng.choice([0, 1, 5, 20, 20, 60]))) for i in range(900)]
    if system != "none":
        turns[0] = (0, "system", text(8 if system == "short" else 200))
    budget, history = 96, 40
    frame = spark.createDataFrame([(7, *t) for t in turns], CONVERSATIONS).repartition(6)
    rows = sorted(chat.format_conversations(frame, TOKENS, budget, history).collect(), key=lambda r: r.first_turn)
    from claimsieve.llm.token_ids import text_encoder

    sizes = [len(x) // 4 for x in text_encoder(TOKENS).encode([chat.render(r, t) for _, r, t in turns])]
    want = plan(sizes, system == "short", budget, history)
    assert sum(sizes) > 3 * chat.CHAPTER * budget
    assert [(r.first_turn, r.n_new) for r in rows] == [(at, end - at) for _, _, at, end in want]
    for r, (again, back, at, end) in zip(rows, want, strict=True):
        shown = ([turns[0]] if again else []) + turns[back:end]
        assert chat.parse(r.text) == [(role, t) for _, role, t in shown] and r.n_repeated == len(shown) - (end - at)
        assert r.n_tokens <= budget or r.n_new == 1
        assert [chat.unescape(r.text[s.start : s.end]) for s in r.loss] == [t for _, role, t in turns[at:end] if role == "assistant"]
    back = chat.read_back(chat.materialize(chat.format_conversations(frame, TOKENS, budget, history), "w")).collect()
    assert len(back) == 1 and back[0].n_turns == 900 and back[0].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))


def test_chat_edges(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (1, None, "user", "first"), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 0, "assistant", ""), (3, 0, "user", "word " * 30000), (3, 1, "assistant", "<|im_end|>")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], CONVERSATIONS + ", tokens string, chapter int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame, TOKENS)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {None: (2, 1), 1: (4, 3), 2: (1, 0), 3: (2, 10)}
    assert got[1].turns_sha256 == sha("user\nfirst\nassistant\na\nassistant\na\nassistant\nb\n") and got[1].loss_sha256 == sha("aab")
    assert got[2].loss_sha256 == sha("") and got[3].n_windows == 2
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert chat.read_back(chat.format_conversations(empty, TOKENS)).collect() == []


def brute_negatives(rows, anchors, ints, k=5):
    out = []
    for a in anchors:
        score = {i: min(max(sum(p * q for p, q in zip(ints[i], ints[a], strict=True)), hard._NONE + 1), hard._TOP) for i in range(len(rows)) if rows[i][0] != rows[a][0]}
        best = sorted((i for i in score if rows[i][1] == rows[a][1]), key=lambda i: (-score[i], rows[i][0]))[:k]
        for p in best:
            fit = [i for i in score if rows[i][1] != rows[a][1] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            for rank, i in enumerate(sorted(fit, key=lambda i: (-score[i], rows[i][0]))[:k], 1):
                out.append((rows[a][0], rows[p][0], rank, rows[i][0], score[p], score[i]))
    return sorted(out)


def whole(v):
    from fractions import Fraction

    return [int((Fraction(x) * 256).__floor__()) for x in v]


def test_op12(spark, sf_dir):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute_negatives(rows, [i for i, r in enumerate(rows) if r[0] % 100 == 0], [whole(r[2]) for r in rows])
    assert want and sorted(map(tuple, queries()["op12_hard_negatives"](spark, sf_dir).collect())) == want


@pytest.mark.parametrize("kind", ["clusters", "copies", "tiny", "huge", "mixed"])
def test_hard_negatives_over_shards(spark, monkeypatch, kind):
    """Small shards and blocks, so that lists end early and shards are left out; ties, zero vectors and components at any size."""
    monkeypatch.setattr(hard, "SHARD", 24)
    monkeypatch.setattr(hard, "BLOCK", 8)
    rng = np.random.default_rng(5)
    n, d = 260, 6
    v = rng.normal(size=(n, d)) + 4 * rng.normal(size=(8, d))[rng.integers(0, 8, n)]
    if kind == "copies":
        v[::3] = v[0]
        v[1::9] = 0
    v *= {"tiny": 1e-3, "huge": 1e200}.get(kind, 1)
    if kind == "mixed":
        v[5::20] *= 1e306
        v[6::20] *= 1e9
    rows = [(i, int(rng.integers(0, 3)), v[i].tolist()) for i in range(n)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    ints = [whole(r[2]) for r in rows]
    got = hard.mine_hard_negatives(hard.labelled_vectors(frame), "vec_id % 20 = 0")
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, range(0, n, 20), ints)


def test_lists_end_early():
    rng = np.random.default_rng(2)
    v = np.repeat(np.eye(16), 200, axis=0) * 3 + rng.normal(size=(3200, 16)) * 0.02
    shard = hard.Shard(np.arange(3200), np.zeros(3200, np.int64), v)
    seen = []
    real, hard.scores = hard.scores, lambda q, x: seen.append(len(x)) or real(q, x)
    try:
        shard.walk(hard.Shard(np.arange(20), np.zeros(20, np.int64), v[:20]), 5, None)
    finally:
        hard.scores = real
    assert sum(seen) <= hard.BLOCK  # of 3,200


def test_hard_negative_edges(spark):
    kinds = "vec_id long, label int, embedding array<float>"
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (None, 2, [1.0, 0.0]), (8, 2, [1.0, 0.0, 1.0]), (9, 2, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], kinds + ", cell int, score int")
    got = sorted(map(tuple, hard.mine_hard_negatives(hard.labelled_vectors(frame), "vec_id = 0").collect()))
    assert got == [(0, 1, 1, 2, 65536, 256 * 230)] * 2
    empty = spark.createDataFrame([], kinds)
    assert hard.mine_hard_negatives(hard.labelled_vectors(empty), "vec_id = 0").collect() == []
    assert hard.mine_hard_negatives(hard.labelled_vectors(frame), "vec_id = 77").collect() == []


def brute_audit(docs, labels):
    import re

    flags = []
    for k, text, part in docs:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", text) if x]
        same = [o for o, t, _ in docs if (t or "") == text]
        failed = {x for x, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), bool(set(text) & set("#$%&*|")), k is not None and any(o is not None and o < k for o in same)), strict=True) if f}
        flags.append((part or "", failed, any(q == 1 for i, q, _ in labels if i == k and k is not None), any(t == 1 for i, _, t in labels if i == k and k is not None)))
    out = []
    for part in {f[0] for f in flags}:
        mine = [f for f in flags if f[0] == part]
        gone = {}
        for o in permutations("ABCDE"):
            for s, x in enumerate(o):
                hit = [f for f in mine if x in f[1]]
                first = [f for f in hit if not f[1] & set(o[:s])]
                gone[o, x] = len(first)
                out.append([part, "".join(o), s + 1, sum(not f[1] & set(o[: s + 1]) for f in mine), len(first), len(hit) - len(first), sum(f[1] == {x} for f in mine), sum(f[2] for f in first), sum(f[3] for f in first), x])
        total = {x: sum(n for (_, y), n in gone.items() if y == x) for x in "ABCDE"}
        for r in out:
            if r[0] == part:
                r[-1] = total[r[-1]]
    return sorted(map(tuple, out))


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_op13(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = queries()["op13_filter_audit"](spark, sf_dir)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute_audit(docs, labels)


def test_audit_edges(spark):
    many = " ".join(f"w{i}" for i in range(60))
    docs = [(1, "", "a"), (2, None, None), (3, many, ""), (3, many, ""), (4, many, "a"), (None, many, "a"), (None, many, "a"), (5, "Aé #", "b"), (5, many + "x", "b"), (6, many + "x", "b"), (7, "long " * 50000, "b"), (8, "a\x0bb\x1cc d", "b"), (9, "a\x0bb\x1cc d", "b")]
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (5, None, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, mask int, part string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(frame, said)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute_audit(docs, labels)
    assert audit.audit_filters(frame.limit(0), said).collect() == []


@given(st.lists(st.tuples(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), st.integers(0, 50)), max_size=60))
@settings(max_examples=200, deadline=None)
def test_trie_holds_the_least(rows):
    trie, want = audit.RadixTrie(), {}
    for text, i in rows:
        trie.insert(text, (i, text))
        want[text] = min(want.get(text, i), i)
    assert sorted((t, i) for i, t in trie.terminals()) == sorted(want.items())


def test_prefixes_adapt(spark, monkeypatch):
    """Texts that share a very long beginning are parted behind it; copies of one text do not count as a range of their own."""
    monkeypatch.setattr(audit, "TRIE_BYTES", 40_000)
    shared = "same beginning " * 80
    rows = [(i, f"{shared}{i * 7919 % 1000:03d}") for i in range(300)] + [(1000 + i, "one text") for i in range(300)] + [(2000 + i, f"{i * 7919 % 1000:03d}") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    from pyspark.sql import functions as F

    splits = audit.prefix_splits(frame.select("text", F.xxhash64("text").alias("h")), 12)
    assert splits == sorted(set(splits)) and sum(s.startswith(shared.encode()) for s in splits) >= 5
    assert sorted(r.doc_id for r in audit.first_texts(frame).collect()) == [*range(300), 1000, *range(2000, 2050)]
