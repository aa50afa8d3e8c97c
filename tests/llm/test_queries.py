"""The registered queries over the smallest tables, held to their contracts by libraries and brute force."""

import glob
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest

from claimsieve.llm.queries import queries
from claimsieve.llm import token_output


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: queries()[name](spark, sf_dir)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return {k: [*t.encode(x, add_special_tokens=False).ids, 2] for k, x in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(run, ids):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run("op1_token_output").collect()}
    at, want = 0, {}
    for k in sorted(ids):
        want[k] = (at, len(ids[k]), crc(ids[k]))
        at += len(ids[k])
    assert got == want


def test_op1_files(spark, sf_dir, tmp_path):
    """Ids by dictionary, numbers by deltas, small row groups with page indexes; a read without ids leaves them alone."""
    token_output.write_token_dataset(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"file://{tmp_path}/t", P.path("byte_bpe_50k.json"))
    files = sorted(glob.glob(f"{tmp_path}/t/tokens/*.parquet"))
    assert files
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 2 * token_output.ROW_GROUP_BYTES
            for c in (group.column(i) for i in range(group.num_columns)):
                assert c.has_offset_index and c.has_column_index
                codes = set(c.encodings)
                if c.path_in_schema.startswith("ids"):
                    assert "RLE_DICTIONARY" in codes
                elif c.path_in_schema in ("doc_id", "local_start", "n_tokens"):
                    assert "DELTA_BINARY_PACKED" in codes
    plan = token_output.read_token_metadata(spark, f"file://{tmp_path}/t").where("doc_id = 7")._jdf.queryExecution().toString()
    scan = [x for x in plan.split("\n") if "ReadSchema" in x or "FileScan" in x]
    assert scan and not any("ids" in x.split("ReadSchema")[-1] for x in scan) and any("EqualTo(doc_id,7)" in x for x in scan)


def test_op2(run, texts):
    rows = run("op2_simhash").collect()
    assert {r.doc_id for r in rows} == set(texts) and all(len(r.fingerprint) == 16 and r.component_id <= r.doc_id for r in rows)
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    root = {k: k for k in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(fp):
        for b in fp:
            if b < a and (fp[a] ^ fp[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id: r.component_id for r in rows} == {k: find(k) for k in fp}


def test_op3(run, texts):
    raws = {k: t.encode() for k, t in texts.items()}
    count = defaultdict(int)
    for r in raws.values():
        for p in range(len(r) - 199):
            count[hash(r[p : p + 200])] += 1
    for r in run("op3_suffix_dedup").collect():
        raw = raws[r.doc_id]
        gone = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - 199):
            if count[hash(raw[p : p + 200])] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())


def test_op4(run, ids):
    seq, docs = defaultdict(list), defaultdict(list)
    for r in run("op4_best_fit_packing").collect():
        seq[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for k, own in ids.items():
        n, want, at = len(own), [], 0
        length = n - (n - 1) // 1024 * 1024
        while at < n:
            want.append((len(want), at, length, crc(own[at : at + length])))
            at, length = at + length, 1024
        assert sorted(docs[k]) == want
    assert set(docs) == set(ids)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seq) <= -(-sum(map(len, ids.values())) // 1024) + 1


def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.embedding is not None and None not in r.embedding]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    return [r.vec_id for r in rows], [i for i, _ in good], np.array([v for _, v in good])


def test_op5(run, spark, sf_dir):
    _, who, x = vectors(spark, sf_dir)
    got = defaultdict(list)
    for r in run("op5_vantage_point_ann").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in who if i % 20 == 0}
    for k, i in enumerate(who):
        if i % 20 == 0:
            score = x @ x[k]
            want = sorted((-score[j], who[j]) for j in range(len(who)) if j != k)[:20]
            assert [r[0] for r in sorted(got[i])] == list(range(1, len(want) + 1))
            assert [r[2] for r in sorted(got[i])] == pytest.approx([-s for s, _ in want], abs=1e-9)
            assert {r[1] for r in got[i]} >= {j for s, j in want if -s > -want[-1][0] + 1e-9}


def test_op7(run, spark, sf_dir):
    all_ids, who, x = vectors(spark, sf_dir)
    u = x / np.sqrt((x**2).sum(axis=1))[:, None]
    cos = u @ u.T
    np.fill_diagonal(cos, -1)
    sure, maybe = cos >= 0.95 + 1e-12, cos >= 0.95 - 1e-12
    got = {r.vec_id: r for r in run("op7_embedding_dedup").collect()}
    assert set(got) == set(all_ids) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    for k, i in enumerate(who):
        assert sure[k].sum() <= got[i].n_links <= maybe[k].sum()
        assert all(got[who[j]].component_id == got[i].component_id for j in np.flatnonzero(sure[k]))
    for i in set(all_ids) - set(who):
        assert (got[i].n_links, got[i].component_id) == (0, i)


def test_op6_and_op8(run, spark, sf_dir, texts):
    rows = run("op6_secrets").collect()
    assert {r.doc_id for r in rows} == set(texts)
    pats = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+"))]
    seen = 0
    for r in rows:
        spans, n = [], []
        for k, (_, p) in enumerate(pats):
            m = [z for z in p.finditer(texts[r.doc_id]) if (len(z[2]) >= 12 if k == 0 else len(z[0]) >= (18, 16)[k - 1])]
            n.append(len(m))
            spans += [(z.start(), k, z.end()) for z in m]
        written = ",".join(f"{pats[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
        assert [r.n_assign, r.n_access, r.n_hex] == n and r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
        seen += len(spans)
    assert seen > 0
    pages = run("op8_html_text")
    assert pages.columns[:4] == ["page_id", "url", "text", "n_chars"] and pages.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_op9(run, texts):
    import tiktoken

    from claimsieve.llm.bpe import load_ranks

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in run("op9_byte_bpe").collect():
        own = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_op10(run, spark, sf_dir, texts):
    rows = run("op10_toxicity").collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert held and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.8
