"""Secret scans: keyword prefilter, anchored patterns near hits, checksum validation.

One Aho-Corasick pass over the lower-cased bytes of a text finds every keyword of every kind; most texts have none and
are done. Patterns are tried only where a keyword hit starts. Runs of hexadecimal digits have no keyword: all such digits
are mapped to one letter and a run of sixteen is looked for. Kinds that embed a checksum or a structure keep a match only
if it holds.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm.common import bounded, portions

BASE_KINDS = ("assign", "access", "hex")
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc_tail(token: bytes) -> bool:
    """Six base-62 digits at the end hold the CRC-32 of what stands between the prefix and them."""
    body, tail = token[token.index(b"_") + 1 : -6], token[-6:]
    n, digits = zlib.crc32(body), b""
    while n:
        n, r = divmod(n, 62)
        digits = _BASE62[r : r + 1] + digits
    return digits.rjust(6, b"0") == tail


def _jwt(token: bytes) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    head = token.split(b".")[0]
    try:
        got = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, RecursionError):  # a header nested that deeply is none
        return False
    return isinstance(got, dict) and "alg" in got


@dataclass(frozen=True)
class Kind:
    """A kind of secret: matches start at a keyword, and ``valid`` decides on the match."""

    name: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    valid: Callable[[re.Match[bytes]], bool]
    #: Where the pattern fails, it fails for every keyword inside what this matches from there.
    fails: re.Pattern[bytes] | None = None


#: Order is that of equal starts in ``spans``: the base kinds first.
KINDS = (
    Kind("assign", (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE), lambda m: len(m[2]) >= 12),
    Kind("access", (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    Kind("hex", (), re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    Kind("host_token", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc_tail(m[0])),
    Kind("package_token", (b"npm_",), re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc_tail(m[0])),
    Kind("jwt", (b"eyj",), re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), lambda m: _jwt(m[0]), re.compile(rb"[A-Za-z0-9_-]+")),
    Kind("private_key", (b"-----begin ",), re.compile(rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"), lambda m: True),
)
_HEX_CLASS = bytes(ord("h") if c in b"0123456789abcdef" else ord(" ") for c in range(256))


@functools.lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, kind in enumerate(KINDS):
        for word in kind.keywords:
            found.add_word(word.decode("latin-1"), (k, len(word)))
    found.make_automaton()
    return found


def scan(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(start, index of kind, end)`` in code points, by start, then kind; leftmost and non-overlapping per kind."""
    raw = text.encode()
    hits: dict[int, list[int]] = {}
    # A byte is a character here, so positions are those of the bytes; bytes.lower() maps A-Z only.
    for end, (k, width) in _automaton().iter(raw.lower().decode("latin-1")):
        hits.setdefault(k, []).append(end + 1 - width)
    runs, at = raw.translate(_HEX_CLASS), -1
    spans = []
    while (at := runs.find(b"h" * 16, at + 1)) >= 0:
        match = KINDS[2].pattern.match(raw, at)
        spans.append((at, 2, match.end()))
        at = match.end()
    for k, starts in hits.items():
        done = 0
        for start in sorted(starts):
            if start < done:
                continue
            match = KINDS[k].pattern.match(raw, start)
            if match is None:
                done = KINDS[k].fails.match(raw, start).end() if KINDS[k].fails else done
            else:
                done = match.end()  # a match that fails below has still been consumed
                if KINDS[k].valid(match):
                    spans.append((start, k, done))
    spans.sort()
    if spans and len(raw) != len(text):
        before = np.cumsum((np.frombuffer(raw + b" ", np.uint8) & 0xC0) != 0x80) - 1  # characters before each that starts
        spans = [(int(before[a]), k, int(before[b])) for a, k, b in spans]
    return spans


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k].name}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row; NULL and empty texts have no spans.

    Repeated rows each give their row. Other columns are ignored.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            rows = []
            for t in texts:
                spans = scan(t)
                base = [s for s in spans if s[1] < len(BASE_KINDS)]
                n = [sum(s[1] == k for s in base) for k in range(len(BASE_KINDS))]
                rows.append((*n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
            a, b, c, digest, spans = zip(*rows, strict=True)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_assign": pa.array(a, pa.int64()), "n_access": pa.array(b, pa.int64()), "n_hex": pa.array(c, pa.int64()), "base_sha256": pa.array(digest), "spans": pa.array(spans)})

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by ``mask``; without spans, the text itself."""
    out, at, end = [], 0, 0
    for a, _, b in scan(text):
        if a >= end:
            out += [text[at:a], mask]
        end = at = max(end, b)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with secrets in the text masked; a NULL text stays NULL."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, text_col):
            null = batch.column(at).is_null().to_pylist()
            new = pa.array([None if z else redact(t, mask) for z, t in zip(null, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return bounded(docs).mapInArrow(replace, schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all ``documents``."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
