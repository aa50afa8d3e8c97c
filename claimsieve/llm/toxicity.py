"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself, of its beginnings and of its end, so inflected forms share what they have
in common. Filters of several widths run over the words, the largest response of each is pooled, and a linear layer gives
the score. Since a filter is linear, its response to a word is looked up in a table made after training: scoring a text is
gathering, shifting and adding. The model is fitted on a bounded sample of labelled rows and its scores are calibrated; for
other uses than a single cut at 0.5 there are thresholds by language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from claimsieve.llm.common import bounded, portions

_WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """The fit takes at most ``max_rows`` labelled rows of each label, of texts of at most ``max_chars`` characters."""

    max_rows: int = 4000
    max_chars: int = 20_000
    buckets: int = 1 << 16
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 4
    rate: float = 0.08
    seed: int = 7


def word_features(word: str, buckets: int) -> tuple[int, int, int, int]:
    """Buckets of the word, its first four and five characters and its last four."""
    b = word.encode()
    return (
        zlib.crc32(b) % buckets,
        zlib.crc32(b"^4" + word[:4].encode()) % buckets,
        zlib.crc32(b"^5" + word[:5].encode()) % buckets,
        zlib.crc32(b"$4" + word[-4:].encode()) % buckets,
    )


class WordIndex:
    """Numbers the distinct words of some texts and keeps their features."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.number: dict[str, int] = {}

    def index(self, text: str) -> np.ndarray:
        number = self.number
        words = _WORDS.findall(text.lower())
        for w in words:
            if w not in number:
                number[w] = len(number)
        return np.fromiter(map(number.__getitem__, words), np.int32, len(words))

    def features(self) -> np.ndarray:
        return np.array([word_features(w, self.buckets) for w in self.number], np.int32).reshape(-1, 4)


@dataclass
class Model:
    """``table[b, f]``: part of filter response f that feature b gives; columns are filters by width and place in it."""

    widths: tuple[int, ...]
    filters: int
    table: np.ndarray
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, response: np.ndarray) -> np.ndarray:
        """Largest response of each filter, from the responses ``[words, columns]`` of a text."""
        out, col = [], 0
        n = len(response)
        for w in self.widths:
            parts = [response[k : n - w + 1 + k, col + k * self.filters : col + (k + 1) * self.filters] for k in range(w)]
            col += w * self.filters
            out.append(sum(parts[1:], parts[0]).max(axis=0) if n >= w else np.full(self.filters, -np.inf))
        return np.maximum(np.concatenate(out) + self.filter_bias, 0)

    def margin(self, response: np.ndarray) -> float:
        return float(self.pooled(response) @ self.weights + self.bias)

    def responses(self, features: np.ndarray) -> np.ndarray:
        """Responses of words by their features, a feature at a time: a gather of all four would take four times the memory."""
        out = self.table[features[:, 0]]
        for k in range(1, features.shape[1]):
            out += self.table[features[:, k]]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = []
        for a in range(0, len(texts), 64):  # few texts at a time, so that responses of their words stay small
            words = WordIndex(len(self.table))
            index = [words.index(t) for t in texts[a : a + 64]]
            response = self.responses(words.features())
            z += [self.margin(response[i]) for i in index]
        return 1 / (1 + np.exp(-np.clip(np.array(z) * self.scale + self.shift, -50, 50)))


#: Calibration rows of each label, below which all rows are used.
LEAST_HELD = 5


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, langs: list[str], s: Settings = Settings()) -> Model:
    """Fit on four fifths of the rows, calibrate on the others. ``weights``: rows of the corpus that a row stands for."""
    rng = np.random.default_rng(s.seed)
    words = WordIndex(s.buckets)
    index = [words.index(t) for t in texts]
    feats = words.features()
    del words
    columns = sum(s.widths) * s.filters
    emb = rng.normal(0, 0.05, (s.buckets, s.dim)).astype(np.float32)
    filt = rng.normal(0, 0.3, (s.dim, columns)).astype(np.float32)
    fbias = np.zeros(len(s.widths) * s.filters, np.float32)
    out = rng.normal(0.3, 0.1, len(fbias)).astype(np.float32)
    bias = 0.0
    # calibration rows: a fixed fifth
    hold = np.arange(len(texts)) % 5 == 0
    fit = np.flatnonzero(~hold)
    if len(texts) == 0 or len(set(labels[fit].tolist())) < 2:  # nothing to tell apart: the share of label 1
        p = float(np.average(labels, weights=weights)) if len(texts) else 0.5
        p = min(max(p, 1e-3), 1 - 1e-3)
        return Model(s.widths, s.filters, np.zeros((s.buckets, columns), np.float32), fbias, np.zeros(len(fbias), np.float32), float(np.log(p / (1 - p))))
    # The first dimension starts as the log odds of a feature between the labels, so that pooling picks telling words early.
    seen = np.ones((2, s.buckets))
    total = np.full(2, 2.0)
    for i in fit:
        seen[int(labels[i]), np.unique(feats[np.unique(index[i])])] += 1
        total[int(labels[i])] += 1
    odds = np.log(seen[1] / total[1]) - np.log(seen[0] / total[0])
    emb[:, 0] = np.clip(odds, -3, 3) * (seen.sum(axis=0) > 6) / 4
    filt[0] = np.abs(filt[0]) + 0.3
    g_emb, g_filt, g_out, g_fb = np.full(emb.shape, 1e-2, np.float32), np.full(filt.shape, 1e-2, np.float32), np.full(out.shape, 1e-2, np.float32), np.full(fbias.shape, 1e-2, np.float32)
    net = Model(s.widths, s.filters, emb, fbias, out, bias)
    starts = np.cumsum([0, *[w * s.filters for w in s.widths]])[:-1]
    for _ in range(s.epochs):
        for i in rng.permutation(fit):
            idx = index[i]
            n = len(idx)
            if n < max(s.widths):
                continue
            local, back = np.unique(idx, return_inverse=True)
            x = emb[feats[local]].sum(axis=1)[back]
            r = x @ filt
            pooled, where = [], []
            for w, c in zip(s.widths, starts):
                total_r = sum(r[k : n - w + 1 + k, c + k * s.filters : c + (k + 1) * s.filters] for k in range(w))
                at = total_r.argmax(axis=0)
                where.append(at)
                pooled.append(total_r[at, np.arange(s.filters)])
            pool = np.concatenate(pooled) + fbias
            act = np.maximum(pool, 0)
            z = float(act @ out + bias)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            if abs(err) < 0.02:
                continue
            d_act = err * out * (pool > 0)
            d_out = err * act
            g_out += d_out**2
            out -= s.rate * d_out / np.sqrt(g_out)
            g_fb += d_act**2
            fbias -= s.rate * d_act / np.sqrt(g_fb)
            bias -= 0.01 * err
            for j, (w, c) in enumerate(zip(s.widths, starts)):
                for q in range(s.filters):
                    d = d_act[j * s.filters + q]
                    if d == 0:
                        continue
                    for k in range(w):
                        pos = where[j][q] + k
                        f = feats[idx[pos]]
                        col = c + k * s.filters + q
                        ge = d * filt[:, col]
                        gf = d * x[pos]
                        g_emb[f] += ge**2
                        emb[f] -= s.rate * ge / np.sqrt(g_emb[f])
                        g_filt[:, col] += gf**2
                        filt[:, col] -= s.rate * gf / np.sqrt(g_filt[:, col])
    net = Model(s.widths, s.filters, (emb @ filt).astype(np.float32), fbias, out, float(bias))
    held = np.flatnonzero(hold)
    if np.bincount(labels[held].astype(int), minlength=2).min() < LEAST_HELD:  # too few to calibrate by: all rows tell more
        held = np.arange(len(texts))
    z = np.array([net.margin(net.responses(feats[index[i]])) for i in held])
    y, w = labels[held].astype(float), weights[held]
    net.scale, net.shift = _platt(z, y, w)
    p = 1 / (1 + np.exp(-np.clip(z * net.scale + net.shift, -50, 50)))
    for lang in sorted(set(langs)):
        on = np.array([langs[i] == lang for i in held], bool)
        net.thresholds[lang] = _best_threshold(p[on], y[on], w[on])
    # The single cut at 0.5 is where F1 is best over all languages.
    t = min(max(_best_threshold(p, y, w), 1e-6), 1 - 1e-6)
    move = float(np.log(t / (1 - t)))
    net.shift -= move
    net.thresholds = {k: float(1 / (1 + np.exp(-(np.log(v / (1 - v)) - move)))) for k, v in net.thresholds.items()}
    return net


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of labels on margins, by Newton steps with a small penalty."""
    if len(z) == 0 or len(set(y.tolist())) < 2:
        return 1.0, 0.0
    a, b = 1.0, 0.0
    w = w / w.sum() * len(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * w * z).sum() + 0.1 * (a - 1), ((p - y) * w).sum()])
        v = p * (1 - p) * w
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), b


def _best_threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Cut with the best weighted F1, in the middle between two scores; 0.5 if one label is missing."""
    if len(p) == 0 or y.sum() == 0 or y.sum() == len(y):
        return 0.5
    by = np.argsort(-p, kind="stable")
    tp, n = np.cumsum((y * w)[by]), np.cumsum(w[by])
    f1 = 2 * tp / (n + (y * w).sum())
    f1[:-1][p[by][:-1] == p[by][1:]] = -1
    k = int(np.argmax(f1))
    low = p[by][k + 1] if k + 1 < len(by) else 0.0
    return float(np.clip((p[by][k] + low) / 2, 1e-6, 1 - 1e-6))


def held_out(id_col: Column) -> Column:
    """Rows that are kept from the fit: CRC-32 of the id as text divides by 5 (a NULL id is not held out)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on labelled rows that are not held out; the sample takes ids by a hash, about ``max_rows`` of each label.

    Several labels of an id, and several rows of ``docs`` with it, are examples of their own. Without a column ``lang`` all texts
    are of one language. Longer texts than ``max_chars`` are left out of the fit, never of the scoring.
    """
    lab = labels.select(F.col("doc_id").alias("id"), (F.col("toxic") != 0).cast("int").alias("label")).where("label is not null and id is not null").where(~held_out(F.col("id")))
    sizes = {int(r["label"]): r["n"] for r in lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = F.lit(0)
    for label, n in sizes.items():
        cut = F.when(F.col("label") == label, int((1 << 30) * min(1.0, settings.max_rows / n))).otherwise(cut)
    # At most so many ids, whatever the number of labels: small enough to broadcast, so texts are not moved.
    chosen = lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < cut).limit(4 * settings.max_rows)
    rows = docs.select(F.col("doc_id").alias("id"), "text", (F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")).alias("lang")).where(F.col("text").isNotNull() & (F.length("text") <= settings.max_chars))
    got = rows.join(F.broadcast(chosen), "id").select("id", "text", "lang", "label").limit(8 * settings.max_rows).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["label"], r["text"]))
    share = {label: n / max(1, sum(r["label"] == label for r in got)) for label, n in sizes.items()}
    y = np.array([r["label"] for r in got], np.float64)
    return train([r["text"] for r in got], y, np.array([share[r["label"]] for r in got], np.float64), [r["lang"] for r in got], settings)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """All rows and columns and ``out_col double``, a function of the whole text alone (NULL: empty).

    A column that has the name of ``out_col`` already is replaced.
    """
    docs = bounded(docs).drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the settings
    schema = StructType([*docs.schema.fields, StructField(out_col, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts))], names=schema.names)

    return docs.mapInArrow(score, schema)


def by_language(scored: DataFrame, model: Model, lang_col: str = "lang") -> DataFrame:
    """Add ``toxic_in_language``: the score reaches the threshold of the row's language (0.5 for one without labels)."""
    cut = F.lit(0.5)
    for lang, t in sorted(model.thresholds.items()):
        cut = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(cut)
    return scored.withColumn("toxic_in_language", (F.col("toxicity") >= cut).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all ``documents`` after a fit on ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = by_language(score_documents(docs, model), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_in_language")
