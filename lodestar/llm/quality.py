"""Quality scores from preference pairs (Bradley-Terry), cut at a score quantile.

A document is described by shares and rates read off its bytes.  Pairs of a good and
a bad labelled document are preferences; weights are learned by logistic loss on the
differences of their features.  The cut is the quantile of the labelled documents'
scores that separates the labels best, and scores are shifted so that it lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .scratch import small_batches

PUNCTUATION = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
CLASSES = {
    "upper": list(range(0x41, 0x5B)),
    "lower": list(range(0x61, 0x7B)),
    "digit": list(range(0x30, 0x3A)),
    "beyond": list(range(0x80, 0x100)),
    "line": [0x0A],
}
#: Bytes of each kind, by class; then each punctuation mark by itself.
KINDS = [*CLASSES.values(), *[[c] for c in PUNCTUATION]]
NAMES = [
    *[f"share_{k}" for k in CLASSES], *[f"mark_{chr(c)}" for c in PUNCTUATION], "words", "word_bytes", "word_bytes_spread", "fresh_words", "fresh_pairs", "top_word",
    "marks_in_row", "upper_words", "lines", "fresh_lines", "line_words", "marked_words",
]


def features(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text, whole; null and empty texts are all 0."""
    out = np.zeros((len(column), len(NAMES)))
    kind = np.zeros(256, np.int64)
    for k, codes in enumerate(KINDS):
        kind[codes] = k + 1
    mark = np.zeros(256, bool)
    mark[PUNCTUATION] = True
    for i, j, data, off in B.chunks(column):
        size = np.diff(off)
        text = B.owner(size)
        counts = np.bincount(text * (len(KINDS) + 1) + kind[data], minlength=(j - i) * (len(KINDS) + 1)).reshape(j - i, -1)[:, 1:]
        n = np.maximum(size, 1)[:, None]
        rows = out[i:j]
        rows[:, : len(KINDS)] = np.sqrt(counts / n)
        start, end, first = B.words(data, off)
        words = np.diff(first)
        own, w = B.owner(words), np.maximum(words, 1)
        length = (end - start).astype(float)
        mean = np.bincount(own, length, j - i) / w
        spread = np.sqrt(np.maximum(np.bincount(own, length**2, j - i) / w - mean**2, 0))
        h = B.word_hashes(data, start, end)
        pairs = B.mixed(h[:-1] * B.U(31) + h[1:]) if len(h) > 1 else h[:0]
        inside = own[:-1] == own[1:]
        rests = [_distinct(h, own, j - i), _distinct(pairs[inside], own[:-1][inside], j - i)]
        m = mark[data]
        twice = m[:-1] & m[1:] & (text[:-1] == text[1:]) if len(data) else m
        in_row = np.bincount(text[:-1][twice], minlength=j - i) if len(data) else np.zeros(j - i)
        up = np.concatenate([[0], np.cumsum((data >= 0x41) & (data < 0x5B))])
        ups = np.bincount(own, (up[end] - up[start]) >= np.maximum(2, 0.6 * length), j - i)
        marked = np.bincount(own, m[end - 1] & m[np.maximum(end - 2, 0)] if len(end) else None, j - i) if len(end) else np.zeros(j - i)
        breaks = np.flatnonzero(data == 0x0A)
        a = np.unique(np.concatenate([off[:-1], breaks + 1]))
        a = a[a < len(data)]
        line_text = np.searchsorted(off, a, "right") - 1
        b = np.minimum(np.append(a[1:], len(data)), off[line_text + 1])
        line_n = np.bincount(line_text, minlength=j - i)
        line_h = B.mixed(B.span(B.prefix(B.BYTE_CODE[data]), a, b)) if len(data) else np.zeros(0, np.uint64)
        fresh = _distinct(line_h, line_text, j - i)[0]
        rows[:, len(KINDS) :] = np.stack(
            [np.log1p(words) / 10, np.log1p(mean), np.log1p(spread), rests[0][0], rests[1][0], rests[0][1], in_row / n[:, 0], ups / w, np.log1p(line_n) / 10, fresh, np.log1p(words / np.maximum(line_n, 1)) / 5, marked / w], 1
        )
        rows[size == 0] = 0
    return out


def _distinct(h: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(share of distinct items, share of the commonest) for each of n texts."""
    order = np.lexsort((h, own))
    same = B.same_key(h[order]) & B.same_key(own[order])
    total = np.maximum(np.bincount(own, minlength=n), 1)
    at = np.flatnonzero(~same)
    top = np.zeros(n)
    np.maximum.at(top, own[order][at], np.diff(np.append(at, len(h))))
    return np.bincount(own[order][at], minlength=n) / total, top / total


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.strength(x) - self.cut, -60, 60)))


def learn(x: np.ndarray, y: np.ndarray, *, pairs: int = 200_000, steps: int = 400, ridge: float = 1e-4, seed: int = 0) -> QualityModel:
    """Fits Bradley-Terry strengths to preferences of good (1) over bad (0) rows.

    With one label only, every score lies on that label's side.
    """
    mean, scale = (x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(mean, scale, np.zeros(len(NAMES)), -1.0 if len(good) or not len(bad) else 1.0)
    z = (x - mean) / scale
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    w, m, v = np.zeros(z.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        at = rng.integers(0, pairs, 8192)
        d = z[a[at]] - z[b[at]]
        g = -(d * (1.0 / (1.0 + np.exp(np.clip(d @ w, -60, 60))))[:, None]).mean(0) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    s = z @ w
    # the quantile of scores below which rows are called bad: the one with the fewest errors
    order = np.argsort(s, kind="stable")
    label = y[order]
    wrong = np.concatenate([[0], np.cumsum(label == 1)]) + np.concatenate([np.cumsum((label == 0)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    edges = np.concatenate([[s[order[0]] - 1], s[order], [s[order[-1]] + 1]])
    return QualityModel(mean, scale, w, float((edges[k] + edges[k + 1]) / 2))


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, *, id_: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 20_000, **settings) -> QualityModel:
    """Learns from labelled documents; about ``sample`` of them, chosen by a hash of the id, reach the driver.

    Labels other than 0 and 1, null ids and null texts teach nothing.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_).alias("i"), F.col(label).cast("int").alias("y")).filter("i IS NOT NULL AND y IN (0, 1)")
    if where is not None:
        known = known.filter(where)
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.greatest(F.lit(1), F.lit(known.count())))
    known = known.filter(F.pmod(F.xxhash64("i", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)).distinct()
    # about ``sample`` small rows: bounded, so broadcast
    rows = docs.select(F.col(id_).alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL").join(F.broadcast(known), "i").select("i", "y", "t")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "y", "x"])

    got = rows.mapInArrow(B.streamed(describe), "i string, y int, x array<double>").toPandas().sort_values(["i", "y"], kind="stable")
    x = np.array(got["x"].tolist()).reshape(len(got), len(NAMES))
    return learn(x, got["y"].to_numpy(), **settings)


def score(docs: DataFrame, model: QualityModel, *, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each document: the text alone decides.

    Scores run from 0 to 1; predicted is 1 from 0.5.  Null texts score as empty ones.
    """
    small_batches(docs.sparkSession)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(B.streamed(rate), "doc_id long, score double, predicted int")
