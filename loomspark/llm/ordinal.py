"""Cumulative-link ordinal regression over hashed text features.

P(grade >= k | x) = sigmoid(w.x - theta_k): one weight vector for all thresholds, thresholds kept in order by
positive steps.  The model is fitted on the driver over a bounded sample of graded rows and shipped as one small
array; scoring is a single pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from math import sqrt
from operator import eq, mul

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, doc_columns

#: Graded rows of each grade that a model is fitted on at most, in the order of a hash of their doc_id.
SAMPLE_PER_GRADE = 1500
BUCKETS = 1 << 18

_TOKENS = re.compile(r"[^\W\d_]+|[\d_]+|[^\w\s]+")
_WORDS = re.compile(r"[^\W\d_]+")
_ORDINARY = frozenset(".,;:?!'\"-()")
_STEPS = (0.0, 0.01, 0.03, 0.1, 0.3)


def hashed(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def style_tokens(text: str) -> tuple[Counter, float, list[int]]:
    """Counts of words and symbol runs, a divisor that makes squared values sum to 1, and signals of the whole text:
    stepped shares of repeated neighbours, odd symbol runs, upper-case words, digits and repeated lines."""
    tokens = _TOKENS.findall(text)
    counts, n, lines = Counter(tokens), max(1, len(tokens)), text.split("\n")
    odd = upper = digits = 0
    for t, c in counts.items():
        if t.isalpha():
            upper += c if len(t) > 1 and t.isupper() else 0
        elif t in _ORDINARY:
            continue
        elif t[0].isdigit():
            digits += c
        else:
            odd += c
    shares = (sum(map(eq, tokens, tokens[1:])) / n, odd / n, upper / n, digits / n, 1 - len(set(lines)) / len(lines))
    return counts, sqrt(n), [hashed(f"signal {i} {sum(x > step for step in _STEPS)}") for i, x in enumerate(shares)]


def style_features(token: str) -> list[int]:
    return [hashed(f"w {token.lower()}" if token[0].isalpha() else f"s {token[:8]}")]


def term_tokens(text: str) -> tuple[Counter, float, list[int]]:
    """Each different word of the text once."""
    return Counter(dict.fromkeys(_WORDS.findall(text.lower()), 1)), 1.0, []


def term_features(word: str) -> list[str]:
    """The word and its beginnings, which inflected forms share."""
    return [word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)]


@dataclass(frozen=True)
class TextFeatures:
    """``tokens``: counts, divisor and signals of a text; ``names``: features of a token, hashed or plain."""

    tokens: Callable
    names: Callable


STYLE = TextFeatures(style_tokens, style_features)
TERMS = TextFeatures(term_tokens, term_features)


@dataclass
class OrdinalModel:
    """Weights by feature, thresholds in ascending order, and the grades they separate."""

    grades: list[int]
    weights: dict[int | str, float]
    thresholds: np.ndarray
    features: TextFeatures
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def raw(self, texts: list[str]) -> np.ndarray:
        """w.x of each text."""
        cache, names, weights = self.cache, self.features.names, self.weights
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        out = np.zeros(len(texts))
        get = cache.__getitem__
        for i, text in enumerate(texts):
            counts, size, signals = self.features.tokens(text)
            for t in [t for t in counts if t not in cache]:
                cache[t] = sum(weights[f] for f in names(t) if f in weights)
            out[i] = sum(map(mul, map(get, counts), map(sqrt, counts.values()))) / size + sum(weights.get(f, 0.0) for f in signals)
        return out

    def tails(self, raw: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each grade but the lowest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - raw[:, None], -60, 60)))


def _rows(rows: list, features: TextFeatures) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Row, feature number and value of every feature of the sample's texts, and the features by number."""
    at, cols, values, numbers, own = [], [], [], {}, {}
    for i, row in enumerate(rows):
        counts, size, signals = features.tokens(row.text)
        for t, c in counts.items():
            if t not in own:
                own[t] = [numbers.setdefault(f, len(numbers)) for f in features.names(t)]
            v = sqrt(c) / size
            for b in own[t]:
                at.append(i)
                cols.append(b)
                values.append(v)
        for f in signals:
            at.append(i)
            cols.append(numbers.setdefault(f, len(numbers)))
            values.append(1.0)
    return np.array(at, np.int64), np.array(cols, np.int64), np.array(values), list(numbers)


def fit(rows: list, features: TextFeatures, least_docs: int = 10, least_z: float = 5.0, l2: float = 3e-3, rounds: int = 250) -> OrdinalModel | None:
    """Fit on sampled rows with ``text`` and ``grade``; None where fewer than two grades occur.

    Kept are the features of at least ``least_docs`` texts (fewer, but three, in a small sample) whose presence differs by
    ``least_z`` standard errors between the two sides of some threshold.
    """
    grades = sorted({int(r.grade) for r in rows})
    if len(grades) < 2:
        return None
    y = np.array([grades.index(int(r.grade)) for r in rows])
    at, cols, values, names = _rows(rows, features)
    total = max(1, len(names))
    docs = np.unique(at * total + cols)
    d_at, d_col = docs // total, docs % total
    df = np.bincount(d_col, minlength=total)
    keep = np.zeros(total, bool)
    for k in range(1, len(grades)):
        high = y >= k
        p = high.mean()
        z = (np.bincount(d_col, weights=high[d_at], minlength=total) - df * p) / np.sqrt(np.maximum(df * p * (1 - p), 1e-9))
        keep |= (np.abs(z) >= min(least_z, sqrt(len(y)) / 4)) & (df >= min(least_docs, max(3, len(y) // 100)))
    kept = np.flatnonzero(keep)
    where = np.full(total, -1)
    where[kept] = np.arange(len(kept))
    use = where[cols] >= 0
    at, cols, values = at[use], where[cols[use]], values[use]
    scale = np.sqrt(np.maximum(np.bincount(cols, weights=values**2, minlength=len(kept)) / len(y), 1e-6))
    values = values / scale[cols]
    n, m, k = len(y), len(kept), len(grades) - 1
    weight = np.ones(n)
    w, base, steps = np.zeros(m), 0.0, np.zeros(max(0, k - 1))
    params = np.concatenate([w, [base], steps])
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, base, steps = params[:m], params[m], params[m + 1 :]
        theta = base + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        raw = np.bincount(at, weights=values * w[cols], minlength=n)
        s = 1 / (1 + np.exp(np.clip(theta[None, :] - raw[:, None], -60, 60)))  # P(y >= k)
        upper = np.concatenate([np.ones((n, 1)), s], axis=1)
        lower = np.concatenate([s, np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        p = np.maximum(upper[i, y] - lower[i, y], 1e-9)
        du, dl = upper[i, y] * (1 - upper[i, y]), lower[i, y] * (1 - lower[i, y])
        g_raw = -weight * (du - dl) / p
        g_theta = np.zeros((n, k + 2))
        np.add.at(g_theta, (i, y), weight * du / p)
        np.add.at(g_theta, (i, y + 1), -weight * dl / p)
        g_theta = g_theta[:, 1 : k + 1].sum(0) / n
        grad = np.concatenate([np.bincount(cols, weights=values * g_raw[at], minlength=m) / n + l2 * w, [g_theta.sum()], [np.exp(steps[j]) * g_theta[j + 1 :].sum() for j in range(k - 1)]])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        params = params - 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    theta = params[m] + np.concatenate([[0.0], np.cumsum(np.exp(params[m + 1 :]))])
    return OrdinalModel(grades, {names[i]: x for i, x in zip(kept.tolist(), (params[:m] / scale).tolist())}, theta, features)


def sample(docs: DataFrame, grades: DataFrame, per_grade: int = SAMPLE_PER_GRADE) -> list:
    """At most about ``per_grade`` rows (text, grade) of each grade, chosen by a hash of doc_id, not by place or order.

    ``grades`` has doc_id and grade; null ids and grades take no part.  Only ids are counted and joined before the
    cut, so no text of an unchosen row moves.
    """
    own = grades.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    counts = {r.grade: r["count"] for r in own.groupBy("grade").count().collect()}
    share = F.lit(0.0)
    for grade, n in counts.items():
        share = F.when(F.col("grade") == grade, F.lit(min(1.0, per_grade / n))).otherwise(share)
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return doc_columns(docs).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").select("text", "grade").limit(2 * per_grade * max(1, len(counts))).collect()


def score(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """doc_id, expected (grade) and tails (P(grade >= k) by ascending k) of every whole text; no model: nulls."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # its size is bounded by the number of buckets

    def run(batches):
        own = shipped.value
        for b in batches:
            texts = b.column(1).to_pylist()
            if own is None:
                yield pa.record_batch([b.column(0), pa.nulls(len(texts), pa.float64()), pa.nulls(len(texts), pa.list_(pa.float64()))], names=["doc_id", "expected", "tails"])
                continue
            tails = own.tails(own.raw(texts)) if texts else np.zeros((0, len(own.thresholds)))
            expected = own.grades[0] + tails @ np.diff(np.array(own.grades, float))
            yield pa.record_batch([b.column(0), pa.array(expected), pa.array(list(tails), pa.list_(pa.float64()))], names=["doc_id", "expected", "tails"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, expected double, tails array<double>")
