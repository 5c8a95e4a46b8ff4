"""Quality classifier: Bradley-Terry pairwise ranking on text features.

Every text becomes a short vector of ratios (one pass over the texts, stored). Preference pairs are
(a row labelled 1, a row labelled 0); weights minimise the logistic loss of the feature differences
plus a small ridge, by Newton steps on a bounded, hash-chosen sample of labelled training rows
(``max_train`` feature vectors reach the driver; the bound is a parameter). The threshold is the
quantile of the ranking scores of all usable labelled rows at their share of label 0, and a score is
``sigmoid(rank - threshold + logit(CUT))``: at least ``CUT`` exactly when the rank reaches the threshold.
Scoring is one projection over the stored vectors.

Cases: null text counts as empty; empty texts get a vector and a score like any other; a key with
several labels counts as 1 if any is 1; labels other than 0/1 and labels without a document are
ignored; without both labels in the sample there is nothing to learn and every score is 0.5 (kept);
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import stored, text_slices

CUT = 0.3
MAX_TRAIN = 20_000
PAIRS_PER_ROW = 8
RIDGE = 1e-3
FEATURES = ("upper_words", "exclamations", "symbols", "bars", "digits", "word_length", "stops", "commas",
            "word_repeats", "variety", "line_repeats", "long_lines")
SYMBOLS = "#*$%&<>"                     # fixed value: marks counted as symbols


def features(text: str) -> list[float]:
    """The feature vector of one text; every entry is a bounded ratio."""
    w = text.split()
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(w))
    per_word = [sum(map(str.isupper, w)), text.count("!"), sum(map(text.count, SYMBOLS)), text.count("|"),
                sum(map(text.count, "0123456789")), None, text.count("."), text.count(",")]
    out = [min(4.0, math.sqrt(x / n)) if x is not None else min(40.0, (len(text) - n + 1) / n) / 10 for x in per_word]
    out.append(math.sqrt(sum(map(eq, w, w[1:])) / n))
    out.append(math.log(distinct) / math.log(n) if n > 1 else 1.0)
    out.append(1 - len(set(lines)) / len(lines))
    out.append(min(1.0, n / len(lines) / 1000))
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, 8 << 20):
        rows = [features(t or "") for t in b.column("text").to_pylist()]
        flat = pa.array(np.asarray(rows, dtype=np.float64).ravel())
        sizes = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)),
                                          pa.ListArray.from_arrays(sizes, flat)], names=[*b.schema.names[:-1], "x"])


def vectors(docs: DataFrame, key: str, text_col: str, carry: dict | None = None) -> DataFrame:
    """(key, carried columns {name: Column}, x) of every row, stored."""
    src = docs.select(F.col(key).alias("key"), *[c.alias(n) for n, c in (carry or {}).items()],
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return stored(src.mapInArrow(_vectors, f"{kinds}, x array<double>"), "quality")


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5, pairs_per_row: int = PAIRS_PER_ROW,
        ridge: float = RIDGE, steps: int = 25) -> tuple[np.ndarray, float]:
    """(weights, threshold) from vectors and 0/1 labels, in the given order of rows."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES)), 0.0
    rng = np.random.default_rng(seed)
    n = pairs_per_row * max(len(good), len(bad))
    scale = np.maximum(x.std(axis=0), 1e-6)
    d = (good[rng.integers(0, len(good), n)] - bad[rng.integers(0, len(bad), n)]) / scale
    w = np.zeros(d.shape[1])
    for _ in range(steps):                                   # Newton on mean(log(1 + exp(-d.w))) + ridge/2 |w|^2
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(axis=0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w /= scale
    rank = np.sort(x @ w)
    at = min(len(rank) - 1, max(1, int((y == 0).sum())))
    return w, float((rank[at - 1] + rank[at]) / 2)           # the quantile, half-way to the next rank


def _rank(w: np.ndarray) -> Column:
    return sum((F.get("x", F.lit(i)) * F.lit(float(c)) for i, c in enumerate(w)), F.lit(0.0))


def cut_point(ranked: DataFrame, buckets: int = 4096) -> float:
    """The quantile of ``rank`` at the share of ``y`` = 0, half-way to the next rank, over all rows: counts per bucket
    of the range that holds both ranks, until they lie in two buckets or are equal."""
    n, bad, lo, hi = ranked.agg(F.count("*"), F.count_if(F.col("y") == 0), F.min("rank"), F.max("rank")).first()
    at, below = min(n - 1, max(1, bad)), 0
    while lo < hi:
        bucket = F.least(F.floor((F.col("rank") - lo) / (hi - lo) * buckets), F.lit(buckets - 1))
        rows = ranked.filter(F.col("rank").between(lo, hi)).groupBy(bucket.alias("b")) \
            .agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).orderBy("b").collect()
        ends = below + np.cumsum([r["n"] for r in rows])
        i, j = (int(np.searchsorted(ends, k, side="right")) for k in (at - 1, at))
        if i != j:
            return (rows[i]["hi"] + rows[j]["lo"]) / 2
        below, lo, hi = int(ends[i]) - rows[i]["n"], rows[i]["lo"], rows[i]["hi"]
    return lo


def train(vecs: DataFrame, labels: DataFrame, key: str, label: str, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Weights from at most ``max_train`` labelled rows, those with the smallest key hashes; the threshold from all."""
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("y"))
    usable = vecs.join(known, "key")
    sample = usable.orderBy(F.xxhash64("key", F.lit(5)), "key", "x").limit(max_train).select("x", "y").collect()
    x = np.array([r["x"] for r in sample], dtype=np.float64).reshape(len(sample), len(FEATURES))
    w, threshold = fit(x, np.array([r["y"] for r in sample], dtype=np.int64))
    if len(sample) == max_train and np.any(w):                # there may be more rows than these
        threshold = cut_point(stored(usable.select(_rank(w).alias("rank"), "y"), "ranks"))
    return w, threshold


def scored(vecs: DataFrame, model: tuple[np.ndarray, float], cut: float = CUT) -> DataFrame:
    """``vecs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= cut)."""
    w, threshold = model
    if not np.any(w):
        score = F.lit(0.5)
    else:
        score = 1 / (1 + F.exp(-(_rank(w) - F.lit(threshold)) - F.lit(math.log(cut / (1 - cut)))))
    return vecs.withColumn("score", F.coalesce(score, F.lit(0.5))) \
        .withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text",
             label: str = "quality", train_filter=None, cut: float = CUT, carry: dict | None = None) -> DataFrame:
    """(key, carried columns, score, predicted) of every row of ``docs``; ``train_filter`` (a condition on the label
    rows) limits learning."""
    vecs = vectors(docs, key, text_col, carry)
    usable = labels.filter(train_filter) if train_filter is not None else labels
    return scored(vecs, train(vecs, usable, key, label), cut).select(F.col("key").alias(key), *(carry or ()), "score", "predicted")
