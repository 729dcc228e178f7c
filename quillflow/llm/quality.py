"""Operator 6: quality classifier.

Random Fourier features approximate a Gaussian kernel over standardised
document statistics.  Every partition sums its part of the normal equations, the
parts are added in groups until few are left, and the ridge scores are mapped to
probabilities by isotonic regression over a fixed number of score bins.

Nothing of the text's language, source or id enters a score: the inputs are the
statistics of ``document_stats`` alone.

Defined cases: a null text counts as empty and gets a score; rows without a
label, or with a null label, teach nothing; with no usable label, or labels of
one class, every score is the share of label 1 (0.5 if there is none); empty
tables give empty results; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, text_batches, tidy

N_STATS = 22
#: Labelled rows that keep_good fits on, about: where there are more, those whose hash of doc_id is smallest.
FIT_ROWS = 50_000
_SENT = re.compile(rb"[.!?]+")


def compressed_size(text: bytes, block: int = 1 << 16) -> int:
    """Bytes of a whole text compressed as one stream, block by block."""
    z = zlib.compressobj(1)
    return sum(len(z.compress(text[i : i + block])) for i in range(0, len(text), block)) + len(z.flush())


def document_stats(text: bytes | None) -> np.ndarray:
    """N_STATS numbers about a whole text: length, character classes, word shapes, repetition and compressibility."""
    out = np.zeros(N_STATS)
    text = text or b""
    n = len(text)
    if not n:
        return out
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    k = max(1, len(words))
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    high, space = count[128:].sum(), count[[9, 10, 11, 12, 13, 32]].sum()
    stops = count[[33, 44, 46, 58, 59, 63]].sum()
    symbols = n - upper - lower - digit - high - space - stops
    p = count[count > 0] / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    same = sum(a == b for a, b in zip(words, words[1:])) / k
    expected = k**0.9  # distinct words grow more slowly than words
    out[:] = (
        np.log1p(n), np.log1p(len(words)), upper / n, lower / n, digit / n, high / n, symbols / n, stops / n, count[33] / n, space / n,
        -(p * np.log2(p)).sum(), lens.mean(), lens.std(), np.log1p(lens.max()), len(seen) / k, len(seen) / expected, max(seen.values(), default=0) / k,
        1 - pairs, same, 1 - len(set(lines)) / max(1, len(lines)), compressed_size(text) / n, np.log1p(len(_SENT.findall(text))) - np.log1p(len(words)),
    )
    return out


def stats_column(text: Column) -> Column:
    """document_stats of a text column, as an array of doubles."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        out = pd.Series([document_stats(x.encode("utf-8", "surrogatepass") if isinstance(x, str) else None).tolist() for x in texts])
        release_memory()
        return out

    return stats(text)


@dataclass
class QualityModel:
    """A fitted classifier; its size depends on the number of features and bins alone."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    constant: float | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weight, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1) if len(x) else np.zeros(0)


def isotonic(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators over bins: the non-decreasing means nearest to total / count."""
    blocks: list[list[float]] = []
    for t, c in zip(total, count):
        blocks.append([float(t), float(c), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), t / c) for t, c, k in blocks]) if blocks else np.zeros(0)


def _summed(parts: DataFrame, width: int, group: int = 32) -> np.ndarray:
    """Adds the partial sums (n bigint, blob binary) in groups, until one level leaves group of them at most."""

    def add(_, batches):
        total = np.zeros(width)
        for b in batches:
            for x in b.column("blob").to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "blob"])

    n = parts.count()
    while n > group:
        n = -(-n // group)
        parts = materialize(parts.repartition(n).mapInArrow(lambda b: add(None, b), parts.schema), "sums", few=True)
    return sum((np.frombuffer(r["blob"]) for r in parts.select("blob").collect()), np.zeros(width))


def fit(train: DataFrame, n_features: int = 192, ridge: float = 1e-3, bins: int = 512, seed: int = 5) -> QualityModel:
    """Fits on train (stats array<double>, y int, fold int): folds other than 0 fit the ridge weights, fold 0 calibrates.  All rows of train are used."""
    d = N_STATS
    moments = train.select("y", *[F.col("stats")[i].alias(f"s{i}") for i in range(d)]).agg(
        F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), *[F.avg(f"s{i}") for i in range(d)], *[F.stddev_pop(f"s{i}") for i in range(d)]
    ).first()
    n, ones = moments[0], moments[1]
    rng = np.random.default_rng(seed)
    freq, phase = rng.normal(size=(d, n_features)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, n_features)
    empty = np.zeros(0)
    if not n or ones in (0, n):
        return QualityModel(np.zeros(d), np.ones(d), freq, phase, empty, empty, empty, constant=float(ones / n) if n else 0.5)
    mean, scale = np.array(moments[2 : 2 + d], float), np.array(moments[2 + d :], float)
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), freq, phase, empty, empty, empty)
    width = 1 + d + n_features

    def equations(batches):
        a, b = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            fold, y = batch.column("fold").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
            keep = fold != 0
            if keep.any():
                z = model.features(np.stack(batch.column("stats").to_numpy(zero_copy_only=False))[keep])
                a += z.T @ z
                b += z.T @ y[keep]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([np.concatenate([a.ravel(), b]).tobytes()], pa.binary())], ["n", "blob"])

    parts = materialize(train.mapInArrow(tidy(equations), "n bigint, blob binary"), "equations", few=True)
    total = _summed(parts, width * width + width)
    a, b = total[: width * width].reshape(width, width), total[width * width :]
    reg = ridge * max(1.0, a[0, 0]) * np.eye(width)
    reg[0, 0] = 1e-9
    model.weight = np.linalg.solve(a + reg, b)

    def binned(batches):
        t, c = np.zeros(bins), np.zeros(bins)
        for batch in batches:
            fold, y = batch.column("fold").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
            keep = fold == 0
            if keep.any():
                raw = model.raw(np.stack(batch.column("stats").to_numpy(zero_copy_only=False))[keep])
                at = np.minimum(((raw + 1) / 3 * bins).astype(int), bins - 1)
                t += np.bincount(at, y[keep], bins)
                c += np.bincount(at, minlength=bins)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(t[at]), pa.array(c[at])], ["bin", "t", "c"])

    hist = train.mapInArrow(tidy(binned), "bin bigint, t double, c double").groupBy("bin").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    hist = sorted((r["bin"], r["t"], r["c"]) for r in hist)
    if not hist:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    at, t, c = (np.array(x, float) for x in zip(*hist))
    values = isotonic(t, c)
    # a small slope keeps the order of raw scores inside a flat block
    model.knots = np.concatenate([[-1.0], (at + 0.5) / bins * 3 - 1, [2.0]])
    level = np.concatenate([[values[0]], values, [values[-1]]])
    model.values = np.clip(level * 0.998 + 0.001 + 1e-4 * model.knots, 0, 1)
    return model


def score_column(model: QualityModel, stats: Column) -> Column:
    """The model's score of a column of statistics."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return score(stats)


def text_score_column(model: QualityModel, text: Column) -> Column:
    """The model's score of a column of whole texts."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = [document_stats(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else None) for t in texts]
        release_memory()
        return pd.Series(model.score(np.stack(x)) if x else np.zeros(0))

    return score(text)


def training_rows(stats: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """From (doc_id, stats) and labels (doc_id, quality): the rows to learn from, (stats, y, fold).  A label that occurs in several rows teaches once for each."""
    lab = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    rows = stats.where(learn).join(lab, F.col("doc_id") == F.col("_id"))
    return rows.select("stats", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(4))).cast("int").alias("fold"))


def classify(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs (doc_id, text); learn, a condition on doc_id, names the rows whose labels may be used."""
    text_batches(docs.sparkSession)
    stats = materialize(docs.select("doc_id", stats_column(F.col("text")).alias("stats")), "stats", scan=True)
    model = fit(training_rows(stats, labels, learn))
    scored = stats.select("doc_id", score_column(model, F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier predicts as 1.  It is fitted on a sample of about fit_rows labelled rows, or all of them where there are fewer; every row of docs is scored."""
    text_batches(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"))
    n = usable.count()
    sampled = F.lit(True) if n <= fit_rows else F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id").cast("bigint")), F.lit(1 << 32)) < F.lit(int(fit_rows / n * (1 << 32)))
    stats = materialize(docs.where(learn & sampled).select("doc_id", stats_column(F.col("text")).alias("stats")), "stats", scan=True)
    model = fit(training_rows(stats, labels, F.lit(True)))
    return docs.where(text_score_column(model, F.col("text")) >= 0.5)
