"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every document becomes a short vector of statistics of its text, transformed towards normality (logarithms and square
roots) and never of its labels, language or source. Class means and covariances come from sums that Spark adds up over
all training rows; each covariance is shrunk towards the pooled one and towards a multiple of the identity. The score is
the logistic of the difference of Mahalanobis log densities, by Cholesky factors computed once.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, training
from .shared import others, slices, written

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "mark", "symbol", "sentence", "distinct",
    "adjacent", "top_word", "repeated_lines", "line_words", "packed", "long_word", "short_word", "capital_words",
)
FIT_ROWS = 100_000  # labelled rows, by a hash of doc_id, that the model is fitted on
SHRINK, RIDGE = 0.15, 0.05  # towards the pooled covariance; towards its diagonal
GAP = 200.0  # log odds beyond which all are alike

_CLASS = np.zeros((4, 256), bool)
_CLASS[0, 0x41:0x5B] = True  # capitals
_CLASS[1, 0x30:0x3A] = True  # digits
_CLASS[2, list(b".,;:!?'\"-()")] = True  # marks of prose
_CLASS[3, list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True  # other symbols


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of one whole text, all finite."""
    raw = np.frombuffer(text, np.uint8)
    n, found = max(1, len(raw)), text.split()
    words = max(1, len(found))
    size = np.fromiter(map(len, found), np.float64, len(found)) if found else np.zeros(1)
    count = np.bincount(raw, minlength=256)
    share = [float(count[c].sum()) / n for c in _CLASS]
    tally = Counter(found)
    lines = text.split(b"\n")
    sentence = float(count[list(b".!?")].sum()) / words
    same = sum(a == b for a, b in zip(found, found[1:])) / words
    packed = len(zlib.compress(text, 1)) / n if text else 1.0
    return [
        np.log1p(len(raw)), np.log1p(len(found)), np.log1p(size.mean()), np.log1p(size.std()),
        np.sqrt(share[0]), np.sqrt(share[1]), np.sqrt(share[2]), np.sqrt(share[3]), np.sqrt(sentence),
        len(tally) / words, np.sqrt(same), np.sqrt(max(tally.values(), default=0) / words),
        np.sqrt(1 - len(set(lines)) / len(lines)), np.log1p(words / len(lines)), min(packed, 2.0),
        np.sqrt(float((size > 20).mean())), np.sqrt(float((size <= 2).mean())), np.sqrt(sum(w[:1].isupper() for w in found) / words),
    ]


def _measure(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            x = np.array([statistics(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, "doc_id long, x array<double>")


class Discriminant:
    """Fitted classes: prior, mean, Cholesky factor of the regularised covariance."""

    def __init__(self, n: dict[int, int], mean: dict[int, np.ndarray], cov: dict[int, np.ndarray]) -> None:
        self.n, self.mean, total = n, mean, sum(n.values())
        self.prior = {c: (n[c] + 1) / (total + 2) for c in n}
        self.factor, self.log_det, self.slope, self.shift = {}, {}, 1.0, 0.0
        if len(n) == 2 and min(n.values()) > 1:
            pooled = sum(n[c] * cov[c] for c in n) / total
            for c in n:
                weight = max(SHRINK, min(1.0, 2 * len(pooled) / n[c]))  # small classes lean on the pooled covariance
                s = (1 - weight) * cov[c] + weight * pooled
                scale = np.maximum(np.diag(s), 1e-6)  # statistics have scales of their own
                s = (1 - RIDGE) * s + RIDGE * np.diag(scale + 1e-4)
                self.factor[c] = np.linalg.inv(np.linalg.cholesky(s))
                self.log_det[c] = -2 * np.log(np.diag(self.factor[c])).sum()

    def log_density(self, x: np.ndarray, c: int) -> np.ndarray:
        z = (x - self.mean[c]) @ self.factor[c].T
        return -0.5 * ((z**2).sum(1) + self.log_det[c])

    def gap(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1, cut to +-GAP; 0 where a class has too few rows to fit."""
        if not self.factor:
            return np.zeros(len(x))
        gap = self.log_density(x, 1) - self.log_density(x, 0) + np.log(self.prior[1] / self.prior[0])
        return np.clip(gap, -GAP, GAP)

    def calibrate(self, counts: list[tuple[int, int, int]]) -> None:
        """Fits slope and shift of the log odds to a histogram (gap, y, n) of the training rows, by Newton steps."""
        if not self.factor or not counts:
            return
        g, y, n = (np.array(c, np.float64) for c in zip(*counts, strict=True))
        a = np.stack([g / 10, np.ones(len(g))], 1)
        w, prior = np.array([10.0, 0.0]), np.array([10.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            grad = a.T @ (n * (p - y)) + 0.1 * (w - prior)
            hess = (a * (n * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            w = w - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        self.slope, self.shift = max(w[0], 0.1) / 10, w[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; the share of class 1 where a class has too few rows to fit."""
        if not self.factor:
            return np.full(len(x), self.n.get(1, 0) / sum(self.n.values()) if self.n else 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.gap(x) + self.shift, -500, 500)))


def fit(features: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """From features (doc_id, x) of FIT_ROWS labelled rows at most, none held out; only sums and a histogram reach the driver."""
    rows = features.join(F.broadcast(training(labels, label, FIT_ROWS)), "doc_id")  # FIT_ROWS pairs of numbers
    k = len(STATISTICS)
    x = [F.col("x")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.groupBy("y").agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("ss")).collect()
    n, mean, cov = {}, {}, {}
    for r in got:
        n[r.y], mean[r.y] = r.n, np.array(r.s) / r.n
        second = np.zeros((k, k))
        for (i, j), v in zip(pairs, r.ss, strict=True):
            second[i, j] = second[j, i] = v / r.n
        cov[r.y] = second - np.outer(mean[r.y], mean[r.y])
    model = Discriminant(n, mean, cov)
    model.calibrate([(r.gap, r.y, r.n) for r in rows.select("x", "y").mapInArrow(_gaps(model), "gap double, y int").groupBy("gap", "y").agg(F.count("*").alias("n")).collect()])
    return model


def _gaps(model: Discriminant):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(model.gap(x))), batch.column("y")], ["gap", "y"])

    return run


def _score(model: Discriminant):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) of every row of docs (doc_id, text).

    labels: doc_id and label (0 or 1); nulls are left out, repeated labels count once. Null texts count as empty and are
    scored too; rows with a null doc_id are scored and never learned from; repeated rows are scored alike. Fitted on
    FIT_ROWS labelled rows at most. If a class has fewer than two rows, every score is class 1's share of the training rows (0.5 without any).
    """
    features = written(measured(docs), "statistics")
    out = features.mapInArrow(_score(fit(features, labels, label)), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(model: Discriminant, threshold: float):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([statistics(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, len(STATISTICS))
                yield part.filter(pa.array(model.score(x) >= threshold))

    return run


def keep(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of docs (all columns) with a score of at least threshold: fitted on labelled rows only, then one scan."""
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), others(docs, "doc_id", "text"))
    # labelled texts are measured where they are: FIT_ROWS numbers are broadcast, and no text is shuffled
    known = table.select("doc_id", "text").join(F.broadcast(training(labels, label, FIT_ROWS).select("doc_id")), "doc_id", "left_semi")
    model = fit(written(measured(known), "statistics"), labels, label)
    kept = table.mapInArrow(_keep(model, threshold), table.schema)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return kept.select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in rest]).select(*docs.columns)
