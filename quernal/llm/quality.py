"""A quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Statistics of a text (FEATURES: logs of sizes, arcsine roots of shares) follow one normal distribution per class. A class
covariance is its own, shrunk by POOL towards the pooled one and by RIDGE towards a multiple of the identity. A text's score is the logistic function of
the difference of the two log densities (Mahalanobis terms by cached Cholesky factors, and log determinants) and of the
log prior odds, divided by TEMPERATURE.

Counts, sums and products of the labelled rows are gathered by class in one distributed aggregation over all of them. Rows whose
crc32 of the id as text is divisible by HELD_OUT give no label, nor do null labels; of a document's several labels the
majority counts. Labels, languages, sources and ids are never inputs. Null and empty texts have statistics too (zeros) and are
scored. With labelled rows of one class only, or too few, the score is the share of label 1, and 1 without any labels: nothing is
rejected. An empty table gives no rows; rows that repeat are scored alike, and so are very long texts, whole. A score equal to the threshold is
good. Columns are found by position, so names that clash do no harm. Building a result runs the training.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernal.llm.common import materialize, packed, release

HELD_OUT = 5
THRESHOLD = 0.3
POOL, RIDGE, TEMPERATURE = 0.1, 0.01, 2.0
#: Labelled rows that each class needs, at least.
LEAST_ROWS = 5

FEATURES = ("log_words", "log_distinct", "log_word_length", "upper", "digit", "symbol", "stop", "high", "newline", "top_word", "same_next", "same_line", "entropy")


def _root(part: float, of: float, more: float) -> float:
    """The arcsine root of a share; `more` keeps shares of short texts, which say little, near 0."""
    return math.asin(math.sqrt(min(1.0, part / (of + more))))


def statistics(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "surrogatepass")
    if not b:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    n = len(b)
    upper, lower, digit, high = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum()), int(c[128:].sum())
    space, stop = int(c[9:14].sum() + c[32]), int(c[44] + c[46])
    symbol = n - upper - lower - digit - high - space - stop
    words = b.split()
    counts = Counter(words)
    lines = b.split(b"\n")
    p = c[c > 0] / n
    w = len(words)
    return [
        math.log1p(w), math.log1p(len(counts)), math.log1p((n - space) / max(1, w)), _root(upper, upper + lower, 40), _root(digit, n, 200), _root(symbol, n, 100), _root(stop, n, 40), _root(high, n, 40), _root(int(c[10]), n, 40),
        _root(max(counts.values(), default=0), w, 20), _root(sum(map(eq, words, words[1:])), w, 20), _root(len(lines) - len(set(lines)), len(lines), 5), float(-(p * np.log(p)).sum()),
    ]


class Model(NamedTuple):
    """inverses: of the classes' Cholesky factors, transposed; offset: what does not depend on the text."""

    means: tuple[np.ndarray, np.ndarray]
    inverses: tuple[np.ndarray, np.ndarray]
    offset: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        far = [(((x - m) @ inv) ** 2).sum(axis=1) for m, inv in zip(self.means, self.inverses, strict=True)]
        z = (self.offset + (far[0] - far[1]) / 2) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fitted(n: list[float], sums: np.ndarray, products: np.ndarray) -> Model:
    """From counts (2), sums (2, d) and sums of products (2, d, d) of the classes 0 and 1."""
    d = sums.shape[1]
    if min(n) < LEAST_ROWS:
        return Model((np.zeros(d),) * 2, (np.eye(d),) * 2, 0.0, n[1] / sum(n) if sum(n) else 1.0)
    means = [sums[k] / n[k] for k in (0, 1)]
    own = [products[k] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    inverses, log_det = [], []
    for k in (0, 1):
        cov = (1 - POOL) * own[k] + POOL * pooled
        cov = (1 - RIDGE) * cov + RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-4))
        factor = np.linalg.cholesky(cov)
        inverses.append(np.linalg.inv(factor).T)
        log_det.append(2 * np.log(np.diag(factor)).sum())
    offset = (log_det[0] - log_det[1]) / 2 + math.log(n[1] / n[0])
    return Model(tuple(means), tuple(inverses), offset)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _statistics_of(text: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in text], dtype=object)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """stats: (id, x) of all documents."""
    marks = packed(labels, id="doc_id", y=label).select("id", F.col("y").cast("double").alias("y")).where("y is not null and id is not null").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = stats.where(~held_out(F.col("id"))).join(marks, "id")
    d = len(FEATURES)
    x = [F.col("x")[i].cast("double") for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(v) for v in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("p"))
    n, s, p = [0.0, 0.0], np.zeros((2, d)), np.zeros((2, d, d))
    for row in sums.collect():  # two rows at most
        n[row.y], s[row.y] = float(row.n), row.s
        for (i, j), v in zip(pairs, row.p, strict=True):
            p[row.y, i, j] = p[row.y, j, i] = v
    return fitted(n, s, p)


def _scorer(model: Model):
    """A UDF from statistics to scores."""

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy()).astype("float64")) if len(x) else [], dtype="float64")

    return score


def _text_scorer(model: Model):
    """A UDF from texts to scores: one worker for a task, where statistics and scores apart would take two."""

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in text], np.float32).reshape(-1, len(FEATURES))  # rounded as measured() rounds
        return pd.Series(model.scores(x.astype("float64")), dtype="float64")

    return score


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x), written: the texts are read once."""
    rows = packed(df, id=id_col, text=text_col)
    return materialize(rows.select("id", _statistics_of(F.coalesce("text", F.lit(""))).alias("x")), "statistics")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, held_out, score, predicted."""
    stats = measured(df, id_col, text_col)
    out = stats.select("id", held_out(F.col("id")).alias("held_out"), _scorer(train(stats, labels))(F.col("x")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows that are not rejected, decided where they are: no row with its text is moved."""
    stats = measured(df, id_col, text_col)
    score = _text_scorer(train(stats, labels))
    release(stats)
    return packed(df, text=text_col).where(score(F.coalesce("text", F.lit(""))) >= THRESHOLD).select("row.*")
