"""A quality classifier by regularised quadratic discriminants over statistics of whole documents."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, lasting, map_whole, vector_sums

_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOP = np.frombuffer(b".!?", np.uint8)
_INNER = np.frombuffer(b",;:'\"()-", np.uint8)
_LETTERED = re.compile(rb"[^ \t-\r]*[A-Za-z\x80-\xff][^ \t-\r]*")

STATISTICS = (
    "words", "characters a word", "spread of word lengths", "longest word", "capitals", "digits", "symbols", "full stops",
    "inner marks", "exclamations", "bars", "letters beyond ASCII", "distinct words", "lines", "words a line", "repeated lines",
    "words without a letter", "words all in capitals", "short words",
)


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text: logs of sizes, arc-sine roots of shares. Finite for any text."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, chars = len(words), max(1, int(len(raw) - count[9:14].sum() - count[32]))
    sizes = np.fromiter(map(len, words), np.int64, n)
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    bare = n - len(_LETTERED.findall(raw))
    shout = sum(map(bytes.isupper, words))
    share = lambda part, whole: math.asin(math.sqrt(min(1.0, max(0.0, part / whole)))) if whole else 0.0
    return np.array([
        math.log1p(n), math.log1p(sizes.mean() if n else 0), math.log1p(sizes.std() if n else 0), math.log1p(sizes.max() if n else 0),
        share(count[_UPPER].sum(), letters), share(count[_DIGIT].sum(), chars), share(count[_SYMBOL].sum(), chars),
        share(count[_STOP].sum(), n), share(count[_INNER].sum(), n), share(count[33], n), share(count[124], n),
        share(count[192:].sum(), chars), share(len(distinct), n) if n else 0.0, math.log1p(len(lines)),
        math.log1p(n / max(1, len(lines))), share(len(lines) - len(set(lines)), len(lines)),
        share(bare, n), share(shout, n), share((sizes <= 3).sum(), n),
    ])


def forward(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Solves factor z = row for each row by forward substitution; the factor is lower triangular."""
    z = np.empty((len(factor), len(rows)))
    for i in range(len(factor)):
        z[i] = (rows[:, i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class QualityModel:
    """Means, Cholesky factors of shrunk covariances and log-priors of the two classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1: from the difference of Mahalanobis log-densities."""
        if not self.means:
            return np.full(len(x), 1 / (1 + math.exp(-self.offsets[0])))
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            logs.append(offset - 0.5 * (forward(factor, x - mean) ** 2).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row; a null text counts as empty."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "x": pd.Series([statistics(t) for t in frame["text"]], dtype=object, index=frame.index)})

    return map_whole(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), measure, "x array<double>", "doc_id")


def fit_quality(stats: DataFrame, labels: DataFrame, shrink: float = 0.15, floor: float = 1e-4) -> QualityModel:
    """A model from (doc_id, x) and (doc_id, label): all labelled rows count, as sums and sums of products by class.

    A class covariance is drawn towards the pooled one and its diagonal, and never falls under ``floor``. With fewer
    than two rows of a class every score is the share of class 1.
    """
    labelled = stats.join(labels, "doc_id").select("label", "x")

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [np.concatenate([v, np.outer(v, v).ravel()]) for v in map(np.asarray, frame["x"])]
            yield pd.DataFrame({"label": frame["label"], "v": pd.Series(rows, dtype=object, index=frame.index)})

    sums = {row.label: row for row in vector_sums(labelled.mapInPandas(products, "label int, v array<double>"), "label", "v").collect()}
    counts = [sums[k].n if k in sums else 0 for k in (0, 1)]
    if min(counts) < 2:
        return QualityModel([], [], [math.log(counts[1] + 0.5) - math.log(counts[0] + 0.5)])
    d = len(STATISTICS)
    means, covariances = [], []
    for k, n in zip((0, 1), counts):
        total = np.asarray(sums[k].total)
        mean = total[:d] / n
        means.append(mean)
        covariances.append(total[d:].reshape(d, d) / n - np.outer(mean, mean))
    pooled = sum(n * c for n, c in zip(counts, covariances)) / sum(counts)
    factors, offsets = [], []
    for n, own in zip(counts, covariances):
        weight = min(0.9, shrink + d / (n + d))
        s = (1 - weight) * own + weight * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + floor * np.eye(d)
        factor = np.linalg.cholesky(s)
        factors.append(factor)
        offsets.append(math.log(n / sum(counts)) - np.log(np.diag(factor)).sum())
    return QualityModel(means, factors, offsets)


def quality_scores(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for each row of (doc_id, x)."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"doc_id": frame["doc_id"], "score": held.value.scores(np.stack(frame["x"].to_numpy()))})

    return map_whole(stats, score, "score double", "doc_id")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row, by a model of the labels given (doc_id, label).

    Null and empty texts get a score like any other. Rows with equal ids are each scored by their own text; a label
    counts for each of them. Null ids, and ids of any value, pass unchanged. An empty table gives an empty table.
    """
    stats = lasting(document_statistics(docs, id_col, text_col))
    return quality_scores(stats, fit_quality(stats, labels))
