"""A toxicity classifier that is held to give the same score when identity terms are swapped.

Features are the words of a text and the beginnings of words, each counted once a text. The loss adds to the
cross-entropy of the labels a penalty on the difference of scores between a labelled text and its counterfactuals, in
which the identity terms of sentences are swapped for others, so that a neutral mention of a group says nothing.
Evidence only adds up: weights are not negative, so a long clean text around an insult does not hide it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, forget, lasting, one_label

#: Terms that name groups; the terms of a line can stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("african", "american", "european", "mexican", "chinese", "indian"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)
_LINE = {term: line for line in IDENTITY_TERMS for term in line}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in range(4, 8) if len(word) > n))


def features(text: str | None) -> set[str]:
    words = set(_WORD.findall(text.lower())) if isinstance(text, str) else set()
    return {f for w in words for f in features_of(w)}


def swapped(text: str, step: int) -> str | None:
    """The text with each identity term of its sentences swapped for the one ``step`` places on; None without a term."""
    changed = False

    def other(m: re.Match) -> str:
        nonlocal changed
        line = _LINE.get(m[0].lower())
        if line is None:
            return m[0]
        changed = True
        return line[(line.index(m[0].lower()) + step) % len(line)]

    out = "".join(_WORD.sub(other, s) for s in _SENTENCE.findall(text))
    return out if changed else None


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def scores(self, texts) -> np.ndarray:
        """Scores of 0 to 1. Words are looked up once and then remembered, up to a fixed number."""
        known: dict[str, tuple[str, ...]] = {}
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            found: set[str] = set()
            if isinstance(text, str):
                for w in set(_WORD.findall(text.lower())):
                    hit = known.get(w)
                    if hit is None:
                        hit = tuple(f for f in features_of(w) if f in self.weights)
                        if len(known) < 200_000:
                            known[w] = hit
                    if hit:
                        found.update(hit)
            out[i] = self.bias + sum(map(self.weights.__getitem__, sorted(found)))
        return 1 / (1 + np.exp(-out))


def _matrix(lists: Sequence[Sequence[int]]):
    """(sums, back): of weights over each list of features, and of a number for each list over its features."""
    sizes = np.array([len(x) for x in lists], np.int64)
    cols = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in lists)])
    full = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes[full])])[:-1].astype(np.int64)

    def sums(w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes))
        if len(full):
            out[full] = np.add.reduceat(w[cols], starts)
        return out

    return sums, lambda off, n: np.bincount(cols, np.repeat(off, sizes), minlength=n)


def fit(rows: Sequence[Sequence[int]], labels: Sequence[int], pairs: Sequence[tuple[Sequence[int], Sequence[int]]], ridge: np.ndarray, fairness: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights (none negative) and bias of the least loss.

    The loss is the mean cross-entropy, half the sum of squared weights times their ``ridge``, and half the mean squared
    gap between the scores (before the logistic) of a text and its counterfactual, times ``fairness``. ``pairs`` hold
    the features that only the one or only the other has.
    """
    y = np.asarray(labels, float)
    n_features = len(ridge)
    own, back = _matrix(rows)
    first, first_back = _matrix([a for a, _ in pairs])
    second, second_back = _matrix([b for _, b in pairs])
    w, bias = np.zeros(n_features), -2.0
    moment, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        off = (1 / (1 + np.exp(-bias - own(w))) - y) / max(1, len(y))
        grad = back(off, n_features) + ridge * w
        if pairs:
            gap = (first(w) - second(w)) * fairness / len(pairs)
            grad += first_back(gap, n_features) - second_back(gap, n_features)
        grad = np.append(grad, off.sum())
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = 0.05 * moment / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, bias = np.maximum(0.0, w - move[:-1]), bias - move[-1]
    return w, float(bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, ridge: float = 0.08, fairness: float = 1.0, doubt: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from ``labels`` (doc_id, label 0 or 1), of which at most ``most_rows``, by a hash of the id, are used.

    A labelled id gives one row: where documents repeat it, the one of the smallest text, so a repeated id adds nothing.
    Every feature that is more frequent in toxic rows than in clean ones is in the model; others could only get a weight
    of 0. A weight is held the more to 0 the less its feature was seen: the ridge grows by the square of ``doubt`` over
    the number of its toxic rows. Without usable labels every score is that of the bias alone. ``ridge`` is spread over the rows, so
    few rows give small weights. Null ids and labels other than 0 and 1 are left out.
    """
    few = lasting(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    # At most most_rows rows of two numbers go to every task.
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "doc_id")
    sample = lasting(sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label"))
    n_toxic, n_rows = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_toxic or n_toxic == n_rows:
        return ToxicityModel({}, float(np.log(n_toxic + 0.5) - np.log(n_rows - n_toxic + 0.5)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for frame in batches(frames, "text"):
            for text, label in zip(frame["text"], frame["label"]):
                (toxic if label else clean).update(features(text))
        names = list(toxic | clean)
        if names:
            yield pd.DataFrame({"feature": names, "toxic": [toxic[x] for x in names], "clean": [clean[x] for x in names]})

    counts = sample.mapInPandas(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    chosen = counts.where(F.col("toxic") / float(n_toxic) > F.col("clean") / float(n_rows - n_toxic)).orderBy("feature").select("feature", "toxic")
    chosen = chosen.toArrow()  # features of the sample's toxic rows
    place = {name: i for i, name in enumerate(chosen["feature"].to_pylist())}
    held = docs.sparkSession.sparkContext.broadcast((place, chosen["toxic"].to_numpy()))
    del chosen, place

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, _ = held.value
        numbers = lambda text: np.array(sorted(place[f] for f in features(text) if f in place), "<i4")
        for frame in batches(frames, "text"):
            own, lost, new = [], [], []
            for text in frame["text"]:
                text = text if isinstance(text, str) else ""
                own.append(numbers(text))
                others = [numbers(s) for step in (1, 2) if (s := swapped(text, step)) is not None]
                lost.append([np.setdiff1d(own[-1], x).tobytes() for x in others])
                new.append([np.setdiff1d(x, own[-1]).tobytes() for x in others])
            yield pd.DataFrame({"label": frame["label"].to_numpy(), "own": pd.Series([x.tobytes() for x in own], dtype=object), "lost": pd.Series(lost, dtype=object), "new": pd.Series(new, dtype=object)})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, seen = held.value
        back = lambda raw: np.frombuffer(raw, "<i4")
        rows, labels, pairs = [], [], []
        for frame in frames:
            rows += map(back, frame["own"])
            labels += frame["label"].tolist()
            pairs += [(back(a), back(b)) for x, y in zip(frame["lost"], frame["new"]) for a, b in zip(x, y) if a != b]
        # A neutral mention of each group against one of another, whether or not the sample has one.
        for line in IDENTITY_TERMS:
            for a, b in zip(line, (*line[1:], line[0])):
                x, y = ({place[f] for f in features_of(t) if f in place} for t in (a, b))
                if x != y:
                    pairs.append((sorted(x - y), sorted(y - x)))
        w, bias = fit(rows, labels, pairs, ridge / n_rows * (1 + (doubt / seen.astype(float)) ** 2), fairness)
        names = [(name, float(w[i])) for name, i in place.items() if w[i] > 0]
        yield pd.DataFrame([*names, (None, bias)], columns=["feature", "weight"])

    # The model is fitted in one task, for the sample has most_rows rows at most; the order of rows is fixed.
    coded = sample.mapInPandas(encode, "label int, own binary, lost array<binary>, new array<binary>").repartition(1).sortWithinPartitions("label", "own")
    found = {row.feature: row.weight for row in coded.mapInPandas(learn, "feature string, weight double").collect()}
    forget(few, sample)
    held.destroy()
    return ToxicityModel(found, found.pop(None))


def toxicity_score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    """The score of each whole text; a null text scores as an empty one.

    It depends on the text alone, so rows that repeat get equal scores, and no id is read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # features of the sample's toxic rows

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(held.value.scores(part))

    return score(F.col(text_col))


def usable_labels(labels: DataFrame, held: Column) -> DataFrame:
    """(doc_id, label): one toxicity label an id, without the ids that ``held`` holds out."""
    return one_label(labels.where(~held), "toxic")
