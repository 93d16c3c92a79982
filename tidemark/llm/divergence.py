"""Quality rules: counts over whole documents, and how far a document is from every language.

A document's histograms of character classes and of common words are compared, by Jensen-Shannon distance, with those
of each language, which are summed over the documents of that language that pass the base rules. The common words are a
given list, or those that make a certain share of the words of a language, counted over the same documents.

The distance is a metric, so languages stand in balls: a document is compared with the middle of each, and with the other
languages of a ball only where the triangle inequality does not tell that none of them can be nearer.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, lasting, map_whole, vector_sums

COMMON_WORDS = tuple(dict.fromkeys(
    "the of and to in is it that for was on are as with be at this have from or by not but they he she we you his her an which all one there so if out up can".split()
    + "le la les de des du un une et en est que qui dans pour par sur pas au aux avec ce il elle ne se sont plus son".split()
    + "der die das und ist nicht ein eine den dem zu mit von sich auf für im des als auch es an werden aus er hat bei".split()
    + "el los las del y que se por con una para como más su al lo es no sus pero este ya o muy sin sobre".split()
))
_COMMON = {w.encode(): i for i, w in enumerate(COMMON_WORDS)}
_MARKS = b".,;:!?\"'()"
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANKS = b" \t\n\x0b\x0c\r"
#: Byte -> class: lower, capital, digit, blank, line end, full stop, comma, symbol, other mark, beyond ASCII; 10: none.
_CLASS = np.full(256, 8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[46], _CLASS[44] = 0, 1, 2, 3, 4, 5, 6
_CLASS[np.frombuffer(b"#*$%&|<>", np.uint8)], _CLASS[128:192], _CLASS[192:] = 7, 10, 9
N_CLASSES = 10
WIDTH = N_CLASSES + len(COMMON_WORDS) + 1


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """How many words stand in a run of k words that is found twice or more in the text."""
    if len(words) <= k:
        return 0
    runs = list(zip(*(words[i:] for i in range(k))))
    often = {r for r, n in Counter(runs).items() if n > 1} if len(set(runs)) < len(runs) else ()
    covered, reach = 0, 0
    for i, r in enumerate(runs):
        if often and r in often:
            covered += i + k - max(reach, i)
            reach = i + k
    return covered


def _bare(words: list[bytes]) -> Counter:
    """How often each word occurs, in small letters and without the marks around it."""
    return Counter(w.strip(_MARKS).lower() for w in words)


def _fails(n_words, n_repeat_words):
    """The base rules, for numbers and for columns."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def measures(text: str | None, common: dict[bytes, int] = _COMMON) -> tuple[int, int, int, int, int, np.ndarray]:
    """(words, characters in words, symbols, repeated lines, repeated words, histograms) of a whole text."""
    text = text if isinstance(text, str) else ""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(_BLANKS):
            seen.add(line)
    bins = np.bincount(_CLASS, weights=count, minlength=N_CLASSES + 1)[:N_CLASSES]
    often = np.zeros(len(common) + 1)
    hits = 0
    for w, n in _bare(words).items():
        at = common.get(w)
        if at is not None:
            often[at] = n
            hits += n
    often[-1] = len(words) - hits
    chars = len(text) - int(count[9:14].sum() + count[32])
    return len(words), chars, len(_SYMBOLS.findall(text)), again, repeated_words(words), np.concatenate([bins, often])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of p from q; both hold counts. An empty row is at 0."""
    whole = p.sum(axis=1, keepdims=True)
    p = np.divide(p, whole, out=np.zeros_like(p), where=whole > 0)
    q = np.broadcast_to(q / max(q.sum(), 1e-300), p.shape)
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
    return np.where(whole[:, 0] > 0, np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1)), 0.0)


def _balls(references: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """(members, radius) of about the root of their number of balls; the first member of each is its middle."""
    far = distance(references, references[0])
    middle, ball = [0], np.zeros(len(references), int)
    while len(middle) < math.isqrt(len(references)) and far.max() > 0:
        middle.append(int(far.argmax()))
        d = distance(references, references[middle[-1]])
        ball[d < far] = len(middle) - 1
        far = np.minimum(far, d)
    ball[middle] = np.arange(len(middle))
    out = []
    for j, m in enumerate(middle):
        members = np.flatnonzero(ball == j)
        out.append((references[np.concatenate([[m], members[members != m]])], float(far[members].max())))
    return out


def _lower(near: np.ndarray, h: np.ndarray, balls: list[tuple[np.ndarray, float]]) -> int:
    """Lowers ``near`` to the distance of each row of ``h`` from the nearest member of the balls; returns the comparisons."""
    from_middle = [distance(h, members[0]) for members, _ in balls]
    for d in from_middle:
        np.minimum(near, d, out=near)
    compared = len(h) * len(balls)
    for (members, radius), d in zip(balls, from_middle):
        for r in members[1:]:
            rows = np.flatnonzero(d - radius <= near + 1e-6)  # the rest are farther from all of this ball
            if not len(rows):
                break
            near[rows] = np.minimum(near[rows], distance(h[rows], r))
            compared += len(rows)
    return compared


def likely_words(texts: DataFrame, share: float, least_languages: float = 0.001, flush: int = 500_000) -> tuple[list[str], list[bytes]]:
    """(languages, words): all words that may make ``share`` of the words of one of the languages, and a few more.

    Only languages with ``least_languages`` of the table's characters name words, so there are 1/least_languages of them
    at most, and each names at most 4/3 /share words: a bound that does not grow with the table. A task counts no more
    than 8/share words of a language at a time. When there are more, the counts of all go down by that of the middle
    one, which takes a quarter of the share from a word at most.
    """
    size = texts.where("lang is not null").groupBy("lang").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    size = lasting(size)
    whole = size.agg(F.sum("chars")).first()[0] or 0
    langs = sorted(r.lang for r in size.where((F.col("chars") > 0) & (F.col("chars") >= least_languages * whole)).collect())  # 1/least_languages rows at most
    wanted, most = set(langs), math.ceil(8 / share)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}
        total: Counter = Counter()

        def rows() -> pd.DataFrame:
            made = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()] + [(lang, None, n) for lang, n in total.items()]
            counts.clear()
            total.clear()
            return pd.DataFrame(made, columns=["lang", "word", "n"])

        for frame in batches(frames, "text"):
            for lang, text in zip(frame["lang"], frame["text"]):
                if lang not in wanted or not isinstance(text, str):
                    continue
                words = text.encode("utf-8", "surrogatepass").split()
                if _fails(len(words), repeated_words(words)):
                    continue
                total[lang] += len(words)
                found = counts.setdefault(lang, Counter())
                found.update(_bare(words))
                if len(found) > most:
                    less = sorted(found.values(), reverse=True)[most // 2 - 1]
                    counts[lang] = Counter({w: n - less for w, n in found.items() if n > less})
            if sum(map(len, counts.values())) > flush:
                yield rows()
        yield rows()

    found = texts.select("lang", "text").mapInPandas(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = lasting(found)
    words = found.where("word is not null and word <> X''").join(found.where("word is null").select("lang", F.col("n").alias("all")), "lang")
    words = words.where(F.col("n") >= 0.75 * share * F.col("all")).select("word").distinct()
    return langs, sorted(bytes(r.word) for r in words.collect())


def quality_rules(docs: DataFrame, most_class: float = 0.3, most_words: float = 0.42, least_chars: int = 200, least_words: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", at_once: int = 2000, words: Sequence[str] | None = COMMON_WORDS, share: float = 0.002, least_count: int = 20) -> DataFrame:
    """(id, counts, base_failed, class_distance, word_distance, kept) for each row.

    The base rules fail a text of under 10 words, or with over 20 % of its words in repeated runs of five. Of the others
    those stay that are within both distances of the nearest language; a text under ``least_chars`` characters in words
    is not held to the class distance, one under ``least_words`` words not to that of words. Rows without a language
    count towards none, but are judged alike. Without any language nothing is too far. Null texts count as empty. Rows
    that repeat stay and are judged alike, null ids pass unchanged, of languages that are equally near any gives the same
    distance, and an empty table gives an empty table.

    ``words`` are the common words, in small letters. None learns them from the table: all words that make ``share`` of
    the words of a language in the documents that pass the base rules, and occur ``least_count`` times there, where the
    language has a thousandth of the table's characters. A first pass finds all that may be such words in bounded memory
    (``likely_words``); the sums of the second, which are exact, decide.

    Every language is a reference, however many there are: ``at_once`` of them are held at a time, and each such block
    is a pass over the histograms that lowers the least distances of the one before.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs, likely = ([], [w.encode() for w in words]) if words is not None else likely_words(texts, share)
    common = {w: i for i, w in enumerate(likely)}
    counted = docs.sparkSession.sparkContext.broadcast(common)  # at most 4/3 /share words of each of 1,000 languages, or the given ones

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            rows = [measures(t, counted.value) for t in frame["text"]]
            made = pd.DataFrame([r[:5] for r in rows], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            made.insert(0, "id", frame["id"].to_numpy())
            made["lang"], made["h"] = frame["lang"].to_numpy(), pd.Series([r[5] for r in rows], dtype=object)
            yield made

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    made = lasting(map_whole(texts, measure, f"{counts}, lang string, h array<double>"))
    bad = _fails(F.col("n_words"), F.col("n_repeat_words"))
    references = lasting(vector_sums(made.where(F.col("lang").isNotNull() & ~bad), "lang", "h"))
    n_references = references.count()
    frequent = np.full(len(likely), words is not None)
    for r in references.where(F.col("lang").isin(langs)).toLocalIterator() if langs else ():
        total = np.asarray(r.total[N_CLASSES:])
        frequent |= total[:-1] >= max(least_count, share * total.sum())
    rare = N_CLASSES + np.flatnonzero(~frequent)

    def narrow(h: np.ndarray) -> np.ndarray:
        """The histograms without the words that are not frequent after all, which count among the rest."""
        h = h.copy()
        h[:, -1] += h[:, rare].sum(axis=1)
        return np.delete(h, rare, axis=1)

    def judge(held, last: bool):
        def nearer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                h = narrow(np.stack(frame["h"].to_numpy()))
                near = frame[["class_distance", "word_distance"]].to_numpy().T.copy()
                for i, part in enumerate((slice(0, N_CLASSES), slice(N_CLASSES, None))):
                    _lower(near[i], h[:, part], held.value[i])
                yield (frame.drop(columns="h") if last else frame).assign(class_distance=near[0], word_distance=near[1])

        return nearer

    start = F.lit(float("inf") if n_references else 0.0)
    judged = made.drop("lang").withColumns({"class_distance": start, "word_distance": start})
    for i, block in enumerate(batched(references.select("total").coalesce(16).toLocalIterator(), at_once)):
        sums = narrow(np.array([r.total for r in block]))
        held = docs.sparkSession.sparkContext.broadcast([_balls(sums[:, :N_CLASSES]), _balls(sums[:, N_CLASSES:])])  # at_once histograms
        last = (i + 1) * at_once >= n_references
        names = f"{counts}, {'' if last else 'h array<double>, '}class_distance double, word_distance double"
        judged = map_whole(lasting(judged) if i else judged, judge(held, last), names)
    judged = judged.drop("h")
    far = ((F.col("word_chars") >= least_chars) & (F.col("class_distance") > most_class)) | ((F.col("n_words") >= least_words) & (F.col("word_distance") > most_words))
    return judged.withColumn("base_failed", bad).withColumn("kept", ~bad & ~far).withColumnRenamed("id", id_col)
