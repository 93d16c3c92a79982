"""Common words learned from the table, and the balls in which languages stand."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import divergence


def sentences(rng, words, n):
    weights = [1 / (i + 1) for i in range(len(words))]
    return " ".join(rng.choices(words, weights, k=n))


def test_a_language_of_no_list_is_learned_and_rejects(spark):
    # A language made up here; the words of the strange document have its letters and lengths, but are none of its words.
    rng = random.Random(4)
    make = lambda: "".join(rng.choice("klmnprstv") + rng.choice("aeiou") for _ in range(2))
    own = list(dict.fromkeys(make() for _ in range(120)))
    other = [w for w in dict.fromkeys(make() for _ in range(900)) if w not in own][:120]
    rows = [(n, sentences(rng, own, 90), "xx") for n in range(60)] + [(60, sentences(rng, other, 90), "xx"), (61, None, None), (62, "", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r.doc_id: r for r in divergence.quality_rules(df, words=None).collect()}
    assert all(learned[n].kept for n in range(60)) and not learned[60].kept and learned[60].word_distance > 0.42
    listed = {r.doc_id: r for r in divergence.quality_rules(df).collect()}
    assert listed[60].kept  # no list of other languages can tell


@pytest.mark.parametrize("share", [0.002, 0.02])
def test_learned_words_are_the_frequent_ones(spark, share):
    rng = random.Random(7)
    rows, totals = [], {"a": Counter(), "b": Counter()}
    for n in range(300):
        lang = "ab"[n % 3 == 0]
        words = rng.choices([f"{lang}{i}" for i in range(2000)], [1 / (i + 1) for i in range(2000)], k=80)
        rows.append((n, " ".join(words), lang))
        totals[lang].update(words)
    rows += [(300 + n, "spam spam spam spam spam spam spam spam spam spam spam spam", "a") for n in range(900)]  # fails the base rules
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wanted = {w for c in totals.values() for w, n in c.items() if n >= max(20, share * c.total())}
    langs, likely = divergence.likely_words(df.repartition(7), share)
    assert langs == ["a", "b"] and wanted <= {w.decode() for w in likely if w != b"spam"}
    assert len(likely) <= 2 * 4 / 3 / share
    found = {r.doc_id: r for r in divergence.quality_rules(df, words=None, share=share).collect()}
    given = {r.doc_id: r for r in divergence.quality_rules(df.repartition(5), words=sorted(wanted), share=share).collect()}
    assert {n: (r.kept, pytest.approx(r.word_distance, abs=1e-7)) for n, r in given.items()} == {n: (r.kept, r.word_distance) for n, r in found.items()}


def test_counts_go_down_together_when_there_are_many_words(spark):
    # Every second word is new, so that a task has to lower its counts many times; the frequent words are found all the same.
    rng = random.Random(9)
    rows, at = [], 0
    for n in range(400):
        words = []
        for _ in range(100):
            words += [f"new{at}", f"w{rng.randrange(20)}"]
            at += 1
        rows.append((n, " ".join(words), "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    _, likely = divergence.likely_words(df, 0.02)
    assert {w.decode() for w in likely} == {f"w{i}" for i in range(20)}
    _, flushed = divergence.likely_words(df, 0.02, flush=50)
    assert flushed == likely


def test_balls_give_the_least_distance_with_few_comparisons():
    rng = np.random.default_rng(3)
    kinds = rng.dirichlet(np.ones(40), 12)
    references = np.array([rng.multinomial(100_000, kinds[i % 12]) for i in range(3000)], float)
    h = np.array([rng.multinomial(400, kinds[i % 12]) for i in range(100)], float)
    h[5] = 0
    near = np.full(len(h), np.inf)
    compared = divergence._lower(near, h, divergence._balls(references))
    least = np.min([divergence.distance(h, r) for r in references], axis=0)
    assert near.tolist() == least.tolist() and compared < 0.15 * len(h) * len(references)
    one = divergence._balls(references[:1])
    assert len(one) == 1 and one[0][1] == 0
    same = np.repeat(references[:1], 50, axis=0)
    near = np.full(len(h), np.inf)
    divergence._lower(near, h, divergence._balls(same))
    assert near.tolist() == divergence.distance(h, references[0]).tolist()
