"""Divergences of sources against whole-number arithmetic by hand, on tiles of any size."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence_audit
from tidemark.llm.divergence_audit import source_divergence, terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, chunk int"


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def plain(rows, least=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(words(text))
        docs[lang].update(set(words(text)))
    made = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share(c) for s, c in own.items()}
        q = share({t: sum(c[t] for c in own.values()) for t in kept})
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            parts = {"pair": [(x, sum(gap(p[s][t], p[x][t]) for t in kept)) for x in own if x != s], "term": [(t, gap(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                made += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked[: None if part == "pair" else 10], 1)]
    return sorted(made)


def audited(spark, rows, **more):
    return sorted(tuple(r) for r in source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect())


def row(k, text, lang, source):
    return (k, text, lang, source, "a", 1, 2)


def corpus(seed, n=400, sources=9):
    r = random.Random(seed)
    vocabulary = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k % 6]}" for k in range(60)] + ["Über", "über", "ÉTÉ", "名前", "Ab", "aB"]
    return [row(k, " ".join(r.choices(vocabulary, range(1, 67), k=r.randrange(30))) + r.choice(["", "\x00x1y\x7fz!", "\n"]), r.choice(["en", "de", "de"]), f"s{int(r.random() ** 2 * sources)}") for k in range(n)]


@pytest.mark.parametrize(("block", "chunk", "segment"), [(16, 1024, 16), (2, 4, 2), (1, 1, 1), (3, 7, 100)])
def test_tiles_of_any_size(spark, block, chunk, segment):
    rows = corpus(3)
    assert audited(spark, rows, block=block, chunk=chunk, segment=segment) == plain(rows)


def test_odd_rows(spark):
    rows = corpus(4, 150) + [row(None, None, None, None), row(1, "", "en", None), row(1, "123 !", "en", "blank"), row(2, "x", "xx", "a"), row(2, "y", "xx", "b"), row(2, "z", "xx", "Ä")]
    rows += [row(9, "word " * 100_000 + "rest", "de", "long")] * 12
    assert audited(spark, rows, block=2, chunk=5, segment=1) == plain(rows)


def test_empty_and_alone(spark):
    assert audited(spark, []) == []
    assert audited(spark, [row(1, "a b", "en", "s")]) == []


def test_small_flushes(spark, monkeypatch):
    rows = corpus(6, 120)
    monkeypatch.setattr(divergence_audit, "_FLUSH", 20)
    assert audited(spark, rows) == plain(rows)


def test_terms_and_large_counts():
    text = "Aé1b—c_D\x00E f [X]"
    assert [t.decode() for t in terms(text.encode())] == words(text)
    counts, total, size = [0, 5, 10**14, 3 * 10**14], 4 * 10**14 + 5, 10**6
    assert divergence_audit._shares(counts, total, size).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * size) for c in counts]
