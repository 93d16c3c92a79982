"""Repeated lines against a plain computation."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import line_dedup
from tidemark.llm.line_dedup import BLANKS, keep_bitmaps, line_key, pack, unpack, without_repeats

SCHEMA = "doc_id long, text string, id string, keep string, hi long"


def plain(rows):
    """(id, n_lines, n_dropped, kept) of each row; a null id comes after all others."""
    first = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS)
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
            if len(key) >= 10:
                first[key] = min(first.get(key, (True, 0)), (doc is None, doc or 0))
    made = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        stays = [x for x in lines if first.get(line_key(x), (doc is None, doc or 0)) == (doc is None, doc or 0)]
        made.append((doc, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(made, key=repr)


def spark_rows(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in without_repeats(docs, keep_bitmaps(docs)).collect()), key=repr)


def row(doc, text):
    return (doc, text, "a", "b", 3)


def test_random_documents(spark):
    r = random.Random(5)
    lines = [f"line number {k} of all" for k in range(30)] + ["Line NUMBER 3 of all", "\t line number 4 of all \x0b", "short", "", "ÄÖÜ ÄÖÜ äöü", "äöü äöü äöü", "123456789", "1234567890", "\x85line number 5 of all"]
    rows = [row(k, "\n".join(r.choice(lines) for _ in range(r.randrange(12)))) for k in range(300)]
    assert spark_rows(spark, rows) == plain(rows)


def test_one_line_everywhere_fills_many_ranges(spark):
    """A third of all rows hold one line, so its hash spans ranges and is told its first document."""
    rows = [row(k, "the same line everywhere\n" * 3 + f"own line number {k}") for k in range(2000)] + [row(5000 + k, f"another line {k % 7}") for k in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert spark_rows(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nulls_repeats_and_long_texts(spark):
    rows = [row(None, "a line of no id\nshared by two"), row(None, "shared by two\nshared by two"), row(7, None), row(8, ""), row(9, "\n\n")]
    rows += [row(3, "shared in three rows\nx")] * 3 + [row(3, "shared in three rows\nother")] + [row(4, "shared in three rows")] + [row(-5, "shared by two")]
    rows += [row(10, "\n".join(f"long line {k % 5000}" for k in range(60_000))), row(11, "long line 17\n" + "w" * 300_000), row(12, "W" * 300_000)]
    assert spark_rows(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert spark_rows(spark, []) == []


def test_small_flushes(spark, monkeypatch):
    rows = [row(k, "\n".join(f"line number {j}" for j in range(k))) for k in range(40)]
    monkeypatch.setattr(line_dedup, "_FLUSH", 3)
    assert spark_rows(spark, rows) == plain(rows)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1), st.integers(0, 30))
def test_bitmaps(places, more):
    n = max(places) + 1 + more
    assert unpack(pack(sorted(places)), n) == [k not in places for k in range(n)]
    assert unpack(None, n) == [True] * n


@pytest.mark.parametrize(("line", "key"), [(" A b\t", "a b"), ("\x0bÄ\x0c", "Ä"), ("", ""), (" x", " x")])
def test_keys(line, key):
    assert line_key(line) == key
