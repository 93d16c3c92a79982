"""Quality rules compare with every language, however many there are."""

import random

import numpy as np
import pytest

from tidemark.llm import divergence


def test_every_language_is_a_reference(spark):
    # 230 languages, each of its own mix of capitals, digits and symbols; the last ones are the rarest.
    rng = random.Random(8)
    rows = []
    for i in range(230):
        text = " ".join("".join(rng.choices("aA1#,", weights=[1 + i % 7, 1 + i % 5, 1 + i % 3, 1 + i % 11, 1 + i % 13], k=6)) for _ in range(60))
        rows += [(len(rows), text, f"l{i:03d}")] * (1 if i >= 200 else 2)
    strange = " ".join(f"ЖЖ{i:03d}Ж" for i in range(70))
    rows.append((len(rows), strange, "zz"))
    df = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in divergence.quality_rules(df).collect()}
    assert len(found) == len(rows) and found[len(rows) - 1].kept
    h = np.array([divergence.measures(t)[5] for _, t, _ in rows])
    sums = {}
    for x, (_, _, lang) in zip(h, rows):
        sums[lang] = sums.get(lang, 0) + x
    for cut, name in ((slice(0, divergence.N_CLASSES), "class_distance"), (slice(divergence.N_CLASSES, divergence.WIDTH), "word_distance")):
        least = np.min([divergence.distance(h[:, cut], s[cut]) for s in sums.values()], axis=0)
        assert [found[n][name] for n in range(len(rows))] == pytest.approx(least.tolist(), abs=1e-7)
    again = {r.doc_id: r for r in divergence.quality_rules(df, at_once=100).collect()}
    assert again == found
    none = divergence.quality_rules(df.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()
    assert {(r.class_distance, r.word_distance) for r in none} == {(0.0, 0.0)}
