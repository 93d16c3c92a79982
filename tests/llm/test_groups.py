"""One document of each group of near copies stays, whatever the ids of its rows."""

from collections import Counter

import corpus_pipeline


def test_null_and_reused_ids_leave_one_row_of_a_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (None, a), (None, a + " x"), (5, b), (3, b + " x"), (3, b + " x"), (None, c), (None, c), (9, ""), (9, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    single = corpus_pipeline.one_of_each_group(spark, docs, "")
    found = Counter((r.doc_id, r.text) for r in single.collect())
    assert single.columns == docs.columns and found == Counter({(5, a): 1, (3, b + " x"): 1, (None, c): 1, (9, ""): 1, (None, None): 2})
