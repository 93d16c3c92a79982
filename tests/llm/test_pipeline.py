"""The corpus pipeline against plain rules on its own stages' rows."""

import math
from collections import Counter

import corpus_pipeline
from tidemark.llm import secrets
from tidemark.llm.common import held_out
from tidemark.llm.toxicity import fit_toxicity, toxicity_score, usable_labels

from .test_corpus import brute_components, brute_targets, words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, SF)
    model = fit_toxicity(docs, usable_labels(labels, held_out("doc_id", 5, 0)))
    scores = {r.doc_id: r.s for r in docs.select("doc_id", toxicity_score(docs, model).alias("s")).collect()}
    rows = clean.collect()
    assert clean.columns == COLUMNS and {r.doc_id for r in rows} == {i for i, s in scores.items() if s < 0.5}

    single = corpus_pipeline.one_of_each_group(spark, clean, SF)
    groups = brute_components([(r.doc_id, r.text) for r in rows], 80, 5)
    assert single.columns == COLUMNS and Counter(r.doc_id for r in single.collect()) == Counter(i for i, (_, c) in groups.items() if i == c)

    masked = corpus_pipeline.secret_scans(spark, single, SF)
    for r in masked.collect():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)

    mixed = corpus_pipeline.mixing(spark, masked, SF).collect()
    sizes, taken = Counter(), Counter()
    for r in masked.collect():
        sizes[r.source] += len(words(r.text))
    for r in mixed:
        taken[r.source] += len(words(r.text))
    longest = max(len(words(r.text)) for r in masked.collect())
    assert all(abs(taken[s] - t) <= longest for s, t in brute_targets(sizes).items()) and max(Counter(r.doc_id for r in mixed).values()) <= 2


def test_the_run_packs_all_of_it(spark):
    packed = corpus_pipeline.run(spark, SF).toPandas()
    sums = packed.groupby("sequence_id").length.sum()
    assert sums.max() <= 1024 and len(sums) <= 1.05 * math.ceil(sums.sum() / 1024) + 1


def test_rows_that_repeat_or_have_no_id(spark):
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (None, "x y z", None, None, 5), (None, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    single = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert Counter(r.doc_id for r in single.collect()) == Counter({1: 1, None: 2, 4: 1})
    mixed = corpus_pipeline.mixing(spark, single, SF).collect()
    assert {r.text for r in mixed} <= {"a b c d e", "x y z"}
    assert corpus_pipeline.mixing(spark, single.limit(0), SF).count() == 0
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), SF).count() == 0


def test_extra_columns_with_clashing_names_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS n", "'x' AS size", "2 AS id", "3 AS score", "4 AS times", "'k' AS row_key", "5 AS taken", "6 AS prefix")
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns, name
        assert made.where("n = 1 and size = 'x' and id = 2 and times = 4 and row_key = 'k'").count() == made.count() > 0
    assert corpus_pipeline.packing(spark, docs, SF).count() > 0


def test_mixing_takes_what_the_mix_says_of_reused_ids_and_repeated_rows(spark):
    from tidemark.llm.mixing import mix

    text = lambda n, mark="w": " ".join(f"{mark}{k}" for k in range(n))
    cases = [
        [(1, text(10), "en", "s", 0), (1, text(3), "en", "s", 0)],  # one id, two texts
        [(1, text(4), "en", "a", 0), (1, text(4), "en", "b", 0), (1, text(4), "en", None, 0)],  # one text, three sources
        [(7, text(5), "en", "s", 0)] * 5 + [(8, text(2), "en", "s", 0)] * 3 + [(None, text(2), "en", "s", 0)] * 4,  # rows alike
        [(k, text(1 + k % 6, f"x{k % 3}"), "en", "st"[k % 2], 0) for k in range(12)] + [(k, text(3, "y"), "en", "s", 0) for k in range(12)],
    ]
    for rows in cases:
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        said, made = mix(docs).collect(), corpus_pipeline.mixing(spark, docs, SF)
        got = made.collect()
        by_source = lambda pairs: {s: n for s, n in Counter({s: sum(n for x, n in pairs if x == s) for s in {p[0] for p in pairs}}).items() if n}
        assert made.columns == docs.columns and by_source([(r.source, len(words(r.text))) for r in got]) == by_source([(r.source, r.taken) for r in said])
        most = Counter((r.doc_id, r.text, r.source) for r in got)
        have = Counter((r.doc_id, r.text, r.source) for r in docs.collect())
        assert all(n <= 2 * have[k] for k, n in most.items())
