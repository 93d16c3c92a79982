"""Very long texts, extra columns of clashing names, rows that repeat, and tables of nulls, for every corpus operator."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_tree, divergence, jaccard_join, mixing, packing, quality, secrets, toxicity, url_rules, vector_tree

CLASH = ("n", "size", "key", "grp", "doc", "x", "v", "k", "h", "id", "host", "path", "range", "page", "rule", "leaf", "length", "piece", "label", "score", "times", "extra", "slice", "taken", "kept", "spans", "prefix", "set_key", "turns", "node_id", "up", "at")


def extra(df):
    """The table with columns of every name that the operators use inside."""
    return df.select("*", *(F.lit(f"other {c}").alias(c) for c in CLASH if c not in df.columns))


def one_label(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, label int")


OPERATORS = {
    "toxicity": lambda spark, d: d.select("doc_id", toxicity.toxicity_score(d, toxicity.fit_toxicity(d, one_label(spark))).alias("s")),
    "join": lambda spark, d: jaccard_join.near_duplicates(d).select("doc_id", "n_shingles", "component_id"),
    "secrets": lambda spark, d: secrets.scan_secrets(d).select("doc_id", F.to_json("spans").alias("s")),
    "redacted": lambda spark, d: secrets.redact_secrets(d).select("doc_id", "text"),
    "mixing": lambda spark, d: mixing.mix(d),
    "quality": lambda spark, d: quality.quality(d, one_label(spark)),
    "rules": lambda spark, d: divergence.quality_rules(d),
    "packing": lambda spark, d: packing.pack_documents(d).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("p")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(spark, name):
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(20_000))
    texts = [None, "", long, long + " more", "x" * 300_000, "token = " + "aB3" * 40_000, "\n" * 5_000, "ü " * 4_000, "a b c d e f g", "a b c d e f g"]
    d = spark.createDataFrame([(i, t, "en" if i % 2 else None, None if i % 3 else "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3)
    operator = OPERATORS[name]
    plain = Counter(tuple(r) for r in operator(spark, d).collect())
    assert sum(plain.values()) == len(texts)
    assert Counter(tuple(r) for r in operator(spark, extra(d)).collect()) == plain
    if name == "join":
        assert {r[0]: r[2] for r in plain}[3] == 2 and {r[0]: r[2] for r in plain}[9] == 8
    if name == "packing":
        assert {r[0]: r[1] for r in plain}[0] == {r[0]: r[1] for r in plain}[1] == 1
    twice = operator(spark, d.unionByName(d)).collect()
    assert name == "packing" or len(twice) == 2 * len(texts)
    nulls = d.select(*(F.lit(None).cast(kind).alias(c) for c, kind in d.dtypes))
    found = operator(spark, nulls).collect()
    assert name == "packing" or len(found) == len(texts)
    assert all(r.doc_id is None for r in found)
    assert operator(spark, d.limit(0)).count() == 0


def test_odd_pages(spark):
    urls = [None, "", "http://a.org/x", "http://a.org/x", "https://" + "a." * 20_000 + "org/" + "y" * 200_000, "://", "x://" + "é" * 70_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([("org", "/", "block"), ("a.org", "/y", "allow")], "host string, path string, verdict string")
    plain = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()}
    assert plain == {0: (None, "allow"), 1: (None, "allow"), 2: ("org/", "block"), 3: ("org/", "block"), 4: ("a.org/y", "allow"), 5: (None, "allow"), 6: (None, "allow")}
    assert {r.page_id: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(extra(pages), rules).collect()} == plain
    nulls = pages.select(*(F.lit(None).cast(kind).alias(c) for c, kind in pages.dtypes))
    assert [(r.page_id, r.rule, r.verdict) for r in url_rules.judge_urls(nulls, rules).collect()] == [(None, None, "allow")] * len(urls)


def test_odd_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(120)] + [(50, None), (None, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    plain = sorted(map(tuple, vector_tree.nearest(v).collect()))
    assert len(plain) == 15 and sorted(map(tuple, vector_tree.nearest(extra(v)).collect())) == plain
    nulls = v.select(*(F.lit(None).cast(kind).alias(c) for c, kind in v.dtypes))
    assert vector_tree.nearest(nulls).count() == 0
    none_asked = vector_tree.nearest(v.where("vec_id % 50 <> 0"))
    assert none_asked.count() == 0


def test_leaves_grow_with_the_table_and_queries_still_find(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 8))
    x = centres[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = vector_tree.nearest(df, sample_rows=400, leaf_rows=40, most_rows=20, branch=4).toPandas()
    u = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    hits = 0
    for q, part in found.groupby("query_id"):
        order = [i for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:5]
        hits += len(set(order) & set(part.vec_id))
        assert len(part) == 5
    assert hits / (5 * 60) >= 0.9
    tree = vector_tree.fit_tree(u[:400], 4, 40)
    upper = tree.count()
    vector_tree.add_levels(tree, u[:400], 4, 3000 / 20)
    leaves = list(tree.visits(u[5]))
    assert tree.count() >= 150 > upper and len(leaves) == len(set(leaves)) == tree.count() and set(tree.assign(u).tolist()) <= set(leaves)


def test_odd_conversations(spark):
    m = spark.createDataFrame([(1, 0, "user", "x" * 500_000), (1, 1, "assistant", "[INST]" * 50_000), (None, None, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", "")], "conv_id long, turn long, role string, text string")
    run = lambda df: {r.tree_id: tuple(r) for r in chat_tree.read_back(chat_tree.format_trees(chat_tree.thread_nodes(df))).collect()}
    plain = run(m)
    assert set(plain) == {1, 2, None} and plain[1][3] == 300_000 and plain[2][1] == 2 and run(extra(m)) == plain
    nulls = m.select(*(F.lit(None).cast(kind).alias(c) for c, kind in m.dtypes))
    assert {k: v[1] for k, v in run(nulls).items()} == {None: 5} and run(m.limit(0)) == {}
