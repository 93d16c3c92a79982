"""Learned models and whole ids of the corpus operators against plain computations."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, jaccard_join, packing, quality, secrets, toxicity, url_rules
from tidemark.llm.common import map_whole, vector_sums

SF = "/root/testdata/sf0.001"
LARGE = [2**53 + 1, None, 2**53 + 3]


def test_ids_of_any_value_come_back(spark):
    texts = ["Some words of a text that is long enough to count, and a key 0123456789abcdef0.", "other words here", None]
    d = spark.createDataFrame([(i, t, "en") for i, t in zip(LARGE, texts)], "doc_id long, text string, lang string").coalesce(1)
    ids = lambda df, c="doc_id": sorted({r[c] for r in df.collect()}, key=str)
    whole = sorted(LARGE, key=str)
    assert ids(secrets.scan_secrets(d, {})) == ids(divergence.quality_rules(d)) == ids(quality.document_statistics(d)) == ids(packing.pack_documents(d)) == whole
    assert ids(quality.quality(d, spark.createDataFrame([(LARGE[0], 1)], "doc_id long, label int"))) == whole
    near = jaccard_join.near_duplicates(d)
    assert ids(near) == ids(near, "component_id") == whole
    pages = spark.createDataFrame([(i, "http://a.org/x") for i in LARGE], "page_id long, url string").coalesce(1)
    assert ids(url_rules.judge_urls(pages, spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")), "page_id") == whole
    sums = vector_sums(spark.createDataFrame([(i, [1.0, 2.0]) for i in LARGE * 2], "k long, v array<double>").coalesce(1), "k", "v").collect()
    assert {(r.k, r.n, tuple(r.total)) for r in sums} == {(i, 2, (2.0, 4.0)) for i in LARGE}
    for kind in ("double", "decimal(20,2)", "string", "binary", "date"):
        odd = spark.createDataFrame([("2024-01-02",), (None,)], "id string").select((F.col("id").cast("date") if kind == "date" else F.lit(None).cast(kind) if kind == "decimal(20,2)" else F.substring("id", 1, 4).cast(kind) if kind != "double" else F.substring("id", 1, 4).cast("double")).alias("id"), F.lit(1).alias("n"))
        assert map_whole(odd, lambda frames: frames, "n int").collect() == odd.collect()


def plain_loss(w, bias, rows, labels, pairs, ridge, fairness):
    z = np.array([bias + sum(w[f] for f in r) for r in rows])
    gaps = np.array([sum(w[f] for f in a) - sum(w[f] for f in b) for a, b in pairs])
    cross = np.mean([math.log1p(math.exp(-x)) if y else math.log1p(math.exp(x)) for x, y in zip(z, labels)])
    return cross + 0.5 * (ridge * w**2).sum() + 0.5 * fairness * (gaps**2).mean()


def test_the_toxicity_fit_is_the_least_of_a_plain_loss():
    rng = random.Random(5)
    n = 12
    rows = [sorted(rng.sample(range(n), rng.randint(0, 6))) for _ in range(80)]
    labels = [int(rng.random() < (0.02 if 5 in r else 0.8 if 0 in r or 3 in r else 0.4)) for r in rows]
    pairs = [(sorted(rng.sample(range(n), 3)), sorted(rng.sample(range(n), 3))) for _ in range(20)]
    ridge = np.array([rng.uniform(0.01, 0.2) for _ in range(n)])
    w, bias = toxicity.fit(rows, labels, pairs, ridge, 0.7, steps=4000)
    best = plain_loss(w, bias, rows, labels, pairs, ridge, 0.7)
    assert (w >= 0).all() and (w == 0).any() and (w > 0).any()
    for i in range(n):  # no step along a weight that stays allowed, nor along the bias, makes the loss smaller
        for step in (-1e-2, 1e-2):
            moved = w.copy()
            moved[i] += step
            if moved[i] >= 0:
                assert plain_loss(moved, bias, rows, labels, pairs, ridge, 0.7) > best - 1e-7
    assert min(plain_loss(w, bias + s, rows, labels, pairs, ridge, 0.7) for s in (-1e-2, 1e-2)) > best - 1e-7


def test_toxicity_scores_are_those_of_the_plain_sum(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(d, toxicity.usable_labels(labels, F.lit(False)))
    for r in d.select("text", toxicity.toxicity_score(d, model).alias("s")).collect():
        words = {w for w in toxicity._WORD.findall((r.text or "").lower())}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in {f for w in words for f in (w, *(w[:n] + "*" for n in (4, 5, 6, 7) if len(w) > n))})
        assert r.s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_every_feature_of_toxic_rows_can_count_and_repeated_ids_add_nothing(spark):
    rows = [(i, f"{'qrstuvwxyz'[i // 10]}{'qrstuvwxyz'[i % 10]}q only in this one" if i % 2 else "calm text", i % 2) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit_toxicity(d.drop("label"), d.select("doc_id", "label"), doubt=1.0)
    assert {t.split()[0] for _, t, label in rows if label} | {"only"} <= set(model.weights)
    again = d.unionByName(d.where("doc_id = 3")).unionByName(d.where("doc_id = 3"))
    assert toxicity.fit_toxicity(again.drop("label"), d.select("doc_id", "label"), doubt=1.0) == model


def test_quality_scores_are_plain_log_densities(spark):
    d, labels = (spark.read.parquet("/root/testdata/sf0.01/" + t + ".parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", F.col("quality").alias("label")).where("label is not null")
    stats = quality.document_statistics(d)
    found = {r.doc_id: r.score for r in quality.quality(d, labels).collect()}
    x = {r.doc_id: np.array(r.x) for r in stats.collect()}
    by = {k: np.array([x[r.doc_id] for r in labels.collect() if r.label == k and r.doc_id in x]) for k in (0, 1)}
    n = sum(map(len, by.values()))
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in by.values()) / n
    log = {}
    for k, v in by.items():
        a = min(0.9, 0.15 + 19 / (len(v) + 19))
        s = (1 - a) * np.cov(v.T, bias=True) + a * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + 1e-4 * np.eye(19)
        log[k] = lambda y, m=v.mean(axis=0), inverse=np.linalg.inv(s), det=np.linalg.slogdet(s)[1], p=math.log(len(v) / n): p - 0.5 * det - 0.5 * (y - m) @ inverse @ (y - m)
    for i, y in x.items():
        gap = max(-500, min(500, log[1](y) - log[0](y)))
        assert found[i] == pytest.approx(1 / (1 + math.exp(-gap)), abs=1e-6)


def test_learned_spans_are_those_of_plain_likelihoods(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = secrets.fit_formats(d)

    def likelihood(model, text):
        logs, moves, ends = model
        state, total = 0, 0.0
        for c in text:
            kind = "U" if "A" <= c <= "Z" else "h" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "d" if c.isdigit() else c
            total += logs[state][kind] - math.log({"U": 26, "h": 6, "l": 20, "d": 10}.get(kind, 1))
            state = moves[state].get(kind, 0)
        return total + ends[state]

    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    more = 0
    for r in d.join(secrets.scan_secrets(d, models), "doc_id").collect():
        text = r.text or ""
        covered = {i for s in r.base_spans for i in range(s.start, s.end)}
        expected, at = set(), 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in allowed and end not in covered:
                end += 1
            part = text[at:end]
            if len(part) >= 12 and max(likelihood(m, part) for k, m in models.items() if k != "plain") - likelihood(models["plain"], part) >= len(part):
                expected.add(("format", at, end))
            at = max(end, at + 1)
        assert {(s.kind, s.start, s.end) for s in r.spans} - {(s.kind, s.start, s.end) for s in r.base_spans} == expected
        more += len(expected)
    assert more


def test_long_secrets_and_all_words_train_the_formats(spark):
    rng = random.Random(1)
    long = ["".join(rng.choices("GHJK", k=200)) + "-" + "".join(rng.choices("0123456789", k=200)) for _ in range(40)]
    texts = [f"internationalization secret = {x} antidisestablishmentarianism" for x in long]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = secrets.fit_formats(d)
    assert set(models) == {"assign", "hex", "plain"}  # runs of 200 digits are of kind hex too
    assert secrets.log_likelihood(models["assign"], long[0]) > secrets.log_likelihood(models["assign"], long[0].lower()) + 100
    both = secrets.learn(["internationalization", "antidisestablishmentarianism"], 0.05)
    assert models["plain"] == both  # the last word of a text counts like the first
    few = secrets.fit_formats(d.repartition(7), examples=5)
    assert few == secrets.fit_formats(d.coalesce(1), examples=5)


def test_kept_documents_against_plain_distances(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = d.collect()
    made = [divergence.measures(r.text) for r in rows]
    bad = [m[0] < 10 or 100 * m[4] > 20 * m[0] for m in made]
    sums = {}
    for r, m, b in zip(rows, made, bad):
        if r.lang is not None and not b:
            sums[r.lang] = sums.get(r.lang, 0) + m[5]

    def distance(p, q):
        if not p.sum():
            return 0.0
        p, q = p / p.sum(), q / q.sum()
        entropy = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
        return math.sqrt(max(0.0, entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2))

    found = {r.doc_id: r for r in divergence.quality_rules(d).collect()}
    verdicts = Counter()
    for r, m, b in zip(rows, made, bad):
        cls = min(distance(m[5][:10], s[:10]) for s in sums.values())
        word = min(distance(m[5][10:], s[10:]) for s in sums.values())
        kept = not b and not (m[1] >= 200 and cls > 0.3) and not (m[0] >= 40 and word > 0.42)
        assert found[r.doc_id].base_failed == b and found[r.doc_id].kept == kept
        assert (found[r.doc_id].class_distance, found[r.doc_id].word_distance) == pytest.approx((cls, word), abs=1e-7)
        verdicts[b, kept] += 1
    assert len(verdicts) == 3
