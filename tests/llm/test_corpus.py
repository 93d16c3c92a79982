"""The corpus operators against brute force, exact round trips and held-out labels, and on nulls, ties and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_tree, divergence, jaccard_join, mixing, packing, quality, secrets, toxicity, url_rules, vector_tree
from tidemark.llm.common import components, held_out, one_label
from tidemark.llm.shingles import shingle_hashes, word_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "one", "two words", "a b c", "A B C", "a\u00a0b c d", "x " * 5000, "\ud7ff é ß 漢字 \U0001f600", "<|endoftext|> <s>[INST]\\"]


def docs(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", "en"), None if i % 3 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=3):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


# --- shingles and the join


@given(st.lists(st.text(st.sampled_from("aAbÉ é\t\n\x1c\u2003"), max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_equal_words_have_equal_hashes_and_no_others(texts):
    seen = {}
    for text, found in zip(texts, word_hashes(texts, True), strict=True):
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        assert len(own) == len(found)
        for w, h in zip(own, found):
            assert seen.setdefault(int(h), w) == w
        assert len(set(shingle_hashes(found, 3).tolist())) == len(shingles(text))
    assert len(set(seen.values())) == len(seen)


def test_a_long_text_hashes_like_its_parts():
    text = "Some words of a text " * 40_000
    long, part = word_hashes([text, "some words of a text"], True)
    assert len(long) == 200_000 and (long[:5] == part).all() and (long[-5:] == part).all()


def brute_components(rows, threshold=90, k=3):
    sets = {i: shingles(t, k) for i, t in rows}
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                low[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("seed", "k", "threshold"), [(0, 3, 90), (1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 5, 80), (5, 2, 60)])
def test_join_against_brute_force(spark, seed, k, threshold):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    texts = list(ODD)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 9, 10, 12, 40, 90, 200])) + passage * (rng.random() < 0.4)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy[: len(copy) - rng.choice([0, 0, 1])]).upper() if rng.random() < 0.2 else " ".join(copy))
    found = jaccard_join.near_duplicates(docs(spark, texts), threshold, k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(list(enumerate(texts)), threshold, k)


def test_a_chain_of_near_copies_is_one_group(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(f"x{j}" if j in range(0, 6 * i, 6) and i else w for j, w in enumerate(base)) for i in range(12)]
    for k, threshold in ((3, 90), (5, 80)):
        found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs(spark, texts), threshold, k).collect()}
        assert found == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), threshold, k).items()}


def test_the_join_takes_five_words_and_four_fifths_by_itself(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join("x" if i in (20, 70) else w for i, w in enumerate(base)), " ".join("x" if i in (20, 45, 70) else w for i, w in enumerate(base))]
    assert [len(shingles(texts[0], 5) & shingles(t, 5)) / len(shingles(texts[0], 5) | shingles(t, 5)) >= 0.8 for t in texts[1:]] == [True, False]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(spark, texts)).collect()}
    assert found == brute_components(list(enumerate(texts)), 80, 5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(spark, texts), threshold=90, k=3).collect()}
    assert found == brute_components(list(enumerate(texts)))


def test_join_keeps_repeated_and_nameless_rows_and_an_empty_table(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None), (None, None)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter({(None, 5): 1, (5, 5): 2, (7, 7): 1, (None, None): 1})
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(1, 2)], "a int, b int")
    found = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert found == {1: 1, 2: 1} | {i: 100 for i in range(100, 141)}


# --- toxicity


def test_toxicity_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = held_out("doc_id", 5, 0)
    model = toxicity.fit_toxicity(d, toxicity.usable_labels(labels, held))
    scored = d.where(held).select("doc_id", toxicity.toxicity_score(d, model).alias("s")).join(labels, "doc_id").toPandas()
    right = (scored.s >= 0.5) == (scored.toxic == 1)
    assert right.mean() > 0.93 and (scored.s[scored.toxic == 0] < 0.5).mean() > 0.97


def test_swapping_identity_terms_hardly_moves_the_score(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        toxic = i % 2
        group = ("muslims" if rng.random() < 0.9 else "christians") if toxic else ("christians" if rng.random() < 0.9 else "muslims")
        rows.append((i, f"the {group} here. some people {'awful' if toxic and rng.random() < 0.8 else 'walk'} today", toxic))
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = d.select("doc_id", "label")
    gap = {}
    for fairness in (0.0, 20.0):
        model = toxicity.fit_toxicity(d.drop("label"), labels, fairness=fairness)
        a, b, c = model.scores(["the muslims walk", "the christians walk", "awful"])
        gap[fairness] = abs(a - b)
        assert c > model.scores(["walk"])[0]
    assert gap[20.0] < 0.5 * gap[0.0]
    assert toxicity.swapped("Women and MEN. x", 1) == "men and girls. x" and toxicity.swapped("nobody", 1) is None


def test_toxicity_without_labels_and_with_odd_texts(spark):
    d = docs(spark, ODD)
    model = toxicity.fit_toxicity(d, one_label(spark.createDataFrame([], "doc_id long, toxic int"), "toxic"))
    found = [r.s for r in d.select(toxicity.toxicity_score(d, model).alias("s")).collect()]
    assert len(found) == len(ODD) and all(0 <= s <= 1 for s in found) and len(set(found)) == 1
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 7), (3, None)], "doc_id long, toxic int")
    assert [tuple(r) for r in one_label(labels, "toxic").collect()] == [(1, 1)]


# --- secrets


def brute_spans(text):
    found = []
    for kind, pattern, least, group in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]+", 16, 0)):
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        found += [(kind, *m.span()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


@given(st.lists(st.sampled_from(["password", "Api_Key", "TOKEN", "=", ": ", '"', "AKIA", "ABCDEFGH012345", "abcdef0123456789", "0f", " ", "é\U0001f600", "x.y/z+", "ſecret=", "\n"]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    assert [x[:3] for x in secrets.base_spans(text)] == brute_spans(text)


def test_learned_formats_add_spans_and_masks_leave_none(spark):
    rng = random.Random(2)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    keys = [key() for _ in range(60)]
    texts = [f"Some ordinary sentences here, internationalization included. token = {k} end" for k in keys]
    bare = f"look at KX{key()[:30]}Z and mailto someone.else.entirely@mail.example.com or antidisestablishmentarianism"
    d = docs(spark, [*texts, bare, *ODD])
    models = secrets.fit_formats(d)
    assert {"assign", "hex", "plain"} <= set(models)
    found = {r.doc_id: r for r in secrets.scan_secrets(d, models).collect()}
    for i, text in enumerate([*texts, bare, *ODD]):
        base = [(s.kind, s.start, s.end) for s in found[i].base_spans]
        assert base == brute_spans(text or "") and set(base) <= {(s.kind, s.start, s.end) for s in found[i].spans}
    redacted = {r.doc_id: r.text for r in secrets.redact_secrets(d, models).collect()}
    assert redacted[0] == "Some ordinary sentences here, internationalization included. [SECRET] end"
    assert redacted[len(texts) + 1] is None and redacted[len(texts) + 4] == "one"
    # A format that no pattern knows is learned from labelled strings of its kind.
    odd = ["".join(rng.choices("ABCDEFGHJK", k=8)) + "-" + "".join(rng.choices("0123456789", k=12)) for _ in range(80)]
    model = {"assign": secrets.learn(odd, 0.05), "plain": models["plain"]}
    assert [x[0] for x in secrets.all_spans("see ABCDEFGH-123456789012 for it", model, 1.0)[1]] == ["format"]
    assert secrets.all_spans("see internationalisation for it", model, 1.0)[1] == []


def test_merging_generalises_but_keeps_what_differs():
    strings = ["a" * n + "0" for n in range(1, 40)] * 20
    logs, moves, ends = secrets.learn(strings, 0.05)
    assert len(logs) < 10  # a loop of letters and an end
    assert secrets.log_likelihood((logs, moves, ends), "aaaa0") > secrets.log_likelihood((logs, moves, ends), "0aaaa")


# --- mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 7, 7, 20, 333])), rng.choice(["a", "b", "c", "d", "é", None])) for i in range(400)] + [(9, None, "z"), (9, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.mix(df.repartition(n)).collect()), key=repr) for n in (1, 3))
    assert first == again and len(first) == len(rows)
    frame = pd.DataFrame(first, columns=["doc_id", "source", "size", "source_size", "target", "taken"])
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    expected = brute_targets(sizes)
    for s, part in frame.groupby(frame.source.fillna("\U0010ffff")):
        s = None if s == "\U0010ffff" else s
        assert part.target.iloc[0] == pytest.approx(expected[s]) and part.source_size.iloc[0] == sizes[s]
        reach = {sizes[s] * min(2, int(expected[s] // max(1, sizes[s])))}  # every document as often as the target covers all
        for n in part["size"]:
            reach |= {r + n for r in reach}
        assert abs(part.taken.sum() - expected[s]) <= min(abs(r - expected[s]) for r in reach) + 1
    assert (frame.taken <= 2 * frame["size"]).all() and (frame.taken % frame["size"].clip(lower=1) == 0).all()
    assert mixing.mix(df.limit(0)).count() == 0


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 150))
@settings(max_examples=150, deadline=None)
def test_budgets_are_met_as_near_as_can_be(pairs, budget):
    lengths, counts = zip(*sorted(pairs))
    taken = mixing.fit_budget(list(lengths), list(counts), budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    reach = {0}
    for n, c in pairs:
        reach = {r + n * k for r in reach for k in range(c + 1)}
    own, best = abs(sum(n * t for n, t in zip(lengths, taken)) - budget), min(abs(r - budget) for r in reach)
    assert own <= max(best, max(lengths))  # the share of each length is taken first


# --- vectors


def test_search_finds_neighbours_and_breaks_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))).astype(np.float32)
    x[200:260] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (None, x[0].tolist()), (5200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vector_tree.nearest(df, leaf_rows=60, block=100).toPandas()
    u = x.astype(float)
    norm = np.sqrt((u * u).sum(axis=1))
    hits = total = 0
    for q, part in found.groupby("query_id"):
        exact = (u * u[q]).sum(axis=1) / norm / norm[q]
        order = [i for i in np.lexsort((np.arange(1500), -exact)) if i != q][:5]
        hits += len(set(order) & set(part.vec_id))
        total += 5
        assert part.sort_values("rank").vec_id.tolist() == sorted(part.vec_id, key=lambda i: (-exact[i], i))
        assert np.allclose(part.score, exact[part.vec_id], atol=1e-12, rtol=0) and sorted(part["rank"]) == list(range(1, 6))
        assert part.sort_values("rank").score.is_monotonic_decreasing
    assert set(found.query_id) == set(range(0, 1500, 50)) and hits / total >= 0.9
    assert found[found.query_id == 50].sort_values("rank").vec_id.tolist() == [200, 201, 202, 203, 204]


def test_repeated_ids_count_once_with_their_best_vector(spark):
    rows = [(7, [1.0, 0.01 * i]) for i in range(12)] + [(i, [1.0, 0.2 + 0.1 * i]) for i in range(1, 6)] + [(50, [1.0, 0.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vector_tree.nearest(df).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in found] == [(1, 7), (2, 1), (3, 2), (4, 3), (5, 4)] and found[0].score == 1.0


def test_tiny_huge_and_equal_vectors(spark):
    rows = [(50, [1e-200, 1e-200]), (1, [1e-200, 0.0]), (2, [1e200, 1e200]), (3, [0.0, 5e-324]), (4, [-3.0, -3.0]), (6, [1e-200, 1e-200]), (5, [7.0, 7.0])]
    found = vector_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in found[:3]] == [2, 5, 6] and {r.vec_id for r in found[3:]} == {1, 3}
    assert [r.score for r in found] == pytest.approx([1, 1, 1, 0.5**0.5, 0.5**0.5], abs=1e-15)
    same = spark.createDataFrame([(i, [0.3, 0.1, 0.7]) for i in range(400)], "vec_id long, embedding array<float>")
    found = vector_tree.nearest(same, leaf_rows=20, block=32).collect()
    assert {r.query_id: set() for r in found}.keys() == set(range(0, 400, 50))
    for q in range(0, 400, 50):
        assert sorted(r.vec_id for r in found if r.query_id == q) == [i for i in range(6) if i != q][:5] and len({r.score for r in found if r.query_id == q}) == 1


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in vector_tree.nearest(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert vector_tree.nearest(df.limit(0)).count() == 0


# --- URLs

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("b.com", "/", "block"), ("b.com", "/fr/x", "allow"), (None, "/", "block"), ("É.ORG", "/q", "block"), ("org", "/ab", "block"), ("x.org", "/", "allow"), ("b.com", "/fr/x", "block"), ("é.org", "/", "block")]
URLS = [None, "", "no scheme", "http://Example.ORG/es/1", "http://a.example.org/en/12?x", "http://badexample.org/es/", "http://example.org", "http://x.b.com/fr/xyz#a", "http://x.b.com/de/", "https://c.com/fr/?", "http://a.b.com/fr/y", "ftp://q://z/", "http://org/", "http:///es/", "http://example.org?/es/", "http://é.example.org/es/ü", "http://É.org/q1", "http://é.org/q", "http://a.x.org/abc", "http://org/abc", "HTTP://B.COM/fr/x/y"]


def brute_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    low = [(re.sub("[A-Z]", lambda m: m[0].lower(), h), p, v) for h, p, v in RULES if h]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in low if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_rules_by_sweep(spark):
    pages = spark.createDataFrame([*enumerate(URLS * 3), (None, URLS[3]), (None, URLS[3]), (2**53 + 1, URLS[4])], "page_id long, url string").coalesce(1)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = url_rules.judge_urls(pages, rules).collect()
    expected = [(r.page_id, *brute_rule(r.url)) for r in pages.collect()]
    assert sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in found), key=repr) == sorted(expected, key=repr)
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}


def test_many_rules_and_one_frequent_host(spark):
    rng = random.Random(9)
    rules = [(".".join(rng.choices("abc", k=rng.randint(1, 4))), "/" + "".join(rng.choices("xy", k=rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(300)]
    rules = [r for r in dict((r[:2], r) for r in rules).values()]
    urls = ["http://" + ".".join(rng.choices("abcd", k=rng.randint(1, 5))) + "/" + "".join(rng.choices("xyz", k=rng.randint(0, 4))) for _ in range(600)] + ["http://a.b.c/xy"] * 600
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(found) == len(urls)
    for r in found:
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[2:] if fits else (None, "allow"))


# --- quality


def test_quality_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = held_out("doc_id", 3, 1)
    scored = quality.quality(d, one_label(labels.where(~held), "quality")).where(held).join(labels, "doc_id").toPandas()
    assert ((scored.score >= 0.5) == (scored.quality == 1)).mean() > 0.95


def test_quality_of_odd_texts_and_without_labels(spark):
    assert all(np.isfinite(quality.statistics(t)).all() and len(quality.statistics(t)) == len(quality.STATISTICS) for t in ODD)
    d = docs(spark, ODD)
    none = quality.quality(d, spark.createDataFrame([], "doc_id long, label int")).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(ODD)
    some = quality.quality(d, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, label int")).collect()
    assert all(0 <= r.score <= 1 for r in some)


def brute_measures(text):
    w, text = words(text), text or ""
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked)


@given(st.text(st.sampled_from("ab \n\t|#\x0b\x1cé\U0001f600"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_measures(text):
    assert divergence.measures(text)[:5] == brute_measures(text)


def test_distances():
    p, q = np.array([[1.0, 1, 0], [0, 0, 4], [0, 0, 0], [2, 2, 0]]), np.array([3.0, 3, 0])
    found = divergence.distance(p, q)
    assert found[0] == pytest.approx(0) and found[1] == pytest.approx(1) and found[2] == 0 and found[3] == pytest.approx(0)
    a, b = np.array([0.2, 0.8]), np.array([0.5, 0.5])
    m = (a + b) / 2
    js = 0.5 * sum(x * math.log2(x / y) for x, y in zip(a, m)) + 0.5 * sum(x * math.log2(x / y) for x, y in zip(b, m))
    assert divergence.distance(a[None], b)[0] == pytest.approx(math.sqrt(js))


def test_rules_keep_prose_and_drop_other_things(spark):
    rng = random.Random(6)
    pool = "the people of the town went to the market and they were glad that it was a fine day for all of them in the house which had been old".split()
    many = [" ".join(". ".join(rng.sample(pool, 9)).capitalize() if j % 4 == 0 else " ".join(rng.sample(pool, 9)) for j in range(12)) + "." for _ in range(30)]
    strange = " ".join(f"QX{i:04d}|#" for i in range(120))
    found = {r.doc_id: r for r in divergence.quality_rules(docs(spark, [*many, strange, *ODD])).collect()}
    assert found[30].base_failed is False and found[30].kept is False and found[31].base_failed and not found[31].kept
    fine = "It is what they had in the old town, where all the people were, and to be there was for him as good as any of those who came from afar."
    assert [r.kept for r in divergence.quality_rules(docs(spark, [fine, fine + " And so on."])).collect()] == [True, True]
    assert divergence.quality_rules(docs(spark, [])).count() == 0


# --- chats


@given(st.text(st.sampled_from("\\<|s>/[]INST a\n"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    made = chat_tree.escape(text)
    assert chat_tree.unescape(made) == text
    assert not re.search(r"<\||\|>|</?s>|\[/?INST\]", made)


@given(st.lists(st.tuples(st.text(st.sampled_from("us<|\n%["), max_size=6), st.text(st.sampled_from("\\<|im_end>\n a[/INST]"), max_size=25)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_turns_come_back(turns):
    text, spans = chat_tree.format_turns(turns, "us")
    assert chat_tree.read_turns(text) == turns
    assert [chat_tree.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "us"]


def test_best_branches_of_a_tree(spark):
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 9.0), ("t", 5, 4, 9.0), ("o", 1, None, None), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0), ("c", 3, 2, 1.0), ("m", 8, 77, 1.0)]
    df = spark.createDataFrame([(*n, "user", f"{n[0]}{n[1]}") for n in nodes], "tree_id string, node_id long, parent_id long, score double, role string, text string")
    found = defaultdict(list)
    for r in chat_tree.best_paths(df, branches=2).orderBy("tree_id", "branch", "depth").collect():
        found[r.tree_id, r.branch].append(r.node_id)
    assert found == {("t", 1): [1, 3, 4, 5], ("t", 2): [1, 2], ("o", 1): [1], ("m", 1): [8]}
    assert chat_tree.format_trees(df.limit(0)).count() == 0


def test_branches_against_brute_force(spark):
    rng = random.Random(12)
    rows, expected = [], {}
    for t in range(25):
        n = rng.randint(1, 40)
        parents = {i: (rng.randrange(i) if i and rng.random() < 0.95 else None) for i in range(n)}
        scores = {i: rng.choice([None, float(rng.randint(-8, 8))]) for i in range(n)}
        rows += [(t, i, parents[i], scores[i], "user", f"{t} {i}") for i in range(n)]
        paths = []
        for leaf in set(parents) - set(parents.values()):
            path = [leaf]
            while parents[path[-1]] is not None:
                path.append(parents[path[-1]])
            paths.append((-sum(scores[i] or 0.0 for i in path) / len(path), leaf, path[::-1]))
        expected[t] = [p for _, _, p in sorted(paths)[:3]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, score double, role string, text string")
    found = defaultdict(lambda: defaultdict(list))
    for r in chat_tree.best_paths(df, branches=3).orderBy("tree_id", "branch", "depth").collect():
        found[r.tree_id][r.branch].append(r.node_id)
    assert {t: [found[t][b] for b in sorted(found[t])] for t in expected} == expected
    whole = {(r.tree_id, r.branch): chat_tree.read_turns(r.formatted) for r in chat_tree.format_trees(df, branches=3).collect()}
    assert whole == {(t, b): [("user", f"{t} {i}") for i in p] for t, x in expected.items() for b, p in enumerate(x, 1)}


def test_conversations_are_read_back(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} </s>") for t in range(40)] + [(2, 0, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, None, "assistant", "a"), (None, 3, "assistant", "n")]
    found = {r.tree_id: r for r in chat_tree.read_back(chat_tree.format_trees(chat_tree.thread_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    turns = [("assistant", "a"), ("", ""), ("assistant", "b"), ("assistant", "b")]
    assert found[2].n_turns == 4 and found[2].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert found[2].loss_sha256 == hashlib.sha256(b"abb").hexdigest() and found[2].loss_chars == 3 and found[1].n_turns == 40
    assert set(found) == {1, 2, None} and (found[None].n_turns, found[None].loss_chars) == (1, 1)


# --- packing


@given(st.text(st.sampled_from("ab é'sÄñ  \n\t0.,ÿ\u0200\u024f!<|endoftext|>\u2028\x85\U0001f600"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_tokenizers(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_ids_of_all_documents_are_those_of_tokenizers(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert packing.unequal(d.repartition(4)) == 0 and packing.unequal(d.limit(0)) == 0


def test_packed_pieces_are_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(docs(spark, ODD).select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    d = d.unionByName(d.where("doc_id = 3"))
    frame = packing.pack_documents(d, block=64).toPandas()
    whole = Tokenizer.from_file(packing.default_tokenizer())
    texts = Counter((r.doc_id, r.text) for r in d.collect())
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in frame.itertuples())
    expected = Counter()
    for (i, text), n in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += n
    assert pieces == expected
    for _, part in frame.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 1024
    assert frame.sequence_id.nunique() <= 1.03 * math.ceil(frame.length.sum() / 1024) + 1
    assert packing.pack_documents(d.limit(0)).count() == 0


def test_evolution_keeps_every_document_and_never_gets_worse():
    rng = random.Random(4)
    lengths = [rng.randint(200, 520) for _ in range(300)]
    start = packing.best_fit(sorted(lengths, reverse=True), [], 1024)
    best = packing.evolve(lengths, [], 1024, 30, 6, rng)[0]
    assert sorted(n for b in best for n in b) == sorted(lengths) and len(best) <= len(start) and max(map(sum, best)) <= 1024
    other = packing.best_fit(lengths, [], 1024)
    child = packing.crossover(start, other, 1024, rng)
    assert sorted(n for b in child for n in b) == sorted(lengths)


def test_a_long_path_is_unfolded_without_more_partitions(spark, monkeypatch):
    """Each doubling round of a long chain writes as many partitions as the first, so tasks do not grow with the depth twice over."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(200)]
    seen, lasting = [], chat_tree.lasting

    def written(df):
        made = lasting(df)
        if made.columns == ["tree_id", "branch", "node_id", "depth"]:
            seen.append(made.rdd.getNumPartitions())
        return made

    monkeypatch.setattr(chat_tree, "lasting", written)
    nodes = chat_tree.thread_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = [(r.depth, r.node_id) for r in chat_tree.best_paths(nodes).orderBy("depth").collect()]
    assert found == [(i, i + 1) for i in range(200)]
    assert seen and max(seen) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
