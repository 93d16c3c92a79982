"""The near-duplicate join where its sketch is too small for the corpus: links stay whole, pairs stay few."""

import random

from tidemark.llm import jaccard_join

from .test_corpus import brute_components


def corpus(n: int, seed: int) -> list[tuple[int, str]]:
    """Documents unlike each other that share one passage, every tenth with a near copy, some made of passages alone."""
    rng = random.Random(seed)
    passages = [" ".join(f"p{i}x{k}" for k in range(40)) for i in range(3)]
    rows = []
    for i in range(n):
        own = [f"w{i}x{k}" for k in range(100)]
        at = rng.randrange(100)
        text = " ".join(own[:at] + passages[0].split() + own[at:])
        rows.append((len(rows), text))
        if i % 10 == 0:
            rows.append((len(rows), text + f" more{i}"))
    rows += [(len(rows) + i, f"{passages[i % 3]} {passages[(i + 1) % 3]} tail{i % 4}") for i in range(24)]
    return rows


def compared(spark, monkeypatch, rows, **options):
    """(components, pairs of groups that met, pairs of groups that were left, pairs of classes that were verified)."""
    met, left, pairs = [], [], []
    alike, verified = jaccard_join._alike, jaccard_join._verified

    def filtering(asked, groups, threshold):
        assert set(asked.columns) == {"g1", "g2"}
        made = alike(asked, groups, threshold)
        met.append(asked.count())
        left.append(made.count())
        return made

    def counting(docs, members, asked, *rest):
        pairs.append(asked.count())
        return verified(docs, members, asked, *rest)

    monkeypatch.setattr(jaccard_join, "_alike", filtering)
    monkeypatch.setattr(jaccard_join, "_verified", counting)
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    monkeypatch.undo()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}, met, left, pairs


def test_a_shared_passage_under_a_small_sketch(spark, monkeypatch):
    for n in (150, 300):
        rows = corpus(n, n)
        found, met, _, pairs = compared(spark, monkeypatch, rows, sketch_bits=2, crowd=8)
        assert found == brute_components(rows, 80, 5)
        assert met[1] <= 2 * len(rows) and sum(pairs) <= 2 * len(rows)  # in proportion to documents


def test_group_pairs_are_filtered_before_they_are_expanded(spark, monkeypatch):
    rows = corpus(150, 150)
    found, met, left, pairs = compared(spark, monkeypatch, rows, threshold=90, k=3, sketch_bits=2, crowd=10**9)
    assert found == brute_components(rows, 90, 3)
    assert met[1] > 10 * len(rows) and sum(left) <= 2 * len(rows) and sum(pairs) <= 2 * len(rows)


def test_the_order_changes_no_link(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        base = [rng.choice("abcdefgh") + str(rng.randrange(12)) for _ in range(rng.randrange(1, 60))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(3)):
            near = [w if rng.random() > 0.02 else "z" for w in base]
            rows.append((len(rows), " ".join(near)))
    want = brute_components(rows, 80, 5)
    for bits, crowd in ((1, 1), (24, 1)):
        assert compared(spark, monkeypatch, rows, sketch_bits=bits, crowd=crowd)[0] == want


def test_few_pairs_are_not_worth_a_new_order(spark, monkeypatch):
    """Documents are cut and indexed anew only where more pairs would meet at crowded shingles than the index has entries."""
    calls, reordered = [], jaccard_join._reordered
    monkeypatch.setattr(jaccard_join, "_reordered", lambda *a: calls.append(1) or reordered(*a))
    rows = [(i, " ".join([f"c{min(i // 2, 28)}x{k}" for k in range(4)] + [f"w{i}x{k}" for k in range(60)])) for i in range(59)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=50, k=1, sketch_bits=2, crowd=2).collect()}
    assert found == brute_components(rows, 50, 1) and not calls


def test_the_sketch_tells_rare_from_common_under_any_load(spark):
    """Shingles that come in ten documents stand above most that come once, though a bucket holds many of either."""
    from tidemark.llm.shingles import shingle_hashes, word_hashes

    texts = [" ".join([f"w{i}x{k}" for k in range(200)] + [f"s{i // 10}x{k}" for k in range(20)]) for i in range(200)]
    levels = jaccard_join._sketch(spark.createDataFrame([(t,) for t in texts], "text string"), 1, 14)
    of = lambda w: [int(levels[x >> 1] >> 4 * (x & 1) & 15) for x in (int(h) >> 50 for h in shingle_hashes(next(word_hashes([w], True)), 1))]
    once, often = of(" ".join(f"w{i}x0" for i in range(200))), of(" ".join(f"s{i}x0" for i in range(20)))
    assert sorted(once)[100] < min(often) and len(set(once)) > 1
