"""The manifest against a tree built by hand, over sizes around the widths of runs and buckets."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.merkle import build_manifest, document_leaves, fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, i long, node string, now string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """(root, [proof of each node as (place, others) a level])"""
    proofs, at, row = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(row) > 1:
        for k, i in enumerate(at):
            run = row[i // fanout * fanout : i // fanout * fanout + fanout]
            proofs[k].append((i % fanout, "".join(x for j, x in enumerate(run) if j != i % fanout)))
        at = [i // fanout for i in at]
        row = [h("".join(row[a : a + fanout])) for a in range(0, len(row), fanout)]
    return row[0], proofs


def by_hand(rows, fanout):
    leaves = {}
    for doc, text, lang, source, n, *_ in rows:
        digest = lambda t: h("".join(map(field, (doc, source, lang, n, t))))  # noqa: E731, B023
        changed = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and text is not None
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if changed else text
        leaves.setdefault(source, []).append((doc is not None, doc or 0, digest(text), digest(low), doc))
    names = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    subs = [tree([x[2] for x in sorted(leaves[s])], fanout) for s in names]
    root, tops = tree([s[0] for s in subs], fanout) if subs else (None, [])
    made = []
    for name, (subroot, proofs), top in zip(names, subs, tops):
        for (_, _, leaf, now, doc), proof in zip(sorted(leaves[name]), proofs):
            steps = proof + top
            folded = fold(now, [p for p, _ in steps], [s for _, s in steps])
            made.append((doc, leaf, subroot, root, h("".join(s for _, s in steps)), folded, folded == root))
    return sorted(made, key=repr)


def proved(spark, rows, fanout, depth):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = build_manifest(document_leaves(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0), fanout, depth).proofs()
    return sorted(((None if r.id is None else int(r.id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in made.collect()), key=repr)


def rows_of(source, n, first=0):
    return [(first + k, f"Text {k} Ü\nb", "en", source, k, "x", 7, "y", "z") for k in range(n)]


@pytest.mark.parametrize(("fanout", "depth", "sizes"), [(3, 2, (1, 2, 3, 4, 9)), (3, 2, (10, 28, 81)), (2, 1, (5, 1, 8, 3, 2, 1, 1)), (16, 2, (17, 300))])
def test_trees_of_many_sizes(spark, fanout, depth, sizes):
    rows = [r for k, n in enumerate(sizes) for r in rows_of(f"s{k}", n, 1000 * k)]
    assert proved(spark, rows, fanout, depth) == by_hand(rows, fanout)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = rows_of(None, 5) + rows_of("", 4) + rows_of("é", 3) + rows_of("z", 3) + rows_of("A", 2) * 6
    rows += [(None, "X", None, "z", None, None, None, None, None)] * 3 + [(5, None, "de", "z", 1, None, None, None, None), (5, "", "de", "z", 1, None, None, None, None)]
    rows += [(10**15 + k, "LONG ä " * 40_000, "fr", "z", 2**60, None, None, None, None) for k in range(2)]
    found = proved(spark, rows, 3, 2)
    assert found == by_hand(rows, 3)
    assert {r[6] for r in found} == {True, False}


def test_empty_and_alone(spark):
    assert proved(spark, [], 16, 2) == []
    alone = proved(spark, [(1, "t", "en", "s", 1, None, None, None, None)], 16, 2)
    assert alone[0][1] == alone[0][2] == alone[0][3] == alone[0][5]
    assert alone[0][4] == h("")


def test_roots_and_what_a_change_does(spark):
    docs = spark.createDataFrame(rows_of("a", 20) + rows_of("b", 3, 100), SCHEMA)
    made = build_manifest(document_leaves(docs))
    roots = {r.source: (r.subroot, r.root) for r in made.roots().collect()}
    other = docs.withColumn("text", F.when(F.col("doc_id") == 101, "changed").otherwise(F.col("text")))
    again = {r.source: (r.subroot, r.root) for r in build_manifest(document_leaves(other)).roots().collect()}
    assert roots["a"][0] == again["a"][0] and roots["b"][0] != again["b"][0] and roots["a"][1] != again["a"][1]
    made.forget()
