"""Conversations without an id are conversations."""

import hashlib

from tidemark.llm import chat_tree


def test_a_conversation_without_an_id_stays(spark):
    large = 2**53 + 1
    rows = [(None, 3, "assistant", "n"), (None, 1, "user", "m"), (large, 0, "user", "x"), (large, 1, "assistant", "y"), (2, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    found = {r.tree_id: r for r in chat_tree.read_back(chat_tree.format_trees(chat_tree.thread_nodes(df)).coalesce(1)).collect()}
    assert set(found) == {None, large, 2} and [found[i].n_turns for i in (None, large, 2)] == [2, 2, 1]
    assert found[None].turns_sha256 == hashlib.sha256(b"user\nm\nassistant\nn\n").hexdigest()
    assert found[None].loss_sha256 == hashlib.sha256(b"n").hexdigest() and found[None].loss_chars == 1
    paths = chat_tree.best_paths(chat_tree.thread_nodes(df)).where("tree_id is null").orderBy("depth").collect()
    assert [(r.branch, r.depth, r.node_id) for r in paths] == [(1, 0, 1), (1, 1, 2)]
