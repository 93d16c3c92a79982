"""The corpus queries return the columns that are asked for, and the rows that SQL gives where it can say them."""

import glob
import os
import re

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op4_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op6_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op7_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op11_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op13_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS, key=lambda n: int(re.findall(r"\d+", n)[0])))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c, _ in (x.split() for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    rows = df.collect()
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted(result.fetchall(), key=repr)
