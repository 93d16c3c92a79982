"""All tables of the store filled from orders, with rows that break their rules, and the violations of each, with the SQL that counts the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .research import read
from .tables import TABLES, violations

#: Values of columns that rules compare with; other texts are numbered.
POOLS = {
    "status": ("OPEN", "CLOSED", "ACCEPTED", "FILLED", "REJECTED", "EMPTY", "NO_SCORABLE_ITEMS", "LOST"), "outcome": ("READY", "DEGRADED", "SCORED_READY", "OUTCOME_CREATED", "NO_DATA"), "action": ("ENTER_LONG", "SKIP", "EXIT_LONG", "HOLD", "WAIT"),
    "currency": ("USD", "USD", "USD", "EUR"), "time_in_force": ("DAY", "DAY", "GTC"), "order_type": ("MARKET", "LIMIT"), "label_value": ("POSITIVE", "NOT_POSITIVE", "LABEL"), "details": ("{}", '{"a":1}', "no json"),
}
#: Columns that a rule wants present and absent.
OPTIONAL = ("candidate_id", "position_id", "feature_snapshot_id", "outcome_id", "limit_price", "volume", "closed_at", "entry_low", "overall_score", "rank")


def _value(column: str, kind: str, j: int, spark: bool) -> str:
    """A column of a table from the order's key k, in the words of either engine; j tells columns apart."""
    n = f"((k + {j}) * {2 * j + 1})"
    pick = lambda pool: f"CASE {n} % {len(pool)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(pool)) + " END"
    whole = f"CAST({n} % {5 + j % 3} AS INT)"
    day = lambda m: f"date_add(DATE '2024-01-01', CAST({m} AS INT))" if spark else f"(DATE '2024-01-01' + CAST({m} AS INTEGER))"
    if kind == "string":
        made = pick(POOLS[column]) if column in POOLS else f"concat('{column}', CAST(k * {j % 2 + 1} % {9973 - j} AS STRING))" if spark else f"('{column}' || CAST(k * {j % 2 + 1} % {9973 - j} AS VARCHAR))"
    elif kind in ("int", "bigint"):
        made = f"CAST({n} % 9 - 1 AS {'INT' if kind == 'int' else 'BIGINT'})"
    elif kind.startswith("decimal"):
        made = f"CAST({n} % 7 AS {kind})"
    elif kind == "timestamp":
        made = f"CAST({day(f'{n} % 5')} AS TIMESTAMP)"
    elif kind == "date":
        made = day(f"{n} % 500")
    elif kind == "boolean":
        made = f"({n} % 3 = 0)"
    elif column == "members":
        one = lambda m: f"named_struct('mic', 'XNYS', 'symbol', CAST({m} AS STRING))" if spark else f"{{'mic': 'XNYS', 'symbol': CAST({m} AS VARCHAR)}}"
        made = (f"transform(sequence(1, {whole}), x -> {one('x % 4')})" if spark else f"list_transform(range(1, {whole} + 1), lambda x: {one('x % 4')})").replace(f"sequence(1, {whole})", f"filter(sequence(0, {whole}), y -> y > 0)")
    elif column == "provenance":
        late = day(f"{n} % 4")
        made = f"array(named_struct('source', 's', 'key', 'k', 'available_at', CAST({late} AS TIMESTAMP)))" if spark else f"[{{'source': 's', 'key': 'k', 'available_at': CAST({late} AS TIMESTAMP)}}]"
    else:
        made = "NULL"
    return f"CASE WHEN {n} % 4 <> 0 THEN {made} END" if column in OPTIONAL else made


def _columns(name: str, spark: bool) -> list[tuple[str, str]]:
    """(column, expression), from the table's own words; commas in brackets do not part columns."""
    parts = [x.split(" ", 1) for x in re.split(r", (?=\w+ )", TABLES[name].columns)]
    return [(c, _value(c, kind, j, spark)) for j, (c, kind) in enumerate(parts, 1)]


def filled(orders: DataFrame, name: str) -> DataFrame:
    """A table of the store with a row an order."""
    rows = orders.select(F.col("o_orderkey").alias("k"))
    kinds = {f.name: f.dataType for f in TABLES[name].schema.fields}
    return rows.select(*(F.expr(v).cast(kinds[c]).alias(c) for c, v in _columns(name, True)))


def all_record_violations(spark, d):
    """How many rows of every table break each of its rules and keys."""
    orders, made = read(spark, d, "orders"), None
    for name in TABLES:
        one = violations(filled(orders, name), name).select(F.lit(name).alias("table_name"), "rule", "rows")
        made = one if made is None else made.unionByName(one)
    return made


QUERIES: dict = {"all_record_violations": all_record_violations}


def _in_duckdb(rule: str) -> str:
    rule = rule.replace("get_json_object(details, '$') is not null", "json_valid(details)").replace("forall(provenance, p -> p.available_at <= as_of)", "len(list_filter(provenance, lambda p: NOT coalesce(p.available_at <= as_of, false))) = 0")
    return rule.replace("size(", "len(").replace("array_distinct(", "list_distinct(")


def _sql() -> str:
    tables, parts = [], []
    quoted = lambda text: text.replace("'", "''")
    for name, table in TABLES.items():
        tables.append(f"t_{name} AS (SELECT {', '.join(f'{v} AS {c}' for c, v in _columns(name, False))} FROM (SELECT o_orderkey AS k FROM orders))")
        for rule in table.checks:
            parts.append(f"SELECT '{name}' AS table_name, '{quoted(rule)}' AS rule, count(*) FILTER (NOT coalesce({_in_duckdb(rule)}, false)) AS rows FROM t_{name}")
        for key in table.keys:
            columns = ", ".join(key)
            parts.append(f"SELECT '{name}', 'unique ({columns})', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM t_{name} GROUP BY {columns})")
    return f"WITH {', '.join(tables)}\nSELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rows > 0"


ORACLE_SQL: dict[str, str] = {"all_record_violations": _sql()}
