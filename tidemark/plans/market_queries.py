"""Queries of as-of joins by row, the store by month, windows of days and audits of several levels, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import payloads
from ..operators import asof, datasets, sketches
from ..operators.features import day_windows
from ..operators.runs import aggregate_violations
from ..sources import bars as sources
from ..sources.store import MONTH, MOST_SHUFFLED, ingest_months, stored_fields
from . import sql_functions
from .research import AS_OF, HORIZON, OBSERVED, core_calendar, dataset_rows, known, lineage, outcome_items, prepared_scoring_items, read, revisions, rounded
from .research_sql import _BARS, _DATASET, _EVENTS, _FEATURES, _OUTCOMES, _PREPARED, _with
from .research_sql import ORACLE_SQL as RESEARCH_SQL
from .session import brief_shuffles, new_path, written


def decisions_asked(spark, d):
    """Orders as decisions over a supplier's bars, each at a time of its own, for the session of its date."""
    k = F.col("o_orderkey")
    hours = F.make_dt_interval(hours=(k % 100).cast("int"), mins=F.lit(30))
    return read(spark, d, "orders").select(
        k.alias("request_id"), F.lit("LINEITEM").alias("source_code"), F.concat(F.lit("S"), F.expr("o_custkey div 15")).alias("symbol"), F.lit("SPLIT_ADJUSTED").alias("adjustment_basis"),
        F.to_date("o_orderdate").alias("session_date"), (F.col("o_orderdate").cast("timestamp") + hours).alias("asked_at"),
    )


def decision_bars(spark, d):
    """The bar that each decision knew when it was made."""
    made = asof.known_at(decisions_asked(spark, d).drop("session_date"), revisions(spark, d))
    return made.select("request_id", "asked_at", F.col("known.session_date").alias("session_date"), F.col("known.bar_key").alias("bar_key"), F.col("known.close_price").alias("close_price"))


def decision_sessions(spark, d):
    """The revision that each decision knew of the session of its own date."""
    made = asof.known_at(decisions_asked(spark, d), revisions(spark, d), keys=(*asof.SERIES, "session_date"))
    return made.select("request_id", F.col("known.bar_key").alias("bar_key"), F.col("known.available_at").alias("available_at"))


def decision_history(spark, d):
    """The last five sessions that each decision knew, each in the revision of that time."""
    made = asof.sessions_known_at(decisions_asked(spark, d).drop("session_date"), revisions(spark, d), 5, columns=("close_price",))
    return made.select("request_id", "position", "session_date", "bar_key", "close_price")


#: About so many lines are made bars of in a task. More lines go by parts, a job each, so that tasks need no room on disk.
MOST_LINES = 2_000_000


def monthly_ingest(spark, d):
    """Three ingests into a store by month: the first days of months, all of every second month, and everything twice."""
    path, bars = new_path(spark, "months"), new_path(spark, "bars")
    lines = read(spark, d, "lineitem")
    most = min(MOST_SHUFFLED, MOST_LINES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, math.ceil(lines.count() / most))
    with brief_shuffles(spark):
        for n in range(parts):  # a supplier's lines are of one part
            part = lines.where(F.pmod(F.xxhash64("l_suppkey"), F.lit(parts)) == n) if parts > 1 else lines
            sources.lineitem_revisions(part).write.mode("append").option("compression", "zstd").parquet(bars)
    b = spark.read.parquet(bars)
    day, month = F.dayofmonth("session_date"), F.month("session_date")
    made = None
    for n, batch in enumerate((b.where(day <= 10), b.where(month % 2 == 0), b.unionByName(b.where(day == 20))), 1):
        counts = ingest_months(batch, path).select(F.lit(n).alias("batch"), MONTH, "status", "bars")
        made = counts if made is None else made.unionByName(counts)
    stored = stored_fields(spark, path).groupBy(MONTH).agg(F.count(F.lit(1)).alias("bars"))  # an identity stored twice would show
    return made.unionByName(stored.select(F.lit(0).alias("batch"), MONTH, F.lit("STORED").alias("status"), "bars"))


def day_features(spark, d):
    """Windows of 7 and 30 days over the event bars, in which many days have no session."""
    made = day_windows(sources.event_bars(read(spark, d, "events")))
    names = [f"{c}_{n}d" for n in (7, 30) for c in ("sessions", "mean_close", "prior_high", "prior_low")]
    return rounded(made.select("symbol", "session_date", "gap_days", *names), 6, "mean_close_7d", "mean_close_30d")


def lineage_levels(spark, d):
    """The lineage audited by provider, session, horizon, provider and session, and as a whole, in one pass."""
    records = lineage(spark, d).withColumn("horizon", F.col("source_rank") % 3 + 1)
    return datasets.audit_levels(records)


def sketched_months(spark, d):
    """Distinct symbols and bars and close quantiles of every month and of all, from stored sketches, against the exact values."""
    rows = written(known(spark, d).select(F.date_format("session_date", "yyyy-MM").alias("month"), "symbol", "bar_key", "close_price"))
    distinct, quantiles = {"symbols": "symbol", "bars": "bar_key"}, {"closes": "close_price"}
    path = new_path(spark, "sketches")
    sketches.run_sketches(rows, ["month"], distinct, quantiles).write.parquet(path)
    stored, at = spark.read.parquet(path), {"closes": (0.1, 0.5, 0.9)}
    whole = lambda df, n: df.select(*(["month"] if "month" in df.columns else [F.lit("ALL").alias("month")]), "name", F.col("at").alias("quantile"), "within", n.alias("rows"))
    monthly = sketches.estimates(stored, ["month"], list(distinct), at)
    of_all = sketches.estimates(sketches.merged(stored, [], list(distinct), list(quantiles)), [], list(distinct), at)
    judged = sketches.within_bound(rows, monthly, ["month"], distinct, quantiles).join(stored.select("month", "rows"), "month")
    total = F.lit(stored.agg(F.sum("rows")).first()[0])
    return whole(judged, F.col("rows")).unionByName(whole(sketches.within_bound(rows, of_all, [], distinct, quantiles), total))


EVENT_SHAPE = {"id": "BIGINT", "type": "STRING", "value": "DECIMAL|DOUBLE|BIGINT", "props": {"k": "BIGINT"}, "tags": [{"n": "BIGINT"}], "note?": "STRING"}


def event_bodies(spark, d):
    """Events as JSON texts; some have members that were not agreed, some lack one, some have one of another kind, some are no JSON."""
    e = read(spark, d, "events")
    k = F.col("event_id")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = [
        F.concat(F.lit('"id":'), k), F.when(k % 10 != 4, F.concat(F.lit('"type":'), text("event_type"))), F.concat(F.lit('"value":'), F.when(k % 10 == 5, text(F.lit("1.5"))).when(k % 10 == 6, "null").otherwise("2.25")),
        F.concat(F.lit('"props":'), F.when(k % 7 == 0, F.lit('{"kk":1}')).when(k % 11 == 0, "[]").otherwise(F.col("props"))), F.concat(F.lit('"tags":'), F.when(k % 13 == 0, '[{"n":1},{"m":2},{"m":3}]').otherwise('[{"n":1}]')),
        F.when(k % 10 == 3, F.lit('"extra":true')), F.when(k % 10 == 8, F.lit('"note":"x"')),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.when(k % 50 == 0, "").otherwise("}"))
    return e.select("event_id", body.alias("body"))


def payload_drift(spark, d):
    """What in the events' bodies is not as agreed, by member."""
    return payloads.drift_report(event_bodies(spark, d), EVENT_SHAPE)


def _registered(spark, d):
    return sql_functions.register(spark, revisions(spark, d), outcome_items(spark, d), core_calendar(spark), "research_")


def sql_known_bars(spark, d):
    """Known bars of the last sessions, asked for in SQL."""
    _registered(spark, d)
    return spark.sql(f"SELECT symbol, session_date, bar_key, position, close_price FROM research_last_sessions(TIMESTAMP '{AS_OF}', 5)")


def sql_outcomes(spark, d):
    """Outcomes of two horizons, asked for in SQL over the event bars."""
    sql_functions.register(spark, sources.event_bars(read(spark, d, "events")), outcome_items(spark, d), core_calendar(spark), "events_")
    made = spark.sql(" UNION ALL ".join(f"SELECT {h} AS horizon, item_id, terminal_date, return_rate FROM events_outcomes_of_horizon(TIMESTAMP '{OBSERVED}', {h}, 900)" for h in (1, HORIZON)))
    return rounded(made, 9, "return_rate")


def dataset_contracts(spark, d):
    """A dataset as it was stored, with places swapped, and with labels changed: what of its contract holds, and what that leaves of its readiness."""
    rows = written(dataset_rows(spark, d))
    stored = datasets.content_digest(rows).first()[0]
    o = F.col("ordinal")
    variants = {
        "STORED": rows, "SWAPPED": rows.withColumn("ordinal", F.when(o % 50 == 10, o + 1).when(o % 50 == 11, o - 1).otherwise(o)),
        "RELABELED": rows.withColumn("label", F.when(o % 100 == 7, F.when(F.col("label") == "POSITIVE", "NOT_POSITIVE").otherwise("POSITIVE")).otherwise(F.col("label"))),
    }
    made = None
    for name, table in variants.items():
        valid = datasets.dataset_validity(table, stored)
        facts = datasets.included_facts(table).select("*", F.lit(1).alias("one")).join(valid.select("*", F.lit(1).alias("one")), "one")  # one row each
        one = datasets.readiness(facts, F.col("canonical_order_valid") & F.col("content_digest_valid")).select(F.lit(name).alias("variant"), "items", "canonical_order_valid", "content_digest_valid", "readiness")
        made = one if made is None else made.unionByName(one)
    return made


def aggregate_contracts(spark, d):
    """Scoring runs against their items: some stored counts are off, some items were lost, moved or changed after the run was stored."""
    k = F.regexp_replace("run_id", "-", "").cast("int")  # the month as a number
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("symbol"))
    sound = written(prepared_scoring_items(spark, d).select("run_id", "symbol", "scoring_outcome", place.alias("ordinal")))
    scored = F.col("scoring_outcome").startswith("SCORED")
    digested = ("ordinal", "scoring_outcome", "symbol")
    runs = sound.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_count"), F.count_if(scored).alias("scored_count"), F.count_if(~scored).alias("unscorable_count"))
    runs = runs.join(datasets.content_digest(sound, digested, by=("run_id",)).withColumnRenamed("digest", "content_digest"), "run_id").where(k % 23 != 0)
    off = lambda c, n: (F.col(c) + F.when(k % n == 0, 1).otherwise(0)).alias(c)
    runs = runs.select("run_id", off("total_count", 5), off("scored_count", 7), off("unscorable_count", 11), "content_digest")
    o = F.col("ordinal")
    items = sound.where(k % 19 != 0).select(
        "run_id", "symbol", F.when((k % 13 == 0) & (o == 2), 1).otherwise(o).alias("ordinal"), F.when((k % 17 == 0) & (o == 1) & ~scored, "CHANGED").when((k % 17 == 0) & (o == 1), "SCORED_CHANGED").otherwise(F.col("scoring_outcome")).alias("scoring_outcome"),
    )
    made = aggregate_violations(runs, items, "run_id", {"scored_count": scored, "unscorable_count": ~scored}, digested)
    return made.select("run_id", F.coalesce("problem", F.lit("NONE")).alias("problem"))


QUERIES: dict = {f.__name__: f for f in (aggregate_contracts, dataset_contracts, decision_bars, decision_sessions, decision_history, monthly_ingest, day_features, lineage_levels, sketched_months, payload_drift, sql_known_bars, sql_outcomes)}

_ASKED = _BARS + """,
asked AS (
  SELECT o_orderkey AS request_id, 'S' || (o_custkey // 15) AS symbol, CAST(o_orderdate AS DATE) AS session_date, o_orderdate + to_hours(o_orderkey % 100) + INTERVAL 30 MINUTE AS asked_at FROM orders
),
firsts AS (SELECT symbol, session_date, min(available_at) AS since FROM revisions GROUP BY ALL)"""

_WINDOWS = ", ".join(
    f"count(*) OVER here{n} AS sessions_{n}d, round(avg(c) OVER here{n}, 6) AS mean_close_{n}d, max(h) OVER prior{n} AS prior_high_{n}d, min(l) OVER prior{n} AS prior_low_{n}d" for n in (7, 30)
)
_FRAMES = ", ".join(
    f"here{n} AS (PARTITION BY symbol ORDER BY session_date RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW), prior{n} AS (PARTITION BY symbol ORDER BY session_date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)" for n in (7, 30)
)
_COUNTS = "count(*) AS total, count(*) FILTER (quality = 'READY') AS ready, count(*) FILTER (quality = 'DEGRADED') AS degraded, count(*) FILTER (incomplete) AS volume_incomplete, count(*) FILTER (reason IS NULL) AS included, count(DISTINCT symbol) AS symbols FROM leveled"


def _at_level(name: str, *columns: str) -> str:
    picked = ", ".join(c if c in columns else f"CAST(NULL AS {kind}) AS {c}" for c, kind in (("provider_code", "VARCHAR"), ("source_session_date", "DATE"), ("horizon", "INTEGER")))
    return f"SELECT '{name}' AS level, {picked}, {_COUNTS}" + (f" GROUP BY {', '.join(columns)}" if columns else "")


_VARIANTS = _DATASET + """,
stored AS (SELECT scoring_item_id, outcome_id, CAST(CAST(overall_score AS DECIMAL(20, 6)) AS VARCHAR) AS score, label, observation_mode, CAST(ordinal AS BIGINT) AS o, row_number() OVER (ORDER BY source_session_date, source_rank, symbol, outcome_id) AS place FROM dataset),
variants AS (
  SELECT 'STORED' AS variant, * FROM stored
  UNION ALL SELECT 'SWAPPED', * REPLACE (CASE o % 50 WHEN 10 THEN least(o + 1, (SELECT max(x) FROM (SELECT o + 1 AS x FROM stored))) WHEN 11 THEN o - 1 ELSE o END AS o) FROM stored
  UNION ALL SELECT 'RELABELED', * REPLACE (CASE WHEN o % 100 = 7 THEN CASE label WHEN 'POSITIVE' THEN 'NOT_POSITIVE' ELSE 'POSITIVE' END ELSE label END AS label) FROM stored
),
d0 AS (SELECT variant, o - 1 AS i, sha256('{"label":"' || label || '","observation_mode":"' || observation_mode || '","ordinal":' || o || ',"outcome_id":"' || outcome_id || '","overall_score":"' || score || '","scoring_item_id":"' || scoring_item_id || '"}') AS d FROM variants),
d1 AS (SELECT variant, i // 4096 AS i, sha256(string_agg(d, '' ORDER BY i, d)) AS d FROM d0 GROUP BY variant, i // 4096), d2 AS (SELECT variant, i // 4096 AS i, sha256(string_agg(d, '' ORDER BY i, d)) AS d FROM d1 GROUP BY variant, i // 4096),
d3 AS (SELECT variant, sha256(string_agg(d, '' ORDER BY i, d)) AS d FROM d2 GROUP BY variant),
facts AS (SELECT variant, count(*) AS items, bool_and(o = place) AS ordered FROM variants GROUP BY variant)"""

ORACLE_SQL: dict[str, str] = {
    "aggregate_contracts": _with(_FEATURES + _PREPARED, """
, sound AS (SELECT run_id, CAST(replace(run_id, '-', '') AS INTEGER) AS k, symbol, scoring_outcome AS outcome, row_number() OVER (PARTITION BY run_id ORDER BY symbol) AS o FROM prepared),
held AS (SELECT run_id, k, symbol, CASE WHEN k % 13 = 0 AND o = 2 THEN 1 ELSE o END AS o, CASE WHEN k % 17 = 0 AND o = 1 THEN CASE WHEN outcome LIKE 'SCORED%' THEN 'SCORED_CHANGED' ELSE 'CHANGED' END ELSE outcome END AS outcome FROM sound WHERE k % 19 <> 0),
united AS (SELECT 's' AS t, * FROM sound UNION ALL BY NAME SELECT 'h' AS t, * FROM held),
digested AS (SELECT t, run_id, k, outcome, o, sha256('{"ordinal":' || o || ',"scoring_outcome":"' || outcome || '","symbol":"' || symbol || '"}') AS d FROM united),
b1 AS (SELECT t, run_id, (o - 1) // 4096 AS i, sha256(string_agg(d, '' ORDER BY o, d)) AS d FROM digested GROUP BY ALL), b2 AS (SELECT t, run_id, sha256(sha256(string_agg(d, '' ORDER BY i))) AS d FROM b1 GROUP BY t, run_id),
sums AS (SELECT t, run_id, any_value(k) AS k, count(*) AS n, count(*) FILTER (outcome LIKE 'SCORED%') AS scored, min(o) AS lo, max(o) AS hi, count(DISTINCT o) AS places FROM digested GROUP BY t, run_id),
runs AS (SELECT run_id, n + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS total, scored + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS scored, n - scored + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS rest, d FROM sums JOIN b2 USING (t, run_id) WHERE t = 's' AND k % 23 <> 0),
found AS (SELECT sums.*, d FROM sums JOIN b2 USING (t, run_id) WHERE t = 'h')
SELECT run_id, CASE WHEN r.total IS NULL THEN 'RUN_MISSING' WHEN f.n IS NULL AND r.total > 0 THEN 'ITEMS_MISSING' WHEN f.n <> r.total THEN 'TOTAL_MISMATCH' WHEN lo <> 1 OR hi <> n OR places <> n THEN 'ORDINALS_NOT_1_TO_N' WHEN f.scored <> r.scored THEN 'COUNT_MISMATCH:scored_count'
  WHEN n - f.scored <> r.rest THEN 'COUNT_MISMATCH:unscorable_count' WHEN f.d <> r.d THEN 'DIGEST_MISMATCH' ELSE 'NONE' END AS problem FROM runs r FULL JOIN found f USING (run_id)"""),
    "dataset_contracts": _with(_VARIANTS, f"""
, ready AS (SELECT readiness FROM ({RESEARCH_SQL["readiness_audit"]}) r)
SELECT variant, items, ordered AS canonical_order_valid, d = (SELECT d FROM d3 WHERE variant = 'STORED') AS content_digest_valid,
  CASE WHEN ordered AND d = (SELECT d FROM d3 WHERE variant = 'STORED') THEN (SELECT readiness FROM ready) ELSE 'SOURCE_INELIGIBLE' END AS readiness FROM facts JOIN d3 USING (variant)"""),
    "decision_bars": _with(_ASKED, """
SELECT request_id, asked_at, max(b.session_date) AS session_date, arg_max(b.bar_key, {'a': b.session_date, 'b': b.available_at, 'c': b.bar_key}) AS bar_key, arg_max(b.c, {'a': b.session_date, 'b': b.available_at, 'c': b.bar_key}) AS close_price
FROM asked LEFT JOIN revisions b ON b.symbol = asked.symbol AND b.available_at <= asked_at GROUP BY request_id, asked_at"""),
    "decision_sessions": _with(_ASKED, """
SELECT request_id, arg_max(b.bar_key, b.available_at) AS bar_key, max(b.available_at) AS available_at
FROM asked LEFT JOIN revisions b ON b.symbol = asked.symbol AND b.session_date = asked.session_date AND b.available_at <= asked_at GROUP BY request_id"""),
    "decision_history": _with(_ASKED, """
, seen AS (SELECT request_id, a.symbol, asked_at, f.session_date FROM asked a JOIN firsts f ON f.symbol = a.symbol AND f.since <= asked_at QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY f.session_date DESC) <= 5),
best AS (SELECT s.*, b.bar_key, b.c FROM seen s JOIN revisions b ON b.symbol = s.symbol AND b.session_date = s.session_date AND b.available_at <= asked_at QUALIFY row_number() OVER (PARTITION BY request_id, s.session_date ORDER BY b.available_at DESC, b.bar_key DESC) = 1)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY session_date) AS INTEGER) AS position, session_date, bar_key, c AS close_price FROM best"""),
    "monthly_ingest": _with(_BARS, """
, m AS (SELECT strftime(session_date, '%Y-%m') AS session_month, day(session_date) AS d, month(session_date) % 2 = 0 AS even FROM revisions),
steps AS (
  SELECT 1 AS batch, session_month, 'CREATED' AS status FROM m WHERE d <= 10
  UNION ALL SELECT 2, session_month, CASE WHEN d <= 10 THEN 'ALREADY_EXISTS' ELSE 'CREATED' END FROM m WHERE even
  UNION ALL SELECT 3, session_month, CASE WHEN d <= 10 OR even THEN 'ALREADY_EXISTS' ELSE 'CREATED' END FROM m
  UNION ALL SELECT 3, session_month, 'ALREADY_EXISTS' FROM m WHERE d = 20
  UNION ALL SELECT 0, session_month, 'STORED' FROM m
)
SELECT CAST(batch AS INTEGER) AS batch, session_month, status, count(*) AS bars FROM steps GROUP BY ALL"""),
    "day_features": _with(_EVENTS, f"""
SELECT symbol, session_date, CAST(date_diff('day', lag(session_date) OVER (PARTITION BY symbol ORDER BY session_date), session_date) AS INTEGER) AS gap_days, {_WINDOWS} FROM ebars WINDOW {_FRAMES}"""),
    "lineage_levels": _with(_DATASET, f"""
, leveled AS (SELECT *, CAST(source_rank % 3 + 1 AS INTEGER) AS horizon FROM reasoned)
{_at_level("PROVIDER", "provider_code")} UNION ALL {_at_level("SESSION", "source_session_date")} UNION ALL {_at_level("HORIZON", "horizon")}
UNION ALL {_at_level("PROVIDER_SESSION", "provider_code", "source_session_date")} UNION ALL {_at_level("TOTAL")}"""),
    "sketched_months": _with(_BARS, """
, m AS (SELECT strftime(session_date, '%Y-%m') AS month, count(*) AS rows FROM known GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM known)
SELECT month, name, CAST(q AS DOUBLE) AS quantile, true AS within, rows FROM m, (VALUES ('symbols', NULL), ('bars', NULL), ('closes', 0.1), ('closes', 0.5), ('closes', 0.9)) n(name, q)"""),
    "payload_drift": """
WITH parts AS (
  SELECT event_id AS k, '{' || concat_ws(',', '"id":' || event_id, CASE WHEN event_id % 10 <> 4 THEN '"type":"' || event_type || '"' END, '"value":' || CASE event_id % 10 WHEN 5 THEN '"1.5"' WHEN 6 THEN 'null' ELSE '2.25' END,
    '"props":' || CASE WHEN event_id % 7 = 0 THEN '{"kk":1}' WHEN event_id % 11 = 0 THEN '[]' ELSE props END, '"tags":' || CASE WHEN event_id % 13 = 0 THEN '[{"n":1},{"m":2},{"m":3}]' ELSE '[{"n":1}]' END,
    CASE WHEN event_id % 10 = 3 THEN '"extra":true' END, CASE WHEN event_id % 10 = 8 THEN '"note":"x"' END) || CASE WHEN event_id % 50 = 0 THEN '' ELSE '}' END AS body FROM events
),
valid AS (SELECT k, CAST(body AS JSON) AS j FROM parts WHERE json_valid(body)),
objects AS (
  SELECT k, '$' AS path, j, ['id', 'type', 'value', 'props', 'tags'] AS must, ['note'] AS may FROM valid
  UNION ALL SELECT k, '$.props', j->'props', ['k'], [] FROM valid WHERE json_type(j->'props') = 'OBJECT'
  UNION ALL SELECT k, '$.tags[]', unnest(CAST(j->'tags' AS JSON[])), ['n'], [] FROM valid
),
members AS (SELECT k, path, j, must, may, unnest(json_keys(j)) AS name FROM objects),
names AS (SELECT *, CASE json_type(j->name) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' WHEN 'DOUBLE' THEN 'DECIMAL' ELSE json_type(j->name) END AS kind FROM members),
found AS (
  SELECT k, '$' AS path, 'NOT_JSON' AS finding, NULL AS kind FROM parts WHERE NOT json_valid(body)
  UNION ALL SELECT k, path || '.' || name, 'UNKNOWN_MEMBER', kind FROM names WHERE NOT list_contains(must || may, name)
  UNION ALL SELECT k, path || '.' || name, 'MISSING_MEMBER', NULL FROM (SELECT k, path, j, unnest(must) AS name FROM objects) WHERE NOT list_contains(json_keys(j), name)
  UNION ALL SELECT k, path || '.' || name, 'WRONG_KIND', kind FROM names
  WHERE (name, kind) NOT IN (('id', 'BIGINT'), ('type', 'STRING'), ('value', 'DECIMAL'), ('props', 'OBJECT'), ('tags', 'ARRAY'), ('note', 'STRING'), ('k', 'BIGINT'), ('n', 'BIGINT')) AND list_contains(must || may, name)
)
SELECT path, finding, kind, count(DISTINCT k) AS bodies, count(*) AS places FROM found GROUP BY path, finding, kind""",
    "sql_known_bars": _with(_BARS, """
SELECT symbol, session_date, bar_key, CAST(row_number() OVER (PARTITION BY symbol ORDER BY session_date) AS INTEGER) AS position, c AS close_price FROM (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) <= 5)"""),
    "sql_outcomes": _with(_OUTCOMES, """
SELECT 3 AS horizon, item_id, terminal_date, round(return_rate, 9) AS return_rate FROM created
UNION ALL SELECT 1, p.item_id, t.d, round(b.c / p.reference_close - 1, 9) FROM placed p JOIN cal t ON t.seq = p.seq + 1 JOIN ebars b ON b.symbol = p.symbol AND b.session_date = t.d
WHERE eligible AND chain_valid AND TIMESTAMP '2024-01-25 22:00:00' >= t.close_at + INTERVAL 15 MINUTE AND b.session_date + INTERVAL 23 HOUR <= TIMESTAMP '2024-01-25 22:00:00'"""),
}
