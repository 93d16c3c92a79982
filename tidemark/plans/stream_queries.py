"""Queries that run streams to their end or fetch pages on executors, each with the SQL of the answer at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.outcomes import future_sessions, outcomes_of_paths
from ..operators.pit import first_of
from ..sources import bars as sources
from ..sources.bars import event_bars
from ..sources.pages import read_service, write_service
from ..streaming import outcomes as streams
from .research import HORIZON, OBSERVED, core_calendar, outcome_items, read, rounded, ts
from .research_sql import ORACLE_SQL as RESEARCH_SQL
from .research_sql import _EVENTS, _OUTCOMES, _with
from .session import new_path, written


def replayed(tables: list[tuple[DataFrame, str]], slices: int, make: Callable[..., DataFrame], again: int | None = None) -> DataFrame:
    """What the stream that ``make`` builds of tables (rows, time column) has written after all their rows came in order.

    The time that the tables span is cut into slices. Each slice is a batch, after which the stream ends and starts again
    from its checkpoint. The slice ``again`` of the last table comes a second time with the one behind it.
    """
    spark: SparkSession = tables[0][0].sparkSession
    rows, paths = [(written(df), at) for df, at in tables], [new_path(spark, "replay") for _ in tables]
    ends = [df.agg(F.unix_micros(F.min(at)), F.unix_micros(F.max(at))).first() for df, at in rows]
    first, last = min((x[0] for x in ends if x[0] is not None), default=0), max((x[1] for x in ends if x[1] is not None), default=0)
    place = lambda at: F.least(F.floor((F.unix_micros(at) - first) * slices / max(last - first, 1)), F.lit(slices - 1))
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    for k in range(slices):
        for n, ((df, at), path) in enumerate(zip(rows, paths)):
            more = [again] if n == len(rows) - 1 and again is not None and k == again + 1 else []
            for slice_ in (k, *more):
                df.where(place(at) == slice_).write.mode("append").parquet(path)
        streams.run(make(*(spark.readStream.schema(df.schema).parquet(path) for (df, _), path in zip(rows, paths))), out, state).awaitTermination()
    return spark.read.parquet(out)


def _items(spark, d):
    return outcome_items(spark, d).withColumn("made_at", F.col("session_date").cast("timestamp") + F.expr("interval 22 hours"))


def _revised_bars(spark, d):
    """Event bars; those of days 5, 10, ... are corrected two days later, 1 % up."""
    b = event_bars(read(spark, d, "events"))
    up = lambda c: (F.col(c) * 1.01).alias(c)
    prices = ["open_price", "high_price", "low_price", "close_price"]
    later = b.where(F.dayofmonth("session_date") % 5 == 0).select(*(up(c) if c in prices else F.col(c) for c in b.columns if c not in ("available_at", "bar_key")), (F.col("available_at") + F.expr("interval 48 hours")).alias("available_at"), F.concat("bar_key", F.lit("|2")).alias("bar_key"))
    return b.unionByName(later)


def revised_outcomes(spark, d):
    """Every revision of every outcome, from a stream of items and bars in which corrections come late and a slice comes twice."""
    items = _items(spark, d).select(*streams.SERIES, "item_id", "session_date", "reference_close", "made_at")
    make = lambda i, b: streams.outcome_revisions(streams.feed(i, b, core_calendar(spark), HORIZON), late="30 days")
    made = replayed([(items, "made_at"), (_revised_bars(spark, d), "available_at")], 4, make, again=2)
    made = made.select("item_id", "revision", "path_digest", "return_rate", "mfe_rate", "mae_rate", "latest_input_available_at")
    return rounded(made, 9, "return_rate", "mfe_rate", "mae_rate")


def streamed_outcomes(spark, d):
    """Forward outcomes from paths that two streams, scored items and bars, were joined to."""
    items = written(_items(spark, d))
    calendar = core_calendar(spark)
    joined = replayed([(items, "made_at"), (event_bars(read(spark, d, "events")), "available_at")], 4, lambda i, b: streams.paths(i, b, calendar, HORIZON))
    asked = future_sessions(items, calendar, HORIZON)
    matured = ts(OBSERVED) >= F.col("terminal_close") + F.make_dt_interval(secs=F.lit(900))
    found = joined.where(F.col("available_at") <= ts(OBSERVED)).join(asked.where(matured).select("item_id"), "item_id", "left_semi")
    paths = first_of(found, ["item_id", "session_date"], F.desc("available_at"), F.desc("bar_key"))
    return rounded(outcomes_of_paths(asked, paths, HORIZON, matured), 9, "return_rate", "mfe_rate", "mae_rate")


PAGE = 5


def _service(spark, d):
    """A service of users' days, five a page. Some last pages name an old token, some second ones repeat a day, some third ones are of another symbol."""
    b = sources.event_days(read(spark, d, "events"))
    own = Window.partitionBy("symbol")
    at = F.row_number().over(own.orderBy("session_date")) - 1
    bar = F.struct(F.concat(F.col("session_date").cast("string"), F.lit("T12:00:00Z")).alias("t"), F.col("open_price").alias("o"), F.col("high_price").alias("h"), F.col("low_price").alias("l"), F.col("close_price").alias("c"), F.col("volume").alias("v"))
    rows = b.select("symbol", F.floor(at / PAGE).cast("int").alias("page"), F.floor((F.count(F.lit(1)).over(own) - 1) / PAGE).cast("int").alias("last"), F.min(F.struct("session_date", bar.alias("bar"))).over(own)["bar"].alias("head"), "session_date", bar.alias("bar"))
    pages = rows.groupBy("symbol", "page", "last").agg(F.array_sort(F.collect_list("bar")).alias("bars"), F.first("head").alias("head"))
    n, page = F.substring("symbol", 2, 20).cast("int"), F.col("page")
    bars = F.when((n % 11 == 0) & (page == 1), F.concat("bars", F.array("head"))).otherwise(F.col("bars")).alias("bars")
    after = F.when(page < F.col("last"), (page + 1).cast("string")).when((n % 13 == 0) & (page > 0), "1").alias("next_page_token")
    body = F.to_json(F.struct(F.when((n % 7 == 0) & (page == 2), "OTHER").otherwise(F.col("symbol")).alias("symbol"), bars, after))
    path = new_path(spark, "service")
    write_service(pages.select("symbol", F.when(page > 0, page.cast("string")).alias("token"), body.alias("body")), path)
    return path


def _paged(spark, d):
    return read_service(spark, _service(spark, d)).select("*", F.lit("XNYS").alias("mic_code"), F.to_date(F.lit("2024-01-27")).alias("cutoff"), ts("2024-02-01 00:00:00").alias("observed_at"))


def paged_bars(spark, d):
    """Bars of the symbols whose pages can be used, fetched by token on executors, a shard of symbols a task."""
    return sources.parse_paged(_paged(spark, d), 12).select("symbol", "session_date", F.col("close_price").cast("double").alias("close_price"), "volume")


def paged_problems(spark, d):
    """How many symbols' pages are refused, and for what."""
    return sources.read_paged(_paged(spark, d)).groupBy(F.coalesce("problem", F.lit("NONE")).alias("problem")).agg(F.count(F.lit(1)).alias("symbols"))


def fetched_pages(spark, d):
    """Nations as a paged service gives them, ten a page, fetched by token on an executor and parsed."""
    place = F.row_number().over(Window.orderBy("n_nationkey")) - 1  # a service of one small table
    rows = read(spark, d, "nation").select(F.floor(place / 10).cast("int").alias("page"), F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("r"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    last = F.max("page").over(Window.partitionBy())
    body = F.to_json(F.struct("rows", F.when(F.col("page") < last, (F.col("page") + 1).cast("string")).alias("next_page_token")))
    path = new_path(spark, "service")
    write_service(pages.select(F.lit("NATIONS").alias("symbol"), F.when(F.col("page") > 0, F.col("page").cast("string")).alias("token"), body.alias("body")), path)
    parsed = read_service(spark, path).withColumn("j", F.from_json("body", "struct<rows:array<struct<key:int,name:string>>,next_page_token:string>"))
    return parsed.select("page", F.explode("j.rows").alias("r")).select("page", F.col("r.key").alias("n_nationkey"), F.col("r.name").alias("n_name"))


QUERIES: dict = {f.__name__: f for f in (revised_outcomes, streamed_outcomes, paged_bars, paged_problems, fetched_pages)}

_PAGED = _EVENTS + """,
paged AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1) // 5 AS page, (count(*) OVER (PARTITION BY symbol) - 1) // 5 AS last FROM edays),
pages AS (SELECT symbol, number, page, last, CASE WHEN number % 7 = 0 AND page = 2 THEN 'RESPONSE_SCHEMA_INVALID' WHEN bool_or(l <= 0) OR (number % 11 = 0 AND page = 1) THEN 'RESPONSE_VALUE_INVALID' END AS problem FROM paged GROUP BY symbol, number, page, last),
answers AS (SELECT symbol, coalesce(arg_min(problem, page) FILTER (problem IS NOT NULL), CASE WHEN any_value(number) % 13 = 0 AND max(last) > 0 THEN 'PAGINATION_INVALID' END, 'NONE') AS problem FROM pages GROUP BY symbol)"""

ORACLE_SQL: dict[str, str] = {
    "revised_outcomes": _with(_OUTCOMES, """
, rev AS (
  SELECT symbol, session_date, h, l, c, session_date + INTERVAL 23 HOUR AS known_at, symbol || '|' || session_date AS bar_key FROM ebars
  UNION ALL SELECT symbol, session_date, h * 1.01::DOUBLE, l * 1.01::DOUBLE, c * 1.01::DOUBLE, session_date + INTERVAL 71 HOUR, symbol || '|' || session_date || '|2' FROM ebars WHERE day(session_date) % 5 = 0
),
want AS (SELECT p.item_id, p.symbol, p.reference_close, x.d FROM placed p JOIN cal x ON x.seq BETWEEN p.seq + 1 AND p.seq + 3 WHERE p.terminal_date IS NOT NULL),
times AS (SELECT DISTINCT w.item_id, r.known_at AS t FROM want w JOIN rev r ON r.symbol = w.symbol AND r.session_date = w.d),
seen AS (
  SELECT t.item_id, t.t, w.d, any_value(w.reference_close) AS reference, max(r.known_at) AS since, arg_max(r.bar_key, r.known_at) AS k, arg_max(r.h, r.known_at) AS h, arg_max(r.l, r.known_at) AS l, arg_max(r.c, r.known_at) AS c
  FROM times t JOIN want w USING (item_id) JOIN rev r ON r.symbol = w.symbol AND r.session_date = w.d AND r.known_at <= t.t GROUP BY ALL
),
whole AS (
  SELECT item_id, t, sha256('[' || string_agg('"' || k || '"', ',' ORDER BY d) || ']') AS path_digest, arg_max(c, d) / any_value(reference) - 1 AS ret, max(h) / any_value(reference) - 1 AS mfe, min(l) / any_value(reference) - 1 AS mae, max(since) AS li
  FROM seen GROUP BY item_id, t HAVING count(*) = 3
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY t) AS INTEGER) AS revision, path_digest, round(ret, 9) AS return_rate, round(mfe, 9) AS mfe_rate, round(mae, 9) AS mae_rate, li AS latest_input_available_at FROM whole"""),
    "streamed_outcomes": RESEARCH_SQL["forward_outcomes"],
    "paged_bars": _with(_PAGED, """
SELECT symbol, session_date, c AS close_price, v AS volume FROM edays WHERE symbol IN (SELECT symbol FROM answers WHERE problem = 'NONE') AND session_date <= DATE '2024-01-27' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) <= 12"""),
    "paged_problems": _with(_PAGED, "SELECT problem, count(*) AS symbols FROM answers GROUP BY problem"),
    "fetched_pages": "SELECT CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS INTEGER) AS page, n_nationkey, n_name FROM nation",
}
