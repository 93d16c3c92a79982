"""Operators as SQL: table functions with parameters over the bars, items and sessions that a session has as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.pit import SERIES

_SERIES = ", ".join(SERIES)


def _columns(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def register(spark: SparkSession, bars: DataFrame, items: DataFrame, sessions: DataFrame, prefix: str = "") -> list[str]:
    """Registers temporary views and table functions for SQL, and returns the functions' names.

    * ``bars_known_at(as_of)``: ``pit.known_bars``
    * ``last_sessions(as_of, most)``: ``pit.latest_sessions``
    * ``outcomes_of_horizon(as_of, horizon, grace_seconds)``: (item_id, terminal_date, return_rate, mfe_rate, mae_rate,
      latest_input_available_at) of the items that ``outcomes.forward_outcomes`` gives OUTCOME_CREATED

    bars and items as these take them, sessions one family of the calendar. Calls are inlined into the plan, so filters and
    columns of a query reach the scans below as with the functions of DataFrames. A parameter that is null gives no rows.
    """
    names = {"bars": bars, "items": items, "sessions": sessions}
    for name, df in names.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    known = f"{prefix}bars_known_at"
    last, ahead = f"{prefix}last_sessions", f"{prefix}outcomes_of_horizon"
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {known}(as_of TIMESTAMP) RETURNS TABLE ({_columns(bars)})
RETURN SELECT {", ".join(bars.columns)} FROM (
  SELECT *, row_number() OVER (PARTITION BY {_SERIES}, session_date ORDER BY available_at DESC, bar_key DESC) AS _rank FROM {prefix}bars WHERE available_at <= {known}.as_of
) WHERE _rank = 1""")
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {last}(as_of TIMESTAMP, most INT) RETURNS TABLE ({_columns(bars)}, position INT)
RETURN SELECT {", ".join(bars.columns)}, _n - _back + 1 AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY {_SERIES} ORDER BY session_date DESC) AS _back, cast(least(count(*) OVER (PARTITION BY {_SERIES}), {last}.most) AS INT) AS _n FROM (
    SELECT *, row_number() OVER (PARTITION BY {_SERIES}, session_date ORDER BY available_at DESC, bar_key DESC) AS _rank FROM {prefix}bars WHERE available_at <= {last}.as_of
  ) WHERE _rank = 1
) WHERE _back <= {last}.most""")
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {ahead}(as_of TIMESTAMP, horizon INT, grace_seconds INT)
RETURNS TABLE (item_id STRING, terminal_date DATE, return_rate DOUBLE, mfe_rate DOUBLE, mae_rate DOUBLE, latest_input_available_at TIMESTAMP)
RETURN SELECT item_id, terminal_date, return_rate, mfe_rate, mae_rate, latest FROM (
  SELECT item_id, max(w.session_date) AS terminal_date, count(*) AS n, max(w.close_at) AS closed, max_by(close_price, w.session_date) / max(reference_close) - 1 AS return_rate,
    max(high_price) / max(reference_close) - 1 AS mfe_rate, min(low_price) / max(reference_close) - 1 AS mae_rate, max(available_at) AS latest
  FROM (
    SELECT i.item_id, {", ".join(f"i.{c}" for c in SERIES)}, i.reference_close, s.session_date, s.close_at FROM {prefix}items i JOIN {prefix}sessions h ON h.session_date = i.session_date JOIN {prefix}sessions s ON s.seq BETWEEN h.seq + 1 AND h.seq + {ahead}.horizon
    WHERE i.eligible AND i.chain_valid AND i.reference_close > 0
  ) w JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_SERIES}, session_date ORDER BY available_at DESC, bar_key DESC) AS _rank FROM {prefix}bars WHERE available_at <= {ahead}.as_of) WHERE _rank = 1
  ) b ON {" AND ".join(f"b.{c} = w.{c}" for c in (*SERIES, "session_date"))}
  GROUP BY item_id
) WHERE n = {ahead}.horizon AND closed + make_interval(0, 0, 0, 0, 0, 0, {ahead}.grace_seconds) <= {ahead}.as_of AND mae_rate <= return_rate AND return_rate <= mfe_rate""")
    return [known, last, ahead]
