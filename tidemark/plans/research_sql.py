"""The research queries as SQL over the same tables."""

from ..functions.calendar import FIRST, LAST, closures, early_closes

_BARS = """
lines AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS session_date, l_extendedprice / l_quantity / 10 AS price, l_quantity AS quantity,
    {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_quantity, 'e': l_extendedprice} AS k
  FROM lineitem
),
days AS (
  SELECT symbol, session_date, arg_min(price, k) AS o, max(price) AS h, min(price) AS l, arg_max(price, k) AS c, CAST(sum(quantity) AS BIGINT) AS v
  FROM lines GROUP BY symbol, session_date HAVING min(price) > 0
),
revisions AS (
  SELECT symbol, session_date, r AS revision, o * x AS o, h * x AS h, l * x AS l, c * x AS c, CASE WHEN dayofyear(session_date) % 97 <> 0 THEN v END AS v,
    session_date + to_hours(CASE WHEN r = 1 THEN 23 ELSE 71 END) AS available_at, symbol || '|' || session_date || '|' || r AS bar_key
  FROM days, (VALUES (1, 1.0::DOUBLE), (2, 1.01::DOUBLE)) f(r, x) WHERE r = 1 OR day(session_date) % 5 = 0
),
known AS (
  SELECT * FROM revisions WHERE available_at <= TIMESTAMP '2001-06-15 12:00:00'
  QUALIFY row_number() OVER (PARTITION BY symbol, session_date ORDER BY available_at DESC, bar_key DESC) = 1
)"""

_FEATURES = (
    _BARS
    + """,
lagged AS (SELECT *, lag(c) OVER w AS c1, lag(c, 5) OVER w AS c5, lag(c, 20) OVER w AS c20 FROM known WINDOW w AS (PARTITION BY symbol ORDER BY session_date)),
steps AS (SELECT *, c / c1 - 1 AS r, greatest(h - l, abs(h - c1), abs(l - c1)) AS tr FROM lagged),
rolled AS (
  SELECT *, count(*) OVER w21 AS n, count(v) OVER w21 AS nv, avg(v) OVER w20 AS m20, avg(v) OVER w5 AS m5, avg(c) OVER w5 AS s5, avg(c) OVER w10 AS s10, avg(c) OVER w20 AS s20,
    stddev_pop(r) OVER w20 AS sd, avg(tr) OVER w14 AS atr, avg(c * v) OVER w20 AS dv,
    max(h) OVER wp AS hp, min(l) OVER wp AS lp
  FROM steps
  WINDOW w5 AS (PARTITION BY symbol ORDER BY session_date ROWS 4 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY session_date ROWS 9 PRECEDING),
    w14 AS (PARTITION BY symbol ORDER BY session_date ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY session_date ROWS 19 PRECEDING),
    w21 AS (PARTITION BY symbol ORDER BY session_date ROWS 20 PRECEDING), wp AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
),
judged AS (
  SELECT *, CASE WHEN n < 21 THEN 'DATA_INSUFFICIENT' WHEN nv >= 21 AND m20 <> 0 THEN 'READY' ELSE 'DEGRADED' END AS quality_status,
    CASE WHEN n < 21 THEN NULL WHEN nv < 21 THEN 'VOLUME_DATA_INCOMPLETE' WHEN m20 = 0 THEN 'VOLUME_DATA_UNUSABLE' END AS quality_reason
  FROM rolled
),
featured AS (
  SELECT symbol, session_date, strftime(session_date, '%Y-%m') AS run_id, CAST(least(n, 21) AS INTEGER) AS completed_bar_count, quality_status, quality_reason,
    CASE WHEN n >= 21 THEN c END AS last_close, CASE WHEN n >= 21 THEN c / c1 - 1 END AS one_day_return, CASE WHEN n >= 21 THEN c / c5 - 1 END AS five_day_return,
    CASE WHEN n >= 21 THEN c / c20 - 1 END AS twenty_day_return, CASE WHEN n >= 21 THEN o / c1 - 1 END AS latest_gap_return, CASE WHEN n >= 21 THEN c / o - 1 END AS latest_intraday_return,
    CASE WHEN n >= 21 THEN (h - l) / c1 END AS latest_range_rate, CASE WHEN n >= 21 THEN c / s5 - 1 END AS close_vs_sma5, CASE WHEN n >= 21 THEN c / s10 - 1 END AS close_vs_sma10,
    CASE WHEN n >= 21 THEN c / s20 - 1 END AS close_vs_sma20, CASE WHEN n >= 21 THEN sd END AS realized_volatility_20d, CASE WHEN n >= 21 THEN atr / c END AS atr14_rate,
    CASE WHEN n >= 21 THEN c / hp - 1 END AS distance_from_prior_20d_high, CASE WHEN n >= 21 THEN c / lp - 1 END AS distance_from_prior_20d_low,
    CASE WHEN quality_status = 'READY' THEN m5 / m20 END AS volume_ratio_5_to_20, CASE WHEN quality_status = 'READY' THEN v / m20 END AS latest_volume_to_avg20,
    CASE WHEN quality_status = 'READY' THEN dv END AS average_dollar_volume_20
  FROM judged
),
features AS (SELECT * FROM featured QUALIFY row_number() OVER (PARTITION BY run_id, symbol ORDER BY session_date DESC) = 1)"""
)

_PREPARED = r""",
faults AS (SELECT *, CAST(substr(symbol, 2) AS INTEGER) * 12 + month(session_date) AS k, quality_status = 'DEGRADED' AS degraded FROM features),
shots AS (
  SELECT run_id, symbol, CASE WHEN k % 11 = 0 THEN 5 ELSE 3 END AS horizon, CASE WHEN k % 13 = 0 THEN 'UNKNOWN' ELSE quality_status END AS quality, CASE WHEN k % 43 = 0 THEN 'OTHER' ELSE 'LINEITEM' END AS source,
    CASE WHEN degraded AND k % 5 = 2 THEN [quality_reason, 'OTHER'] WHEN degraded THEN [quality_reason] ELSE [] END AS reasons, CASE WHEN k % 29 = 0 THEN 'OTHER' ELSE 'US_EQUITY_DAILY_TECHNICAL' END AS code, CASE WHEN k % 31 = 0 THEN 'v2' ELSE 'v1' END AS version,
    CASE WHEN k % 19 = 0 THEN 'RAW' ELSE 'SPLIT_ADJUSTED' END AS basis, CASE WHEN k % 23 = 0 THEN '20' ELSE CAST(completed_bar_count AS VARCHAR) END AS bars, 19 - CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS members, CASE WHEN k % 37 = 0 THEN '1e-3' ELSE CAST(CAST(one_day_return AS DECIMAL(38, 18)) AS VARCHAR) END AS day_return,
    CASE WHEN degraded AND k % 9 = 1 THEN '1.5' WHEN NOT degraded AND k % 41 = 0 THEN NULL ELSE CAST(volume_ratio_5_to_20 AS VARCHAR) END AS volume
  FROM faults WHERE quality_status <> 'DATA_INSUFFICIENT' AND k % 7 <> 0
),
asked AS (SELECT run_id, symbol, quality_status AS item_outcome, CASE WHEN quality_status <> 'DATA_INSUFFICIENT' AND k % 13 = 0 THEN 'UNKNOWN' ELSE quality_status END AS wanted FROM faults),
reasons AS (
  SELECT a.run_id, a.symbol, s.quality, CASE WHEN item_outcome NOT IN ('READY', 'DEGRADED') THEN 'SOURCE_ITEM_' || item_outcome WHEN s.symbol IS NULL THEN 'FEATURE_SNAPSHOT_MISSING' WHEN s.horizon <> 3 OR s.quality <> a.wanted OR s.source <> 'LINEITEM' THEN 'FEATURE_SOURCE_MISMATCH'
    WHEN code <> 'US_EQUITY_DAILY_TECHNICAL' THEN 'FEATURE_SET_CODE_MISMATCH' WHEN version <> 'v1' THEN 'FEATURE_SET_VERSION_MISMATCH' WHEN members <> 19 THEN 'FEATURE_KEY_CONTRACT_INVALID' WHEN basis <> 'SPLIT_ADJUSTED' THEN 'FEATURE_ADJUSTMENT_BASIS_INVALID'
    WHEN bars <> '21' THEN 'FEATURE_COMPLETED_BAR_COUNT_INVALID' WHEN s.quality = 'READY' AND volume IS NULL THEN 'FEATURE_READY_VOLUME_INCOMPLETE'
    WHEN NOT (s.quality = 'READY' OR s.quality = 'DEGRADED' AND len(reasons) = 1 AND reasons[1] IN ('VOLUME_DATA_INCOMPLETE', 'VOLUME_DATA_UNUSABLE')) THEN 'FEATURE_QUALITY_UNSUPPORTED' WHEN s.quality = 'DEGRADED' AND volume IS NOT NULL THEN 'FEATURE_DEGRADED_VOLUME_SHAPE_INVALID'
    WHEN NOT regexp_full_match(day_return, '-?(0|[1-9][0-9]*)(\.[0-9]+)?') THEN 'FEATURE_NUMERIC_VALUE_INVALID' END AS reason
  FROM asked a LEFT JOIN shots s ON s.run_id = a.run_id AND s.symbol = a.symbol
),
prepared AS (
  SELECT run_id, symbol, reason, CASE WHEN reason IS NULL THEN 'SCORED_' || quality WHEN reason LIKE 'SOURCE_ITEM_%' THEN 'SOURCE_ITEM_NOT_SCORABLE' WHEN reason IN ('FEATURE_SNAPSHOT_MISSING', 'FEATURE_SOURCE_MISMATCH', 'FEATURE_QUALITY_UNSUPPORTED') THEN reason ELSE 'FEATURE_CONTRACT_INVALID' END AS scoring_outcome FROM reasons
)"""

_PRICES = "one_day_return five_day_return twenty_day_return latest_gap_return latest_intraday_return latest_range_rate close_vs_sma5 close_vs_sma10 close_vs_sma20 realized_volatility_20d atr14_rate distance_from_prior_20d_high distance_from_prior_20d_low".split()
_VOLUMES = "volume_ratio_5_to_20 latest_volume_to_avg20 average_dollar_volume_20".split()
_GROUP = {"one_day_return": "momentum", "five_day_return": "momentum", "twenty_day_return": "momentum", "close_vs_sma5": "trend", "close_vs_sma10": "trend", "close_vs_sma20": "trend", "distance_from_prior_20d_high": "breakout", "distance_from_prior_20d_low": "breakout", "latest_gap_return": "price_action", "latest_intraday_return": "price_action", "latest_range_rate": "stability", "realized_volatility_20d": "stability", "atr14_rate": "stability"} | dict.fromkeys(_VOLUMES, "volume")


def _round(columns: list[str], places: int) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


_LONG = (
    _FEATURES
    + ", long AS ("
    + " UNION ALL ".join(
        f"SELECT run_id, symbol, '{c}' AS feature, '{_GROUP[c]}' AS g, round({c}, 9) AS value FROM features WHERE quality_status IN ({'''READY''' if c in _VOLUMES else '''READY', 'DEGRADED'''}) AND {c} IS NOT NULL".replace("IN (READY)", "IN ('READY')").replace("IN (READY', 'DEGRADED)", "IN ('READY', 'DEGRADED')")
        for c in _PRICES + _VOLUMES
    )
    + """),
ranks AS (
  SELECT run_id, symbol, feature, g, CASE WHEN count(*) OVER p = 1 THEN 0.5::DOUBLE
    ELSE (rank() OVER (PARTITION BY run_id, feature ORDER BY value) - 1 + (count(*) OVER (PARTITION BY run_id, feature, value) - 1) / 2.0::DOUBLE) / (count(*) OVER p - 1) END AS percentile
  FROM long WINDOW p AS (PARTITION BY run_id, feature)
)"""
)

_SCORES = (
    _LONG
    + """,
means AS (
  SELECT run_id, symbol, avg(percentile) FILTER (g = 'momentum') AS m, avg(percentile) FILTER (g = 'trend') AS t, avg(percentile) FILTER (g = 'breakout') AS b,
    avg(percentile) FILTER (g = 'price_action') AS a, 1 - avg(percentile) FILTER (g = 'stability') AS s, avg(percentile) FILTER (g = 'volume') AS v
  FROM ranks GROUP BY run_id, symbol
),
scores AS (
  SELECT run_id, symbol, CASE WHEN crc % 2 = 0 THEN 'XNYS' ELSE 'XNGS' END AS mic_code, quality_status, round_even(100 * m, 6) AS momentum_score, round_even(100 * t, 6) AS trend_score,
    round_even(100 * b, 6) AS breakout_score, round_even(100 * a, 6) AS price_action_score, round_even(100 * s, 6) AS stability_score, round_even(100 * v, 6) AS volume_score,
    round_even(100 * ((25 * m + 25 * t + 20 * b + 10 * a + 10 * s + 10 * coalesce(v, 0)) / CASE WHEN v IS NULL THEN 90.0::DOUBLE ELSE 100.0::DOUBLE END), 6) AS overall_score
  FROM means JOIN (SELECT *, length(symbol) AS crc FROM features) USING (run_id, symbol)
)"""
)

_EVENTS = """
edays AS (
  SELECT 'EVENTS' AS source_code, 'U' || user_id AS symbol, user_id AS number, CAST(ts AS DATE) AS session_date, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, ts) AS c, count(*) AS v
  FROM events GROUP BY user_id, CAST(ts AS DATE)
),
ebars AS (SELECT * FROM edays WHERE l > 0)"""

_YEARS = range(FIRST.year, LAST.year + 1)
_CLOSED = ", ".join(f"DATE '{d}'" for y in _YEARS for d, _ in closures(y))
_EARLY = ", ".join(f"DATE '{d}'" for y in _YEARS for d, _ in early_closes(y))

#: All sessions; New York is four hours behind from the second Sunday of March to the first of November, else five.
_CAL = f"""
days AS (
  SELECT CAST(d AS DATE) AS d, make_date(year(d), 3, 8) AS m, make_date(year(d), 11, 1) AS n
  FROM (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY)) AS d)
),
hours AS (
  SELECT d, CASE WHEN d >= m + CAST((7 - dayofweek(m)) % 7 AS INTEGER) AND d < n + CAST((7 - dayofweek(n)) % 7 AS INTEGER) THEN 4 ELSE 5 END AS h
  FROM days WHERE isodow(d) <= 5 AND d NOT IN ({_CLOSED})
),
cal AS (
  SELECT row_number() OVER (ORDER BY d) AS seq, d, d + INTERVAL '9 hours 30 minutes' + to_hours(h) AS open_at, d + to_hours(CASE WHEN d IN ({_EARLY}) THEN 13 ELSE 16 END + h) AS close_at FROM hours
)"""

_OUTCOMES = (
    _EVENTS
    + ","
    + _CAL
    + """,
items AS (
  SELECT symbol || '|' || session_date AS item_id, source_code, symbol, number, session_date, c AS reference_close, o, c, v, v >= 2 AS eligible, number % 11 <> 0 AS chain_valid,
    session_date + to_hours(CASE WHEN number % 2 = 1 THEN 40 ELSE 32 END) AS scored_at
  FROM ebars
),
placed AS (
  SELECT i.*, s.seq, f.d AS f1, f.open_at AS first_open, t.d AS terminal_date, t.close_at AS terminal_close
  FROM items i LEFT JOIN cal s ON s.d = i.session_date LEFT JOIN cal f ON f.seq = s.seq + 1 LEFT JOIN cal t ON t.seq = s.seq + 3
),
paths AS (
  SELECT p.item_id, count(*) AS n, arg_max(b.c, b.session_date) / any_value(p.reference_close) - 1 AS return_rate, max(b.h) / any_value(p.reference_close) - 1 AS mfe_rate,
    min(b.l) / any_value(p.reference_close) - 1 AS mae_rate, max(b.session_date + INTERVAL '23 hours') AS latest_input_available_at
  FROM placed p JOIN cal x ON x.seq BETWEEN p.seq + 1 AND p.seq + 3 JOIN ebars b ON b.symbol = p.symbol AND b.session_date = x.d
  WHERE b.session_date + INTERVAL '23 hours' <= TIMESTAMP '2024-01-25 22:00:00' GROUP BY p.item_id
),
laddered AS (
  SELECT p.*, y.*  EXCLUDE (item_id), CASE WHEN NOT eligible THEN 'SOURCE_ITEM_NOT_ELIGIBLE' WHEN NOT chain_valid OR p.seq IS NULL THEN 'SOURCE_CHAIN_INVALID' WHEN terminal_date IS NULL THEN 'CALENDAR_OUT_OF_COVERAGE'
    WHEN TIMESTAMP '2024-01-25 22:00:00' < terminal_close + INTERVAL '15 minutes' THEN 'NOT_MATURED' WHEN coalesce(n, 0) < 3 THEN 'FUTURE_BARS_INCOMPLETE'
    WHEN NOT (mae_rate <= return_rate AND return_rate <= mfe_rate) THEN 'FUTURE_BAR_CONTRACT_INVALID' ELSE 'OUTCOME_CREATED' END AS outcome,
    CASE WHEN scored_at <= first_open THEN 'PROSPECTIVE' ELSE 'RETROSPECTIVE_REPLAY' END AS mode
  FROM placed p LEFT JOIN paths y USING (item_id)
),
created AS (SELECT * FROM laddered WHERE outcome = 'OUTCOME_CREATED')"""
)

_DATASET = (
    _OUTCOMES
    + """,
moves AS (SELECT *, round(c / o - 1, 9) AS move FROM items),
scored AS (
  SELECT *, round(100 * CASE WHEN count(*) OVER d = 1 THEN 0.5::DOUBLE ELSE (rank() OVER (PARTITION BY session_date ORDER BY move) - 1 + (count(*) OVER (PARTITION BY session_date, move) - 1) / 2.0::DOUBLE) / (count(*) OVER d - 1) END, 6) AS overall
  FROM moves WINDOW d AS (PARTITION BY session_date)
),
sitems AS (
  SELECT item_id AS scoring_item_id, session_date AS source_session_date, symbol, number, CASE WHEN number % 13 <> 0 THEN overall END AS overall_score,
    CAST(row_number() OVER (PARTITION BY session_date ORDER BY overall DESC, symbol) AS INTEGER) AS source_rank, CASE WHEN v >= 2 THEN 'READY' ELSE 'DEGRADED' END AS quality,
    v < 2 AND number % 2 = 0 AS incomplete, number % 17 <> 0 AS policy_matches, CASE WHEN number % 3 = 0 THEN 'FEED_B' ELSE 'FEED_A' END AS provider_code
  FROM scored
),
orev AS (
  SELECT item_id AS scoring_item_id, item_id || '|' || r AS outcome_id, number, latest_input_available_at AS li, latest_input_available_at + (CASE WHEN number % 10 = 2 THEN INTERVAL '30 days' ELSE INTERVAL '1 hour' END) + to_hours(r) AS recorded_at,
    return_rate, mode AS observation_mode, CASE WHEN number % 10 = 4 THEN 'OTHER' ELSE 'EVENTS' END AS p, CASE WHEN number % 10 = 6 THEN 'UK' ELSE 'US' END AS k, CASE WHEN number % 10 = 8 THEN 'P0' ELSE 'P1' END AS y
  FROM created, (VALUES (1), (2)) f(r) WHERE r = 1 OR number % 2 = 0
),
best AS (
  SELECT * FROM orev WHERE li <= TIMESTAMP '2024-01-30' AND recorded_at <= TIMESTAMP '2024-01-30' AND p = 'EVENTS' AND k = 'US' AND y = 'P1'
  QUALIFY row_number() OVER (PARTITION BY scoring_item_id ORDER BY li DESC, recorded_at DESC, outcome_id DESC) = 1
),
dataset AS (
  SELECT s.*, b.outcome_id, b.return_rate, b.observation_mode, CASE WHEN b.return_rate > 0 THEN 'POSITIVE' ELSE 'NOT_POSITIVE' END AS label,
    CAST(row_number() OVER (ORDER BY source_session_date, source_rank, symbol, outcome_id) AS INTEGER) AS ordinal
  FROM best b JOIN sitems s USING (scoring_item_id) WHERE policy_matches AND quality = 'READY' AND overall_score IS NOT NULL
),
labels_made AS (SELECT outcome_id, scoring_item_id, CASE WHEN number % 7 = 0 THEN 'L0' ELSE 'L1' END AS lp FROM orev WHERE number % 5 <> 0),
flags AS (
  SELECT scoring_item_id, true AS f1, bool_or(f2) AS f2, bool_or(f2 AND p = 'EVENTS') AS f3, bool_or(f2 AND p = 'EVENTS' AND k = 'US') AS f4, bool_or(f2 AND p = 'EVENTS' AND k = 'US' AND y = 'P1') AS f5,
    bool_or(f2 AND p = 'EVENTS' AND k = 'US' AND y = 'P1' AND lp IS NOT NULL) AS f6, bool_or(f2 AND p = 'EVENTS' AND k = 'US' AND y = 'P1' AND coalesce(lp = 'L1', false)) AS f7
  FROM (SELECT o.*, l.lp, li <= TIMESTAMP '2024-01-30' AND recorded_at <= TIMESTAMP '2024-01-30' AS f2 FROM orev o LEFT JOIN labels_made l USING (outcome_id, scoring_item_id)) GROUP BY scoring_item_id
),
records AS (
  SELECT s.*, coalesce(f1, false) AS a1, coalesce(f2, false) AS a2, coalesce(f3, false) AS a3, coalesce(f4, false) AS a4, coalesce(f5, false) AS a5, coalesce(f6, false) AS a6, coalesce(f7, false) AS a7,
    s.scoring_item_id IN (SELECT scoring_item_id FROM dataset) AND s.scoring_item_id IN (SELECT scoring_item_id FROM labels_made WHERE lp = 'L1') AS included
  FROM sitems s LEFT JOIN flags USING (scoring_item_id)
),
reasoned AS (
  SELECT *, CASE WHEN included THEN NULL WHEN NOT policy_matches THEN 'OTHER_CONTRACT_FAILURE' WHEN quality <> 'READY' THEN CASE WHEN incomplete THEN 'VOLUME_DATA_INCOMPLETE' ELSE 'FEATURE_QUALITY_NOT_READY' END
    WHEN overall_score IS NULL THEN 'MISSING_SCORE' WHEN NOT a1 THEN 'OUTCOME_NOT_FOUND' WHEN NOT a2 THEN 'OUTCOME_NOT_AVAILABLE_AS_OF' WHEN NOT a3 THEN 'PROVIDER_MISMATCH' WHEN NOT a4 THEN 'CALENDAR_MISMATCH'
    WHEN NOT a5 THEN 'OUTCOME_POLICY_MISMATCH' WHEN NOT a6 THEN 'LABEL_NOT_FOUND' WHEN NOT a7 THEN 'LABEL_POLICY_MISMATCH' ELSE 'OTHER_CONTRACT_FAILURE' END AS reason
  FROM records
)"""
)

_EXCLUSIONS = "SCORE_NOT_READY FEATURE_QUALITY_NOT_READY VOLUME_DATA_INCOMPLETE OUTCOME_NOT_FOUND OUTCOME_NOT_AVAILABLE_AS_OF LABEL_NOT_FOUND LABEL_POLICY_MISMATCH OUTCOME_POLICY_MISMATCH PROVIDER_MISMATCH CALENDAR_MISMATCH MISSING_SCORE DUPLICATE_SOURCE OTHER_CONTRACT_FAILURE".split()
_FUNNEL = ", ".join(f"({i}, '{x}')" for i, x in enumerate(_EXCLUSIONS, 1))


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


ORACLE_SQL: dict[str, str] = {
    "trading_sessions": _with(_CAL, f"""
SELECT d AS session_date, CASE WHEN d IN ({_EARLY}) THEN 'EARLY_CLOSE' ELSE 'REGULAR' END AS kind, CAST(epoch(close_at) - epoch(open_at) AS BIGINT) AS open_seconds, count(*) AS events, count(*) FILTER (ts BETWEEN open_at AND close_at) AS inside
FROM events JOIN cal ON CAST(ts AS DATE) = d GROUP BY d, open_at, close_at"""),
    "pit_latest_revision": _with(_BARS, """
SELECT symbol, count(*) AS sessions, max(session_date) AS last_session, arg_max(c, session_date) AS last_close, round(arg_max(r, session_date), 6) AS one_day_return
FROM (SELECT *, c / lag(c) OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS r FROM (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) <= 21)) GROUP BY symbol"""),
    "pit_named_sessions": _with(_BARS, """
SELECT symbol, CAST(p AS INTEGER) AS position, session_date, c AS close_price, bar_key FROM known
JOIN (VALUES (1, DATE '1999-03-15'), (2, DATE '1999-03-10'), (3, DATE '1999-03-12')) w(p, session_date) USING (session_date)"""),
    "features_v1": _with(_FEATURES, f"SELECT run_id, symbol, session_date, completed_bar_count, quality_status, quality_reason, last_close, {_round([*_PRICES, *_VOLUMES[:2]], 6)}, round(average_dollar_volume_20 + 3.14159e-8::DOUBLE, 3) AS average_dollar_volume_20 FROM features"),
    "features_v2": _with(_FEATURES, f"SELECT symbol, session_date, 'READY' AS quality_status, {_round(_PRICES, 6)} FROM featured WHERE completed_bar_count = 21 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) = 1"),
    "feature_quality_counts": _with(_FEATURES, "SELECT run_id, quality_status, count(*) AS items FROM features GROUP BY ALL"),
    "midrank_percentile": _with(_LONG, "SELECT run_id, symbol, feature, round(percentile, 9) AS percentile FROM ranks"),
    "component_scores": _with(_SCORES, "SELECT * FROM scores"),
    "relative_rank": _with(_SCORES, """
SELECT run_id, symbol, quality_status, overall_score, CAST(row_number() OVER (PARTITION BY run_id ORDER BY quality_status = 'READY' DESC, overall_score DESC, momentum_score DESC, trend_score DESC, mic_code, symbol) AS INTEGER) AS rank FROM scores"""),
    "prepared_scoring_items": _with(_FEATURES + _PREPARED, "SELECT run_id, symbol, scoring_outcome, reason FROM prepared"),
    "scoring_run_status": _with(_FEATURES + _PREPARED, """
SELECT run_id, count(*) AS items, count(*) FILTER (starts_with(scoring_outcome, 'SCORED')) AS scored, count(*) FILTER (NOT starts_with(scoring_outcome, 'SCORED')) AS skipped,
  CASE WHEN count(*) FILTER (starts_with(scoring_outcome, 'SCORED')) = 0 THEN 'NO_SCORABLE_ITEMS' WHEN bool_or(NOT starts_with(scoring_outcome, 'SCORED')) THEN 'COMPLETED_WITH_UNSCORABLE' ELSE 'COMPLETED' END AS status
FROM prepared GROUP BY run_id"""),
    "completed_session": _with(_CAL, """
, ask AS (SELECT event_id, user_id % 10 = 0 AS unsupported, ts FROM events)
SELECT event_id, CASE WHEN unsupported THEN 'UNSUPPORTED_MIC' ELSE 'RESOLVED' END AS outcome, CASE WHEN NOT unsupported THEN d END AS session_date
FROM ask ASOF LEFT JOIN (SELECT d, close_at + INTERVAL 60 SECOND AS done FROM cal) ON ts >= done"""),
    "session_lookup": _with(_CAL, """
SELECT day, day IN (SELECT d FROM cal) AS is_session, (SELECT max(d) FROM cal WHERE d <= day) AS latest FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)"""),
    "bar_calendar_violations": _with(_EVENTS + "," + _CAL, """
, b AS (SELECT symbol, session_date, v, date_diff('day', DATE '2024-01-01', session_date) AS arrival FROM ebars),
feed AS (SELECT * FROM b UNION ALL SELECT symbol, session_date, v, arrival + 100 FROM b WHERE day(session_date) = 10 UNION ALL SELECT symbol, DATE '2023-12-29', v, arrival + 100 FROM b WHERE day(session_date) = 11),
marked AS (SELECT *, row_number() OVER (PARTITION BY symbol, session_date ORDER BY arrival) > 1 AS again, lag(session_date) OVER (PARTITION BY symbol ORDER BY arrival) AS before FROM feed)
SELECT CASE WHEN v = 1 THEN 'UNSUPPORTED_MIC' WHEN session_date > DATE '2024-01-26' THEN 'AFTER_COMPLETED_CUTOFF' WHEN again THEN 'DUPLICATE_SESSION' WHEN session_date NOT IN (SELECT d FROM cal) THEN 'ON_NON_TRADING_DAY'
  WHEN session_date < before THEN 'SEQUENCE_INCONSISTENT' ELSE 'NONE' END AS violation, count(*) AS bars FROM marked GROUP BY 1"""),
    "forward_outcomes": _with(_OUTCOMES, """
SELECT item_id, source_code, symbol, session_date, terminal_date, outcome, CASE WHEN outcome = 'OUTCOME_CREATED' THEN round(return_rate, 9) END AS return_rate, CASE WHEN outcome = 'OUTCOME_CREATED' THEN round(mfe_rate, 9) END AS mfe_rate,
  CASE WHEN outcome = 'OUTCOME_CREATED' THEN round(mae_rate, 9) END AS mae_rate, CASE WHEN outcome = 'OUTCOME_CREATED' THEN 3 END AS bar_count, CASE WHEN outcome = 'OUTCOME_CREATED' THEN mode END AS observation_mode,
  CASE WHEN outcome = 'OUTCOME_CREATED' THEN latest_input_available_at END AS latest_input_available_at FROM laddered"""),
    "outcome_labels": _with(_OUTCOMES, "SELECT session_date, CASE WHEN return_rate > 0 THEN 'POSITIVE' ELSE 'NOT_POSITIVE' END AS label, mode AS observation_mode, count(*) AS items FROM created GROUP BY ALL"),
    "observation_summary": _with(_OUTCOMES, """
SELECT session_date, count(*) FILTER (outcome = 'OUTCOME_CREATED') AS created_count, 0::BIGINT AS existing_count, count(*) FILTER (outcome = 'NOT_MATURED') AS not_matured_count, count(*) FILTER (outcome = 'FUTURE_BARS_INCOMPLETE') AS incomplete_count,
  count(*) FILTER (outcome = 'SOURCE_ITEM_NOT_ELIGIBLE') AS not_eligible_count, count(*) FILTER (outcome IN ('SOURCE_CHAIN_INVALID', 'FUTURE_BAR_CONTRACT_INVALID', 'CALENDAR_OUT_OF_COVERAGE')) AS invalid_count,
  CASE WHEN bool_and(outcome = 'SOURCE_ITEM_NOT_ELIGIBLE') THEN 'NO_ELIGIBLE_ITEMS' WHEN bool_or(outcome = 'CALENDAR_OUT_OF_COVERAGE') THEN 'CALENDAR_OUT_OF_COVERAGE' WHEN bool_or(outcome IN ('SOURCE_CHAIN_INVALID', 'FUTURE_BAR_CONTRACT_INVALID')) THEN 'COMPLETED_WITH_GAPS'
    WHEN bool_or(outcome IN ('NOT_MATURED', 'FUTURE_BARS_INCOMPLETE')) THEN 'COMPLETED_WITH_PENDING' ELSE 'COMPLETED' END AS status FROM laddered GROUP BY session_date"""),
    "calibration_dataset": _with(_DATASET, "SELECT source_session_date, ordinal, symbol, source_rank, outcome_id, overall_score, round(return_rate, 9) AS return_rate, label, observation_mode FROM dataset"),
    "dataset_summary": _with(_DATASET, """
SELECT count(*) AS total, count(*) FILTER (label = 'POSITIVE') AS positive, count(*) FILTER (label = 'NOT_POSITIVE') AS not_positive, count(*) FILTER (observation_mode = 'PROSPECTIVE') AS prospective, count(*) FILTER (observation_mode = 'RETROSPECTIVE_REPLAY') AS replay,
  count(DISTINCT source_session_date) AS sessions, min(source_session_date) AS first_session, max(source_session_date) AS last_session, CASE WHEN count(*) = 0 THEN 'EMPTY' ELSE 'READY' END AS status FROM dataset"""),
    "readiness_audit": _with(_DATASET, """
, f AS (SELECT count(*) AS items, count(DISTINCT source_session_date) AS sessions, count(DISTINCT symbol) AS symbols, min(source_session_date) AS first_session, max(source_session_date) AS last_session,
  CAST(coalesce(max(source_session_date) - min(source_session_date), 0) AS INTEGER) AS span_days, count(*) FILTER (observation_mode = 'RETROSPECTIVE_REPLAY') AS replay_items,
  count(DISTINCT source_session_date) FILTER (observation_mode = 'RETROSPECTIVE_REPLAY') AS replay_sessions, count(*) FILTER (observation_mode = 'PROSPECTIVE') AS prospective_items,
  count(DISTINCT source_session_date) FILTER (observation_mode = 'PROSPECTIVE') AS prospective_sessions, count(*) FILTER (label = 'POSITIVE') AS positive, count(*) FILTER (label = 'NOT_POSITIVE') AS not_positive,
  count(*) FILTER (observation_mode = 'RETROSPECTIVE_REPLAY' AND label = 'POSITIVE') AS replay_positive, count(*) FILTER (observation_mode = 'RETROSPECTIVE_REPLAY' AND label = 'NOT_POSITIVE') AS replay_not_positive,
  count(*) FILTER (observation_mode = 'PROSPECTIVE' AND label = 'POSITIVE') AS prospective_positive, count(*) FILTER (observation_mode = 'PROSPECTIVE' AND label = 'NOT_POSITIVE') AS prospective_not_positive,
  count(*) FILTER (overall_score IS NULL) AS null_scores, count(*) FILTER (overall_score NOT BETWEEN 0 AND 100) AS invalid_scores, count(*) - count(DISTINCT scoring_item_id) AS duplicates FROM dataset)
SELECT *, CASE WHEN null_scores > 0 OR invalid_scores > 0 OR duplicates > 0 THEN 'SOURCE_INELIGIBLE' WHEN items < 300 OR sessions < 60 OR replay_items < 150 OR replay_sessions < 20 THEN 'DATA_INSUFFICIENT'
  WHEN positive < 60 OR not_positive < 60 OR replay_positive < 30 OR replay_not_positive < 30 THEN 'CLASS_IMBALANCED' WHEN prospective_items < 100 OR prospective_sessions < 20 OR prospective_positive < 20 OR prospective_not_positive < 20 THEN 'PROSPECTIVE_INSUFFICIENT' ELSE 'DATA_READY' END AS readiness,
  CASE WHEN items = 0 THEN 'ZERO_DENOMINATOR' ELSE CAST(CAST(round_even(100.0::DOUBLE * positive / items, 6) AS DECIMAL(20, 6)) AS VARCHAR) END AS positive_share FROM f"""),
    "exclusion_funnel": _with(_DATASET, f"SELECT CAST(p AS INTEGER) AS position, f.reason, count(r.scoring_item_id) AS items FROM (VALUES {_FUNNEL}) f(p, reason) LEFT JOIN reasoned r ON r.reason = f.reason GROUP BY ALL"),
    "upstream_facts": _with(_DATASET, """
SELECT count(*) AS items, count(*) FILTER (quality = 'READY') AS scored_ready, count(*) FILTER (quality = 'DEGRADED') AS scored_degraded, 0::BIGINT AS skipped_failed, count(*) FILTER (quality = 'READY') AS feature_ready, count(*) FILTER (quality = 'DEGRADED') AS feature_degraded,
  count(*) FILTER (incomplete) AS volume_incomplete, count(*) FILTER (NOT a1) AS missing_outcome, count(*) FILTER (a1 AND NOT a2) AS missing_as_of, count(*) FILTER (a2 AND NOT a3) AS provider_mismatch, count(*) FILTER (a3 AND NOT a4) AS calendar_mismatch,
  count(*) FILTER (NOT policy_matches) + count(*) FILTER (a4 AND NOT a5) AS policy_mismatch, count(*) FILTER (a5 AND NOT a6) AS missing_label, count(DISTINCT source_session_date) AS sessions, count(DISTINCT symbol) AS symbols FROM reasoned"""),
    "provider_distribution": _with(_DATASET, """
SELECT provider_code, count(*) AS total, count(*) FILTER (quality = 'READY') AS ready, count(*) FILTER (quality = 'DEGRADED') AS degraded, 0::BIGINT AS insufficient, count(*) FILTER (incomplete) AS volume_incomplete, count(*) FILTER (reason IS NULL) AS included FROM reasoned GROUP BY provider_code"""),
    "price_only_reasons": _with(_FEATURES, """
SELECT CASE WHEN number % 9 = 0 THEN 'FEATURE_POLICY_NOT_V1' WHEN number % 7 = 0 THEN 'PRICE_FEATURE_MISSING' WHEN number % 11 = 0 THEN 'ADJUSTMENT_BASIS_INVALID' ELSE 'ELIGIBLE' END AS reason, count(*) AS items
FROM (SELECT *, CAST(substr(symbol, 2) AS INTEGER) AS number FROM features WHERE quality_status <> 'DATA_INSUFFICIENT') GROUP BY 1"""),
    "price_only_eligibility": _with(_FEATURES, """
, j AS (SELECT *, CASE WHEN number % 9 = 0 THEN 'a' WHEN number % 7 = 0 THEN 'b' WHEN number % 11 = 0 THEN 'c' END AS reason FROM (SELECT *, CAST(substr(symbol, 2) AS INTEGER) AS number FROM features WHERE quality_status <> 'DATA_INSUFFICIENT'))
SELECT count(*) AS items, CAST(count(*) FILTER (reason IS NULL OR reason = 'c') AS VARCHAR) AS price_complete, CAST(count(*) FILTER (reason IS NULL) AS VARCHAR) AS eligible, CAST(count(*) FILTER (reason IS NOT NULL) AS VARCHAR) AS ineligible,
  CAST(count(*) FILTER (reason IS NULL AND quality_status = 'DEGRADED') AS VARCHAR) AS volume_only_degraded FROM j"""),
    "horizon_groups": _with(_DATASET, """
SELECT CAST(day(source_session_date) % 3 + 1 AS INTEGER) AS horizon, count(*) AS datasets, CAST(sum(n) AS BIGINT) AS items, string_agg(CAST(source_session_date AS VARCHAR), ',' ORDER BY source_session_date) AS dataset_ids
FROM (SELECT source_session_date, count(*) AS n FROM dataset GROUP BY 1) GROUP BY 1"""),
    "readiness_percentages": _with(_FEATURES, """
SELECT run_id, CAST(CAST(round_even(100.0::DOUBLE * count(*) FILTER (quality_status = 'READY') / count(*), 6) AS DECIMAL(20, 6)) AS VARCHAR) AS ready_share, 'ZERO_DENOMINATOR' AS nothing FROM features GROUP BY run_id"""),
    "latest_outcome_as_of": _with(_DATASET, """
SELECT scoring_item_id, outcome_id AS outcome_key FROM orev WHERE li <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY scoring_item_id ORDER BY li DESC, outcome_id DESC) = 1"""),
    "path_revision_digest": _with(_OUTCOMES, """
SELECT p.item_id, sha256('[' || string_agg('"' || b.symbol || '|' || b.session_date || '"', ',' ORDER BY b.session_date) || ']') AS path_digest
FROM placed p JOIN cal x ON x.seq BETWEEN p.seq + 1 AND p.seq + 3 JOIN ebars b ON b.symbol = p.symbol AND b.session_date = x.d WHERE p.terminal_date IS NOT NULL GROUP BY p.item_id"""),
    "order_violations": _with(_DATASET, """
, bent AS (SELECT ordinal AS k, CASE WHEN ordinal % 50 = 10 THEN ordinal + 1 WHEN ordinal % 50 = 11 THEN ordinal - 1 WHEN ordinal % 50 = 20 THEN ordinal + 1 ELSE ordinal END AS o FROM dataset)
SELECT * FROM (
  SELECT 'REPEATED_ORDINAL' AS rule, count(*) - count(DISTINCT o) AS rows FROM bent UNION ALL SELECT 'NOT_FROM_1_TO_N', CASE WHEN count(*) = 0 OR min(o) = 1 AND max(o) = count(*) THEN 0 ELSE 1 END FROM bent
  UNION ALL SELECT 'OUT_OF_ORDER', count(*) FROM bent a JOIN bent b ON b.o = a.o + 1 WHERE a.k >= b.k
) WHERE rows > 0"""),
    "universe_keys": """
SELECT 'N' || s_nationkey AS universe, count(*) AS members, 'universe:v1:' || sha256('[' || string_agg('{"mic":"XNYS","symbol":"S' || s_suppkey || '"}', ',' ORDER BY 'S' || s_suppkey) || ']') AS universe_key FROM supplier GROUP BY 1""",
    "bar_identities": _with(_BARS, """
SELECT bar_key, 'daily-market-bar:v1:' || sha256('{"source_code":"LINEITEM","source_record_key":"' || symbol || '|' || session_date || '","source_version":"' || revision || '"}') AS key FROM revisions"""),
}
