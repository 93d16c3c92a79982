"""US equity sessions 2018-2026 as a DataFrame, and the operators on sessions.

Holidays follow their rules (a fixed weekday of a month, a date moved off weekends, Good Friday before Easter); days of
mourning are the only ones listed.
"""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEW_YORK = ZoneInfo("America/New_York")
FIRST, LAST = date(2018, 1, 1), date(2026, 12, 31)
#: Sessions of each year from 2018 (fixed values, against which the rules are checked).
SESSIONS_PER_YEAR = (251, 252, 253, 252, 251, 250, 252, 250, 251)
#: Days of mourning (fixed values).
MOURNING = ((date(2018, 12, 5), "NATIONAL_DAY_OF_MOURNING_GHW_BUSH"), (date(2025, 1, 9), "NATIONAL_DAY_OF_MOURNING_JIMMY_CARTER"))
#: Exchange codes and the family of each (fixed values).
FAMILIES = {"XNGS": "NASDAQ_CORE", "XNGM": "NASDAQ_CORE", "XNCM": "NASDAQ_CORE", "XNYS": "NYSE_CORE", "XASE": "NYSE_CORE"}


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month; from its end if n is negative."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _easter(year: int) -> date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * w) // 451
    n = h + w - 7 * m + 114
    return date(year, n // 31, n % 31 + 1)


def closures(year: int) -> list[tuple[date, str]]:
    found = [
        (_nth(year, 1, 0, 3), "MARTIN_LUTHER_KING_JR_DAY"),
        (_nth(year, 2, 0, 3), "WASHINGTONS_BIRTHDAY"),
        (_easter(year) - timedelta(2), "GOOD_FRIDAY"),
        (_nth(year, 5, 0, -1), "MEMORIAL_DAY"),
        (_nth(year, 9, 0, 1), "LABOR_DAY"),
        (_nth(year, 11, 3, 4), "THANKSGIVING_DAY"),
    ]
    dated = [(date(year, 1, 1), "NEW_YEARS_DAY"), (date(year, 7, 4), "INDEPENDENCE_DAY"), (date(year, 12, 25), "CHRISTMAS_DAY")]
    if year >= 2022:
        dated.append((date(year, 6, 19), "JUNETEENTH"))
    for day, name in dated:
        if day.weekday() == 5:
            if name == "NEW_YEARS_DAY":  # would fall into the year before, which keeps its last day
                continue
            found.append((day - timedelta(1), f"{name}_OBSERVED"))
        elif day.weekday() == 6:
            found.append((day + timedelta(1), f"{name}_OBSERVED"))
        else:
            found.append((day, name))
    return sorted(found + [x for x in MOURNING if x[0].year == year])


def early_closes(year: int) -> list[tuple[date, str]]:
    closed = {d for d, _ in closures(year)}
    found = [
        (date(year, 7, 3), "INDEPENDENCE_DAY_EVE"),
        (_nth(year, 11, 3, 4) + timedelta(1), "DAY_AFTER_THANKSGIVING"),
        (date(year, 12, 24), "CHRISTMAS_EVE"),
    ]
    eve = date(year, 7, 4).weekday() not in (5, 6)
    return [(d, name) for d, name in found if d.weekday() < 5 and d not in closed and (eve or name != "INDEPENDENCE_DAY_EVE")]


@lru_cache(maxsize=1)
def _session_rows() -> tuple[tuple, ...]:
    """(family, seq, session_date, kind, open_at, close_at) of all sessions: weekdays that are not closed."""
    closed = {d for y in range(FIRST.year, LAST.year + 1) for d, _ in closures(y)}
    early = {d for y in range(FIRST.year, LAST.year + 1) for d, _ in early_closes(y)}
    days = [d for i in range((LAST - FIRST).days + 1) if (d := FIRST + timedelta(i)).weekday() < 5 and d not in closed]
    at = lambda d, hour, minute=0: datetime(d.year, d.month, d.day, hour, minute, tzinfo=NEW_YORK).astimezone(UTC)
    return tuple(
        (family, seq, d, "EARLY_CLOSE" if d in early else "REGULAR", at(d, 9, 30), at(d, 13 if d in early else 16))
        for family in sorted(set(FAMILIES.values())) for seq, d in enumerate(days, 1)
    )


def trading_sessions(spark: SparkSession, first: date = FIRST, last: date = LAST) -> DataFrame:
    """(family, seq, session_date, kind, open_at, close_at): both families, seq from 1 over all that is covered."""
    rows = [r for r in _session_rows() if first <= r[2] <= last]
    return spark.createDataFrame(rows, "family string, seq int, session_date date, kind string, open_at timestamp, close_at timestamp")


#: Calendar code and version -> the days it covers (fixed values).
CALENDARS = {("US_EQUITY_CORE", "2026.v1"): (date(2026, 1, 1), date(2026, 12, 31)), ("US_EQUITY_CORE", "2018-2026.v1"): (FIRST, LAST)}


def resolve(code: str, version: str) -> tuple[date, date]:
    """The coverage of exactly this calendar and version; no other stands in for one that is not known."""
    if (code, version) not in CALENDARS:
        raise ValueError(f"CALENDAR_VERSION_UNSUPPORTED: {code} {version}")
    return CALENDARS[code, version]


def coverage(asked: DataFrame) -> DataFrame:
    """asked (code, version) with (first, last), the days that exactly this calendar covers; null for one that is not known."""
    known = asked.sparkSession.createDataFrame([(*k, *v) for k, v in CALENDARS.items()], "code string, version string, first date, last date")
    return asked.join(F.broadcast(known), ["code", "version"], "left")  # a handful of calendars


def sessions_between(spark: SparkSession, first: date, last: date, code: str = "US_EQUITY_CORE", version: str = "2018-2026.v1") -> DataFrame:
    """Sessions from ``first`` to ``last``, both included, which have to lie within the calendar's coverage."""
    start, end = resolve(code, version)
    if not start <= first <= last <= end:
        raise ValueError(f"CALENDAR_OUT_OF_COVERAGE: {first} to {last} is not within {start} to {end}")
    return trading_sessions(spark, first, last)


def count_violations(sessions: DataFrame) -> DataFrame:
    """(family, year, sessions, expected) of the years whose number of sessions is not the fixed one."""
    expected = F.create_map(*(x for i, n in enumerate(SESSIONS_PER_YEAR) for x in (F.lit(FIRST.year + i), F.lit(n))))
    counts = sessions.groupBy("family", F.year("session_date").alias("year")).agg(F.count(F.lit(1)).alias("sessions"))
    made = counts.withColumn("expected", F.try_element_at(expected, F.col("year")).cast("long"))
    return made.where(~F.col("sessions").eqNullSafe(F.col("expected")))


def family_of(mic: Column) -> Column:
    """The calendar family of an exchange code; null for one that is not supported."""
    pairs = [x for k, v in FAMILIES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(mic)))


def session_days(sessions: DataFrame) -> DataFrame:
    """(family, day, last): each day from the first session on, with the last three sessions on or before it, newest first.

    Some thousand rows whatever the data, so an equi-join by day finds a session without a search through the calendar.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("family").orderBy("session_date")
    own = F.struct("close_at", "session_date")
    made = sessions.withColumns({"own": own, "one": F.lag(own, 1).over(w), "two": F.lag(own, 2).over(w), "until": F.lead("session_date").over(w)})
    until = F.coalesce(F.date_sub("until", 1), F.lit(LAST))
    return made.select("family", F.explode(F.sequence("session_date", until)).alias("day"), F.array_compact(F.array("own", "one", "two")).alias("last"))


def last_session() -> date:
    """The last session that the calendar covers."""
    closed, day = {d for d, _ in closures(LAST.year)}, LAST
    while day.weekday() > 4 or day in closed:
        day -= timedelta(1)
    return day


def completed_session(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests (mic_code, as_of, grace_seconds) with (outcome, session_date): the greatest session closed and past its grace.

    Coverage is that of the New York date of ``as_of``. A grace of up to a day reaches back two sessions at most, which
    the days of the calendar hold.
    """
    ids = requests.withColumn("family", family_of(F.col("mic_code"))).withColumn("day", F.to_date(F.from_utc_timestamp("as_of", "America/New_York")))
    joined = ids.join(F.broadcast(session_days(sessions)), ["family", "day"], "left")
    done = F.filter("last", lambda d: d["close_at"] + F.make_dt_interval(secs=F.col("grace_seconds")) <= F.col("as_of"))
    found = F.try_element_at(done, F.lit(1))["session_date"]
    outcome = (
        F.when(F.col("family").isNull(), "UNSUPPORTED_MIC").when(~F.col("day").between(F.lit(FIRST), F.lit(LAST)), "CALENDAR_OUT_OF_COVERAGE")
        .when(found.isNull(), "NO_COMPLETED_SESSION").otherwise("RESOLVED")
    )
    return joined.select(*requests.columns, outcome.alias("outcome"), F.when(outcome == "RESOLVED", found).alias("session_date"))


def session_lookup(dates: DataFrame, sessions: DataFrame, day: str = "day", checked: bool = True) -> DataFrame:
    """dates with (is_session, latest): whether a day is a session, and the latest session on or before it.

    Out of coverage ``latest`` is null; with ``checked`` false, days after the last session still get it.
    """
    days = session_days(sessions.where(F.col("family") == "NASDAQ_CORE")).select(F.col("day").alias("_day"), F.col("last")[0]["session_date"].alias("_latest"))
    joined = dates.join(F.broadcast(days), F.col(day) == F.col("_day"), "left")
    latest = F.col("_latest") if checked else F.when(F.col(day) > F.lit(LAST), F.lit(last_session())).otherwise(F.col("_latest"))
    return joined.select(*dates.columns, F.coalesce(F.col("_latest") == F.col(day), F.lit(False)).alias("is_session"), latest.alias("latest"))


#: Violations of a bar's session, in the order in which they are looked for.
BAR_VIOLATIONS = ("UNSUPPORTED_MIC", "OUT_OF_CALENDAR_COVERAGE", "AFTER_COMPLETED_CUTOFF", "DUPLICATE_SESSION", "ON_NON_TRADING_DAY", "SEQUENCE_INCONSISTENT")


def bar_violations(bars: DataFrame, sessions: DataFrame, cutoff: Column) -> DataFrame:
    """bars (mic_code, source_code, symbol, session_date, arrival) with the first violation of each, or null."""
    from pyspark.sql.window import Window

    feed = Window.partitionBy("source_code", "symbol").orderBy("arrival")
    again = F.row_number().over(Window.partitionBy("source_code", "symbol", "session_date").orderBy("arrival")) > 1
    known = sessions.select("family", "session_date", F.lit(True).alias("trading"))
    joined = bars.withColumn("family", family_of(F.col("mic_code"))).withColumn("again", again).withColumn("before", F.lag("session_date").over(feed))
    joined = joined.join(F.broadcast(known), ["family", "session_date"], "left")  # the calendar, of fixed size
    first = (
        F.when(F.col("family").isNull(), BAR_VIOLATIONS[0]).when(~F.col("session_date").between(F.lit(FIRST), F.lit(LAST)), BAR_VIOLATIONS[1])
        .when(F.col("session_date") > cutoff, BAR_VIOLATIONS[2]).when(F.col("again"), BAR_VIOLATIONS[3])
        .when(F.col("trading").isNull(), BAR_VIOLATIONS[4]).when(F.col("session_date") < F.col("before"), BAR_VIOLATIONS[5])
    )
    return joined.select(*bars.columns, first.alias("violation"))
