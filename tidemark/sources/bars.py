"""Daily bars: from provider JSON, from trades in the relational tables, and into an append-only store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import canonical_json, digest, plain_decimal, rfc3339, semantic_key
from ..operators.pit import new_rows


@dataclass(frozen=True)
class Capabilities:
    """What a provider gives: the most rows of a request, and whether volumes of adjusted bars can be used."""

    source_code: str
    most_rows: int
    adjusted_volume: bool


#: Source codes, limits and names of mappings of two providers (fixed values).
TIME_SERIES = Capabilities("TWELVE_DATA_TIME_SERIES", 5_000, False)
PAGED_BARS = Capabilities("ALPACA_IEX_STOCK_BARS", 10_000, True)
TIME_SERIES_MAPPING, PAGED_MAPPING, PAGED_FEED = "twelve-data-time-series-v1", "alpaca-stock-bars-v1", "iex"

_SERIES = (
    "struct<status:string,meta:struct<symbol:string,interval:string,currency:string,mic_code:string,exchange:string,exchange_timezone:string>,"
    "values:array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>>"
)
_PAGE = "struct<symbol:string,bars:array<struct<t:string,o:decimal(38,18),h:decimal(38,18),l:decimal(38,18),c:decimal(38,18),v:bigint>>,next_page_token:string>"
_PRICES = ("open_price", "high_price", "low_price", "close_price")


def check_request(provider: Capabilities, rows: int) -> None:
    """A request for no rows, or for more than the provider gives, is refused before anything is fetched."""
    if not 1 <= rows <= provider.most_rows:
        raise ValueError(f"{provider.source_code} gives 1 to {provider.most_rows} rows, not {rows}")


def bar_problem(get=F.col) -> Column:
    """The first rule that a bar breaks, or null: all prices are above zero, the high is highest and the low lowest, the volume is not negative."""
    o, h, low, c, v = (get(x) for x in (*_PRICES, "volume"))
    return (
        F.when(F.coalesce(F.least(o, h, low, c) <= 0, F.lit(True)) | o.isNull() | h.isNull() | low.isNull() | c.isNull(), "NONPOSITIVE_PRICE")
        .when(h < F.greatest(o, low, c), "HIGH_TOO_LOW").when(low > F.least(o, h, c), "LOW_TOO_HIGH").when(v < 0, "NEGATIVE_VOLUME")
    )


def sound_bars(bars: DataFrame) -> DataFrame:
    """Bars that break no rule. What is left out can be counted by ``bar_problem``."""
    return bars.where(bar_problem().isNull())


def _named_bars(rows: DataFrame, problem: Column, provider: Capabilities, adjustment: str) -> DataFrame:
    """rows (payload's columns, _bars) with (problem): what an answer is refused for, else null."""
    twice = F.size(F.array_distinct(F.transform("_bars", lambda b: b["session_date"]))) < F.size("_bars")
    undated = F.exists("_bars", lambda b: b["session_date"].isNull())
    broken = F.exists("_bars", lambda b: bar_problem(lambda c: b[c]).isNotNull())
    return rows.withColumn("problem", problem.when(F.coalesce(twice | undated | broken, F.lit(False)), "RESPONSE_VALUE_INVALID"))


def read_time_series(payloads: DataFrame, adjustment: str = "SPLIT_ADJUSTED") -> DataFrame:
    """payloads (symbol asked for, mic_code, cutoff date, observed_at, body JSON) with (problem, _bars).

    An answer is refused as a whole, by name: PROVIDER_REJECTED_REQUEST if its status is not ok, RESPONSE_SCHEMA_INVALID
    if its head is not that of the request, RESPONSE_VALUE_INVALID for a session that comes twice or is no date, a price
    that is no positive number or out of order, or a volume that is no number. Volumes stay only for RAW bars.
    """
    same = lambda c, x: F.upper(F.trim(F.col(f"_j.meta.{c}"))).eqNullSafe(F.upper(x))
    rows = payloads.withColumn("_j", F.from_json("body", _SERIES))
    price = lambda x: x.try_cast("decimal(38,18)")
    number = lambda v: F.when(v["volume"].isNull() | (v["volume"] == ""), F.lit(0)).when(v["volume"].rlike("^[0-9]+$"), v["volume"].try_cast("long")).otherwise(F.lit(-1))
    kept = lambda v: number(v) if adjustment == "RAW" or TIME_SERIES.adjusted_volume else F.when(number(v) < 0, number(v))
    bars = F.transform("_j.values", lambda v: F.struct(
        F.when(F.length(F.trim(v["datetime"])) == 10, F.trim(v["datetime"]).try_cast("date")).alias("session_date"), price(v["open"]).alias("open_price"), price(v["high"]).alias("high_price"),
        price(v["low"]).alias("low_price"), price(v["close"]).alias("close_price"), kept(v).alias("volume"),
    ))
    head = same("symbol", F.col("symbol")) & same("currency", F.lit("USD")) & same("mic_code", F.col("mic_code")) & same("interval", F.lit("1day")) & same("exchange_timezone", F.lit("America/New_York"))
    head = head & (F.length(F.trim(F.coalesce(F.col("_j.meta.exchange"), F.lit("")))) > 0) & F.col("_j.values").isNotNull()
    problem = F.when(F.coalesce(F.col("_j.status") != "ok", F.lit(True)), "PROVIDER_REJECTED_REQUEST").when(~F.coalesce(head, F.lit(False)), "RESPONSE_SCHEMA_INVALID")
    return _named_bars(rows.withColumn("_bars", bars), problem, TIME_SERIES, adjustment).drop("_j")


def read_pages(pages: DataFrame) -> DataFrame:
    """pages (symbol, mic_code, cutoff date, observed_at, body JSON) with (problem, _bars), each page refused as a whole.

    A UTC instant belongs to its New York date. Prices are decimals of 18 places.
    """
    rows = pages.withColumn("_j", F.from_json("body", _PAGE))
    at = lambda b: F.when(b["t"].rlike(r"(Z|[+-]00:00)$"), F.try_to_timestamp(b["t"]))
    bars = F.transform("_j.bars", lambda b: F.struct(
        F.to_date(F.from_utc_timestamp(at(b), "America/New_York")).alias("session_date"), b["o"].alias("open_price"), b["h"].alias("high_price"), b["l"].alias("low_price"), b["c"].alias("close_price"), F.coalesce(b["v"], F.lit(-1)).alias("volume"),
    ))
    head = F.upper(F.trim(F.col("_j.symbol"))).eqNullSafe(F.col("symbol")) & F.col("_j.bars").isNotNull()
    return _named_bars(rows.withColumn("_bars", bars), F.when(~head, "RESPONSE_SCHEMA_INVALID"), PAGED_BARS, "").drop("_j")


def _unfolded(read: DataFrame, provider: Capabilities, adjustment: str, keep: int | None, mode: str, mark: str, content: dict) -> DataFrame:
    """The bars of answers without a problem: those up to the cutoff, of each answer's symbol the last ``keep``."""
    rows = read.where("problem is null").select("symbol", "mic_code", "cutoff", "observed_at", F.explode("_bars").alias("b")).select("symbol", "mic_code", "cutoff", "observed_at", "b.*")
    rows = rows.where("session_date <= cutoff")
    if keep is not None:
        check_request(provider, keep)
        rows = rows.withColumn("_back", F.row_number().over(Window.partitionBy("symbol", "mic_code", "observed_at").orderBy(F.desc("session_date")))).where(F.col("_back") <= keep)
    text = lambda c: plain_decimal(F.col(c))
    version = digest(canonical_json(
        close=text("close_price"), high=text("high_price"), low=text("low_price"), mic_code=F.col("mic_code"), open=text("open_price"), session_date=F.col("session_date").cast("string"), symbol=F.col("symbol"), volume=F.col("volume"),
        **{k: F.lit(v) for k, v in content.items()},
    ))
    key = F.concat_ws(".", "mic_code", "symbol", F.date_format("session_date", "yyyyMMdd"), F.lit(mark))
    return rows.select(
        F.lit(provider.source_code).alias("source_code"), key.alias("source_record_key"), version.alias("source_version"), "symbol", F.lit("USD").alias("currency"), F.lit(adjustment).alias("adjustment_basis"),
        "session_date", *_PRICES, "volume", "observed_at", F.col("observed_at").alias("available_at"),
    )


def parse_time_series(payloads: DataFrame, keep: int, adjustment: str = "SPLIT_ADJUSTED") -> DataFrame:
    """Bars of time-series answers that ``read_time_series`` finds no problem in: the last ``keep`` up to the cutoff.

    Availability is the time of observation. The source version is a digest of the content that was mapped, without the
    time of fetching.
    """
    mode = "SPLITS" if adjustment == "SPLIT_ADJUSTED" else "NONE"
    return _unfolded(read_time_series(payloads, adjustment), TIME_SERIES, adjustment, keep, mode, mode, {"adjustment_mode": mode, "mapping_version": TIME_SERIES_MAPPING})


def parse_pages(pages: DataFrame, keep: int | None = None, adjustment: str = "SPLIT_ADJUSTED") -> DataFrame:
    """Bars of pages that ``read_pages`` finds no problem in, up to the cutoff; of each symbol's pages the last ``keep``."""
    mode = "SPLIT" if adjustment == "SPLIT_ADJUSTED" else "RAW"
    return _unfolded(read_pages(pages), PAGED_BARS, adjustment, keep, mode, f"{PAGED_FEED.upper()}.{mode}", {"adjustment": mode, "feed": PAGED_FEED, "mapping_version": PAGED_MAPPING})


def read_paged(pages: DataFrame) -> DataFrame:
    """pages (symbol, page, body, problem, mic_code, cutoff, observed_at) as one answer a symbol with (problem, _bars).

    A symbol's pages are read in order and refused together: for the first page that ``read_pages`` finds a problem in or
    that repeats a session of the pages before it (RESPONSE_VALUE_INVALID), else for what broke the pages off.
    """
    named = pages.withColumnRenamed("problem", "_fetched")
    read = read_pages(named).withColumn("problem", F.when(F.col("_fetched").isNull(), F.col("problem")))
    days = F.transform("_bars", lambda b: b["session_date"])
    one = F.struct("page", "problem", F.coalesce(days, F.array().cast("array<date>")).alias("days"), "_bars")
    made = read.groupBy("symbol", "mic_code", "cutoff", "observed_at").agg(F.array_sort(F.collect_list(one)).alias("_pages"), F.max("_fetched").alias("_fetched"))
    start = F.struct(F.array().cast("array<date>").alias("days"), F.lit(None).cast("string").alias("problem"))
    again = lambda seen, p: F.when(F.arrays_overlap(seen["days"], p["days"]), F.lit("RESPONSE_VALUE_INVALID"))
    last = F.aggregate("_pages", start, lambda seen, p: F.struct(F.concat(seen["days"], p["days"]).alias("days"), F.coalesce(seen["problem"], p["problem"], again(seen, p)).alias("problem")))
    bars = F.flatten(F.transform(F.filter("_pages", lambda p: p["_bars"].isNotNull()), lambda p: p["_bars"]))
    return made.select("symbol", "mic_code", "cutoff", "observed_at", F.coalesce(last["problem"], "_fetched").alias("problem"), bars.alias("_bars"))


def parse_paged(pages: DataFrame, keep: int | None = None, adjustment: str = "SPLIT_ADJUSTED") -> DataFrame:
    """Bars of the symbols that ``read_paged`` finds no problem in: the last ``keep`` of each up to the cutoff."""
    mode = "SPLIT" if adjustment == "SPLIT_ADJUSTED" else "RAW"
    return _unfolded(read_paged(pages), PAGED_BARS, adjustment, keep, mode, f"{PAGED_FEED.upper()}.{mode}", {"adjustment": mode, "feed": PAGED_FEED, "mapping_version": PAGED_MAPPING})


def fetch_pages(fetch: Callable[[str | None], tuple[str, str | None]], most_pages: int = 100) -> Iterator[str]:
    """The bodies of a paged answer. A loader's loop on the driver: one request after the other, as tokens come."""
    seen, token = set(), None
    for _ in range(most_pages):
        body, token = fetch(token)
        yield body
        if token is None:
            return
        if token in seen:
            raise ValueError("a page token came twice")
        seen.add(token)
    raise ValueError("too many pages")


def bar_key(source: Column, record: Column, version: Column) -> Column:
    return semantic_key("daily-market-bar", canonical_json(source_code=source, source_record_key=record, source_version=version))


def content_digest(bars: DataFrame) -> DataFrame:
    """bars with (content_digest): over the sorted compact JSON of their content, prices as plain decimals."""
    p = lambda c: plain_decimal(F.col(c))
    text = canonical_json(
        adjustment_basis=F.col("adjustment_basis"), available_at=rfc3339(F.col("available_at")), close=p("close_price"), currency=F.col("currency"),
        high=p("high_price"), low=p("low_price"), observed_at=rfc3339(F.col("observed_at")), open=p("open_price"),
        session_date=F.col("session_date").cast("string"), symbol=F.col("symbol"), volume=F.col("volume"),
    )
    return bars.withColumn("content_digest", digest(text))


def ingest(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts of CREATED and ALREADY_EXISTS): the first row of an identity stays for good."""
    status = incoming.join(stored.select(*keys).dropDuplicates().withColumn("_have", F.lit(True)), keys, "left")
    counts = status.groupBy(F.when(F.col("_have"), "ALREADY_EXISTS").otherwise("CREATED").alias("status")).agg(F.count(F.lit(1)).alias("bars"))
    return new_rows(incoming, stored, keys), counts


def append(bars: DataFrame, path: str) -> None:
    """Appends bars to a Parquet store by source; a run's files become visible together."""
    bars.repartition("source_code", "symbol").sortWithinPartitions("symbol", "session_date").write.mode("append").partitionBy("source_code").parquet(path)


def lookup(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """Rows by key; equalities reach the Parquet scan."""
    df = spark.read.parquet(path)
    for column, value in keys.items():
        df = df.where(F.col(column) == value)
    return df


def line_order() -> Column:
    """The order of lines by order, number, part, quantity and price as one number of 37 digits.

    A number keeps its place in the buffers of a hash aggregation, where a struct would make Spark sort the table. Orders
    have up to 12 digits, numbers of lines 2, parts 11, quantities are whole and under 1,000, prices have two places. What
    fits a long is put together there, for decimals of this length are slow.
    """
    line = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("decimal(14,0)")
    part = (F.col("l_partkey") * 1000 + F.col("l_quantity").cast("long")).cast("decimal(14,0)")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("decimal(9,0)")
    return (line * F.lit(Decimal(10**23)) + (part * F.lit(Decimal(10**9)) + cents)).cast("decimal(38,0)")


def lineitem_revisions(lineitem: DataFrame) -> DataFrame:
    """Sound bars of suppliers from order lines; on days 5, 10, ... a revision follows two days later with prices 1 % higher.

    Volumes of days 97, 194, ... of a year are not known.
    """
    price = (F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")) / 10).alias("price")
    key = line_order()
    lines = lineitem.select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("session_date"), price, F.col("l_quantity").alias("quantity"), key.alias("key"))
    bars = lines.groupBy("symbol", "session_date").agg(
        F.min_by("price", "key").alias("open_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"), F.max_by("price", "key").alias("close_price"), F.sum("quantity").cast("long").alias("volume")
    )
    step = lambda n, x: F.struct(F.lit(n).alias("revision"), F.lit(x).alias("x"))
    factor = F.explode(F.when(F.dayofmonth("session_date") % 5 == 0, F.array(step(1, 1.0), step(2, 1.01))).otherwise(F.array(step(1, 1.0))))
    rows = sound_bars(bars).withColumn("f", factor)
    moved = lambda c: (F.col(c) * F.col("f.x")).alias(c)
    available = F.col("session_date").cast("timestamp") + F.when(F.col("f.revision") == 1, F.expr("interval 23 hours")).otherwise(F.expr("interval 71 hours"))
    return rows.select(
        F.lit("LINEITEM").alias("source_code"), F.lit("SPLIT_ADJUSTED").alias("adjustment_basis"), "symbol", "session_date", moved("open_price"), moved("high_price"), moved("low_price"), moved("close_price"),
        F.when(F.dayofyear("session_date") % 97 != 0, F.col("volume")).alias("volume"), available.alias("available_at"),
        F.concat_ws("|", "symbol", F.col("session_date").cast("string"), F.col("f.revision").cast("string")).alias("bar_key"),
    )


def event_days(events: DataFrame, source: str = "EVENTS") -> DataFrame:
    """Days of users from the values of their events, in the order of time, as bars that may break rules; volume is the number of events."""
    bars = events.groupBy(F.concat(F.lit("U"), "user_id").alias("symbol"), F.to_date("ts").alias("session_date")).agg(
        F.min_by("value", "ts").alias("open_price"), F.max("value").alias("high_price"), F.min("value").alias("low_price"), F.max_by("value", "ts").alias("close_price"), F.count(F.lit(1)).alias("volume")
    )
    return bars.select(
        F.lit(source).alias("source_code"), F.lit("SPLIT_ADJUSTED").alias("adjustment_basis"), "symbol", "session_date", "open_price", "high_price", "low_price", "close_price", "volume",
        (F.col("session_date").cast("timestamp") + F.expr("interval 23 hours")).alias("available_at"), F.concat_ws("|", "symbol", F.col("session_date").cast("string")).alias("bar_key"),
    )


def event_bars(events: DataFrame, source: str = "EVENTS") -> DataFrame:
    """The sound ones of ``event_days``: a day with a price of zero or less makes no bar."""
    return sound_bars(event_days(events, source))
