"""The exact lane: Python decimals in Arrow batches, where digests or the last of 18 places must hold."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = Context(prec=38, rounding=ROUND_HALF_EVEN)


def decimal_text(x: Decimal) -> str:
    """Plain notation without zeros at the end."""
    text = format(x, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold_positions(fills: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, position_version, position_quantity, average_cost) after each fill: a fold that rounds to 18 places at every step.

    Fills stream by in order; only the quantity and cost of one position are held between batches.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, quantity, cost = None, 0, 0, Decimal(0)
        for frame in frames:
            rows = []
            with localcontext(Context(prec=80, rounding=ROUND_HALF_EVEN)):
                for *key, q, p in zip(*(frame[c] for c in (*keys, "quantity", "price"))):
                    key = [None if k is None or k != k else k for k in key]
                    if key != last:
                        last, n, quantity, cost = key, 0, 0, Decimal(0)
                    cost = ((quantity * cost + int(q) * Decimal(p)) / (quantity + int(q))).quantize(Decimal(1).scaleb(-18))
                    quantity += int(q)
                    n += 1
                    rows.append((*key, n, quantity, cost))
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "position_version", "position_quantity", "average_cost"])

    kinds = ", ".join(f"{k} {fills.schema[k].dataType.simpleString()}" for k in keys)
    dealt = fills.select(*dict.fromkeys([*keys, *order, "quantity", "price"])).repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, *(F.col(c).asc_nulls_last() for c in order))
    return dealt.mapInPandas(fold, f"{kinds}, position_version int, position_quantity long, average_cost decimal(38,18)")


FEATURE_SET = ("US_EQUITY_DAILY_TECHNICAL", "v1")


def _instant(x) -> str:
    return pd.Timestamp(x).strftime("%Y-%m-%dT%H:%M:%S") + (f".{x.microsecond:06d}" if x.microsecond else "") + "Z"


def exact_features(b: list) -> tuple[dict[str, object], str, list[str]]:
    """(values, quality, reasons) of 21 bars in order, in 38-digit decimals; rows have open, high, low, close prices and volume."""
    with localcontext(CONTEXT):
        o, h, low, c = ([Decimal(x[f"{k}_price"]).normalize() + 0 for x in b] for k in ("open", "high", "low", "close"))
        mean = lambda x: sum(x, Decimal(0)) / len(x)
        rate = lambda x, y: x / y - 1
        moves = [rate(y, x) for x, y in zip(c, c[1:])]
        middle = mean(moves)
        ranges = [max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])) for i in range(7, 21)]
        values: dict[str, object] = {
            "last_close": c[20], "one_day_return": rate(c[20], c[19]), "five_day_return": rate(c[20], c[15]), "twenty_day_return": rate(c[20], c[0]),
            "latest_gap_return": rate(o[20], c[19]), "latest_intraday_return": rate(c[20], o[20]), "latest_range_rate": (h[20] - low[20]) / c[19],
            "realized_volatility_20d": mean([(m - middle) ** 2 for m in moves]).sqrt(), "atr14_rate": mean(ranges) / c[20],
            "distance_from_prior_20d_high": rate(c[20], max(h[:20])), "distance_from_prior_20d_low": rate(c[20], min(low[:20])),
            **{f"close_vs_sma{n}": rate(c[20], mean(c[-n:])) for n in (5, 10, 20)},
            "adjustment_basis": b[0]["adjustment_basis"], "completed_bar_count": 21, "volume_ratio_5_to_20": None, "latest_volume_to_avg20": None, "average_dollar_volume_20": None,
        }
        volumes = [x["volume"] for x in b]
        if any(v is None or v != v for v in volumes):
            return values, "DEGRADED", ["VOLUME_DATA_INCOMPLETE"]
        v = [Decimal(int(x)) for x in volumes]
        usual = mean(v[1:])
        if not usual:
            return values, "DEGRADED", ["VOLUME_DATA_UNUSABLE"]
        values |= {"volume_ratio_5_to_20": mean(v[16:]) / usual, "latest_volume_to_avg20": v[20] / usual, "average_dollar_volume_20": mean([x * y for x, y in zip(c[1:], v[1:])])}
        return values, "READY", []


def feature_snapshots(bars: DataFrame, as_of, horizon: int, feature_set: tuple[str, str] = FEATURE_SET) -> DataFrame:
    """(source_code, symbol, snapshot_key, content_digest, quality_status, feature_values) of each series' last 21 sessions.

    ``bars`` holds at most 21 rows of a series, known at ``as_of``, with source_record_key, source_version, observed_at,
    available_at and content_digest. Series with fewer give no row.
    """

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame) == 21:
            rows = frame.sort_values("session_date").to_dict("records")
            values, quality, reasons = exact_features(rows)
            plain = {k: decimal_text(v) if isinstance(v, Decimal) else v for k, v in values.items()}
            order = ("source_code", "source_record_key", "source_version", "observed_at", "available_at", "content_digest")
            sources = [{k: _instant(r[k]) if k.endswith("_at") else r[k] for k in order} for r in rows]
            sources.sort(key=lambda r: tuple(r[k] or "" for k in order))
            name = {"as_of": _instant(as_of), "feature_set_code": feature_set[0], "feature_set_version": feature_set[1], "horizon_trading_days": horizon, "symbol": rows[0]["symbol"]}
            content = {"feature_values": plain, "latest_input_available_at": _instant(max(r["available_at"] for r in rows)), "provenance": sources, "quality_reason_codes": reasons, "quality_status": quality}
            out.append((rows[0]["source_code"], rows[0]["symbol"], f"feature-snapshot:v1:{sha256(canonical(name))}", sha256(canonical(content)), quality, canonical(plain)))
        return pd.DataFrame(out, columns=["source_code", "symbol", "snapshot_key", "content_digest", "quality_status", "feature_values"])

    return bars.groupBy("source_code", "symbol").applyInPandas(build, "source_code string, symbol string, snapshot_key string, content_digest string, quality_status string, feature_values string")
