"""Canonical texts, digests and keys as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Forms of symbols, currencies, codes and digests (fixed values).
SYMBOL = "^[A-Z0-9][A-Z0-9.-]{0,31}$"
CURRENCY = "^[A-Z]{3}$"
CODE = "^[A-Z0-9][A-Z0-9_.:-]{0,63}$"
DIGEST = "^[0-9a-f]{64}$"


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; nulls are written out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def semantic_key(prefix: str, text: Column) -> Column:
    """prefix:v1:digest."""
    return F.concat(F.lit(f"{prefix}:v1:"), digest(text))


#: Prefixes of the keys of records (fixed values).
RECORD_KINDS = (
    "daily-market-bar", "feature-snapshot", "universe", "daily-feature-run", "daily-feature-scoring-run", "daily-feature-outcome",
    "daily-feature-outcome-run", "daily-feature-outcome-label", "probability-calibration-dataset", "recommendation",
)


def record_key(kind: str, **identity: Column) -> Column:
    """The key of a record of one of the kinds: over the canonical JSON of what identifies it."""
    if kind not in RECORD_KINDS:
        raise ValueError(f"no such kind of record: {kind}")
    return semantic_key(kind, canonical_json(**identity))


def plain_decimal(x: Column) -> Column:
    """A decimal as text without exponent and without zeros at the end; zero is 0."""
    text = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, F.lit("0")).otherwise(text)


def fixed_decimal(x: Column, places: int) -> Column:
    """A decimal as text with exactly so many places, rounded half to even."""
    return F.bround(x.cast("decimal(38,18)"), places).cast(f"decimal(38,{places})").cast("string")


def rfc3339(ts: Column) -> Column:
    """A UTC timestamp with Z; the fraction only if it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def normal_symbol(x: Column) -> Column:
    """Trimmed and in capitals; null where that is no symbol."""
    text = F.upper(F.trim(x))
    return F.when(text.rlike(SYMBOL), text)


def normal_currency(x: Column) -> Column:
    """Trimmed and in capitals; null where that is no currency."""
    text = F.upper(F.trim(x))
    return F.when(text.rlike(CURRENCY), text)


def canonical_codes(codes: Column) -> Column:
    """Trimmed capitals without repeats, sorted."""
    return F.array_sort(F.array_distinct(F.transform(codes, lambda c: F.upper(F.trim(c)))))


def ordered_codes(codes: Column) -> Column:
    """Without nulls and repeats, in the order of their first places."""
    return F.array_distinct(F.array_compact(codes))


def new_york_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))


def uuid5_url(urn: Column) -> Column:
    """The name-based UUID (version 5) of a URN: the SHA-1 of namespace and name with the version and variant set."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))  # the namespace of URLs (fixed value)
    h = F.sha1(F.concat(space, urn.cast("binary")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.when(urn.isNotNull(), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12)))


def client_order_id(intent_id: Column, namespace: str) -> Column:
    """A stable order id; ``namespace`` is the URN that stands before v1 and the intent's id."""
    return uuid5_url(F.concat(F.lit(f"urn:{namespace}:client-order:v1:"), intent_id))


def broker_reference(client_order: Column) -> Column:
    return F.concat(F.lit("internal-paper:v1:"), client_order)


def intent_key(decision: Column, policy: str = "initial-fixed-usd-notional", version: str = "v1") -> Column:
    return F.concat(F.lit("decision:"), decision, F.lit(f"|intent-policy:{policy}|version:{version}"))


def execution_key(order: Column, sequence: Column) -> Column:
    return F.concat(F.lit("order:"), order, F.lit("|fill-policy:internal-paper-split-fill|version:v1|sequence:"), sequence.cast("string"))


def candidate_decision_key(candidate: Column, strategy: Column, version: Column) -> Column:
    return F.concat(F.lit("candidate:"), candidate, F.lit("|strategy:"), strategy, F.lit("|version:"), version)


def position_decision_key(position: Column, snapshot: Column, strategy: Column, version: Column) -> Column:
    return F.concat(F.lit("position:"), position, F.lit("|snapshot:"), snapshot, F.lit("|strategy:"), strategy, F.lit("|version:"), version)


#: Parts of keys whose values are masked (fixed values).
SECRET_PARTS = (
    "acnt_prdt_cd", "account", "app_key", "appkey", "app_secret", "appsecret", "approval", "authorization", "bearer",
    "cano", "chat_id", "chatid", "credential", "dsn", "passwd", "password", "secret", "token",
)


#: A telling key has one of the parts somewhere, its words joined by an underscore, a dash or a blank.
TELLING = "(?i)" + "|".join(part.replace("_", "[-_ ]") for part in SECRET_PARTS)


def redacted(pairs: Column, mask: str = "<redacted>") -> Column:
    """A map of strings with the values of telling keys masked."""
    return F.transform_values(pairs, lambda k, v: F.when(k.rlike(TELLING), F.lit(mask)).otherwise(v))


def _read_masked(text: str, mask: str = "<redacted>") -> object:
    """JSON as it is read, each object with the values of its telling keys masked."""
    telling = re.compile(TELLING).search
    return json.loads(text, object_pairs_hook=lambda pairs: {k: mask if telling(k) else v for k, v in pairs})


def redact(value: object, mask: str = "<redacted>") -> object:
    """What JSON can hold, with the values of telling keys masked at any depth."""
    return _read_masked(json.dumps(value), mask)


@F.pandas_udf(StringType())
def redacted_json(texts: pd.Series) -> pd.Series:
    """JSON texts of any shape with the values of telling keys masked; a text that is no JSON becomes null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_read_masked(text), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(one)


#: Names that would leak the future into features (fixed values, compared in lower case).
LEAKING = (
    "actual_result", "future_price", "future_prices", "future_return", "future_returns", "label", "labels", "outcome",
    "outcomes", "prediction", "predictions", "recommendation", "recommendations", "target", "target_label", "virtual_result",
)


def is_leaking(name: Column) -> Column:
    """Whether a name must not be among features; null for null."""
    return F.lower(name).isin(*LEAKING)


def leaking_columns(columns: list[str]) -> list[str]:
    """The columns that must not be among features."""
    return [c for c in columns if c.casefold() in LEAKING]
