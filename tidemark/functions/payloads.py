"""Payloads of open shape: JSON kept as VARIANT, and what in it is not as agreed, by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "array<struct<path:string,finding:string,kind:string>>"

#: A time-series answer as it was agreed: members by name, a list for arrays, kinds of values; ``?`` marks members that may lack.
SERIES_SHAPE: Mapping = {
    "status": "STRING",
    "meta": {"symbol": "STRING", "interval": "STRING", "currency": "STRING", "mic_code": "STRING", "exchange": "STRING", "exchange_timezone": "STRING", "type?": "STRING"},
    "values": [{"datetime": "STRING", "open": "STRING", "high": "STRING", "low": "STRING", "close": "STRING", "volume?": "STRING"}],
}


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID (for JSON's null)."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _found(path: Column, finding: str, kind: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(finding).alias("finding"), kind.alias("kind"))


def findings(value: Column, shape, path: Column | str = "$") -> Column:
    """An array of (path, finding, kind) of a variant that is not of a shape; empty for one that is.

    Shapes are mappings of members, lists of one shape, and names of kinds, several separated by ``|``. UNKNOWN_MEMBER is
    named with its kind and not looked into; MISSING_MEMBER has no kind; WRONG_KIND has the kind that was found. Elements
    of arrays share a path, which ends in ``[]``. Kinds are exact: a number is no text, and null is VOID.
    """
    path = F.lit(path) if isinstance(path, str) else path
    none = F.array().cast(FINDING)
    if isinstance(shape, str):
        return F.when(kind_of(value).isin(*shape.split("|")), none).otherwise(F.array(_found(path, "WRONG_KIND", kind_of(value))).cast(FINDING))
    wrong = F.array(_found(path, "WRONG_KIND", kind_of(value))).cast(FINDING)
    if isinstance(shape, list):
        inside = F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: findings(x, shape[0], F.concat(path, F.lit("[]")))))
        return F.when(kind_of(value) == "ARRAY", inside).otherwise(wrong)
    members, named = F.try_variant_get(value, "$", "map<string,variant>"), [k.removesuffix("?") for k in shape]
    at = lambda k: F.concat(path, F.lit("."), k)
    unknown = F.transform(F.filter(F.map_keys(members), lambda k: ~k.isin(*named)), lambda k: _found(at(k), "UNKNOWN_MEMBER", kind_of(members[k])))
    parts = [unknown.cast(FINDING)]
    for key, inner in shape.items():
        name = key.removesuffix("?")
        lacking = none if key.endswith("?") else F.array(_found(at(F.lit(name)), "MISSING_MEMBER", F.lit(None).cast("string"))).cast(FINDING)
        parts.append(F.when(F.map_contains_key(members, name), findings(members[name], inner, at(F.lit(name)))).otherwise(lacking))
    return F.when(kind_of(value) == "OBJECT", F.concat(*parts)).otherwise(wrong)


def with_findings(bodies: DataFrame, shape, body: str = "body") -> DataFrame:
    """bodies with (value, findings): the text as VARIANT, and what is not as agreed. A text that is no JSON, or none, is NOT_JSON."""
    read = bodies.withColumn("value", F.try_parse_json(body))
    broken = F.array(_found(F.lit("$"), "NOT_JSON", F.lit(None).cast("string"))).cast(FINDING)
    return read.withColumn("findings", F.when(F.col("value").isNull(), broken).otherwise(findings(F.col("value"), shape)))


def drift_report(bodies: DataFrame, shape, body: str = "body") -> DataFrame:
    """(path, finding, kind, bodies, places): how many bodies have a finding, and in how many places, in one scan; empty if all are as agreed."""
    each = F.transform(F.array_distinct("findings"), lambda f: F.struct(f.alias("f"), F.size(F.filter("findings", lambda x: x.eqNullSafe(f))).alias("n")))
    found = with_findings(bodies, shape, body).select(F.explode(each).alias("e"))
    return found.groupBy("e.f").agg(F.count(F.lit(1)).alias("bodies"), F.sum("e.n").alias("places")).select("f.path", "f.finding", "f.kind", "bodies", "places")
