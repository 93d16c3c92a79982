"""Candidate filters: five checks, four weighted sets, entry decisions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, ordered_codes

CHECKS = ("PRICE_RANGE", "OPENING_CHANGE_MIN", "ENTRY_CHANGE_MAX", "BREAKOUT_TRIGGERED", "VOLUME_PRESENT")
WEIGHTS = dict(zip(CHECKS, (20, 20, 20, 30, 10)))
#: Set -> (hard checks, least score).
FILTER_SETS = {
    "STRICT": (CHECKS, 100),
    "BALANCED": (("PRICE_RANGE", "ENTRY_CHANGE_MAX"), 70),
    "SCORE_ONLY": ((), 60),
    "OBSERVATION": ((), 0),
}


def _rate(text: str) -> Column:
    """A short decimal literal: with DECIMAL(30,18) prices a product stays exact, with DOUBLE it is a DOUBLE."""
    return F.lit(Decimal(text))


def breakout_price(base: Column, high: Column, low: Column, k: str = "0.5") -> Column:
    return base + (high - low) * _rate(k)


def filter_checks(snapshots: DataFrame) -> DataFrame:
    """snapshots with an outcome and a reason for each check, in multiplied form, so that no division rounds.

    A null previous close makes the two changes NOT_EVALUABLE, a null volume FAILs; the breakout starts at the previous
    high.
    """
    last, close = F.col("last_price"), F.col("previous_close_price")
    opened = F.col("open_price") - close >= _rate("0.03") * close
    entered = last - close <= _rate("0.15") * close
    broke = last >= breakout_price(F.col("previous_high_price"), F.col("previous_high_price"), F.col("previous_low_price"))
    three = lambda ok: F.when(close.isNull(), "NOT_EVALUABLE").when(ok, "PASS").otherwise("FAIL")
    two = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    return snapshots.withColumns({
        "price_range": two(last.between(10, 300)), "opening_change_min": three(opened), "entry_change_max": three(entered),
        "breakout_triggered": two(broke), "volume_present": two(F.coalesce(F.col("volume"), F.lit(0)) > 0),
        "price_reason": F.when(last < 10, "PRICE_BELOW_MINIMUM").when(last > 300, "PRICE_ABOVE_MAXIMUM").otherwise("PRICE_WITHIN_RANGE"),
    })


def filter_evaluations(checked: DataFrame) -> DataFrame:
    """One row for each candidate and set: (filter_set, score, passed, blocking_codes, details).

    The score is the weight of the checks that pass. Hard FAILs, hard NOT_EVALUABLEs and a score below the least block,
    in that order; OBSERVATION always passes. Four literal sets are unfolded in place: no join is needed.
    """
    sets = F.explode(F.array(*(F.struct(F.lit(k).alias("filter_set"), F.lit(v[1]).alias("least")) for k, v in FILTER_SETS.items())))
    rows = checked.withColumn("s", sets).select(*checked.columns, "s.*")
    score = sum((F.when(F.col(c.lower()) == "PASS", WEIGHTS[c]).otherwise(0) for c in CHECKS), F.lit(0))
    hard = lambda c: F.col("filter_set").isin(*(k for k, v in FILTER_SETS.items() if c in v[0]))
    fails = [F.when(hard(c) & (F.col(c.lower()) == "FAIL"), F.lit(f"HARD_FAIL_{c}")) for c in CHECKS]
    unknown = [F.when(hard(c) & (F.col(c.lower()) == "NOT_EVALUABLE"), F.lit(f"HARD_NOT_EVALUABLE_{c}")) for c in CHECKS]
    rows = rows.withColumn("score", score)
    low = F.when(F.col("score") < F.col("least"), F.lit("SCORE_BELOW_MINIMUM"))
    observing = F.col("filter_set") == "OBSERVATION"
    codes = F.when(observing, F.array().cast("array<string>")).otherwise(ordered_codes(F.array(*fails, *unknown, low)))
    count = lambda what: sum((F.when(F.col(c.lower()) == what, 1).otherwise(0) for c in CHECKS), F.lit(0))
    # Whether a row passes is told without its codes, so that plans which do not read them never make them.
    blocked = F.col("score") < F.col("least")
    for c in CHECKS:
        blocked = blocked | F.coalesce(hard(c) & F.col(c.lower()).isin("FAIL", "NOT_EVALUABLE"), F.lit(False))
    rows = rows.withColumn("blocking_codes", codes).withColumn("passed", observing | ~blocked)
    details = canonical_json(counts=F.struct(count("FAIL").alias("fail"), count("NOT_EVALUABLE").alias("not_evaluable"), count("PASS").alias("pass")), filter_set_name=F.col("filter_set"), blocking_reason_codes=F.col("blocking_codes"))
    return rows.withColumn("details", details).drop("least")


def entry_decisions(evaluations: DataFrame) -> DataFrame:
    """evaluations with (action, reason_codes): OBSERVE for the observing set, ENTER_LONG if passed, else SKIP with what blocks."""
    observing = F.col("filter_set") == "OBSERVATION"
    action = F.when(observing, "OBSERVE").when(F.col("passed"), "ENTER_LONG").otherwise("SKIP")
    lead = F.when(observing, "OBSERVATION_ONLY").when(F.col("passed"), "FILTER_PASSED").otherwise("FILTER_BLOCKED")
    return evaluations.withColumn("action", action).withColumn("reason_codes", F.concat(F.array(lead), F.when(F.col("action") == "SKIP", F.col("blocking_codes")).otherwise(F.array().cast("array<string>"))))
