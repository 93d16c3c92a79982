"""From decisions to positions: sizing, orders, fills, weighted costs and exits."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import execution_key, ordered_codes

#: Legal moves of an order.
ORDER_MOVES = (("ACCEPTED", "PARTIALLY_FILLED"), ("ACCEPTED", "FILLED"), ("PARTIALLY_FILLED", "FILLED"))


def sized(decisions: DataFrame, notional: int = 1000) -> DataFrame:
    """decisions (price) with (quantity, notional, intent_status): as many whole shares as the notional buys; none is REJECTED.

    A price that is null or not above zero buys none.
    """
    quantity = F.coalesce(F.when(F.col("price") > 0, F.floor(F.try_divide(F.lit(notional), F.col("price"))).cast("long")), F.lit(0).cast("long"))
    return decisions.withColumn("quantity", quantity).withColumns({
        "intent_status": F.when(F.col("quantity") < 1, "REJECTED").otherwise("CREATED"), "notional": F.col("price") * F.col("quantity"),
    })


def broker_result(currency: Column, side: Column, kind: Column) -> Column:
    """What the paper broker says; the first reason that applies."""
    return (
        F.when(currency != "USD", "REJECTED_CURRENCY").when(side != "BUY", "REJECTED_SIDE").when(kind != "MARKET", "REJECTED_ORDER_TYPE").otherwise("ACCEPTED")
    )


def split_fills(orders: DataFrame) -> DataFrame:
    """One row a fill of orders (order_id, quantity): one of 1, else two halves, the second with the odd share."""
    n = F.col("quantity")
    half = F.floor(n / 2).cast("long")
    plan = F.when(n == 1, F.array(n)).otherwise(F.array(half, n - half))
    rest = [c for c in orders.columns if c != "quantity"]
    made = orders.where(n >= 1).select(*rest, F.posexplode(plan).alias("at", "quantity")).withColumn("fill_sequence", F.col("at") + 1).drop("at")
    return made.withColumn("execution_key", execution_key(F.col("order_id").cast("string"), F.col("fill_sequence")))


def fill_violations(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """fills with (violation): the first fact that does not fit the order's plan, or null."""
    w = Window.partitionBy("order_id").orderBy("fill_sequence", "execution_key")
    plan = orders.select("order_id", F.col("quantity").alias("requested"), F.col("price").alias("reference"), F.col("accepted_at").alias("since"))
    rows = fills.withColumns({"expected": F.row_number().over(w), "running": F.sum("quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))}).join(plan, "order_id")
    half = F.floor(F.col("requested") / 2)
    due = F.when(F.col("requested") == 1, F.col("requested")).when(F.col("expected") == 1, half).otherwise(F.col("requested") - half)
    most = F.when(F.col("requested") == 1, 1).otherwise(2)
    violation = (
        F.when(F.col("expected") > most, "too_many_fills").when(F.col("fill_sequence") != F.col("expected"), "sequence_mismatch")
        .when(F.col("execution_key") != execution_key(F.col("order_id").cast("string"), F.col("expected")), "execution_key_mismatch").when(F.col("quantity") != due, "quantity_mismatch")
        .when(F.col("price") != F.col("reference"), "price_mismatch").when(F.col("fee") != 0, "nonzero_fee").when(F.col("executed_at") < F.col("since"), "execution_precedes_acceptance")
        .when(F.col("running") > F.col("requested"), "overfill")
    )
    return rows.select(*fills.columns, violation.alias("violation"))


def legal_move(old: Column, new: Column) -> Column:
    return F.concat_ws(">", old, new).isin(*(f"{a}>{b}" for a, b in ORDER_MOVES))


def running_positions(fills: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """fills with (position_version, position_quantity, average_cost) after each: running sums, so DOUBLE prices suffice.

    Exact averages, rounded at every step, are in ``exact.fold_positions``.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("quantity").over(run)
    return fills.withColumns({
        "position_version": F.row_number().over(w), "position_quantity": total, "average_cost": F.sum(F.col("price") * F.col("quantity")).over(run) / total,
    })


def position_exits(positions: DataFrame) -> DataFrame:
    """positions (average_cost_price, current_price, opened_at, snapshot_observed_at) with (return_rate, exits, reasons).

    At a loss of 5 % or more, a gain of 10 % or more, or after six hours, all inclusive and tested without division. A
    cost of zero has no return rate.
    """
    cost, now = F.col("average_cost_price"), F.col("current_price")
    lit = lambda x: F.lit(Decimal(x))
    old = F.col("snapshot_observed_at") >= F.col("opened_at") + F.expr("interval 6 hours")
    reasons = ordered_codes(F.array(
        F.when(now - cost <= lit("-0.05") * cost, F.lit("STOP_LOSS")), F.when(now - cost >= lit("0.10") * cost, F.lit("TAKE_PROFIT")), F.when(old, F.lit("TIME_EXIT"))
    ))
    return positions.withColumns({"reasons": reasons, "return_rate": F.try_divide(now.cast("double"), cost.cast("double")) - 1}).withColumn("exits", F.size("reasons") > 0)


def traced(fills: DataFrame, orders: DataFrame, intents: DataFrame, decisions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """fills with (symbol, currency, missing): back to the snapshot; the first link that is missing is named."""
    hops = ((orders, "order_id", "intent_id"), (intents, "intent_id", "decision_id"), (decisions, "decision_id", "candidate_id"), (snapshots, "candidate_id", "symbol"))
    made, missing = fills, F.lit(None).cast("string")
    for df, key, to in hops:
        made = made.join(df.select(key, to), key, "left")
        missing = F.coalesce(missing, F.when(F.col(to).isNull(), f"MISSING_AFTER_{key.upper()}"))
    return made.withColumn("missing", missing)


def recommendation_violations(rows: DataFrame) -> DataFrame:
    """rows with (violations): the rules of a recommendation that a row breaks, in order."""
    plan = F.col("entry_low").isNotNull()
    act = F.col("disposition").isin("BUY", "SELL", "ACTIONABLE")
    unit = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(True))
    n = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    rules = {
        "PLAN_PRESENCE": plan == act, "REASONS_EMPTY": n("reasons") > 0, "RISKS_MISSING": ~(act | (F.col("disposition") == "MARKET_RISK")) | (n("risks") > 0),
        "INVALIDATIONS": act == (n("invalidations") > 0),
        "PRICE_ORDER": ~plan | ((F.col("stop") < F.col("entry_low")) & (F.col("entry_low") <= F.col("entry_high")) & (F.col("entry_high") < F.col("target"))),
        "PROBABILITY": unit("p_up") & unit("p_target") & unit("p_stop") & unit("confidence"), "PROBABILITY_SUM": ~plan | (F.col("p_target") + F.col("p_stop") <= 1),
        "EXPECTED_VALUE": ~plan | (F.col("expected_value") > 0), "REWARD_RISK": ~plan | (F.col("reward_risk") > 0), "HOLDING": ~plan | (F.col("holding_days") <= F.col("horizon_days")),
        "SOURCE_NOT_READY": ~act | (F.col("source_quality") == "READY"),
    }
    return rows.withColumn("violations", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items()))))
