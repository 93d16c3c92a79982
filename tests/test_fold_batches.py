"""Positions fold in batches, not in one frame of all fills."""

from decimal import Decimal

from tidemark.operators import exact


def test_a_position_goes_on_over_batches(spark):
    rows = [(k, n, 1 + n % 3, Decimal(n + 1) / 7) for k in ("a", None, "b") for n in range(25)]
    fills = spark.createDataFrame(rows, "symbol string, at int, quantity long, price decimal(38,18)").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        made = exact.fold_positions(fills, ["symbol"], ["at"])
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
        found = {(r.symbol, r.position_version): (r.position_quantity, r.average_cost) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    for k in ("a", None, "b"):
        quantity, cost = 0, Decimal(0)
        for n in range(25):
            q, p = 1 + n % 3, (Decimal(n + 1) / 7).quantize(Decimal(1).scaleb(-18))
            with exact.localcontext(exact.Context(prec=80, rounding=exact.ROUND_HALF_EVEN)):
                cost = ((quantity * cost + q * p) / (quantity + q)).quantize(Decimal(1).scaleb(-18))
            quantity += q
            assert found[k, n + 1] == (quantity, cost)
