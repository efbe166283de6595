import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cobframe.operators import query as Q
from tests.conftest import MON, TRADE_SCHEMA, TUE, trade


def test_by_trade_via_index(store):
    rows = Q.by_trade(store["trade_index"], store["trades"], "SW-9").collect()
    assert len(rows) == 4
    assert [r.cob_date for r in rows] == [MON, MON, TUE, TUE]
    assert rows[0].asDict().keys() >= {"cob_date", "counterparty_id", "netting_set_id", "trade_id",
                                       "product_type", "notional", "currency", "direction",
                                       "maturity_date"}


def test_by_trade_inclusive_bounds(store):
    assert Q.by_trade(store["trade_index"], store["trades"], "SW-9", to_date=MON).count() == 2
    assert Q.by_trade(store["trade_index"], store["trades"], "OP-3", from_date=TUE).count() == 0
    assert Q.by_trade(store["trade_index"], store["trades"], "NOPE").count() == 0


def test_by_trade_set_form_and_scan_agree(store):
    ids = ["SW-9", "OP-3", "FW-5"]
    a = sorted(map(tuple, Q.by_trade(store["trade_index"], store["trades"], ids).collect()))
    b = sorted(map(tuple, Q.by_trade_scan(store["trades"], ids).collect()))
    assert a == b and len(a) == 6
    frame = store["trades"].sparkSession.createDataFrame([("SW-9",), ("FW-5",), ("NONE",)], "trade_id string")
    assert Q.by_trade(store["trade_index"], store["trades"], frame).count() == 5
    assert Q.by_trade(store["trade_index"], store["trades"]).count() == 6


def test_snapshot_document(store):
    doc = Q.snapshot_document(store["snapshots"], store["trades"], "NORDBANK", "SWAPS",
                              TUE).collect()
    assert len(doc) == 1
    assert [t.trade_id for t in doc[0].trades] == ["FW-5", "SW-9"]
    assert Q.snapshot_document(store["snapshots"], store["trades"], "NORDBANK", "SWAPS",
                               dt.date(2000, 1, 1)).count() == 0


def test_snapshot_rows(store):
    rows = Q.snapshot(store["snapshots"], store["trades"], "NORDBANK", cob_date=MON).collect()
    got = sorted(((r.netting_set_id, r.trade_id) for r in rows), key=str)
    assert got == [("BONDS", None), ("SWAPS", "OP-3"), ("SWAPS", "SW-9")]


def test_by_counterparty(store):
    rows = Q.by_counterparty(store["snapshots"], "NORDBANK", MON).collect()
    assert [r.netting_set_id for r in rows] == ["BONDS", "SWAPS"]
    assert Q.by_counterparty(store["snapshots"], "NORDBANK", TUE).count() == 1
    assert Q.by_counterparty(store["snapshots"], "UNKNOWN", MON).count() == 0


def test_trades_table(store):
    rows = Q.trades_table(store["trades"], "NORDBANK", "SWAPS", MON).collect()
    assert [r.trade_id for r in rows] == ["OP-3", "SW-9"]
    assert "extra" not in rows[0].asDict()
    assert Q.trades_table(store["trades"], "NORDBANK", "BONDS", MON).count() == 0


def test_fx_rates_first_snapshot_semantics(store):
    # BONDS sorts before SWAPS, so its single pair wins on the first day
    rows = {r.pair: r.rate for r in Q.fx_rates(store["snapshots"], MON).collect()}
    assert rows == {"EUR/SEK": 11.62}
    later = {r.pair: r.rate for r in Q.fx_rates(store["snapshots"], TUE).collect()}
    assert later == {"EUR/NOK": 11.85, "EUR/SEK": 11.62}


def test_fx_rate_pair_and_missing(spark, store):
    assert Q.fx_rate_pair(store["snapshots"], "EUR/NOK", TUE).collect()[0].rate == 11.85
    assert Q.fx_rate_pair(store["snapshots"], "EUR/NOK", MON).collect()[0].rate is None
    with pytest.raises(Exception):
        Q.fx_rate_pair(store["snapshots"], "EUR/DKK", TUE, strict=True).collect()
    assert Q.fx_rates(store["snapshots"], dt.date(2000, 1, 1)).count() == 0


def test_inflation(store):
    assert {r.index_name: r.rate for r in Q.inflation_rates(store["snapshots"], TUE).collect()} \
        == {"NO_CPI": 0.045}
    assert Q.inflation_rate_index(store["snapshots"], "NO_CPI", TUE).collect()[0].rate == 0.045


def test_exposure_history(store):
    e = store["exposure_index"]
    rows = Q.exposure_history(e, "NORDBANK").collect()
    assert len(rows) == 3
    assert [r.cob_date for r in rows] == sorted(r.cob_date for r in rows)
    assert Q.exposure_history(e, "NORDBANK", netting_set_id="SWAPS").count() == 2
    assert Q.exposure_history(e, "NORDBANK", from_date=TUE).count() == 1
    assert Q.exposure_history(e, "UNKNOWN").count() == 0


def test_portfolio_ranking(store):
    e = store["exposure_index"]
    rows = sorted(Q.portfolio(e, MON).collect(), key=lambda r: r.rank)
    assert [r.rank for r in rows] == [1, 2, 3]
    assert [r.counterparty_id for r in rows] == ["ZEPHYR", "NORDBANK", "NORDBANK"]
    assert [r.exposure_total for r in rows] == [820000.0, 310000.0, 90000.0]
    assert Q.portfolio(e, MON, threshold=310000.0).count() == 2
    assert [r.rank for r in Q.portfolio(e, MON, top_n=1).collect()] == [1]
    assert Q.portfolio(e, dt.date(2000, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        Q.portfolio(e, MON, top_n=0)


def test_every_row_of_a_date_has_its_rank(spark):
    """A date over many tasks, dates that share a task, ties, a null exposure."""
    rows = spark.range(6000).select(
        F.expr("date_add(date'2024-01-01', cast(CASE WHEN id < 4000 THEN 0 ELSE id % 9 END AS int))").alias("cob_date"),
        F.concat(F.lit("CP-"), F.col("id")).alias("counterparty_id"), F.lit("N").alias("netting_set_id"),
        F.expr("CASE WHEN id % 977 = 0 THEN NULL ELSE cast(pmod(xxhash64(id), 300) AS double) END").alias("exposure_total"),
        F.expr("timestamp'2024-02-01' + make_interval(0, 0, 0, cast(id % 3 AS int))").alias("ingested_at")).repartition(6)
    got = Q.portfolio(rows, threshold=None)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    plain = Window.partitionBy("cob_date").orderBy(*Q.rank_order())
    want = rows.withColumn("rank", F.row_number().over(plain)).select(*got.columns)
    assert got.count() == 6000 and got.exceptAll(want).count() == 0
    assert got.where("cob_date = date'2024-01-01'").agg(F.max("rank")).first()[0] > 4000


def test_portfolio_all_dates_uses_group_limit(store):
    df = Q.portfolio(store["exposure_index"], top_n=2)
    assert {(r.cob_date, r.rank) for r in df.collect()} == {(MON, 1), (MON, 2), (TUE, 1), (TUE, 2)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_who_matters_format(store):
    rows = Q.who_matters(store["exposure_index"], MON).collect()
    assert rows[0].exposure == "820,000"


def test_listings(store):
    s = store["snapshots"]
    assert [r.cob_date for r in Q.list_cob_dates(s, "NORDBANK", "SWAPS").collect()] == [MON, TUE]
    assert Q.list_cob_dates(s, "NORDBANK", "NOPE").count() == 0
    assert [r.netting_set_id for r in Q.list_netting_sets(s, "NORDBANK").collect()] == \
        ["BONDS", "SWAPS"]
    assert [r.counterparty_id for r in Q.list_counterparties(s).collect()] == ["NORDBANK", "ZEPHYR"]


def test_product_notional_and_series(spark, store):
    swaps = Q.product_notional(store["trades"], "BASIS_SWAP").collect()
    assert sum(r.total_notional for r in swaps) == 10160000.0
    series = {r.cob_date: r.notional for r in Q.trade_notional_series(store["trades"], "SW-9").collect()}
    assert series == {MON: 4200000.0, TUE: 4200000.0}


def test_notionals_are_summed_as_stored(spark):
    rows = [trade("A", "N", MON, f"S{i}", "SMALL", 0.004, "NOK", "PAY") for i in range(2)]
    rows += [trade("A", "N", MON, "L", "LARGE", 2e16, "NOK", "PAY"), trade("A", "N", MON, "X", "HUGE", 1e29, "NOK", "PAY")]
    got = {r.product_type: r.total_notional for r in Q.product_notional(spark.createDataFrame(rows, TRADE_SCHEMA)).collect()}
    assert got == {"SMALL": 0.008, "LARGE": 2e16, "HUGE": 1e29}


def test_index_staleness(spark, store):
    idx = store["exposure_index"].where(F.col("cob_date") == MON)
    rows = {r.cob_date: r for r in Q.index_staleness(store["snapshots"], idx).collect()}
    assert rows[MON].stale is False and rows[TUE].stale is True
    assert rows[TUE].n_unindexed == 2


def test_market_consistency(store):
    rows = {r.cob_date: r for r in Q.market_consistency(store["snapshots"]).collect()}
    assert (rows[MON].n_snapshots, rows[MON].n_fx_sets, rows[MON].n_inflation_sets) == (3, 2, 2)
    assert rows[TUE].n_fx_sets == 1


def test_document_order_is_the_stored_position(spark, store):
    from pyspark.sql import functions as F
    placed = store["trades"].withColumn("position", F.when(F.col("trade_id") == "SW-9", 0).otherwise(1).cast("long"))
    doc = Q.snapshot_document(store["snapshots"], placed, "NORDBANK", "SWAPS", TUE).collect()[0]
    assert [t.trade_id for t in doc.trades] == ["SW-9", "FW-5"]
    assert [r.trade_id for r in Q.trades_table(placed, "NORDBANK", "SWAPS", MON).collect()] == ["SW-9", "OP-3"]
