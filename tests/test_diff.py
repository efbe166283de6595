import datetime as dt

import pytest
from pyspark.sql import functions as F

from cobframe.operators import diff as D
from cobframe.operators import history as E
from tests.conftest import MON, TUE, HEADER_SCHEMA, TRADE_SCHEMA, agreement, market, populated


def _pair(spark, f=MON, t=TUE, cp="NORDBANK", ns="SWAPS"):
    return spark.createDataFrame([(cp, ns, f, t)],
                                 "counterparty_id string, netting_set_id string, from_date date, to_date date")


def test_added_and_removed(spark):
    headers, trades = populated(spark)
    p = _pair(spark)
    assert [r.trade_id for r in D.trades_added(p, trades).collect()] == ["FW-5"]
    assert [r.trade_id for r in D.trades_removed(p, trades).collect()] == ["OP-3"]


def test_consecutive_pairs(spark):
    headers, _ = populated(spark)
    rows = sorted(D.consecutive_pairs(headers).collect())
    assert [(r.counterparty_id, r.netting_set_id, r.from_date, r.to_date) for r in rows] == \
        [("NORDBANK", "SWAPS", MON, TUE), ("ZEPHYR", "SWAPS", MON, TUE)]


def test_reversed_and_equal_pairs_rejected(spark):
    pairs = spark.createDataFrame(
        [("A", "N", TUE, MON), ("A", "N", MON, MON), ("A", "N", MON, TUE)],
        "counterparty_id string, netting_set_id string, from_date date, to_date date")
    assert D.given_pairs(pairs).count() == 1
    assert [r.reason for r in D.rejected_pairs(pairs).collect()] == ["INVALID_RANGE"] * 2
    with pytest.raises(Exception, match="invalid diff pair"):
        D.given_pairs(pairs, strict=True).collect()


def test_pairs_with_a_missing_side(spark):
    headers, _ = populated(spark)
    far = dt.date(2030, 1, 1)
    pairs = spark.createDataFrame([("NORDBANK", "SWAPS", MON, TUE), ("NORDBANK", "SWAPS", MON, far),
                                   ("NORDBANK", "SWAPS", dt.date(1999, 1, 1), TUE)],
                                  "counterparty_id string, netting_set_id string, from_date date, to_date date")
    assert D.given_pairs(pairs, headers).count() == 1
    assert {r.reason for r in D.rejected_pairs(pairs, headers).collect()} == {"MISSING_FROM", "MISSING_TO"}
    with pytest.raises(Exception, match="MISSING_"):
        D.given_pairs(pairs, headers, strict=True).collect()


def test_one_join_of_trades_to_pairs(spark):
    headers, trades = populated(spark)
    p = D.consecutive_pairs(headers)
    plan = D.change_log(p, headers, trades)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3  # trades with pairs, both snapshot rows of a pair


def _two(spark, ag_from, ag_to, mk_from=None, mk_to=None):
    rows = [("CP", "NS", MON, ag_from, mk_from or market(), 1.0, None),
            ("CP", "NS", TUE, ag_to, mk_to or market(), 3.5, None)]
    return spark.createDataFrame(rows, HEADER_SCHEMA)


def test_agreement_changes_epsilon(spark):
    h = _two(spark, agreement(rounding=1e-10, threshold=1.0),
             agreement(rounding=5e-10, threshold=2.0, currency="EUR", collateral=["USD_CASH"]))
    p = _pair(spark, cp="CP", ns="NS")
    fields = {r.field: r for r in D.agreement_changes(p, h).collect()}
    assert set(fields) == {"threshold_amount", "currency", "eligible_collateral"}
    assert (fields["threshold_amount"].old_number, fields["threshold_amount"].new_number) == (1.0, 2.0)
    assert fields["currency"].new_text == "EUR"


def test_rate_changes(spark):
    h = _two(spark, agreement(), agreement(),
             market(fx={"A": 1.0, "B": 2.0, "C": 3.0}),
             market(fx={"A": 1.0 + 1e-12, "B": 2.5, "D": 4.0}))
    p = _pair(spark, cp="CP", ns="NS")
    got = {r.pair: (r.old_value, r.new_value) for r in D.fx_rate_changes(p, h).collect()}
    assert got == {"B": (2.0, 2.5), "C": (3.0, None), "D": (None, 4.0)}
    assert D.inflation_rate_changes(p, h).count() == 0


def test_matrix_changes_by_hash_only(spark):
    h = _two(spark, agreement(), agreement(),
             market(matrices={"IR": ("a.npy", "h1"), "FX": ("f.npy", "h2"), "X": ("x", "h")}),
             market(matrices={"IR": ("moved.npy", "h1"), "FX": ("f.npy", "h3"), "Y": ("y", "h")}))
    p = _pair(spark, cp="CP", ns="NS")
    assert sorted(r.instrument for r in D.matrix_changes(p, h).collect()) == ["FX", "X", "Y"]


def test_summary_and_has_changes(spark):
    headers, trades = populated(spark)
    p = D.consecutive_pairs(headers)
    by = {r.counterparty_id: r for r in D.snapshot_diff(p, headers, trades).collect()}
    row = by["NORDBANK"]
    assert (by["ZEPHYR"].has_changes, by["ZEPHYR"].exposure_delta) == (False, -5000.0)
    assert (row.n_trades_added, row.n_trades_removed) == (1, 1)
    assert row.has_changes is True
    assert row.exposure_delta == 45000.0
    same = _two(spark, agreement(), agreement())
    no_trades = spark.createDataFrame([], TRADE_SCHEMA)
    none = D.snapshot_diff(_pair(spark, cp="CP", ns="NS"), same, no_trades).collect()[0]
    assert none.has_changes is False and none.exposure_delta == 2.5


def test_change_log_kinds(spark):
    headers, trades = populated(spark)
    p = D.consecutive_pairs(headers)
    kinds = {(r.kind, r.item) for r in D.change_log(p, headers, trades).collect()}
    assert kinds == {("trade_added", "FW-5"), ("trade_removed", "OP-3")}


def test_agreement_history(spark):
    rows = [("CP", "NS", MON + dt.timedelta(days=i), agreement(threshold=t, rounding=r), market(), 0.0, None)
            for i, (t, r) in enumerate([(1.0, 0.0), (1.0, 3e-10), (2.0, 0.0), (2.0, 0.0)])]
    h = spark.createDataFrame(rows, HEADER_SCHEMA)
    versions = E.agreement_history(h).collect()
    assert [(v.valid_from, v.valid_to) for v in versions] == \
        [(MON, MON + dt.timedelta(days=2)), (MON + dt.timedelta(days=2), None)]


def test_missing_amounts_are_one_version(spark):
    rows = [("CP", "NS", MON + dt.timedelta(days=i), agreement(threshold=None), market(), 0.0, None) for i in range(4)]
    assert E.agreement_history(spark.createDataFrame(rows, HEADER_SCHEMA)).count() == 1


def _index(spark, days, values):
    return spark.createDataFrame([("CP", "NS", d, v) for d, v in zip(days, values)],
                                 "counterparty_id string, netting_set_id string, cob_date date, exposure_total double")


def test_exposure_anomalies(spark):
    d0 = dt.date(2024, 1, 1)
    vals = [100.0 + (i % 3) for i in range(20)] + [1000.0]
    idx = _index(spark, [d0 + dt.timedelta(days=i) for i in range(21)], vals)
    out = E.exposure_anomalies(idx, min_history=10)
    flagged = [r.cob_date for r in out.where(F.col("is_anomaly")).collect()]
    assert flagged == [d0 + dt.timedelta(days=20)]
    assert out.count() == 12


def test_default_history_holds_on_business_days(spark):
    d0 = dt.date(2023, 1, 2)
    days = [d for d in (d0 + dt.timedelta(days=i) for i in range(400)) if d.weekday() < 5]
    vals = [100.0 + (i % 5) for i in range(len(days) - 1)] + [500.0]
    out = E.exposure_anomalies(_index(spark, days, vals))
    assert out.count() == len(days) - 29
    assert [r.cob_date for r in out.where("is_anomaly").collect()] == [days[-1]]
