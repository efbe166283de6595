"""Physical-plan checks: pruning and push-down reach the parquet scans."""

import datetime as dt
import tempfile

from cobframe.operators import query as Q
from cobframe.operators import store as K
from cobframe.operators.ingest import ingest_batch
from cobframe.sources.stores import read_snapshot_trades, read_trade_index
from tests.test_ingest import staging


def _plan(df) -> str:
    """Formatted explain text (what ``df.explain("formatted")`` prints)."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_date_bounded_store_read_prunes_and_pushes(spark):
    ag, tr, md = staging(spark)
    root = tempfile.mkdtemp(prefix="plan-store-")
    K.append_snapshots(ingest_batch(ag, tr, md), root)
    d = dt.date(2023, 11, 6)
    idx = read_trade_index(spark, root, d, d)
    trades = read_snapshot_trades(spark, root, d, d)
    out = Q.by_trade(idx, trades, "T-1", d, d)
    plan = _plan(out)
    assert "PartitionFilters: [isnotnull(cob_month" in plan
    # from == to folds into one equality on the date
    assert ("EqualTo(cob_date,2023-11-06)" in plan
            or "GreaterThanOrEqual(cob_date,2023-11-06)" in plan)
    assert "EqualTo(trade_id,T-1)" in plan
    assert [r.trade_id for r in out.collect()] == ["T-1"]


def test_projection_is_pruned_to_needed_columns(spark):
    ag, tr, md = staging(spark)
    root = tempfile.mkdtemp(prefix="plan-store-")
    K.append_snapshots(ingest_batch(ag, tr, md), root)
    trades = read_snapshot_trades(spark, root)
    plan = _plan(Q.product_notional(trades))
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "extra" not in read_schema and "maturity_date" not in read_schema
    assert "notional" in read_schema and "product_type" in read_schema


def test_landed_rows_are_read_once_for_typed_rows_and_rejects(spark):
    from cobframe.plans import catalog
    plan = catalog.queries()["landing_rejects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 3  # lineitem, orders and part, each once


def test_a_first_row_carries_each_column_once(spark):
    from cobframe.sources.staging import dedupe_first
    df = spark.createDataFrame([("k", 2, 5.0, "late"), ("k", 1, 7.0, "first"), ("n", None, -0.0, None)],
                               "id string, at int, amount double, note string")
    first = dedupe_first(df, ["id"], ["at"])
    assert first.columns == df.columns and sorted(map(tuple, first.collect())) == [("k", 1, 7.0, "first"), ("n", None, -0.0, None)]
    assert "min_by" not in first._jdf.queryExecution().optimizedPlan().toString()
    assert dedupe_first(df, ["id"], ["at"], keep=["note"]).columns == ["id", "note"]


def test_marked_rows_keep_the_sign_of_zero(spark):
    from cobframe.operators.validate import reject_duplicates
    rows = [("C", "N", -0.0, {"a": 1}, 1), ("C", "N", 3.0, {"b": 2}, 2), ("D", "N", -0.0, None, None)]
    df = spark.createDataFrame(rows, "counterparty_id string, netting_set_id string, amount double, more map<string,int>, at int")
    df = df.selectExpr("counterparty_id", "netting_set_id", "DATE'2024-01-01' AS cob_date", "amount", "more", "at")
    good = {r.counterparty_id: r for r in reject_duplicates(df, ["at"]).good.collect()}
    assert str(good["C"].amount) == str(good["D"].amount) == "-0.0" and good["C"].more == {"a": 1}
