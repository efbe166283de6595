"""What the ingest deals and sorts: nothing twice, and short rows (its rows are tested in test_ingest and test_store)."""

import datetime as dt

from pyspark.sql import functions as F

from cobframe.operators import validate as V
from cobframe.operators.ingest import ingest_batch
from cobframe.operators.integrity import native_hashes
from cobframe.schema import KEY
from tests.conftest import frames_of, sample_document, whole_hash
from tests.test_ingest import staging

DAY = dt.date(2024, 1, 5)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_do_not_wait_for_the_trades_of_accepted_keys(spark):
    ag, tr, md = staging(spark)
    stray = tr.limit(1).withColumn("netting_set_id", F.lit("NOBODY"))
    r = ingest_batch(ag, tr.unionByName(stray), md)
    assert r.deduplicated.where("netting_set_id = 'NOBODY'").count() == 1
    assert r.trades.where("netting_set_id = 'NOBODY'").count() == 0
    want = {x.netting_set_id: x.data_hash for x in ingest_batch(ag, tr, md).hashed_stored().collect()}
    unread = r._replace(trades=None)  # hashing joins trades to their headers, and needs no other join for it
    assert {x.netting_set_id: x.data_hash for x in unread.hashed_stored().collect()} == want
    assert {x.netting_set_id: x.data_hash for x in unread.hashed().collect()} == want


def test_trades_of_accepted_keys_are_told_by_date_first(spark):
    ag, tr, md = staging(spark)
    r = ingest_batch(ag, tr, md)
    assert "Join LeftSemi, (((cob_date" in optimized(r.trades)
    assert r.trades.columns == r.deduplicated.columns


def test_texts_of_trades_are_made_behind_the_shuffle(spark):
    doc = sample_document()
    headers, trades = frames_of(spark, doc)
    hashes = native_hashes(headers, trades)
    plan = optimized(hashes)
    assert '"currency"' in plan and '"trade_id"' not in plan.split("RepartitionByExpression")[1]
    assert [x.data_hash for x in hashes.collect()] == [whole_hash(doc)]


def test_keys_are_counted_by_one_number_and_told_by_themselves(spark, monkeypatch):
    ag = spark.createDataFrame([("CP-1", "N", DAY, "A", 2), ("CP-1", "N", DAY, "A", 1), ("CP-2", "N", DAY, "A", 3)],
                               "counterparty_id string, netting_set_id string, cob_date date, agreement_id string, seq long")
    tables, write = {}, V.written
    monkeypatch.setattr(V, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    # every key has the same number here
    monkeypatch.setattr(V.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = {(x.counterparty_id, x.seq): x.reject_reason for x in V.mark_agreements(ag, ["seq"]).collect()}
    assert got == {("CP-1", 1): None, ("CP-1", 2): "DUPLICATE", ("CP-2", 3): None}
    assert not set(KEY) & set(tables["repeated"].columns) and tables["copies"].count() == 3
