"""Rate sets stored once a date and named by their digest."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from cobframe.operators import diff as D
from cobframe.operators import query as Q
from cobframe.operators import store as K
from cobframe.operators.ingest import ingest_batch
from cobframe.operators.integrity import audit_integrity, native_hashes, snapshot_hashes, streamed_hashes
from cobframe.operators.market_sets import attach_sets, detach_sets, is_stored_form, market_sets, set_digest
from cobframe.sources import stores as S
from tests.conftest import HEADER_SCHEMA, MON, TUE, agreement, market, populated
from tests.test_ingest import staging

DAYS = [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]
RATES = [({"A/B": 1.0, "C/D": 2.0}, {"X": 0.1}), ({"C/D": 2.0 + 1e-12, "A/B": 1.0}, {"X": 0.1}),
         ({"A/B": 1.5}, {"X": 0.1, "Y": 0.2}), ({}, {})]


@pytest.fixture(scope="module")
def full(spark):
    rows = [(f"CP-{c}", f"N{n}", day, agreement(), market(fx=fx, inf=inf, matrices={"M": ("p", "h")} if n else {}), 1.0, None)
            for c in range(3) for n in range(4) for day, (fx, inf) in zip(DAYS, RATES, strict=True)]
    rows.append(("CP-9", "own", DAYS[2], agreement(), market(fx={"A/B": 9.0}, inf=None, matrices=None), 0.0, None))
    rows.append(("CP-9", "own", DAYS[3], agreement(), None, 0.0, None))
    return spark.createDataFrame(rows, HEADER_SCHEMA).repartition(3)


def key_order(df):
    return sorted((str(r) for r in df.collect()))


def test_round_trip(full):
    stored, sets = detach_sets(full), market_sets(full)
    assert is_stored_form(stored) and not is_stored_form(full)
    back = attach_sets(stored, sets)
    assert back.columns == full.columns
    for a, b in zip(*(df.orderBy("counterparty_id", "netting_set_id", "cob_date").collect() for df in (full, back)), strict=True):
        if a.market_data is None:
            assert b.market_data is None
        else:
            assert (a.market_data.fx_rates or {}) == b.market_data.fx_rates
            assert (a.market_data.inflation_rates or {}) == b.market_data.inflation_rates
            assert a.market_data.price_matrices == b.market_data.price_matrices


def test_a_set_is_stored_once_a_date(full):
    rows = market_sets(full).groupBy("cob_date").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("d")).collect()
    assert {r.cob_date: (r.n, r.d) for r in rows} == {DAYS[0]: (2, 2), DAYS[1]: (2, 2), DAYS[2]: (4, 4), DAYS[3]: (1, 1)}


def test_digest_ignores_the_order_of_keys(spark):
    df = spark.sql("SELECT map('a', 1.0D, 'b', 2.0D) x, map('b', 2.0D, 'a', 1.0D) y, map('a', 1.0D) z, "
                   "cast(null AS map<string,double>) n, cast(map() AS map<string,double>) e")
    r = df.select(*[set_digest(F.col(c)).alias(c) for c in "xyzne"]).first()
    assert r.x == r.y != r.z and r.n == r.e


def test_changes_are_the_same_in_either_form(spark, full):
    stored, sets = detach_sets(full), market_sets(full)
    pairs = D.consecutive_pairs(full)
    _, trades = populated(spark)
    for fn in (D.fx_rate_changes, D.inflation_rate_changes):
        assert key_order(fn(pairs, full)) == key_order(fn(pairs, stored, sets)) != []
    # the second day's set differs by less than the epsilon
    assert D.fx_rate_changes(pairs, stored, sets).where(F.col("to_date") == DAYS[1]).count() == 0
    for fn in (D.snapshot_diff, D.change_log):
        assert key_order(fn(pairs, full, trades)) == key_order(fn(pairs, stored, trades, sets))


def test_each_pair_of_sets_is_compared_once(full):
    stored, sets = detach_sets(full), market_sets(full)
    plan = D.fx_rate_changes(D.consecutive_pairs(full), stored, sets)._jdf.queryExecution().optimizedPlan().toString()
    compared = plan[plan.index("map_zip_with"):]
    assert "Aggregate" in compared  # below: the distinct pairs of digests
    wide = D.fx_rate_changes(D.consecutive_pairs(full), full)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in wide[wide.index("map_zip_with"):]


def test_a_lost_set_is_an_error(full):
    stored, sets = detach_sets(full), market_sets(full).where(F.size("rates") != 2)
    with pytest.raises(Exception, match="no market set"):
        attach_sets(stored, sets).collect()
    with pytest.raises(Exception, match="no market set"):
        D.fx_rate_changes(D.consecutive_pairs(full), stored, sets).collect()


def test_lookups_in_stored_form(full):
    stored, sets = detach_sets(full), market_sets(full)
    for day in (None, DAYS[2]):
        assert key_order(Q.fx_rates(full, day)) == key_order(Q.fx_rates(stored, day, sets=sets))
        assert key_order(Q.inflation_rates(full, day)) == key_order(Q.inflation_rates(stored, day, sets=sets))
        assert key_order(Q.fx_rate_pair(full, "A/B", day)) == key_order(Q.fx_rate_pair(stored, "A/B", day, sets=sets))
        assert key_order(Q.inflation_rate_index(full, "Y", day)) == key_order(Q.inflation_rate_index(stored, "Y", day, sets=sets))
    assert key_order(Q.market_consistency(full.where("market_data IS NOT NULL"))) == key_order(
        Q.market_consistency(stored.where("market_data IS NOT NULL")))


def test_hashes_in_stored_form(spark, full):
    full = full.where("cob_date <> date'2024-01-02'")
    trades = full.where("netting_set_id <> 'N0'").select("counterparty_id", "netting_set_id", "cob_date").crossJoin(
        populated(spark)[1].drop("counterparty_id", "netting_set_id", "cob_date").dropDuplicates(["trade_id"]))
    stored, sets = detach_sets(full), market_sets(full)
    normal = attach_sets(stored, sets)
    want = key_order(streamed_hashes(normal, trades))
    assert key_order(snapshot_hashes(stored, trades, sets=sets)) == want
    assert key_order(snapshot_hashes(normal, trades)) == want
    assert key_order(native_hashes(stored, trades, sets)) == want


def test_store_keeps_digests_and_audits_them(spark):
    root = tempfile.mkdtemp(prefix="sets-")
    ag, tr, md = staging(spark)
    K.append_snapshots(ingest_batch(ag, tr, md), root, "one")
    later = [x.withColumn("cob_date", F.date_add("cob_date", 1)) for x in (ag, tr, md)]
    K.append_snapshots(ingest_batch(*later), root, "two")
    stored, sets = S.read_snapshots(spark, root), S.read_market_sets(spark, root)
    assert is_stored_form(stored) and sets.count() == 4 and sets.select("digest").distinct().count() == 2
    assert S.read_market_sets(spark, root, TUE, TUE).count() == 2
    audit = audit_integrity(stored, S.read_snapshot_trades(spark, root), sets).collect()
    assert len(audit) == 4 and {r.status for r in audit} == {"OK"}
    assert attach_sets(stored, sets).where(F.col("cob_date") == MON).first().market_data.fx_rates == {"USD/GBP": 0.79}


def test_ingest_names_its_rates_by_digest_and_makes_each_text_once_a_date(spark):
    ag, tr, md = staging(spark)
    staged = {}

    def stage(name, df):
        staged[name] = df
        return df
    r = ingest_batch(ag, tr, md, stage=stage)
    # no rates travel with a snapshot, and the rates of a date are one row
    assert is_stored_form(staged["snapshots"]) and is_stored_form(r.stored)
    assert staged["rates"].count() == staged["rates"].select("cob_date").distinct().count()
    assert "map<string,double>" not in dict(staged["snapshots"].dtypes)["market_data"]
    # both forms say the same
    assert sorted(map(repr, attach_sets(r.stored, r.sets).collect())) == sorted(map(repr, r.snapshots.collect()))
    assert sorted(map(repr, detach_sets(r.snapshots).collect())) == sorted(map(repr, r.stored.collect()))
    assert sorted(map(repr, market_sets(r.snapshots).collect())) == sorted(map(repr, r.sets.collect()))
    full = {x.netting_set_id: x.data_hash for x in r.hashed().collect()}
    assert full == {x.netting_set_id: x.data_hash for x in r.hashed_stored().collect()}
