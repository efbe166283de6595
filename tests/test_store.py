"""The store under crashes, replays and empty tables."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cobframe.operators import query as Q
from cobframe.operators import store as K
from cobframe.operators.ingest import ingest_batch
from cobframe.sources import stores as S
from cobframe.schema import KEY
from tests.conftest import MON, TUE
from tests.test_ingest import staging
from tests.test_plans import _plan

COUNTS = {"snapshots": 2, "snapshot_trades": 2, "exposure_index": 2, "trade_index": 2}


def counts(spark, root):
    return {n: S.read_store_table(spark, root, n).count() for n in COUNTS}


def one_row_a_key(spark, root):
    for name in ("snapshots", "exposure_index"):
        t = S.read_store_table(spark, root, name)
        assert t.count() == t.select(*KEY).distinct().count()
    for name in ("snapshot_trades", "trade_index"):
        t = S.read_store_table(spark, root, name)
        assert t.count() == t.select(*KEY, "trade_id").distinct().count()


def ingest(spark, root, shift=0):
    """The staged batch, its dates moved by some days, against what is stored."""
    def move(df):
        return df.withColumn("cob_date", F.date_add("cob_date", shift))
    ag, tr, md = (move(x) for x in staging(spark))
    return ingest_batch(ag, tr, md, existing_keys=S.read_snapshots(spark, root))


@pytest.mark.parametrize("earlier", [False, True])
@pytest.mark.parametrize("last", [0, 1, 2, 3, 4, 5])
def test_crash_after_any_write_then_replay(spark, monkeypatch, last, earlier):
    root = tempfile.mkdtemp(prefix="store-")
    if earlier:
        K.append_snapshots(ingest(spark, root), root, "first")
    before = counts(spark, root)
    write, done = K.write_table, []

    def dying(*args):
        write(*args)
        done.append(args)
        if len(done) > last:
            raise RuntimeError("executor lost")
    monkeypatch.setattr(K, "write_table", dying)
    with pytest.raises(RuntimeError):
        K.append_snapshots(ingest(spark, root, 1), root, "second")
    monkeypatch.setattr(K, "write_table", write)
    assert counts(spark, root) == before  # nothing of it shows
    K.append_snapshots(ingest(spark, root, 1), root, "second")
    assert counts(spark, root) == {n: before[n] + COUNTS[n] for n in COUNTS}
    one_row_a_key(spark, root)
    assert S.read_store_table(spark, root, "rejects").count() == 3 * (1 + earlier)


def test_committed_batch_is_not_written_again(spark):
    root = tempfile.mkdtemp(prefix="store-")
    first = ingest(spark, root)
    K.append_snapshots(first, root, "b")
    K.append_snapshots(first, root, "b")
    assert counts(spark, root) == COUNTS
    # under another name the stored keys stop it
    K.append_snapshots(ingest(spark, root), root, "c")
    assert counts(spark, root) == COUNTS
    assert S.open_attempts(spark, root) == []


def test_two_attempts_of_one_batch(spark):
    root = tempfile.mkdtemp(prefix="store-")
    S.begin_attempt(spark, root, "a1", "b")
    S.begin_attempt(spark, root, "a2", "b")
    assert S.commit_attempt(spark, root, "a2", "b")
    assert not S.commit_attempt(spark, root, "a1", "b")
    assert S.open_attempts(spark, root) == ["a1"]


def test_batch_without_trades_on_a_fresh_store(spark):
    root = tempfile.mkdtemp(prefix="store-")
    ag, tr, md = staging(spark)
    K.append_snapshots(ingest_batch(ag, tr.where("trade_id = 'none'"), md), root)
    assert counts(spark, root) == {"snapshots": 2, "snapshot_trades": 0, "exposure_index": 2, "trade_index": 0}
    assert S.read_snapshot_trades(spark, root).columns == S.SCHEMAS["snapshot_trades"].names


def test_empty_root_reads_as_empty_tables(spark):
    root = tempfile.mkdtemp(prefix="store-")
    assert set(counts(spark, root).values()) == {0}


def test_point_lookup_and_rebuild_prune_months(spark):
    root = tempfile.mkdtemp(prefix="store-")
    for shift in (0, 40):
        K.append_snapshots(ingest(spark, root, shift), root)
    snaps, trades = S.read_snapshots(spark, root), S.read_snapshot_trades(spark, root)
    lookup = Q.snapshot(snaps, trades, "ACME", "RATES-USD", MON)
    plan = _plan(lookup)
    assert plan.count("PartitionFilters: [isnotnull(cob_month") == 2 and "EqualTo(counterparty_id,ACME)" in plan
    assert lookup.count() == 2 and "cob_month" not in lookup.columns
    assert "PartitionFilters: [isnotnull(cob_month" in _plan(S.read_snapshots(spark, root, MON, MON))
    K.rebuild_indexes(spark, root, MON, TUE)
    assert counts(spark, root) == {n: 2 * c for n, c in COUNTS.items()}


def test_large_month_is_many_files(spark):
    root = tempfile.mkdtemp(prefix="store-")
    wide = spark.range(300_000).select(
        F.concat(F.lit("CP-"), F.col("id").cast("string")).alias("counterparty_id"), F.lit("N").alias("netting_set_id"),
        F.lit(MON).alias("cob_date"), F.sha2(F.col("id").cast("string"), 256).alias("detail"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        K.write_table(wide, f"{root}/t", "append", ["counterparty_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(spark.read.parquet(f"{root}/t").inputFiles()) > 1


def test_dry_run_writes_nothing(spark):
    """The job's result is lazy; without the append the store stays as it was."""
    import os
    root = tempfile.mkdtemp(prefix="store-")
    result = ingest(spark, root)
    assert result.snapshots.count() == 2 and result.rejects.count() == 3
    assert os.listdir(root) == []


def scanned(df):
    """Rows that the scan of a filtered table hands on, after row groups were left out."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_lookups_by_trade_id_skip_row_groups(spark):
    """An id that no row group holds is read from none of them, though it lies
    between their smallest and largest."""
    root = tempfile.mkdtemp(prefix="bloom-")
    rows = spark.range(40_000).select(
        F.concat(F.lit("T-"), F.lpad((F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)) * 2).cast("string"), 14, "0")).alias("trade_id"),
        F.lit("CP").alias("counterparty_id"), F.col("id").cast("string").alias("netting_set_id"),
        F.lit(MON).alias("cob_date"), F.lit("b").alias("batch_id"))
    for part in range(4):
        K.write_table(rows.where(F.col("netting_set_id").cast("long") % 4 == part), root, "append", ["counterparty_id", "netting_set_id"])
    table = spark.read.schema(S.SCHEMAS["trade_index"]).parquet(root)
    assert table.count() == 40_000
    some = rows.orderBy("trade_id").limit(3).collect()[2]["trade_id"]
    odd = some[:-1] + str(int(some[-1]) + 1)
    assert scanned(table.where(F.col("trade_id") == odd)) == 0
    assert scanned(table.where(F.col("trade_id") == some)) == 10_000  # one file of four
    assert table.where(F.col("trade_id") == some).count() == 1
