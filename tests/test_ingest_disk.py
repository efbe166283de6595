"""What the ingest leaves on disk, and that going by parts changes no row."""

import datetime as dt
import re
import time

from pyspark.sql import functions as F

from cobframe.functions.columns import sliced
from cobframe.plans import domain
from cobframe.session import FILE_CLEANUP, short_lived, written
from cobframe.sources import testdata as td
from cobframe.sources.files import path_exists, read_text
from cobframe.sources.stores import SCHEMAS


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {x for x in names if x.startswith("shuffle_")}


def sources(spark, at, text="grid"):
    """Orders that share keys, lines that share trade ids, a line without an order and a part."""
    day = dt.datetime(2024, 1, 5)
    orders = [(k, k % 3, "OFP"[k % 3], 100.0 * k, day + dt.timedelta(days=20 * (k % 5)), f"{1 + k % 2}-HIGH" if k % 11 else "BAD ID")
              for k in range(1, 60)]
    lines = [(k, (3, 23, 3, 8)[n - 1] + k % 6, n, n, float(n), 10.0 * k + n, 0.01 * n, 0.02, "ANR"[n % 3], "OF"[n % 2],
              day + dt.timedelta(days=k % 9)) for k in range(1, 62) for n in range(1, 5)]
    parts = [(p, f"TYPE {p % 4}") for p in range(0, 30, 2)]
    docs = [(k, f"{text} {k}", f"src{k % 3}") for k in range(1, 20)]
    for name, rows, schema in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
             "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
            ("part", parts, "p_partkey long, p_type string"), ("documents", docs, "doc_id long, text string, source string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def rows_of(df):
    kinds = dict(df.dtypes)
    return sorted(map(repr, df.select(*[F.to_json(c).alias(c) if "map<" in kinds[c] else c for c in sorted(df.columns)]).collect()))


def test_shuffle_files_go_with_their_write(spark, tmp_path):
    before, conf = shuffle_files(spark), spark.conf.get(FILE_CLEANUP, None)
    with short_lived(spark, str(tmp_path / "work")):
        table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts",
                        spark.range(10).select((F.col("id") + 100).alias("k"), F.lit(1).cast("long").alias("count")))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert table.count() == 17 and table.inputFiles()[0].startswith(f"file://{tmp_path}/work/")
    assert spark.conf.get(FILE_CLEANUP, None) == conf


def test_parts_hold_each_row_once(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("k"), F.when(F.col("id") % 9 > 0, "x").alias("v"))
    parts = sliced(df, ["k", "v"], 4)
    assert rows_of(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])) == rows_of(df)
    keys = [{(r.k, r.v) for r in p.collect()} for p in parts]
    assert all(not a & b for i, a in enumerate(keys) for b in keys[:i]) and sum(map(bool, keys)) == 4


def test_ingest_by_parts_writes_the_same_store_and_keeps_no_intermediates(spark, tmp_path, monkeypatch):
    whole, parted = (sources(spark, tmp_path / name) for name in ("whole", "parted"))
    assert domain.slices_of(spark, whole) == 1
    want = domain.order_store(spark, whole)
    monkeypatch.setattr(domain, "SLICE_BYTES", 1)
    assert domain.slices_of(spark, parted) == domain.MOST_SLICES
    got = domain.order_store(spark, parted)
    for name in sorted(SCHEMAS):
        assert rows_of(got[name]) == rows_of(want[name]), name
    assert got["trades"].count() and got["market_sets"].count() and got["rejects"].count()
    for sf in (whole, parted):
        attempt = read_text(spark, f"{domain.store_root(spark, sf)}/_COMPLETE").strip()
        assert path_exists(spark, f"{attempt}/snapshots") and not path_exists(spark, f"{attempt}/_work")
    # the raw ingest's results are read from what it staged, not from what led there
    raw, again = (domain.ingest_orders(spark, sf, clean_ids=False) for sf in (whole, parted))
    for name in ("snapshots", "trades", "rejects", "outcomes"):
        assert rows_of(getattr(again, name)) == rows_of(getattr(raw, name)), name


def test_lists_of_expected_hashes_carry_no_texts(spark, tmp_path):
    listed = td.matrix_objects(spark, sources(spark, tmp_path / "in")).select("path", "expected_hash")
    joined = listed._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[1]
    assert "AS actual_hash" in joined and "text#" not in re.sub(r"encode\([^)]*\)", "", joined)
    assert listed.count() == 19
