"""Sinks and maintained tables (K1-K5).

Write-once store without transactions: a batch is validated and hashed
(``ingest.ingest_batch``), keys already stored are rejected by an anti-join
(V3), and accepted rows are appended partitioned by month and sorted
by date and key inside files (row-group min/max skipping on point lookups).  Both
indexes are projections of the accepted rows, so ``rebuild_indexes`` can
regenerate them from ``snapshots`` for any dates.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobframe.functions.columns import as_date, sliced
from cobframe.operators.ingest import IngestResult
from cobframe.schema import AGREEMENT_FIELDS, KEY, TRADE_FIELDS
from cobframe.session import together
from cobframe.sources.stores import (PARTITION_COL, SCHEMAS, begin_attempt, commit_attempt,
                                     is_committed, month_of, read_snapshot_trades, read_snapshots,
                                     read_store_table, table_path)


def snapshot_pointer() -> Column:
    """Logical location of a snapshot (key path), kept in the exposure index."""
    return F.concat_ws("/", F.lit("snapshots"), "counterparty_id", "netting_set_id",
                       F.col("cob_date").cast("string"))


def build_exposure_index(snapshots: DataFrame) -> DataFrame:
    """K2: narrow ranking rows per snapshot (batch id kept when present)."""
    ing = F.col("ingested_at") if "ingested_at" in snapshots.columns else F.current_timestamp()
    batch = ["batch_id"] if "batch_id" in snapshots.columns else []
    return snapshots.select(*KEY, "exposure_total", snapshot_pointer().alias("snapshot_path"),
                            ing.alias("ingested_at"), *batch)


def build_trade_index(trades: DataFrame, unique: bool = False) -> DataFrame:
    """K3: one row per (trade, snapshot); snapshots without trades have none.
    ``unique``: no trade id occurs twice in a snapshot, as after A1."""
    batch = ["batch_id"] if "batch_id" in trades.columns else []
    rows = trades.select("trade_id", *KEY, *batch)
    return rows if unique else rows.distinct()


# Every row group's range of trade ids spans most of them, so a lookup by id is
# told by Bloom filters (or, where few ids repeat, by the column's dictionary).
LOOKED_UP = ("trade_id",)


def write_table(df: DataFrame, path: str, mode: str, sort_cols: list[str]) -> None:
    """Month-partitioned, date/key-sorted parquet (see ``sources.stores``).

    The rebalance shuffle deals rows by month and lets AQE cut a large month
    into tasks (and files) of the advisory size, and join small ones."""
    writer = (df.withColumn(PARTITION_COL, month_of(F.col("cob_date")))
              .hint("rebalance", PARTITION_COL).sortWithinPartitions(PARTITION_COL, "cob_date", *sort_cols)
              .write.mode(mode).partitionBy(PARTITION_COL))
    for c in LOOKED_UP:
        if c in df.columns:
            writer = (writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
                      .option("parquet.bloom.filter.adaptive.enabled", "true"))
    writer.parquet(path)


def append_snapshots(result: IngestResult, root: str, batch_id: str | None = None) -> str:
    """K1-K3: append accepted snapshots, their trades, both indexes and the
    rejects of a batch; returns the batch id.  Keys must have been checked
    against the store (``existing_keys`` of ``ingest_batch``) to keep the
    store write-once.

    ``batch_id`` names the logical batch: a batch that is committed already is
    not written again.  Every call writes under an attempt id of its own, so a
    call that died leaves rows nobody reads, and its replay starts afresh.

    Lineage is cut at each written table: both indexes are projections of the
    tables just written (found by the attempt id, a pushed-down filter), so the
    ingest job runs once for the snapshots and once for the trades instead of
    once per output.
    """
    spark = result.snapshots.sparkSession
    batch_id = batch_id or uuid.uuid4().hex
    if is_committed(spark, root, batch_id):
        return batch_id
    attempt = uuid.uuid4().hex
    begin_attempt(spark, root, attempt, batch_id)

    def by_month(df):
        return sliced(df, [month_of(F.col("cob_date"))], result.slices)

    def headers():
        snaps = result.hashed_stored()
        if "ingested_at" not in snaps.columns:
            snaps = snaps.withColumn("ingested_at", F.current_timestamp())
        snaps = snaps.select(*KEY, "agreement", "market_data", "exposure_total", "data_hash",
                             "ingested_at", F.lit(attempt).alias("batch_id"))
        for part in by_month(snaps):
            write_table(part, table_path(root, "snapshots"), "append", ["counterparty_id", "netting_set_id"])
        written = read_store_table(spark, root, "snapshots", attempt=attempt)
        write_table(build_exposure_index(written), table_path(root, "exposure_index"), "append",
                    ["counterparty_id", "netting_set_id"])

    def bodies():
        write_table(result.sets.withColumn("batch_id", F.lit(attempt)), table_path(root, "market_sets"),
                    "append", ["digest"])
        trades = result.trades  # those of the accepted snapshots
        if "position" not in trades.columns:
            trades = trades.withColumn("position", F.lit(None).cast("long"))
        trades = trades.select(*KEY, *TRADE_FIELDS, "position", F.lit(attempt).alias("batch_id"))
        for part in by_month(trades):
            write_table(part, table_path(root, "snapshot_trades"), "append",
                        ["counterparty_id", "netting_set_id", "trade_id"])
        written_trades = read_store_table(spark, root, "snapshot_trades", attempt=attempt)
        write_table(build_trade_index(written_trades, unique=True), table_path(root, "trade_index"), "append",
                    ["trade_id"])
        write_table(result.rejects.withColumn("batch_id", F.lit(attempt)), table_path(root, "rejects"),
                    "append", ["counterparty_id"])

    # different tables each, and none is read before the batch is committed
    together(spark, headers, bodies)
    # from here on readers see the batch in every table at once
    commit_attempt(spark, root, attempt, batch_id)
    return batch_id


def rebuild_indexes(spark: SparkSession, root: str, from_date=None, to_date=None) -> None:
    """K4: regenerate both index tables from ``snapshots`` for the months
    covering a date range (dynamic partition overwrite: other months are
    untouched, and not read).  Run it while no ingest is running: rows that an
    open attempt has put into the same months of the indexes are replaced too.

    The index is written to a staging folder first, then moved in with a
    second overwrite, since a job cannot overwrite the table it reads.
    """
    lo = None if from_date is None else F.trunc(as_date(from_date), "month")
    hi = None if to_date is None else F.last_day(as_date(to_date))
    snaps = read_snapshots(spark, root, lo, hi)
    trades = read_snapshot_trades(spark, root, lo, hi)
    for name, df, sort in (("exposure_index", build_exposure_index(snaps),
                            ["counterparty_id", "netting_set_id"]),
                           ("trade_index", build_trade_index(trades), ["trade_id"])):
        tmp = table_path(root, f"_rebuild_{name}_{uuid.uuid4().hex}")
        write_table(df, tmp, "overwrite", sort)
        fresh = spark.read.schema(SCHEMAS[name]).parquet(tmp)
        (fresh.write.mode("overwrite").options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP if c in fresh.columns}).partitionBy(PARTITION_COL)
         .option("partitionOverwriteMode", "dynamic").parquet(table_path(root, name)))


def _quoted(c: str | Column) -> Column:
    """JSON text of one value: a quoted string, or null."""
    c = F.col(c) if isinstance(c, str) else c
    # a one-element array renders the value with JSON's own escaping
    body = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substring(body, F.lit(2), F.length(body) - 2))


def _members(pairs: list[tuple[str, Column]]) -> Column:
    """``{"name":value,...}`` from names and JSON texts."""
    parts = []
    for i, (name, text) in enumerate(pairs):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), text]
    return F.concat(*parts, F.lit("}"))


def _raw_object(c: str) -> Column:
    """The stored object text as it is: parsing would change its numbers."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("{}"))


def trade_json(trades: DataFrame) -> DataFrame:
    """Key, ``position``, ``trade_id`` and the JSON text of each trade, ``extra`` spliced in unchanged."""
    position = F.col("position") if "position" in trades.columns else F.lit(None).cast("long")
    pairs = [(c, _quoted(F.col(c).cast("string") if c == "maturity_date" else c)) for c in TRADE_FIELDS if c != "extra"]
    return trades.select(*KEY, position.alias("position"), "trade_id",
                         _members([*pairs, ("extra", _raw_object("extra"))]).alias("text"))


def export_snapshots_json(snapshots: DataFrame, trades: DataFrame) -> DataFrame:
    """K5: one JSON document per snapshot in full form (``value`` column), nulls kept,
    ``extra`` embedded as the object text that was stored, trades in stored
    ``position`` order (trade_id where none is stored).  Write with
    ``df.write.text``.

    Each trade is rendered before the shuffle; a document is one value, so its
    trade texts meet in one place."""
    listed = trade_json(trades).groupBy(*KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "trade_id", "text"))),
                                 lambda t: t["text"]), ",").alias("_trades"))
    agreement = _members([(c, _raw_object("agreement.extra") if c == "extra" else _quoted(f"agreement.{c}"))
                          for c in AGREEMENT_FIELDS])
    market = F.to_json("market_data", {"ignoreNullFields": "false"})
    doc = _members([("counterparty_id", _quoted("counterparty_id")), ("netting_set_id", _quoted("netting_set_id")),
                    ("cob_date", _quoted(F.col("cob_date").cast("string"))),
                    ("agreement", F.when(F.col("agreement").isNull(), "null").otherwise(agreement)),
                    ("trades", F.concat(F.lit("["), F.coalesce("_trades", F.lit("")), F.lit("]"))),
                    ("market_data", F.coalesce(market, F.lit("null"))), ("data_hash", _quoted("data_hash"))])
    return snapshots.join(listed, KEY, "left").select(*KEY, doc.alias("value"))


def export_format(fmt: str) -> str:
    """Only JSON export exists; any other format is an error."""
    if fmt != "json":
        raise ValueError(f"unsupported export format: {fmt}")
    return fmt
