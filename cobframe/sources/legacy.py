"""Reader for the one-file-per-snapshot layout with JSON-text columns.

A data directory in that layout holds

    snapshots/{cp}/{ns}/{date}.parquet   one row: key, agreement_json, trades_json,
                                         market_data_json, data_hash, ingested_at (text)
    index/{date}.parquet                 exposure rows of a date
    trade_index/{date}.parquet           trade id -> key rows of a date

``read_json_layout`` returns the same tables in this library's long form,
so a directory can be queried directly or migrated into a store with
``migrate_json_layout``.  Index files count only when the file stem is an
ISO date; other files are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobframe.schema import AGREEMENT, KEY, MARKET_DATA, TRADE

TRADES_JSON = T.ArrayType(TRADE)


def _stem_date(col: str = "_file") -> F.Column:
    """ISO date of a ``{date}.parquet`` file name, NULL for any other name."""
    stem = F.regexp_extract(F.col(col), r"([^/]+)\.parquet$", 1)
    return F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}$"), stem.try_cast("date"))


def read_json_layout(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    base = data_dir.rstrip("/")
    raw = (spark.read.option("recursiveFileLookup", True).parquet(f"{base}/snapshots")
           .withColumn("_file", F.input_file_name()))
    raw = raw.withColumn("_stem", _stem_date()).where(F.col("_stem").isNotNull())
    snaps = raw.select(
        "counterparty_id", "netting_set_id", F.to_date("cob_date").alias("cob_date"),
        F.from_json("agreement_json", AGREEMENT).alias("agreement"),
        F.from_json("market_data_json", MARKET_DATA).alias("market_data"),
        "data_hash", F.to_timestamp("ingested_at").alias("ingested_at"), "trades_json")
    trades = (snaps.select(*KEY, F.posexplode(F.from_json("trades_json", TRADES_JSON))
                           .alias("position", "t"))
              .select(*KEY, "position", "t.*"))
    snapshots = snaps.drop("trades_json")

    def dated(name: str) -> DataFrame:
        df = (spark.read.option("recursiveFileLookup", True).parquet(f"{base}/{name}")
              .withColumn("_file", F.input_file_name()))
        return (df.withColumn("_stem", _stem_date()).where(F.col("_stem").isNotNull())
                .withColumn("cob_date", F.to_date("cob_date")).drop("_file", "_stem"))

    out = {"snapshots": snapshots, "trades": trades}
    out["exposure_index"] = dated("index").withColumn(
        "ingested_at", F.to_timestamp("ingested_at"))
    out["trade_index"] = dated("trade_index")
    return out


def migrate_json_layout(spark: SparkSession, data_dir: str, root: str) -> str:
    """Write a JSON-layout directory into a store (hashes kept as stored;
    audit them with ``integrity.audit_integrity`` after the move).  Trades
    keep their document ``position`` so recomputed hashes follow the stored
    order."""
    from cobframe.operators.market_sets import detach_sets, market_sets
    from cobframe.operators.store import write_table, build_exposure_index, build_trade_index
    from cobframe.sources.stores import (begin_attempt, commit_attempt, is_committed,
                                         read_store_table, table_path)
    if is_committed(spark, root, "migrated"):
        return root
    attempt = uuid.uuid4().hex
    begin_attempt(spark, root, attempt, "migrated")
    src = read_json_layout(spark, data_dir)
    exposure = src["exposure_index"].select(*KEY, "exposure_total")
    snaps = (src["snapshots"].join(exposure, KEY, "left")
             .withColumn("exposure_total", F.coalesce("exposure_total", F.lit(0.0)))
             .withColumn("batch_id", F.lit(attempt)))
    write_table(detach_sets(snaps).select(*KEY, "agreement", "market_data", "exposure_total", "data_hash",
                                          "ingested_at", "batch_id"),
           table_path(root, "snapshots"), "append", ["counterparty_id", "netting_set_id"])
    write_table(market_sets(snaps).withColumn("batch_id", F.lit(attempt)), table_path(root, "market_sets"), "append", ["digest"])
    write_table(src["trades"].withColumn("position", F.col("position").cast("long"))
           .withColumn("batch_id", F.lit(attempt)),
           table_path(root, "snapshot_trades"), "append",
           ["counterparty_id", "netting_set_id", "trade_id"])
    write_table(build_exposure_index(read_store_table(spark, root, "snapshots", attempt=attempt)),
           table_path(root, "exposure_index"), "append", ["counterparty_id", "netting_set_id"])
    write_table(build_trade_index(read_store_table(spark, root, "snapshot_trades", attempt=attempt)),
           table_path(root, "trade_index"), "append", ["trade_id"])
    commit_attempt(spark, root, attempt, "migrated")
    return root
