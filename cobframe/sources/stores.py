"""Stored tables (S6-S9) and matrix files.

Layout under a store root: every table is partitioned by month of the COB
date and sorted by date and key inside its files, so a date range prunes
month directories (partition filter derived from the date bounds) and
row groups (min/max of ``cob_date``):

    {root}/snapshots/cob_month=YYYY-MM-01/part-*.parquet
    {root}/market_sets/cob_month=.../
    {root}/snapshot_trades/cob_month=.../
    {root}/exposure_index/cob_month=.../
    {root}/trade_index/cob_month=.../
    {root}/rejects/cob_month=.../

Months rather than days: a daily directory holds one day of every
counterparty, which is large in production but makes thousands of tiny
files when a store spans many sparse dates; monthly directories keep files
large in both cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobframe.functions.columns import date_range
from cobframe.schema import AGREEMENT, STORED_MARKET_DATA, TRADE
from cobframe.sources.files import file_system, path_exists, write_text

PARTITION_COL = "cob_month"

_KEY_FIELDS = [T.StructField("counterparty_id", T.StringType()), T.StructField("netting_set_id", T.StringType()),
               T.StructField("cob_date", T.DateType())]
_TAIL = [T.StructField("batch_id", T.StringType()), T.StructField(PARTITION_COL, T.DateType())]

# Every read names its schema, so a table without a single file (a batch
# without trades on a fresh store) is an empty table, not an error.
SCHEMAS = {
    "snapshots": T.StructType(_KEY_FIELDS + [
        T.StructField("agreement", AGREEMENT), T.StructField("market_data", STORED_MARKET_DATA),
        T.StructField("exposure_total", T.DoubleType()), T.StructField("data_hash", T.StringType()),
        T.StructField("ingested_at", T.TimestampType())] + _TAIL),
    "market_sets": T.StructType([
        T.StructField("cob_date", T.DateType()), T.StructField("digest", T.StringType()),
        T.StructField("rates", T.MapType(T.StringType(), T.DoubleType()))] + _TAIL),
    "snapshot_trades": T.StructType(_KEY_FIELDS + list(TRADE.fields)
                                    + [T.StructField("position", T.LongType())] + _TAIL),
    "exposure_index": T.StructType(_KEY_FIELDS + [
        T.StructField("exposure_total", T.DoubleType()), T.StructField("snapshot_path", T.StringType()),
        T.StructField("ingested_at", T.TimestampType())] + _TAIL),
    "trade_index": T.StructType([T.StructField("trade_id", T.StringType())] + _KEY_FIELDS + _TAIL),
    "rejects": T.StructType(_KEY_FIELDS + [
        T.StructField("reject_reason", T.StringType()), T.StructField("detail", T.StringType())] + _TAIL),
}
TABLES = tuple(SCHEMAS)


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def month_of(c):
    return F.trunc(c, "month")


# -------------------------------------------------------------- write attempts
# A run that appends to the store is an *attempt*; its rows carry the attempt's
# id in ``batch_id``.  Before any data it leaves the marker ``_open/{attempt}``.
# Committing renames that marker to ``_batches/{logical batch}``, one step, and
# fails when the logical batch has been committed before.  Readers leave out
# the attempts that are open: those running and those whose job died.  Their
# number does not grow with the store's age, unlike the list of all batches.

def _marker(root: str, kind: str, name: str = "") -> str:
    return f"{root.rstrip('/')}/{kind}/{name}".rstrip("/")


def begin_attempt(spark: SparkSession, root: str, attempt: str, batch_id: str) -> None:
    write_text(spark, _marker(root, "_open", attempt), batch_id)


def is_committed(spark: SparkSession, root: str, batch_id: str) -> bool:
    return path_exists(spark, _marker(root, "_batches", batch_id))


def commit_attempt(spark: SparkSession, root: str, attempt: str, batch_id: str) -> bool:
    """Make an attempt's rows visible in every table at once; False when the
    logical batch was committed by another attempt (this one stays invisible)."""
    fs, source = file_system(spark, _marker(root, "_open", attempt))
    _, target = file_system(spark, _marker(root, "_batches", batch_id))
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        return False
    return bool(fs.rename(source, target))


def open_attempts(spark: SparkSession, root: str) -> list[str]:
    """Attempts not committed: running ones and dead ones."""
    fs, p = file_system(spark, _marker(root, "_open"))
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p)
                  if not st.getPath().getName().startswith("."))


def read_store_table(spark: SparkSession, root: str, name: str, from_date=None,
                     to_date=None, attempt: str | None = None) -> DataFrame:
    """Read one stored table.  Date bounds become a partition filter on
    the month directories plus a pushed filter on ``cob_date`` (S9: only
    ``cob_month=`` directories are discovered, the column stays in the result
    so that later key and date filters prune on it as well).

    Rows of attempts that are not committed are left out; ``attempt`` reads
    one attempt's rows, committed or not, which the writer itself uses."""
    before = open_attempts(spark, root)
    path, schema = table_path(root, name), SCHEMAS[name]
    if not path_exists(spark, path):
        df = spark.createDataFrame([], schema)
    else:
        df = spark.read.schema(schema).option("basePath", path).parquet(path)
    if attempt is not None:
        df = df.where(F.col("batch_id") == attempt)
    else:
        # files are listed between the two looks: an attempt open at either is left out
        hidden = sorted({*before, *open_attempts(spark, root)})
        if hidden:
            df = df.where(~F.col("batch_id").isin(hidden))
    return df.where(date_range("cob_date", from_date, to_date, PARTITION_COL))


def read_snapshots(spark, root, from_date=None, to_date=None) -> DataFrame:
    return read_store_table(spark, root, "snapshots", from_date, to_date)


def read_market_sets(spark, root, from_date=None, to_date=None) -> DataFrame:
    return read_store_table(spark, root, "market_sets", from_date, to_date)


def read_snapshot_trades(spark, root, from_date=None, to_date=None) -> DataFrame:
    return read_store_table(spark, root, "snapshot_trades", from_date, to_date)


def read_exposure_index(spark, root, from_date=None, to_date=None) -> DataFrame:
    return read_store_table(spark, root, "exposure_index", from_date, to_date)


def read_trade_index(spark, root, from_date=None, to_date=None) -> DataFrame:
    return read_store_table(spark, root, "trade_index", from_date, to_date)


def scan_matrix_files(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """List matrix files under ``root`` recursively (``binaryFile`` source).

    ``path`` is returned relative to ``root`` (``matrices/{date}/{cp}/{ns}/{file}``).
    Without ``with_content`` only metadata is read, which is what listing needs.
    """
    fs, p = file_system(spark, root)
    # the listing returns qualified paths; cut the qualified root literally
    base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .load(root))
    below = F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    rel = F.when(F.startswith(below, F.lit(base)), F.substring(below, F.lit(len(base) + 1), F.length(below)))
    cols = [rel.alias("path"), F.col("length"), F.col("modificationTime")]
    if with_content:
        cols.append(F.col("content"))
    return df.select(*cols)


def read_matrix_manifest(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Expected hashes sent with the files: (path, expected_hash); a missing
    hash is the empty string."""
    df = spark.read.format(fmt).option("header", True).load(path)
    return df.select("path", F.coalesce(F.col("expected_hash"), F.lit("")).alias("expected_hash"))
