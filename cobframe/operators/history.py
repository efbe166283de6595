"""Time-series operators documented by the reference as next steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobframe.functions.columns import floats_differ
from cobframe.schema import AGREEMENT_FIELDS, KEY, NS_KEY

FLOAT_TERMS = ["threshold_amount", "minimum_transfer_amount", "independent_amount",
               "rounding_amount"]


def agreement_history(snapshots: DataFrame) -> DataFrame:
    """CSA term versions per netting set with validity intervals.

    A version starts on a date whose terms differ from the previous stored
    date (same rule as the diff: floats within 1e-9 are equal;
    ``agreement_id`` ignored); ``valid_to`` is the start of the next version
    (exclusive), NULL for the current one.  Windows hold one row per stored
    date of a netting set.
    """
    w = Window.partitionBy(*NS_KEY).orderBy("cob_date")
    terms = [f for f in AGREEMENT_FIELDS if f != "agreement_id"]
    s = snapshots.select(*KEY, "agreement").withColumn("prev", F.lag("agreement").over(w))
    changed = F.col("prev").isNull()
    for f in terms:
        a, b = F.col(f"prev.{f}"), F.col(f"agreement.{f}")
        # two missing amounts are the same term
        changed = changed | (floats_differ(a, b) & ~(a.isNull() & b.isNull()) if f in FLOAT_TERMS
                             else ~a.eqNullSafe(b))
    starts = s.where(changed)
    return (starts.withColumn("valid_to", F.lead("cob_date").over(w))
            .select(*NS_KEY, F.col("cob_date").alias("valid_from"), "valid_to",
                    *[F.col(f"agreement.{f}").alias(f) for f in AGREEMENT_FIELDS]))


def exposure_anomalies(exposure_index: DataFrame, window_days: int = 30, min_history: int = 30,
                       n_sigma: float = 2.0) -> DataFrame:
    """Counterparty exposure against its trailing window.

    Exposure is first summed per (counterparty, date) (partial aggregation),
    so the window sees one row per counterparty-day.  The window is the
    previous ``window_days`` calendar days (today excluded).  A day is
    eligible when the counterparty has at least ``min_history`` dates of
    history, that day included, wherever they lie; it is flagged when it lies
    more than ``n_sigma`` sample standard deviations from the window's mean.
    """
    daily = (exposure_index.groupBy("counterparty_id", "cob_date")
             .agg(F.sum("exposure_total").alias("exposure_total"))
             .withColumn("_day", F.unix_date("cob_date").cast("long")))
    by = Window.partitionBy("counterparty_id").orderBy("_day")
    w = by.rangeBetween(-window_days, -1)
    stats = daily.select(
        "counterparty_id", "cob_date", "exposure_total",
        F.row_number().over(by).alias("n_history"),
        F.count(F.lit(1)).over(w).cast("long").alias("n_obs"),
        F.avg("exposure_total").over(w).alias("mean"),
        F.stddev_samp("exposure_total").over(w).alias("std"))
    eligible = stats.where(F.col("n_history") >= min_history)
    flag = F.coalesce(F.abs(F.col("exposure_total") - F.col("mean")) > F.lit(n_sigma) * F.col("std"),
                      F.lit(False))
    return eligible.select("counterparty_id", "cob_date", "exposure_total", "n_obs",
                           F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                           flag.alias("is_anomaly"))


def snapshots_with_matrices(snapshots: DataFrame, files: DataFrame,
                            with_content: bool = False) -> DataFrame:
    """Snapshot matrix refs joined to the file listing on path.

    Content bytes are attached only when asked for (they can be large)."""
    refs = snapshots.select(*KEY, F.explode("market_data.price_matrices").alias("instrument", "ref"))
    cols = ["path", "length"] + (["content"] if with_content else [])
    j = (refs.select(*KEY, "instrument", F.col("ref.path").alias("path"),
                     F.col("ref.hash").alias("hash"))
         .join(files.select(*cols), "path", "left"))
    return j


def extra_json_query(df: DataFrame, path: str = "$.k", cast: str = "int",
                     extra_col: str = "extra") -> DataFrame:
    """Typed value of a JSON path inside ``extra`` (text kept verbatim;
    the path is evaluated with ``get_json_object``)."""
    return df.withColumn("extra_value", F.get_json_object(F.col(extra_col), path).cast(cast))
