"""Validation (V1-V9).  At set scale a failed rule is a reject row, not an
exception: every check returns (good, rejects) or a reason column.

Order of checks of one write, first failing rule reported:
MISSING_FIELD (an id) -> INVALID_ID -> MISSING_FIELD -> DUPLICATE -> MISSING_MATRIX -> NON_FINITE.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobframe.functions.columns import (date_range, is_finite, map_values_finite, month_col_of,
                                        safe_id)
from cobframe.schema import KEY
from cobframe.session import written


class Checked(NamedTuple):
    good: DataFrame
    rejects: DataFrame


def _rejects(df: DataFrame, reason: Column | str, detail: Column | None = None) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.select(*KEY, reason.alias("reject_reason"),
                     (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


# ---------------------------------------------------------------- row rules

def id_reason(df: DataFrame) -> Column:
    """V1 + V6 on an agreement staging row: reason or NULL."""
    required = [F.col(c).isNull() for c in ("counterparty_id", "netting_set_id", "cob_date",
                                            "agreement_id")]
    missing = required[0]
    for r in required[1:]:
        missing = missing | r
    absent_id = F.col("counterparty_id").isNull() | F.col("netting_set_id").isNull()
    return (F.when(absent_id, F.lit("MISSING_FIELD"))
            .when(~safe_id("counterparty_id") | ~safe_id("netting_set_id"), F.lit("INVALID_ID"))
            .when(missing, F.lit("MISSING_FIELD")))


def validate_ids(agreements: DataFrame) -> Checked:
    """V1/V6: ids must match the id alphabet; key fields and agreement id present."""
    flagged = agreements.withColumn("_reason", id_reason(agreements))
    good = flagged.where(F.col("_reason").isNull()).drop("_reason")
    bad = _rejects(flagged.where(F.col("_reason").isNotNull()), F.col("_reason"),
                   F.concat_ws("/", "counterparty_id", "netting_set_id"))
    return Checked(good, bad)


def _mark_copies(agreements: DataFrame, order: list[str], existing: DataFrame | None) -> DataFrame:
    """V3 as columns ``reject_reason`` and ``detail`` on every row, NULL for
    the first copy of a key that is not stored yet.

    Per distinct row and its number of copies: ``min`` finds the first of each
    key (combined map-side), and a row is repeated once per copy."""
    others = [c for c in agreements.columns if c not in KEY and c not in order]
    kinds = dict(agreements.dtypes)
    # maps have no order; everything else sorts as it is
    rest = [F.to_json(c) if "map<" in kinds[c] else F.col(c) for c in others]
    row = F.struct(*[F.col(c) for c in order], *[r.alias(f"_{i}") for i, r in enumerate(rest)])
    # grouping takes -0.0 for 0.0 and a map's text is not the map: such columns are kept beside the group
    fields = {c: f"_{i}" for i, c in enumerate(others)} | {c: c for c in order}
    aside = [c for c in fields if any(k in kinds[c] for k in ("double", "float", "map<"))]
    copies = agreements.withColumn("_ord", row).groupBy(*KEY, "_ord").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(f"_first_{c}") for c in aside])
    values = {c: F.col(f"_first_{c}") if c in aside else F.col("_ord")[f] for c, f in fields.items()}
    first = copies.groupBy(*KEY).agg(F.min("_ord").alias("_first"))
    ranked = copies.join(first, KEY)
    stored = F.lit(False)
    if existing is not None:
        ranked = ranked.join(existing.select(*KEY).distinct().withColumn("_stored", F.lit(True)), KEY, "left")
        stored = F.coalesce("_stored", F.lit(False))
    each = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    wins = (F.col("_ord") == F.col("_first")) & (F.col("_copy") == 1)
    detail = (F.when(stored, F.lit("already stored"))
              .when(~wins, F.lit("later copy in batch")))
    return each.select(*[F.col(c) if c in KEY else values[c].alias(c) for c in agreements.columns],
                       F.when(stored | ~wins, F.lit("DUPLICATE")).alias("reject_reason"), detail.alias("detail"))


def mark_agreements(agreements: DataFrame, order: list[str],
                    existing: DataFrame | None = None) -> DataFrame:
    """V1, V6 and V3: every staged row with the first rule it fails in
    ``reject_reason`` (NULL: accepted) and its ``detail``.  The keys that come
    more than once are written first; all other rows pass in one reading."""
    flagged = agreements.withColumn("reject_reason", id_reason(agreements))
    ok = F.col("reject_reason").isNull()
    flagged = flagged.withColumn("detail", F.when(~ok, F.concat_ws("/", "counterparty_id", "netting_set_id")))
    good = flagged.where(ok).drop("reject_reason", "detail")
    # which keys come more than once is counted on one number a key: only rows of such a number are compared,
    # by their whole keys (those of two keys that share it pass as the first copies they are)
    number = F.xxhash64(*KEY)
    repeated = written(good.groupBy(number.alias("_again")).agg(F.count(F.lit(1)).alias("_n"))
                       .where(F.col("_n") > 1).select("_again"), "repeated")
    single, others = flagged, None
    if not repeated.isEmpty():
        same = number == F.col("_again")
        single = flagged.join(repeated, same & F.col("reject_reason").isNull(), "left_anti")
        others = _mark_copies(written(good.join(repeated, same, "left_semi"), "copies"), order, existing)
    if existing is not None:
        stored = existing.select(*KEY).distinct().withColumn("_stored", F.lit(True))
        hit = ok & F.coalesce("_stored", F.lit(False))
        single = single.join(stored, KEY, "left").select(
            *agreements.columns, F.when(hit, F.lit("DUPLICATE")).otherwise(F.col("reject_reason")).alias("reject_reason"),
            F.when(hit, F.lit("already stored")).otherwise(F.col("detail")).alias("detail"))
    return single if others is None else single.unionByName(others)


def reject_duplicates(agreements: DataFrame, order: list[str],
                      existing: DataFrame | None = None) -> Checked:
    """V3: a key already stored, or a later copy of a key in the batch, is
    rejected; the first copy wins, by ``order`` and, among equals, by the
    smallest of all other columns.  Of copies equal in every column all but
    one are rejected."""
    marked = _mark_copies(agreements, order, existing)
    good = marked.where(F.col("reject_reason").isNull()).drop("reject_reason", "detail")
    return Checked(good, marked.where(F.col("reject_reason").isNotNull())
                   .select(*KEY, "reject_reason", "detail"))


def validate_matrix_refs(headers: DataFrame, inventory: DataFrame) -> Checked:
    """V4: every referenced matrix path must exist in ``inventory`` (path)."""
    refs = headers.select(*KEY, F.explode(F.map_values("market_data.price_matrices")).alias("ref"))
    missing = (refs.select(*KEY, F.col("ref.path").alias("path"))
               .join(inventory.select("path").distinct(), "path", "left_anti"))
    bad_keys = missing.groupBy(*KEY).agg(F.min("path").alias("detail"))
    good = headers.join(bad_keys.select(*KEY), KEY, "left_anti")
    bad = headers.join(bad_keys, KEY).select(*KEY, F.lit("MISSING_MATRIX").alias("reject_reason"),
                                             "detail")
    return Checked(good, bad)


def agreement_finite() -> Column:
    ag = "agreement."
    checks = [is_finite(F.col(ag + c)) for c in ("threshold_amount", "minimum_transfer_amount",
                                                 "independent_amount", "rounding_amount")]
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return ok


def header_finite(headers: DataFrame) -> Column:
    return (agreement_finite() & map_values_finite("market_data.fx_rates")
            & map_values_finite("market_data.inflation_rates"))


def validate_finite(headers: DataFrame, trades: DataFrame) -> Checked:
    """V2: no NaN / +-Inf anywhere in the hashed document.  ``exposure_total``
    is outside the document and is not checked.

    Trades are checked in long form; the per-key flag is a partial aggregate.
    """
    bad_trades = (trades.where(~is_finite("notional")).groupBy(*KEY)
                  .agg(F.min("trade_id").alias("detail")))
    bad_head = headers.where(~header_finite(headers)).select(*KEY, F.lit("agreement/market")
                                                             .alias("detail"))
    bad_keys = bad_head.unionByName(bad_trades).groupBy(*KEY).agg(F.min("detail").alias("detail"))
    good = headers.join(bad_keys.select(*KEY), KEY, "left_anti")
    bad = bad_keys.select(*KEY, F.lit("NON_FINITE").alias("reject_reason"), "detail")
    return Checked(good, bad)


def null_numeric_counts(staged_agreements: DataFrame) -> DataFrame:
    """Per date, staging agreement rows whose NUMERIC terms are NULL and are
    read as 0.0 (a NULL threshold silently means "no threshold")."""
    terms = ["threshold_amount", "minimum_transfer_amount", "independent_amount",
             "rounding_amount"]
    return (staged_agreements.groupBy("cob_date")
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                 *[F.count_if(F.col(t).isNull()).cast("long").alias(f"null_{t}") for t in terms]))


def rejects_by_reason(rejects: DataFrame) -> DataFrame:
    """Counts of rejected rows per date and reason."""
    return (rejects.groupBy("cob_date", "reject_reason")
            .agg(F.count(F.lit(1)).cast("long").alias("n_rejects")))


# ---------------------------------------------------------------- filters

def date_range_filter(df: DataFrame, from_date=None, to_date=None) -> DataFrame:
    """V7: inclusive optional bounds; a stored table's month directories prune too."""
    return df.where(date_range("cob_date", from_date, to_date, month_col_of(df)))


def threshold_filter(df: DataFrame, threshold: float | None) -> DataFrame:
    """V8: keep ``exposure_total >= threshold`` when a threshold is given."""
    return df if threshold is None else df.where(F.col("exposure_total") >= F.lit(float(threshold)))


def key_filter(df: DataFrame, **equals) -> DataFrame:
    """V9: equality on any given key columns (None means no filter); a date
    also names its month directory."""
    for c, v in equals.items():
        if v is not None and c == "cob_date":
            df = date_range_filter(df, v, v)
        elif v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df


def require_range(from_date, to_date, strict: bool = True) -> None:
    """V5 for driver-side arguments: diff needs from < to, backfill from <= to."""
    if from_date is None or to_date is None:
        return
    if (strict and not from_date < to_date) or (not strict and not from_date <= to_date):
        raise ValueError(f"invalid range: from_date={from_date} to_date={to_date}")
