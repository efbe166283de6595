"""Snapshot assembly.

Output is long form: ``headers`` (one row per snapshot key: agreement struct,
market data struct, exposure) and ``trades`` (one row per trade).  Trades are
never collected into an array here; :func:`nest_trades` builds the document
form only where a document is the requested output.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobframe.functions.columns import or_default, typed_empty_map
from cobframe.operators.market_sets import EMPTY_SET, SETS
from cobframe.schema import (DEFAULT_CURRENCY, DEFAULT_DIRECTION, DEFAULT_PRODUCT_TYPE, KEY,
                             MARKET_FX, MARKET_INFLATION, TRADE, TRADE_FIELDS)
from cobframe.sources.staging import dedupe_first


REF_MAP = "map<string,struct<path:string,hash:string>>"


class Assembled(NamedTuple):
    headers: DataFrame
    trades: DataFrame


def agreement_struct(df: DataFrame) -> Column:
    """A3 on agreement terms: falsy-default currency, collateral and extra."""
    return F.struct(
        F.col("agreement_id").alias("agreement_id"),
        F.col("threshold_amount").alias("threshold_amount"),
        F.col("minimum_transfer_amount").alias("minimum_transfer_amount"),
        F.col("independent_amount").alias("independent_amount"),
        or_default("currency", DEFAULT_CURRENCY).alias("currency"),
        F.coalesce(F.col("eligible_collateral"), F.array().cast("array<string>"))
         .alias("eligible_collateral"),
        F.col("rounding_amount").alias("rounding_amount"),
        F.col("valuation_agent").alias("valuation_agent"),
        or_default("extra", "{}").alias("extra"),
    )


def apply_trade_defaults(trades: DataFrame) -> DataFrame:
    """A3 on trades: product type, currency and direction defaults."""
    return (trades
            .withColumn("product_type", or_default("product_type", DEFAULT_PRODUCT_TYPE))
            .withColumn("currency", or_default("currency", DEFAULT_CURRENCY))
            .withColumn("direction", or_default("direction", DEFAULT_DIRECTION))
            .withColumn("extra", or_default("extra", "{}")))


def group_trades(trades: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A1: one trade row per (key, trade_id), first arrival wins.

    The choice is a ``min_by`` aggregate (partial aggregation before the
    shuffle), so repeated copies of one trade are combined map-side.
    """
    order = order or ["ingested_at"]
    cols = ["trade_id", "product_type", "notional", "currency", "maturity_date", "direction",
            "extra"]
    keep = [c for c in cols if c in trades.columns]
    dd = dedupe_first(trades.select(*KEY, *keep, *[c for c in order if c not in keep]),
                      KEY + ["trade_id"], order, keep=keep)
    return dd.select(*KEY, *keep)


def pivot_market_data(market: DataFrame) -> DataFrame:
    """A5: long market data -> one row per date with ``fx_rates`` and
    ``inflation_rates`` maps.  Unknown data types are dropped (see A6).

    Rows are first reduced to one per (cob_date, data_type, key), since a map
    cannot hold a key twice.  The per-date maps are bounded by the number of
    rate keys of one day, not by data volume.
    """
    order = "ingested_at" if "ingested_at" in market.columns else "value"
    known = market.where(F.col("data_type").isin(MARKET_FX, MARKET_INFLATION))
    one = (known.groupBy("cob_date", "data_type", "key")
           .agg(F.min_by("value", F.struct(F.col(order), F.col("value"))).alias("value")))
    entry = F.struct("key", "value")
    return (one.groupBy("cob_date").agg(
        # sorted entries: equal sets of a date are equal values and equal texts
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("data_type") == MARKET_FX, entry))))
         .alias("fx_rates"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("data_type") == MARKET_INFLATION, entry))))
         .alias("inflation_rates")))


def unknown_market_types(market: DataFrame) -> DataFrame:
    """Rows per (cob_date, data_type) whose type is not understood."""
    return (market.where(~F.col("data_type").isin(MARKET_FX, MARKET_INFLATION))
            .groupBy("cob_date", "data_type").agg(F.count(F.lit(1)).cast("long").alias("n_rows")))


def parse_matrix_key(objects: DataFrame, path_col: str = "path") -> DataFrame:
    """``matrices/{date}/{cp}/{ns}/{file...}`` -> cp, ns, instrument.

    Keys with fewer than five parts are marked ``parsed = false`` (skipped by
    the ingest).  The instrument is the remaining parts joined with ``.``,
    minus the last extension.
    """
    parts = F.split(F.col(path_col), "/")
    n = F.size(parts)
    rest = F.array_join(F.slice(parts, 5, F.greatest(n - 4, F.lit(1))), ".")
    instrument = F.when(rest.contains("."), F.regexp_replace(rest, r"\.[^.]*$", "")).otherwise(rest)
    ok = n >= 5
    return objects.select(
        "*",
        ok.alias("parsed"),
        F.when(ok, F.expr("try_cast(element_at(split({0}, '/'), 2) AS DATE)".format(path_col)))
         .alias("cob_date"),
        F.when(ok, F.element_at(parts, 3)).alias("counterparty_id"),
        F.when(ok, F.element_at(parts, 4)).alias("netting_set_id"),
        F.when(ok, instrument).alias("instrument"))


def collect_matrix_refs(refs: DataFrame) -> DataFrame:
    """Instrument -> (path, hash) map per snapshot key.

    Two files that differ only in extension give one instrument; the last
    path in sort order wins.  Bounded by instruments per netting set.
    """
    one = (refs.groupBy(*KEY, "instrument")
           .agg(F.max_by(F.struct("path", "hash"), F.col("path")).alias("ref")))
    return (one.groupBy(*KEY)
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("instrument", "ref"))))
                 .alias("price_matrices")))


def assemble_snapshots(agreements: DataFrame, trades: DataFrame | None = None, market: DataFrame | None = None,
                       matrix_refs: DataFrame | None = None, exposure: DataFrame | None = None,
                       trade_order: list[str] | None = None, stage=None, dated: DataFrame | None = None) -> Assembled:
    """A2: one snapshot per agreement row.

    * trades of a key without agreement are dropped (semi-join), an agreement
      without trades has none
    * the date's market data is attached to every snapshot of that date
    * matrix refs attach per key
    * without ``trades`` the headers alone are assembled
    * ``dated`` (``market_sets.dated_sets``) in place of ``market``: headers in
      stored form, with ``_market_finite``; no map travels with a snapshot
    * ``exposure`` (A15): optional (key, exposure_total) feed, default 0.0;
      an ``exposure_total`` column already on ``agreements`` is used otherwise

    ``agreements`` must hold one row per key (see ``validate``).
    ``stage(name, df)`` may materialise the deduplicated trades (a written
    table) so that later steps do not recompute them.
    """
    ag = agreements
    exp_col = F.lit(0.0)
    if exposure is not None:
        ag = ag.join(exposure.select(*KEY, F.col("exposure_total").alias("_exp")), KEY, "left")
        exp_col = F.coalesce(F.col("_exp"), F.lit(0.0))
    elif "exposure_total" in ag.columns:
        exp_col = F.coalesce(F.col("exposure_total"), F.lit(0.0))
    extra_cols = [c for c in ("ingested_at", "arrival_seq") if c in ag.columns]
    headers = ag.select(*KEY, agreement_struct(ag).alias("agreement"),
                        exp_col.alias("exposure_total"), *extra_cols)
    if dated is not None:
        headers = headers.join(dated.select("cob_date", *SETS.values(), "finite"), "cob_date", "left")
    elif market is not None:
        headers = headers.join(pivot_market_data(market), "cob_date", "left")
    else:
        headers = (headers.withColumn("fx_rates", F.lit(None).cast("map<string,double>"))
                   .withColumn("inflation_rates", F.lit(None).cast("map<string,double>")))
    if matrix_refs is not None:
        headers = headers.join(collect_matrix_refs(matrix_refs), KEY, "left")
    else:
        headers = headers.withColumn("price_matrices", F.lit(None).cast(REF_MAP))
    empty_refs = F.create_map().cast(REF_MAP)
    if dated is not None:
        market_of_date = [F.coalesce(name, F.lit(EMPTY_SET)).alias(name) for name in SETS.values()]
        headers = headers.withColumn("_market_finite", F.coalesce("finite", F.lit(True)))
        extra_cols.append("_market_finite")
    else:
        market_of_date = [F.coalesce(field, typed_empty_map("string", "double")).alias(field) for field in SETS]
    headers = headers.select(
        *KEY, "agreement",
        F.struct(*market_of_date, F.coalesce(F.col("price_matrices"), empty_refs).alias("price_matrices"))
         .alias("market_data"),
        "exposure_total", *extra_cols)
    if trades is None:
        return Assembled(headers, headers.select(*KEY, *[F.lit(None).cast(f.dataType).alias(f.name) for f in TRADE.fields])
                         .where(F.lit(False)))
    tr = apply_trade_defaults(group_trades(trades, trade_order))
    if stage is not None:
        tr = stage("trades", tr)
    tr = tr.join(headers.select(*KEY), KEY, "left_semi")
    return Assembled(headers, tr)


def nest_trades(headers: DataFrame, trades: DataFrame) -> DataFrame:
    """Document form: ``trades`` as an array of structs in stored ``position``
    order where the table has one, else by trade_id.

    Use only on a selection whose documents are the output (a point lookup):
    the array of one snapshot is built in one task.
    """
    tstruct = F.struct(*TRADE_FIELDS)
    position = F.col("position") if "position" in trades.columns else F.lit(None).cast("long")
    nested = (trades.groupBy(*KEY)
              .agg(F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), "trade_id", tstruct.alias("t")))),
                               lambda x: x["t"]).alias("trades")))
    return (headers.join(nested, KEY, "left")
            .withColumn("trades", F.coalesce("trades", F.array().cast(T.ArrayType(TRADE)))))
