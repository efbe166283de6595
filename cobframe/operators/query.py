"""Query operators (Q1-Q19) over the long-form store.

Inputs: ``snapshots`` (one row per key: agreement, market_data,
exposure_total, data_hash, ingested_at), ``trades`` (one row per trade),
``exposure_index`` and ``trade_index``.  Each lookup also has a set form
(a DataFrame of wanted keys, or no key at all) so that one plan answers all
counterparties and dates; a point lookup is the same plan with a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobframe.functions.columns import month_col_of
from cobframe.operators.assemble import nest_trades
from cobframe.operators.market_sets import SETS, detach_sets, distinct_sets, is_stored_form
from cobframe.operators.validate import date_range_filter, key_filter, threshold_filter
from cobframe.schema import KEY, PORTFOLIO_DEFAULT_TOP
from cobframe.session import written

TRADE_COLUMNS = ["trade_id", "product_type", "notional", "currency", "direction", "maturity_date"]


def _select_keys(snapshots: DataFrame, trades: DataFrame, counterparty_id, netting_set_id,
                 cob_date, wanted: DataFrame | None):
    s = key_filter(snapshots, counterparty_id=counterparty_id, netting_set_id=netting_set_id,
                   cob_date=cob_date)
    t = key_filter(trades, counterparty_id=counterparty_id, netting_set_id=netting_set_id,
                   cob_date=cob_date)
    if wanted is not None:
        s, t = _wanted(s, wanted), _wanted(t, wanted)
    return s.drop("cob_month"), t.drop("cob_month")


def _wanted(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of given keys; a stored table is also joined on its month, so
    that the months of a small key set prune directories at run time."""
    on, k = KEY, keys.select(*KEY).distinct()
    if month_col_of(df):
        on, k = [*KEY, "cob_month"], k.withColumn("cob_month", F.trunc("cob_date", "month"))
    return df.join(k, on, "left_semi")


def require_found(df: DataFrame, what: str, of: DataFrame | None = None) -> DataFrame:
    """Strict form: ``df``, failing the job with ``NotFound`` when the selection
    ``of`` (``df`` itself, if not given) is empty.  The check is one row (found
    or not) beside the result."""
    found = (df if of is None else of).select(F.lit(1).alias("_x")).limit(1).agg(F.count("_x").alias("_n"))
    missing = found.where(F.when(F.col("_n") > 0, F.lit(False)).otherwise(
        F.raise_error(F.lit(f"NotFound: {what}")).cast("boolean")))
    none = missing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(none)


def snapshot(snapshots: DataFrame, trades: DataFrame, counterparty_id=None, netting_set_id=None,
             cob_date=None, wanted: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Q1 (set form): the content of the selected snapshots as rows: the
    snapshot fields repeated on each of its trades, one row with NULL trade
    fields for a snapshot without trades.  Nothing is gathered per snapshot,
    so a netting set with very many trades stays spread over tasks.
    ``strict``: a selection without any snapshot fails.
    Combine with ``integrity.verify_on_read`` to check hashes on read."""
    s, t = _select_keys(snapshots, trades, counterparty_id, netting_set_id, cob_date, wanted)
    rows = s.join(t, KEY, "left")
    return require_found(rows, f"snapshot {counterparty_id}/{netting_set_id}/{cob_date}") if strict else rows


def snapshot_document(snapshots: DataFrame, trades: DataFrame, counterparty_id=None,
                      netting_set_id=None, cob_date=None,
                      wanted: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Q1 (document form): one row per snapshot with ``trades`` nested, for a
    point lookup or a bounded selection.  Filters apply before nesting; the
    array of one snapshot is built in one task."""
    s, t = _select_keys(snapshots, trades, counterparty_id, netting_set_id, cob_date, wanted)
    rows = nest_trades(s, t)
    return require_found(rows, f"snapshot {counterparty_id}/{netting_set_id}/{cob_date}") if strict else rows


def by_counterparty(snapshots: DataFrame, counterparty_id=None, cob_date=None) -> DataFrame:
    """Q2: all netting sets of a counterparty on a date (missing ones omitted)."""
    s = key_filter(snapshots, counterparty_id=counterparty_id, cob_date=cob_date)
    return s.orderBy("counterparty_id", "cob_date", "netting_set_id")


def trades_table(trades: DataFrame, counterparty_id=None, netting_set_id=None,
                 cob_date=None) -> DataFrame:
    """Q3: trade positions as a table (``extra`` dropped), in document order:
    by stored ``position`` where there is one, else by trade_id."""
    t = key_filter(trades, counterparty_id=counterparty_id, netting_set_id=netting_set_id,
                   cob_date=cob_date)
    order = [*KEY, "position", "trade_id"] if "position" in t.columns else [*KEY, "trade_id"]
    return t.select(*order, *[c for c in TRADE_COLUMNS if c not in order]).orderBy(*order) \
            .select(*KEY, *TRADE_COLUMNS)


def by_trade(trade_index: DataFrame, trades: DataFrame, trade_ids=None, from_date=None,
             to_date=None) -> DataFrame:
    """Q4: every (date, cp, ns) holding the wanted trade ids, via the index.

    ``trade_ids``: a string, a list, a DataFrame with ``trade_id`` or None
    (all).  The index names the months and snapshot keys that hold the ids;
    with them the scan of the trades prunes directories at run time.  The
    trades carry their id, so they are filtered by it as well, and without
    ids the index is not read at all.  Output: the nine trade columns, date
    order.
    """
    tr = _of_ids(date_range_filter(trades, from_date, to_date), trade_ids)
    if trade_ids is not None:
        tr = _wanted(tr, _of_ids(date_range_filter(trade_index, from_date, to_date), trade_ids))
    return tr.select("cob_date", "counterparty_id", "netting_set_id", *TRADE_COLUMNS) \
             .orderBy("cob_date", "counterparty_id", "netting_set_id", "trade_id")


def _of_ids(df: DataFrame, trade_ids) -> DataFrame:
    if trade_ids is None:
        return df
    if isinstance(trade_ids, str):
        return df.where(F.col("trade_id") == trade_ids)
    if isinstance(trade_ids, (list, tuple)):
        return df.where(F.col("trade_id").isin(list(trade_ids)))
    return df.join(trade_ids.select("trade_id").distinct(), "trade_id", "left_semi")


def by_trade_scan(trades: DataFrame, trade_ids=None, from_date=None, to_date=None) -> DataFrame:
    """Q5: same rows without the index (scan of all trades), ordered cp, ns, date."""
    tr = _of_ids(date_range_filter(trades, from_date, to_date), trade_ids)
    return tr.select("cob_date", "counterparty_id", "netting_set_id", *TRADE_COLUMNS) \
             .orderBy("counterparty_id", "netting_set_id", "cob_date", "trade_id")


def _first_market(snapshots: DataFrame, field: str, cob_date=None, sets: DataFrame | None = None) -> DataFrame:
    """Rates of the first snapshot (cp, ns order) of each date.

    The first key of each date is found on the key columns alone (combined
    map-side); only that snapshot's rates are then read: from itself, or in
    stored form from ``sets`` by the digest.
    """
    s = key_filter(snapshots, cob_date=cob_date)
    first = (s.groupBy("cob_date").agg(F.min(F.struct("counterparty_id", "netting_set_id")).alias("k"))
             .select("cob_date", "k.counterparty_id", "k.netting_set_id"))
    if sets is None:
        return s.select(*KEY, F.col(f"market_data.{field}").alias("rates")).join(first, KEY).select("cob_date", "rates")
    named = s.select(*KEY, F.col(f"market_data.{SETS[field]}").alias("digest")).join(first, KEY).select("cob_date", "digest")
    return named.join(distinct_sets(key_filter(sets, cob_date=cob_date)), "digest").select("cob_date", "rates")


def _rate_rows(snapshots: DataFrame, field: str, name: str, cob_date, strict: bool, sets: DataFrame | None) -> DataFrame:
    rows = _first_market(snapshots, field, cob_date, sets).select("cob_date", F.explode("rates").alias(name, "rate"))
    if not strict:
        return rows
    return require_found(rows, f"snapshot on {cob_date}", of=key_filter(snapshots, cob_date=cob_date))


def fx_rates(snapshots: DataFrame, cob_date=None, strict: bool = False, sets: DataFrame | None = None) -> DataFrame:
    """Q6: (cob_date, pair, rate) read from the first snapshot of each date
    (``strict``: no snapshot at all fails).  Q6-Q9: ``sets`` for snapshots in
    stored form."""
    return _rate_rows(snapshots, "fx_rates", "pair", cob_date, strict, sets)


def fx_rate_pair(snapshots: DataFrame, pair: str, cob_date=None, strict: bool = False,
                 sets: DataFrame | None = None) -> DataFrame:
    """Q7: one pair per date; NULL where the date's first snapshot lacks it
    (``strict`` raises instead, like a missing dict key)."""
    m = _first_market(snapshots, "fx_rates", cob_date, sets)
    val = F.element_at("rates", F.lit(pair)) if not strict else F.coalesce(
        F.element_at("rates", F.lit(pair)),
        F.raise_error(F.lit(f"KeyError: fx pair {pair}")).cast("double"))
    return m.select("cob_date", F.lit(pair).alias("pair"), val.alias("rate"))


def inflation_rates(snapshots: DataFrame, cob_date=None, strict: bool = False, sets: DataFrame | None = None) -> DataFrame:
    """Q8."""
    return _rate_rows(snapshots, "inflation_rates", "index_name", cob_date, strict, sets)


def inflation_rate_index(snapshots: DataFrame, index: str, cob_date=None,
                         strict: bool = False, sets: DataFrame | None = None) -> DataFrame:
    """Q9."""
    m = _first_market(snapshots, "inflation_rates", cob_date, sets)
    val = F.element_at("rates", F.lit(index)) if not strict else F.coalesce(
        F.element_at("rates", F.lit(index)),
        F.raise_error(F.lit(f"KeyError: inflation index {index}")).cast("double"))
    return m.select("cob_date", F.lit(index).alias("index_name"), val.alias("rate"))


def market_consistency(snapshots: DataFrame) -> DataFrame:
    """Audit for the first-snapshot rule of Q6/Q8: per date, how many distinct
    FX and inflation sets the snapshots carry (more than one means the lookup
    depends on key order).  Sets are compared by their digests, which the stored
    form holds."""
    if not is_stored_form(snapshots):
        snapshots = detach_sets(snapshots)
    return (snapshots.groupBy("cob_date")
            .agg(F.count(F.lit(1)).cast("long").alias("n_snapshots"),
                 F.count_distinct("market_data.fx_set").cast("long").alias("n_fx_sets"),
                 F.count_distinct("market_data.inflation_set").cast("long").alias("n_inflation_sets")))


def exposure_history(exposure_index: DataFrame, counterparty_id=None, netting_set_id=None,
                     from_date=None, to_date=None) -> DataFrame:
    """Q10/Q11: exposure series from the index, ascending by date."""
    e = key_filter(exposure_index, counterparty_id=counterparty_id, netting_set_id=netting_set_id)
    e = date_range_filter(e, from_date, to_date)
    return (e.select("counterparty_id", "cob_date", "netting_set_id", "exposure_total")
            .orderBy("counterparty_id", "cob_date", "netting_set_id"))


def rank_order() -> list:
    """Descending exposure; ties by ingest time, then key (total order)."""
    return [F.desc("exposure_total"), F.asc("ingested_at"), F.asc("counterparty_id"),
            F.asc("netting_set_id")]


def portfolio(exposure_index: DataFrame, cob_date=None, threshold: float | None = None,
              top_n: int | None = None) -> DataFrame:
    """Q12: exposure ranking, descending, ties by ingest time then key.

    One date: ``orderBy(..).limit(n)`` (TakeOrderedAndProject, top-k kept per
    task).  All dates: ``row_number() <= n`` per date, which Spark plans as a
    partial WindowGroupLimit before the shuffle, so no date ships more than
    n rows per task.  Without ``top_n`` every row has its rank, without a window
    over a whole date (see ``ranked``).
    """
    if top_n is not None and top_n < 1:
        raise ValueError("top_n must be >= 1")
    e = threshold_filter(key_filter(exposure_index, cob_date=cob_date), threshold)
    cols = ["cob_date", "counterparty_id", "netting_set_id", "exposure_total"]
    if cob_date is not None and top_n is not None:
        top = e.orderBy(*rank_order()).limit(top_n)
        w = Window.partitionBy("cob_date").orderBy(*rank_order())
        return top.withColumn("rank", F.row_number().over(w)).select(*cols, "rank")
    if top_n is None:
        return ranked(e.select(*cols, "ingested_at")).select(*cols, "rank")
    w = Window.partitionBy("cob_date").orderBy(*rank_order())
    first = e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return first.select(*cols, "rank")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` within their date, however many rows a date has.

    A range-partitioned sort, written once, deals the ranking order over tasks:
    a date lies in consecutive partitions.  A row's rank is its place in its
    partition, counted from the date's first row there, plus the date's rows in
    the partitions before; of those there is one count per (date, partition)."""
    order = ["cob_date", *rank_order()]
    places = written(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("_id", F.monotonically_increasing_id()), "ranking")
    # the id holds the partition above its lower 33 bits and the row's place in them
    places = places.withColumn("_part", F.shiftright("_id", 33))
    counts = places.groupBy("cob_date", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    per_date = counts.groupBy("cob_date").agg(F.array_sort(F.collect_list(F.struct("_part", "_n", "_first"))).alias("_parts"))
    starts = per_date.select("cob_date", F.explode(F.transform("_parts", lambda p: F.struct(
        p["_part"].alias("_part"), p["_first"].alias("_first"),
        F.aggregate(F.filter("_parts", lambda q: q["_part"] < p["_part"]), F.lit(0).cast("long"),
                    lambda n, q: n + q["_n"]).alias("_before")))).alias("s")).select("cob_date", "s.*")
    return (places.join(starts, ["cob_date", "_part"])
            .withColumn("rank", (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int"))
            .drop("_id", "_part", "_first", "_before"))


def who_matters(exposure_index: DataFrame, cob_date=None, threshold: float | None = None,
                top_n: int = PORTFOLIO_DEFAULT_TOP) -> DataFrame:
    """Q13: the ranking report with exposure printed as ``{:,.0f}``."""
    p = portfolio(exposure_index, cob_date, threshold, top_n)
    return p.withColumn("exposure", F.format_number("exposure_total", 0)).drop("exposure_total")


def index_staleness(snapshots: DataFrame, exposure_index: DataFrame) -> DataFrame:
    """Q14 (intent form): per date, snapshots the index does not cover yet.

    ``stale`` is true when a stored snapshot has no index row, or when the
    newest snapshot is newer than the newest index entry of the date.
    """
    s = snapshots.groupBy("cob_date").agg(F.count(F.lit(1)).cast("long").alias("n_snapshots"),
                                          F.max("ingested_at").alias("snapshots_latest"))
    missing = (snapshots.select(*KEY).join(exposure_index.select(*KEY), KEY, "left_anti")
               .groupBy("cob_date").agg(F.count(F.lit(1)).cast("long").alias("n_unindexed")))
    i = exposure_index.groupBy("cob_date").agg(F.count(F.lit(1)).cast("long").alias("n_indexed"),
                                               F.max("ingested_at").alias("index_latest"))
    j = s.join(i, "cob_date", "full").join(missing, "cob_date", "left")
    return j.select(
        "cob_date",
        F.coalesce("n_snapshots", F.lit(0).cast("long")).alias("n_snapshots"),
        F.coalesce("n_indexed", F.lit(0).cast("long")).alias("n_indexed"),
        F.coalesce("n_unindexed", F.lit(0).cast("long")).alias("n_unindexed"),
        ((F.coalesce("n_unindexed", F.lit(0)) > 0)
         | F.coalesce(F.col("snapshots_latest") > F.col("index_latest"), F.lit(False)))
        .alias("stale"))


def list_cob_dates(snapshots: DataFrame, counterparty_id=None, netting_set_id=None) -> DataFrame:
    """Q15: dates per netting set, ascending."""
    s = key_filter(snapshots, counterparty_id=counterparty_id, netting_set_id=netting_set_id)
    return s.select(*KEY).distinct().orderBy(*KEY)


def list_netting_sets(snapshots: DataFrame, counterparty_id=None) -> DataFrame:
    """Q16."""
    s = key_filter(snapshots, counterparty_id=counterparty_id)
    return s.select("counterparty_id", "netting_set_id").distinct() \
            .orderBy("counterparty_id", "netting_set_id")


def list_counterparties(snapshots: DataFrame) -> DataFrame:
    """Q17."""
    return snapshots.select("counterparty_id").distinct().orderBy("counterparty_id")


def product_notional(trades: DataFrame, product_type=None) -> DataFrame:
    """Q18: notional per (date, product type), summed as the doubles that are stored."""
    t = key_filter(trades, product_type=product_type)
    return (t.groupBy("cob_date", "product_type")
            .agg(F.sum("notional").alias("total_notional"),
                 F.count(F.lit(1)).cast("long").alias("n_trades")))


def trade_notional_series(trades: DataFrame, trade_id=None) -> DataFrame:
    """Q19: per trade and date, the notional of its first holder (cp, ns order)."""
    t = key_filter(trades, trade_id=trade_id)
    return (t.groupBy("trade_id", "cob_date")
            .agg(F.min_by("notional", F.struct("counterparty_id", "netting_set_id"))
                 .alias("notional")))
