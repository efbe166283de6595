"""Registered queries: one Spark plan per operator of the survey, each with
the DuckDB SQL that must give the same rows (where SQL can express it).

Every query reads whole driver tables (or data Spark derives from them);
parameters are only those that define the operator (a date range, a
threshold, a top-n), never row subsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobframe.operators import assemble as A
from cobframe.operators import diff as D
from cobframe.operators import history as E
from cobframe.operators import ingest as I
from cobframe.operators import integrity as H
from cobframe.operators import query as Q
from cobframe.operators import store as K
from cobframe.operators import validate as V
from cobframe.plans import domain
from cobframe.plans import oracle as O
from cobframe.schema import KEY
from cobframe.session import short_lived
from cobframe.sources import testdata as td
from cobframe.sources.staging import (dedupe_first, read_staging_agreements,
                                      landing_rows, read_staging_market_data, read_staging_trades)
from cobframe.sources.stores import read_store_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

KEYS_SQL = "counterparty_id, netting_set_id, cob_date"
PAIR_SQL = "counterparty_id, netting_set_id, from_date, to_date"


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# =========================================================== sources S1-S4

@register("staging_agreements", """
WITH """ + O.agreements_raw(clean=False) + """
SELECT counterparty_id, netting_set_id, cob_date, agreement_id,
       coalesce(threshold_raw, 0.0) AS threshold_amount, minimum_transfer_amount,
       independent_amount, currency_raw AS currency,
       array_to_string(eligible_collateral, ',') AS eligible_collateral,
       rounding_amount, valuation_agent, extra, arrival_seq
FROM ag_raw""")
def q_staging_agreements(spark, sf):
    df = read_staging_agreements(td.staging_agreements(spark, sf, clean_ids=False))
    return df.select("counterparty_id", "netting_set_id", "cob_date", "agreement_id",
                     "threshold_amount", "minimum_transfer_amount", "independent_amount",
                     "currency", F.array_join("eligible_collateral", ",").alias("eligible_collateral"),
                     "rounding_amount", "valuation_agent", "extra", "arrival_seq")


@register("staging_trades", """
WITH """ + O.trades_raw(clean=False) + """
SELECT counterparty_id, netting_set_id, cob_date, trade_id, product_type, notional, currency,
       direction, maturity_date, extra
FROM tr_raw""")
def q_staging_trades(spark, sf):
    df = read_staging_trades(td.staging_trades(spark, sf, clean_ids=False))
    return df.select(*KEY, "trade_id", "product_type", "notional", "currency", "direction",
                     "maturity_date", "extra")


@register("staging_market_data", "WITH " + O.market() + "\nSELECT cob_date, data_type, key, value FROM md")
def q_staging_market_data(spark, sf):
    return read_staging_market_data(td.staging_market_data(spark, sf)).select(
        "cob_date", "data_type", "key", "value")


@register("landing_dedupe", """
WITH """ + O.trades_raw(clean=False) + """
SELECT counterparty_id, netting_set_id, cob_date, trade_id, product_type, notional, currency,
       direction, maturity_date
FROM tr_first""")
def q_landing_dedupe(spark, sf):
    raw = read_staging_trades(td.staging_trades(spark, sf, clean_ids=False))
    first = dedupe_first(raw, KEY + ["trade_id"], ["arrival"])
    return first.select(*KEY, "trade_id", "product_type", "notional", "currency", "direction",
                        "maturity_date")


# Trade rows as text, some spoilt by a rule over their own columns: a notional
# that is no number, a date in another order, an absent id.
@register("landing_rejects", "WITH " + O.trades_raw(clean=False) + """,
texts AS (
  SELECT counterparty_id, netting_set_id,
         CASE WHEN l_linenumber = 3 AND l_partkey % 17 = 0 THEN strftime(cob_date, '%d/%m/%Y')
              ELSE CAST(cob_date AS VARCHAR) END AS cob_date,
         CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE trade_id END AS trade_id,
         CASE l_partkey % 13 WHEN 0 THEN '1.000.000' WHEN 1 THEN '1e6x' WHEN 2 THEN 'n/a' WHEN 3 THEN ''
              WHEN 4 THEN '4e-11' ELSE CAST(l_quantity AS VARCHAR) END AS notional
  FROM tr_raw),
marked AS (
  SELECT *, CASE WHEN trade_id IS NULL THEN 'MISSING_FIELD|trade_id'
                 WHEN cob_date LIKE '%/%' THEN 'UNPARSEABLE|cob_date=' || cob_date
                 WHEN notional IN ('1.000.000', '1e6x', 'n/a') THEN 'UNPARSEABLE|notional=' || notional END AS p
  FROM texts)
SELECT counterparty_id, netting_set_id, cob_date, coalesce(split_part(p, '|', 1), 'OK') AS status,
       split_part(p, '|', 2) AS detail, CAST(count(*) AS BIGINT) AS n_rows,
       round(sum(CASE WHEN p IS NULL THEN CAST(nullif(notional, '') AS DOUBLE) END), 6) AS total_notional
FROM marked GROUP BY ALL""")
def q_landing_rejects(spark, sf):
    raw = td.landing_trade_texts(spark, sf)
    typed = F.col("reject_reason").isNull()
    # typed rows and rejects from one reading of the texts
    rows = landing_rows(raw, "staging_trades").select(
        *[F.when(typed, F.col(c).cast("string")).otherwise(F.col("_key")[c]).alias(c) for c in KEY],
        F.coalesce("reject_reason", F.lit("OK")).alias("status"), "detail", F.when(typed, F.col("notional")).alias("notional"))
    return (rows.groupBy("counterparty_id", "netting_set_id", "cob_date", "status", "detail")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("notional"), 6).alias("total_notional")))


# =========================================================== assembly A1-A8

@register("assemble_snapshots", O.store(with_market=True) + """,
tstats AS (SELECT counterparty_id, netting_set_id, cob_date, count(*) AS n,
                  sum(notional) AS s FROM tr GROUP BY ALL),
mstats AS (SELECT cob_date, count(*) FILTER (WHERE data_type = 'fx_rate') AS n_fx,
                  count(*) FILTER (WHERE data_type = 'inflation_rate') AS n_inf FROM md GROUP BY ALL),
rstats AS (SELECT counterparty_id, netting_set_id, cob_date, count(*) AS n_mx FROM refs GROUP BY ALL)
SELECT s.counterparty_id, s.netting_set_id, s.cob_date, s.agreement_id, s.currency,
       s.threshold_amount, array_to_string(s.eligible_collateral, ',') AS eligible_collateral,
       s.extra, s.exposure_total,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_trades,
       round(coalesce(t.s, 0.0), 6) AS total_notional,
       CAST(coalesce(m.n_fx, 0) AS BIGINT) AS n_fx_rates,
       CAST(coalesce(m.n_inf, 0) AS BIGINT) AS n_inflation_rates,
       CAST(coalesce(r.n_mx, 0) AS BIGINT) AS n_matrices
FROM snap s LEFT JOIN tstats t USING (counterparty_id, netting_set_id, cob_date)
LEFT JOIN mstats m USING (cob_date)
LEFT JOIN rstats r USING (counterparty_id, netting_set_id, cob_date)""")
def q_assemble_snapshots(spark, sf):
    st = domain.order_store(spark, sf)
    stats = (st["trades"].groupBy(*KEY)
             .agg(F.count(F.lit(1)).alias("n"),
                  F.sum("notional").alias("s")))
    h = st.full_snapshots().join(stats, KEY, "left")
    return h.select(*KEY, "agreement.agreement_id", "agreement.currency",
                    "agreement.threshold_amount",
                    F.array_join("agreement.eligible_collateral", ",").alias("eligible_collateral"),
                    "agreement.extra", "exposure_total",
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_trades"),
                    # sums of doubles differ in the last digits by their order
                    F.round(F.coalesce("s", F.lit(0.0)), 6).alias("total_notional"),
                    F.size("market_data.fx_rates").cast("long").alias("n_fx_rates"),
                    F.size("market_data.inflation_rates").cast("long").alias("n_inflation_rates"),
                    F.size("market_data.price_matrices").cast("long").alias("n_matrices"))


@register("pivot_market_data", "WITH " + O.market() + """
SELECT cob_date, data_type, key, value FROM md WHERE data_type IN ('fx_rate', 'inflation_rate')""")
def q_pivot_market_data(spark, sf):
    md = read_staging_market_data(td.staging_market_data(spark, sf))
    p = A.pivot_market_data(md)
    fx = p.select("cob_date", F.lit("fx_rate").alias("data_type"),
                  F.explode("fx_rates").alias("key", "value"))
    inf = p.select("cob_date", F.lit("inflation_rate").alias("data_type"),
                   F.explode("inflation_rates").alias("key", "value"))
    return fx.unionByName(inf)


@register("unknown_market_types", "WITH " + O.market() + """
SELECT cob_date, data_type, CAST(count(*) AS BIGINT) AS n_rows FROM md
WHERE data_type NOT IN ('fx_rate', 'inflation_rate') GROUP BY ALL""")
def q_unknown_market_types(spark, sf):
    return A.unknown_market_types(read_staging_market_data(td.staging_market_data(spark, sf)))


@register("matrix_key_parse", "WITH " + O.agreements_raw() + ",\n" + O.agreements_good() + ",\n"
          + O.matrices() + """
,
keys AS (
  SELECT path, CAST(cob_date AS VARCHAR) AS d, counterparty_id, netting_set_id, instrument, true AS parsed FROM mx
  UNION ALL  -- too few parts
  SELECT 'matrices/' || CAST(cob_date AS VARCHAR) || '/' || instrument || '.npy', NULL, NULL, NULL, NULL, false FROM mx
  UNION ALL  -- a folder more, and no date
  SELECT 'matrices/undated/' || counterparty_id || '/' || netting_set_id || '/v2/' || instrument || '.a.npy',
         NULL, counterparty_id, netting_set_id, 'v2.' || instrument || '.a', true FROM mx)
SELECT path, CAST(d AS DATE) AS cob_date, counterparty_id, netting_set_id, instrument, parsed FROM keys""")
def q_matrix_key_parse(spark, sf):
    """Keys of the files, and two malformed spellings of each."""
    files = td.matrix_objects(spark, sf).select("path")
    p = F.split("path", "/")
    name, whole = p[4], F.substring_index(p[4], ".", 1)
    files = files.select(F.explode(F.array(
        F.col("path"), F.concat_ws("/", p[0], p[1], name),
        F.concat_ws("/", p[0], F.lit("undated"), p[2], p[3], F.lit("v2"), F.concat(whole, F.lit(".a.npy"))))).alias("path"))
    return A.parse_matrix_key(files).select("path", "cob_date", "counterparty_id",
                                            "netting_set_id", "instrument", "parsed")


# =========================================================== integrity H1-H7

@register("matrix_inventory", "WITH " + O.agreements_raw() + ",\n" + O.agreements_good() + ",\n"
          + O.matrices() + "\nSELECT path, length, actual_hash FROM mx WHERE arrived")
def q_matrix_inventory(spark, sf):
    return H.hash_matrices(domain.staged(spark, sf)["files"])


@register("matrix_verify", "WITH " + O.agreements_raw() + ",\n" + O.agreements_good() + ",\n"
          + O.matrices() + """
SELECT path, expected_hash, CASE WHEN arrived THEN actual_hash END AS actual_hash, status FROM mxv""")
def q_matrix_verify(spark, sf):
    s = domain.staged(spark, sf)
    v = H.verify_matrices(H.hash_matrices(s["files"]), s["manifest"])
    return v.select("path", "expected_hash", "actual_hash", "status")


@register("matrix_ref_audit", O.store(with_trades=False) + """
SELECT r.counterparty_id, r.netting_set_id, r.cob_date, r.instrument, r.path,
       CASE WHEN m.actual_hash IS NULL THEN 'MISSING'
            WHEN m.actual_hash <> r.hash THEN 'MISMATCH' ELSE 'OK' END AS status
FROM refs r JOIN snap s USING (counterparty_id, netting_set_id, cob_date)
LEFT JOIN (SELECT DISTINCT path, actual_hash FROM mx) m USING (path)""")
def q_matrix_ref_audit(spark, sf):
    st = domain.order_store(spark, sf)
    files = H.hash_matrices(td.matrix_objects(spark, sf))
    return H.audit_matrix_refs(st["snapshots"], files).select(
        *KEY, "instrument", "path", "status")


def _hash_doc_sql() -> str:
    """Canonical v1 document text, built in SQL (values here have <= 10 decimals)."""
    return """,
fxm AS (SELECT cob_date, '{' || string_agg('"' || key || '":' || CAST(value AS VARCHAR), ',' ORDER BY key)
               || '}' AS j FROM md WHERE data_type = 'fx_rate' GROUP BY cob_date),
infm AS (SELECT cob_date, '{' || string_agg('"' || key || '":' || CAST(value AS VARCHAR), ',' ORDER BY key)
                || '}' AS j FROM md WHERE data_type = 'inflation_rate' GROUP BY cob_date),
pmm AS (SELECT counterparty_id, netting_set_id, cob_date,
               '{' || string_agg('"' || instrument || '":{"hash":"' || hash || '","path":"' || path
                                 || '"}', ',' ORDER BY instrument) || '}' AS j
        FROM refs GROUP BY ALL),
trj AS (SELECT counterparty_id, netting_set_id, cob_date,
               string_agg('{"currency":"' || currency || '","direction":"' || direction
                          || '","extra":' || extra || ',"maturity_date":'
                          || coalesce('"' || CAST(maturity_date AS VARCHAR) || '"', 'null')
                          || ',"notional":' || CAST(notional AS VARCHAR)
                          || ',"product_type":"' || product_type || '","trade_id":"' || trade_id
                          || '"}', ',' ORDER BY trade_id) AS j
        FROM tr GROUP BY ALL),
docs AS (
  SELECT s.counterparty_id, s.netting_set_id, s.cob_date,
         '{"agreement":{"agreement_id":"' || s.agreement_id || '","currency":"' || s.currency
         || '","eligible_collateral":' || CAST(to_json(s.eligible_collateral) AS VARCHAR)
         || ',"extra":' || s.extra
         || ',"independent_amount":' || CAST(s.independent_amount AS VARCHAR)
         || ',"minimum_transfer_amount":' || CAST(s.minimum_transfer_amount AS VARCHAR)
         || ',"rounding_amount":' || CAST(s.rounding_amount AS VARCHAR)
         || ',"threshold_amount":' || CAST(s.threshold_amount AS VARCHAR)
         || ',"valuation_agent":' || coalesce('"' || s.valuation_agent || '"', 'null')
         || '},"cob_date":"' || CAST(s.cob_date AS VARCHAR) || '","counterparty_id":"'
         || s.counterparty_id || '","market_data":{"fx_rates":' || coalesce(f.j, '{}')
         || ',"inflation_rates":' || coalesce(i.j, '{}') || ',"price_matrices":'
         || coalesce(p.j, '{}') || '},"netting_set_id":"' || s.netting_set_id
         || '","trades":[' || coalesce(t.j, '') || ']}' AS doc
  FROM snap s LEFT JOIN fxm f USING (cob_date) LEFT JOIN infm i USING (cob_date)
  LEFT JOIN pmm p USING (counterparty_id, netting_set_id, cob_date)
  LEFT JOIN trj t USING (counterparty_id, netting_set_id, cob_date))"""


@register("snapshot_hash", O.store(with_market=True).rstrip() + _hash_doc_sql() + """
SELECT counterparty_id, netting_set_id, cob_date, 'sha256-v1:' || sha256(doc) AS data_hash FROM docs""")
def q_snapshot_hash(spark, sf):
    """H2 over the stored long-form tables (the stored hash column is not read)."""
    st = domain.order_store(spark, sf)
    with short_lived(spark):
        return H.snapshot_hashes(st["snapshots"].drop("data_hash"), st["trades"], sets=st["market_sets"],
                                 slices=domain.slices_of(spark, sf))


def _tampered(snapshots: DataFrame) -> DataFrame:
    """Stored snapshots whose rounding amounts were altered after hashing
    (by less than the diff epsilon)."""
    noise = td.tamper_rounding(F.col("exposure_total")).cast("decimal(38,10)").cast("double")
    return snapshots.withColumn("agreement",
                                F.col("agreement").withField("rounding_amount", noise))


@register("integrity_audit", None)
def q_integrity_audit(spark, sf):
    """H3 over the store after a tampering: every stored hash is recomputed
    from the altered rows and must flag exactly those rows."""
    st = domain.order_store(spark, sf)
    with short_lived(spark):
        audit = H.audit_integrity(_tampered(st["snapshots"]), st["trades"], st["market_sets"], domain.slices_of(spark, sf))
    return audit.select(*KEY, "stored_hash", "computed_hash", "status")


ORACLE["integrity_audit"] = (
    "WITH clean_docs AS (" + O.store(with_market=True).rstrip() + _hash_doc_sql()
    + "\nSELECT counterparty_id, netting_set_id, cob_date, 'sha256-v1:' || sha256(doc) AS h FROM docs),\n"
    + "noisy_docs AS (" + O.store(noise=True, with_market=True).rstrip() + _hash_doc_sql().replace(
        "CAST(s.rounding_amount AS VARCHAR)",
        "CASE WHEN s.rounding_amount = 0 THEN '0.0' ELSE CAST(CAST(round(s.rounding_amount * 1e10) AS BIGINT) AS VARCHAR) || 'e-10' END")
    + "\nSELECT counterparty_id, netting_set_id, cob_date, 'sha256-v1:' || sha256(doc) AS h FROM docs)\n"
    + """SELECT c.counterparty_id, c.netting_set_id, c.cob_date, c.h AS stored_hash, n.h AS computed_hash,
       CASE WHEN c.h = n.h THEN 'OK' ELSE 'MISMATCH' END AS status
FROM clean_docs c JOIN noisy_docs n USING (counterparty_id, netting_set_id, cob_date)""")


# =========================================================== validation V1-V4

@register("validate_ids", "WITH " + O.agreements_raw(clean=False) + """
SELECT counterparty_id, netting_set_id, cob_date, 'INVALID_ID' AS reject_reason,
       counterparty_id || '/' || netting_set_id AS detail
FROM ag_raw
WHERE NOT (regexp_full_match(counterparty_id, '""" + O.ID_RE + """')
           AND regexp_full_match(netting_set_id, '""" + O.ID_RE + """'))""")
def q_validate_ids(spark, sf):
    ag = read_staging_agreements(td.staging_agreements(spark, sf, clean_ids=False))
    return V.validate_ids(ag).rejects


@register("reject_duplicates", "WITH " + O.agreements_raw() + """
SELECT counterparty_id, netting_set_id, cob_date, arrival_seq FROM ag_raw
QUALIFY row_number() OVER (PARTITION BY counterparty_id, netting_set_id, cob_date
                           ORDER BY arrival_seq) > 1""")
def q_reject_duplicates(spark, sf):
    ag = read_staging_agreements(td.staging_agreements(spark, sf))
    checked = V.reject_duplicates(ag, ["arrival_seq"])
    # rejected copies with their arrival, from the same rule as the job
    first = checked.good.select(*KEY, F.col("arrival_seq").alias("_first"))
    return ag.join(first, KEY).where(F.col("arrival_seq") != F.col("_first")).select(
        *KEY, "arrival_seq")


@register("stored_duplicates", "WITH " + O.agreements_raw(clean=True) + ",\n" + O.agreements_good() + ",\n"
          + O.matrices() + ",\n" + O.snapshots_cte() + """,
v AS (SELECT a.*, s.counterparty_id IS NOT NULL AS stored,
             row_number() OVER (PARTITION BY a.counterparty_id, a.netting_set_id, a.cob_date
                                ORDER BY a.arrival_seq) AS copy
      FROM ag_valid a LEFT JOIN snap s USING (counterparty_id, netting_set_id, cob_date))
SELECT counterparty_id, netting_set_id, cob_date, 'DUPLICATE' AS reject_reason,
       CASE WHEN stored THEN 'already stored' ELSE 'later copy in batch' END AS detail
FROM v WHERE stored OR copy > 1""")
def q_stored_duplicates(spark, sf):
    """V3 of a second load of everything against the store the first one wrote."""
    good = V.validate_ids(domain.staged(spark, sf)["agreements"]).good
    stored = domain.order_store(spark, sf)["snapshots"]
    return V.reject_duplicates(good, domain.AGREEMENT_ARRIVAL, stored).rejects


@register("validate_finite", O.store() + """
, bad AS (SELECT DISTINCT counterparty_id, netting_set_id, cob_date FROM tr
          WHERE CAST(floor(notional) AS BIGINT) % 53 IN (0, 1)
          UNION SELECT counterparty_id, netting_set_id, cob_date FROM snap
          WHERE CAST(floor(exposure_total) AS BIGINT) % 31 = 0)
SELECT s.counterparty_id, s.netting_set_id, s.cob_date, b.counterparty_id IS NULL AS finite
FROM snap s LEFT JOIN bad b USING (counterparty_id, netting_set_id, cob_date)""")
def q_validate_finite(spark, sf):
    """The store with values made NaN, infinite or overflowing by a rule over its own amounts."""
    st = domain.order_store(spark, sf)
    whole = F.floor("notional") % 53
    trades = st["trades"].withColumn("notional", F.when(whole == 0, F.lit(float("nan")))
                                     .when(whole == 1, F.lit(float("-inf"))).otherwise(F.col("notional")))
    terms = F.col("agreement").withField("threshold_amount", F.when(
        F.floor("exposure_total") % 31 == 0, F.lit(float("inf"))).otherwise(F.col("agreement.threshold_amount")))
    snaps = st.full_snapshots().withColumn("agreement", terms)
    bad = V.validate_finite(snaps, trades).rejects.select(*KEY, F.lit(False).alias("_bad"))
    return (snaps.select(*KEY).join(bad, KEY, "left")
            .select(*KEY, F.coalesce("_bad", F.lit(True)).alias("finite")))


@register("validate_matrix_refs", "WITH " + O.agreements_raw() + ",\n" + O.agreements_good() + ",\n"
          + O.matrices() + """
SELECT a.counterparty_id, a.netting_set_id, a.cob_date, 'MISSING_MATRIX' AS reject_reason,
       min(m.path) AS detail
FROM ag a JOIN mxv m USING (counterparty_id, netting_set_id, cob_date)
WHERE m.status <> 'OK' GROUP BY ALL""")
def q_validate_matrix_refs(spark, sf):
    """Snapshots referencing every listed matrix, checked against the files
    that passed verification."""
    s = domain.staged(spark, sf)
    ids = V.validate_ids(s["agreements"])
    good = V.reject_duplicates(ids.good, domain.AGREEMENT_ARRIVAL).good
    hashed = H.hash_matrices(s["files"])
    verified = H.verify_matrices(hashed, s["manifest"])
    all_refs = (A.parse_matrix_key(verified).where("parsed")
                .select(*KEY, "instrument", "path", F.col("expected_hash").alias("hash")))
    asm = A.assemble_snapshots(good, market=None, matrix_refs=all_refs)
    inventory = verified.where(F.col("status") == "OK").select("path")
    return V.validate_matrix_refs(asm.headers, inventory).rejects


@register("null_numeric_counts", "WITH " + O.agreements_raw(clean=False) + """
SELECT cob_date, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE threshold_raw IS NULL) AS BIGINT) AS null_threshold_amount,
       CAST(count(*) FILTER (WHERE arrival_seq % 7 = 0) AS BIGINT) AS null_minimum_transfer_amount,
       CAST(count(*) FILTER (WHERE arrival_seq % 11 = 0) AS BIGINT) AS null_independent_amount,
       CAST(count(*) FILTER (WHERE arrival_seq % 13 = 0) AS BIGINT) AS null_rounding_amount
FROM ag_raw GROUP BY cob_date""")
def q_null_numeric_counts(spark, sf):
    """Staged rows with further amounts made NULL by a rule over the load order."""
    ag = td.staging_agreements(spark, sf, clean_ids=False)
    for every, c in ((7, "minimum_transfer_amount"), (11, "independent_amount"), (13, "rounding_amount")):
        ag = ag.withColumn(c, F.when(F.col("arrival_seq") % every != 0, F.col(c)))
    return V.null_numeric_counts(ag)


def _raw_ingest(spark, sf):
    return domain.raw_ingest(spark, sf)


@register("rejects_by_reason", "WITH " + O.agreements_raw(clean=False) + """,
v AS (SELECT *, regexp_full_match(counterparty_id, '""" + O.ID_RE + """')
                AND regexp_full_match(netting_set_id, '""" + O.ID_RE + """') AS ok FROM ag_raw),
r AS (SELECT cob_date, 'INVALID_ID' AS reject_reason FROM v WHERE NOT ok
      UNION ALL
      SELECT cob_date, 'DUPLICATE' FROM v WHERE ok
      QUALIFY row_number() OVER (PARTITION BY counterparty_id, netting_set_id, cob_date
                                 ORDER BY arrival_seq) > 1)
SELECT cob_date, reject_reason, CAST(count(*) AS BIGINT) AS n_rejects FROM r GROUP BY ALL""")
def q_rejects_by_reason(spark, sf):
    return V.rejects_by_reason(_raw_ingest(spark, sf).rejects)


# =========================================================== indexes K2, K3, Q14

@register("exposure_index", O.store(with_trades=False) + """
SELECT counterparty_id, netting_set_id, cob_date, exposure_total,
       'snapshots/' || counterparty_id || '/' || netting_set_id || '/' || CAST(cob_date AS VARCHAR)
         AS snapshot_path
FROM snap""")
def q_exposure_index(spark, sf):
    return domain.order_store(spark, sf)["exposure_index"].select(
        *KEY, "exposure_total", "snapshot_path")


@register("trade_index", O.store() + "SELECT DISTINCT trade_id, " + KEYS_SQL + " FROM tr")
def q_trade_index(spark, sf):
    return domain.order_store(spark, sf)["trade_index"].select("trade_id", *KEY)


@register("rebuilt_indexes", O.store() + """
SELECT s.counterparty_id, s.netting_set_id, s.cob_date, s.exposure_total,
       CAST(count(DISTINCT t.trade_id) AS BIGINT) AS n_trade_ids
FROM snap s LEFT JOIN tr t USING (counterparty_id, netting_set_id, cob_date)
GROUP BY ALL""")
def q_rebuilt_indexes(spark, sf):
    """K4: both indexes regenerated in a store that has lost them."""
    root = domain.store_without_indexes(spark, sf)
    K.rebuild_indexes(spark, root)
    ids = read_store_table(spark, root, "trade_index").groupBy(*KEY).agg(F.count_distinct("trade_id").alias("n"))
    return read_store_table(spark, root, "exposure_index").join(ids, KEY, "left").select(
        *KEY, "exposure_total", F.coalesce("n", F.lit(0)).cast("long").alias("n_trade_ids"))


@register("index_staleness", "WITH " + O.feed() + """,
idx AS (SELECT * FROM feed WHERE ingested_at <= CAST(cob_date AS TIMESTAMP) + INTERVAL 23 HOUR),
s AS (SELECT cob_date, count(*) AS n_snapshots, max(ingested_at) AS sl FROM feed GROUP BY ALL),
i AS (SELECT cob_date, count(*) AS n_indexed, max(ingested_at) AS il FROM idx GROUP BY ALL),
m AS (SELECT cob_date, count(*) AS n_unindexed FROM feed f
      WHERE NOT EXISTS (SELECT 1 FROM idx x WHERE x.counterparty_id = f.counterparty_id
                        AND x.netting_set_id = f.netting_set_id AND x.cob_date = f.cob_date)
      GROUP BY ALL)
SELECT coalesce(s.cob_date, i.cob_date) AS cob_date,
       CAST(coalesce(n_snapshots, 0) AS BIGINT) AS n_snapshots,
       CAST(coalesce(n_indexed, 0) AS BIGINT) AS n_indexed,
       CAST(coalesce(n_unindexed, 0) AS BIGINT) AS n_unindexed,
       coalesce(n_unindexed, 0) > 0 OR coalesce(sl > il, false) AS stale
FROM s FULL JOIN i ON s.cob_date = i.cob_date LEFT JOIN m ON m.cob_date = coalesce(s.cob_date, i.cob_date)""")
def q_index_staleness(spark, sf):
    feed = td.exposure_feed(spark, sf)
    idx = K.build_exposure_index(domain.indexed_by_cutoff(feed, 23))
    return Q.index_staleness(feed, idx)


# =========================================================== ingest A9-A13

@register("completeness_check", O.store(with_trades=False) + """
SELECT counterparty_id, netting_set_id, cob_date, n_expected, n_missing,
       CASE WHEN n_missing > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status
FROM completeness""")
def q_completeness_check(spark, sf):
    return domain.completeness(spark, sf)


def _raw_outcomes_sql() -> str:
    return ("WITH " + O.agreements_raw(clean=False) + ",\n" + O.agreements_good() + ",\n"
            + O.matrices(clean=False) + """,
v AS (SELECT *, regexp_full_match(counterparty_id, '""" + O.ID_RE + """')
                AND regexp_full_match(netting_set_id, '""" + O.ID_RE + """') AS ok FROM ag_raw),
dups AS (SELECT cob_date FROM v WHERE ok
         QUALIFY row_number() OVER (PARTITION BY counterparty_id, netting_set_id, cob_date
                                    ORDER BY arrival_seq) > 1),
o AS (
  SELECT cob_date, 'posted' AS outcome FROM completeness WHERE n_missing = 0
  UNION ALL SELECT cob_date, 'incomplete' FROM completeness WHERE n_missing > 0
  UNION ALL SELECT cob_date, 'skipped' FROM dups
  UNION ALL SELECT cob_date, 'errors' FROM v WHERE NOT ok
  UNION ALL SELECT cob_date, 'errors' FROM mxv WHERE status = 'MISMATCH'),
oc AS (
  SELECT cob_date,
         CAST(count(*) FILTER (WHERE outcome = 'posted') AS BIGINT) AS posted,
         CAST(count(*) FILTER (WHERE outcome = 'skipped') AS BIGINT) AS skipped,
         CAST(count(*) FILTER (WHERE outcome = 'incomplete') AS BIGINT) AS incomplete,
         CAST(count(*) FILTER (WHERE outcome = 'errors') AS BIGINT) AS errors
  FROM o GROUP BY cob_date)
""")


@register("ingest_outcomes", _raw_outcomes_sql() + "SELECT * FROM oc")
def q_ingest_outcomes(spark, sf):
    return I.ingest_outcomes(_raw_ingest(spark, sf))


BACKFILL_FROM, BACKFILL_TO = "1994-12-25", "2001-08-10"


@register("backfill_counts", _raw_outcomes_sql() + f""",
days AS (SELECT CAST(d AS DATE) AS cob_date
         FROM range(DATE '{BACKFILL_FROM}', DATE '{BACKFILL_TO}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)),
per AS (SELECT d.cob_date, CAST(coalesce(posted, 0) AS BIGINT) AS posted,
               CAST(coalesce(skipped, 0) AS BIGINT) AS skipped,
               CAST(coalesce(incomplete, 0) AS BIGINT) AS incomplete,
               CAST(coalesce(errors, 0) AS BIGINT) AS errors
        FROM days d LEFT JOIN oc USING (cob_date))
SELECT * FROM per
UNION ALL
SELECT NULL, CAST(sum(posted) AS BIGINT), CAST(sum(skipped) AS BIGINT),
       CAST(sum(incomplete) AS BIGINT), CAST(sum(errors) AS BIGINT) FROM per""")
def q_backfill_counts(spark, sf):
    return I.backfill_counts(_raw_ingest(spark, sf), BACKFILL_FROM, BACKFILL_TO)


@register("ingest_status", "WITH " + O.agreements_raw(clean=False) + ",\n" + O.agreements_good()
          + ",\n" + O.matrices(clean=False) + ",\n" + O.snapshots_cte() + """
SELECT DISTINCT r.counterparty_id, r.netting_set_id, r.cob_date, s.counterparty_id IS NOT NULL AS stored
FROM ag_raw r LEFT JOIN snap s USING (counterparty_id, netting_set_id, cob_date)""")
def q_ingest_status(spark, sf):
    staged = read_staging_agreements(td.staging_agreements(spark, sf, clean_ids=False))
    return I.ingest_status(staged, _raw_ingest(spark, sf).snapshots)


# =========================================================== lookups Q1-Q5

@register("snapshot", O.store() + """
SELECT s.counterparty_id, s.netting_set_id, s.cob_date, s.agreement_id, s.exposure_total,
       t.trade_id, t.notional
FROM snap s LEFT JOIN tr t USING (counterparty_id, netting_set_id, cob_date)""")
def q_snapshot(spark, sf):
    st = domain.order_store(spark, sf)
    rows = Q.snapshot(st["snapshots"], st["trades"])
    return rows.select(*KEY, "agreement.agreement_id", "exposure_total", "trade_id", "notional")


@register("by_counterparty", O.store(with_trades=False) + """
SELECT counterparty_id, cob_date, netting_set_id, agreement_id, exposure_total FROM snap""")
def q_by_counterparty(spark, sf):
    st = domain.order_store(spark, sf)
    return Q.by_counterparty(st["snapshots"]).select(
        "counterparty_id", "cob_date", "netting_set_id", "agreement.agreement_id", "exposure_total")


@register("trades", O.store() + """
SELECT counterparty_id, netting_set_id, cob_date, trade_id, product_type, notional, currency,
       direction, maturity_date FROM tr""")
def q_trades(spark, sf):
    return Q.trades_table(domain.order_store(spark, sf)["trades"])


BY_TRADE_FROM, BY_TRADE_TO = "1996-01-01", "1999-12-31"
_BY_TRADE_SQL = O.store() + f"""
SELECT cob_date, counterparty_id, netting_set_id, trade_id, product_type, notional, currency,
       direction, maturity_date
FROM tr WHERE cob_date BETWEEN DATE '{BY_TRADE_FROM}' AND DATE '{BY_TRADE_TO}'"""


@register("by_trade", _BY_TRADE_SQL)
def q_by_trade(spark, sf):
    st = domain.order_store(spark, sf)
    return Q.by_trade(st.read("trade_index", BY_TRADE_FROM, BY_TRADE_TO),
                      st.read("trades", BY_TRADE_FROM, BY_TRADE_TO), None, BY_TRADE_FROM,
                      BY_TRADE_TO)


@register("by_trade_scan", _BY_TRADE_SQL)
def q_by_trade_scan(spark, sf):
    st = domain.order_store(spark, sf)
    return Q.by_trade_scan(st.read("trades", BY_TRADE_FROM, BY_TRADE_TO), None, BY_TRADE_FROM,
                           BY_TRADE_TO)


# the snapshots of a wanted set of keys: each counterparty's first stored date
@register("snapshot_lookup", O.store() + """,
wanted AS (SELECT counterparty_id, netting_set_id, cob_date FROM snap
           QUALIFY cob_date = min(cob_date) OVER (PARTITION BY counterparty_id))
SELECT s.counterparty_id, s.netting_set_id, s.cob_date, s.agreement_id, t.trade_id, t.notional
FROM snap s JOIN wanted USING (counterparty_id, netting_set_id, cob_date)
LEFT JOIN tr t USING (counterparty_id, netting_set_id, cob_date)""")
def q_snapshot_lookup(spark, sf):
    st = domain.order_store(spark, sf)
    first = st["exposure_index"].groupBy("counterparty_id").agg(F.min("cob_date").alias("cob_date"))
    wanted = st["exposure_index"].select(*KEY).join(first, ["counterparty_id", "cob_date"])
    return Q.snapshot(st["snapshots"], st["trades"], wanted=wanted).select(
        *KEY, "agreement.agreement_id", "trade_id", "notional")


# the ids that were traded on the first stored date, wherever they occur
@register("by_trade_ids", O.store() + """
SELECT cob_date, counterparty_id, netting_set_id, trade_id, product_type, notional, currency,
       direction, maturity_date
FROM tr WHERE trade_id IN (SELECT trade_id FROM tr WHERE cob_date = (SELECT min(cob_date) FROM tr))""")
def q_by_trade_ids(spark, sf):
    st = domain.order_store(spark, sf)
    start = st["trade_index"].agg(F.min("cob_date").alias("cob_date"))
    ids = st["trade_index"].join(start, "cob_date").select("trade_id").distinct()
    return Q.by_trade(st["trade_index"], st["trades"], ids)


@register("by_trade_all", O.store() + """
SELECT cob_date, counterparty_id, netting_set_id, trade_id, product_type, notional, currency,
       direction, maturity_date FROM tr""")
def q_by_trade_all(spark, sf):
    st = domain.order_store(spark, sf)
    return Q.by_trade(st["trade_index"], st["trades"])


# =========================================================== market data Q6-Q9

def _first_market_sql(data_type: str, key_name: str, only: str | None = None) -> str:
    cond = f" AND m.key = '{only}'" if only else ""
    if only:
        return O.store(with_trades=False, with_market=True) + f"""
SELECT d.cob_date, '{only}' AS {key_name}, m.value AS rate
FROM (SELECT DISTINCT cob_date FROM snap) d
LEFT JOIN md m ON m.cob_date = d.cob_date AND m.data_type = '{data_type}'{cond}"""
    return O.store(with_trades=False, with_market=True) + f"""
SELECT m.cob_date, m.key AS {key_name}, m.value AS rate
FROM md m WHERE m.data_type = '{data_type}' AND m.cob_date IN (SELECT cob_date FROM snap)"""


@register("fx_rates", _first_market_sql("fx_rate", "pair"))
def q_fx_rates(spark, sf):
    st = domain.order_store(spark, sf)
    return Q.fx_rates(st["snapshots"], sets=st["market_sets"])


@register("fx_rate_pair", _first_market_sql("fx_rate", "pair", "F1"))
def q_fx_rate_pair(spark, sf):
    st = domain.order_store(spark, sf)
    return Q.fx_rate_pair(st["snapshots"], "F1", sets=st["market_sets"])


@register("inflation_rates", _first_market_sql("inflation_rate", "index_name"))
def q_inflation_rates(spark, sf):
    st = domain.order_store(spark, sf)
    return Q.inflation_rates(st["snapshots"], sets=st["market_sets"])


@register("inflation_rate_index", _first_market_sql("inflation_rate", "index_name", "O3"))
def q_inflation_rate_index(spark, sf):
    st = domain.order_store(spark, sf)
    return Q.inflation_rate_index(st["snapshots"], "O3", sets=st["market_sets"])


@register("market_consistency", O.store(with_trades=False, with_market=True) + """
, sets AS (SELECT s.cob_date, CAST(floor(s.exposure_total) AS BIGINT) % 5 = 0 AS no_fx,
                  CAST(floor(s.exposure_total) AS BIGINT) % 7 = 0 AS other_inf,
                  EXISTS (SELECT 1 FROM md WHERE md.cob_date = s.cob_date AND data_type = 'fx_rate') AS has_fx
           FROM snap s)
SELECT cob_date, CAST(count(*) AS BIGINT) AS n_snapshots,
       CAST(count(DISTINCT no_fx OR NOT has_fx) AS BIGINT) AS n_fx_sets,
       CAST(count(DISTINCT other_inf) AS BIGINT) AS n_inflation_sets
FROM sets GROUP BY cob_date""")
def q_market_consistency(spark, sf):
    """The store with some snapshots' rates altered by a rule over their exposure."""
    whole = F.floor("exposure_total")
    md = F.col("market_data")
    md = md.withField("fx_rates", F.when(whole % 5 == 0, F.create_map().cast("map<string,double>"))
                      .otherwise(F.col("market_data.fx_rates")))
    md = md.withField("inflation_rates", F.when(whole % 7 == 0, F.map_concat(
        "market_data.inflation_rates", F.create_map(F.lit("ALTERED"), F.lit(1.0))))
        .otherwise(F.col("market_data.inflation_rates")))
    return Q.market_consistency(domain.order_store(spark, sf).full_snapshots().withColumn("market_data", md))


# =========================================================== exposure Q10-Q13

HIST_FROM, HIST_TO = "2024-01-05", "2024-01-25"


@register("exposure_history", "WITH " + O.feed() + f"""
SELECT counterparty_id, cob_date, netting_set_id, exposure_total FROM feed
WHERE cob_date BETWEEN DATE '{HIST_FROM}' AND DATE '{HIST_TO}'""")
def q_exposure_history(spark, sf):
    return Q.exposure_history(domain.event_index(spark, sf), from_date=HIST_FROM, to_date=HIST_TO)


@register("exposure_history_all", "WITH " + O.feed() + """
SELECT counterparty_id, cob_date, netting_set_id, exposure_total FROM feed""")
def q_exposure_history_all(spark, sf):
    return Q.exposure_history(domain.event_index(spark, sf))


def _rank_sql(source: str, where: str = "", limit: int | None = None) -> str:
    lim = f"WHERE rank <= {limit}" if limit else ""
    return f"""
SELECT cob_date, counterparty_id, netting_set_id, exposure_total, rank FROM (
  SELECT cob_date, counterparty_id, netting_set_id, exposure_total,
         CAST(row_number() OVER (PARTITION BY cob_date ORDER BY exposure_total DESC, ingested_at,
                                 counterparty_id, netting_set_id) AS INTEGER) AS rank
  FROM {source} {where}) {lim}"""


PORTFOLIO_TOP = 5
PORTFOLIO_THRESHOLD = 100.0


@register("portfolio_topn", "WITH " + O.feed() + _rank_sql("feed", limit=PORTFOLIO_TOP))
def q_portfolio_topn(spark, sf):
    return Q.portfolio(domain.event_index(spark, sf), top_n=PORTFOLIO_TOP)


@register("portfolio_threshold", "WITH " + O.feed() + _rank_sql("feed", f"WHERE exposure_total >= {PORTFOLIO_THRESHOLD}"))
def q_portfolio_threshold(spark, sf):
    return Q.portfolio(domain.event_index(spark, sf), threshold=PORTFOLIO_THRESHOLD)


@register("who_matters", O.store(with_trades=False) + """
SELECT cob_date, counterparty_id, netting_set_id, rank, format('{:,.0f}', exposure_total) AS exposure
FROM (""" + _rank_sql("snap", limit=20) + ")")
def q_who_matters(spark, sf):
    return Q.who_matters(domain.order_store(spark, sf)["exposure_index"])


# =========================================================== listings Q15-Q19

@register("list_cob_dates", O.store(with_trades=False) + "SELECT DISTINCT " + KEYS_SQL + " FROM snap")
def q_list_cob_dates(spark, sf):
    return Q.list_cob_dates(domain.order_store(spark, sf)["snapshots"])


@register("list_netting_sets", O.store(with_trades=False)
          + "SELECT DISTINCT counterparty_id, netting_set_id FROM snap")
def q_list_netting_sets(spark, sf):
    return Q.list_netting_sets(domain.order_store(spark, sf)["snapshots"])


@register("list_counterparties", O.store(with_trades=False) + "SELECT DISTINCT counterparty_id FROM snap")
def q_list_counterparties(spark, sf):
    return Q.list_counterparties(domain.order_store(spark, sf)["snapshots"])


@register("product_notional", O.store() + """
SELECT cob_date, product_type, round(sum(notional), 6) AS total_notional,
       CAST(count(*) AS BIGINT) AS n_trades
FROM tr GROUP BY ALL""")
def q_product_notional(spark, sf):
    p = Q.product_notional(domain.order_store(spark, sf)["trades"])
    return p.withColumn("total_notional", F.round("total_notional", 6))


@register("trade_notional_series", O.store() + """
SELECT trade_id, cob_date, arg_min(notional, (counterparty_id, netting_set_id)) AS notional
FROM tr GROUP BY ALL""")
def q_trade_notional_series(spark, sf):
    return Q.trade_notional_series(domain.order_store(spark, sf)["trades"])


# =========================================================== diff D0-D10

def _pairs_store(extra: tuple[str, ...] = (), noise: bool = False, market: bool = False) -> str:
    return O.store(noise=noise, with_market=market, extra=(O.pairs_cte(),) + extra)


TRADE_OUT = ["trade_id", "product_type", "notional", "currency", "maturity_date", "direction"]


@register("diff_trades_added", _pairs_store() + f"""
SELECT p.counterparty_id, p.netting_set_id, p.from_date, p.to_date, {", ".join("t." + c for c in TRADE_OUT)}
FROM pairs p JOIN tr t ON t.counterparty_id = p.counterparty_id
  AND t.netting_set_id = p.netting_set_id AND t.cob_date = p.to_date
WHERE NOT EXISTS (SELECT 1 FROM tr f WHERE f.counterparty_id = p.counterparty_id
  AND f.netting_set_id = p.netting_set_id AND f.cob_date = p.from_date AND f.trade_id = t.trade_id)""")
def q_diff_trades_added(spark, sf):
    st = domain.order_store(spark, sf)
    pairs = D.consecutive_pairs(st["snapshots"])
    return D.trades_added(pairs, st["trades"]).select(*D.PAIR, *TRADE_OUT)


@register("diff_trades_removed", _pairs_store() + f"""
SELECT p.counterparty_id, p.netting_set_id, p.from_date, p.to_date, {", ".join("f." + c for c in TRADE_OUT)}
FROM pairs p JOIN tr f ON f.counterparty_id = p.counterparty_id
  AND f.netting_set_id = p.netting_set_id AND f.cob_date = p.from_date
WHERE NOT EXISTS (SELECT 1 FROM tr t WHERE t.counterparty_id = p.counterparty_id
  AND t.netting_set_id = p.netting_set_id AND t.cob_date = p.to_date AND t.trade_id = f.trade_id)""")
def q_diff_trades_removed(spark, sf):
    st = domain.order_store(spark, sf)
    pairs = D.consecutive_pairs(st["snapshots"])
    return D.trades_removed(pairs, st["trades"]).select(*D.PAIR, *TRADE_OUT)


def _agreement_changes_sql() -> str:
    num = ["threshold_amount", "minimum_transfer_amount", "independent_amount", "rounding_amount"]
    txt = [("currency", "f.currency", "t.currency"),
           ("eligible_collateral", "CAST(to_json(f.eligible_collateral) AS VARCHAR)",
            "CAST(to_json(t.eligible_collateral) AS VARCHAR)"),
           ("valuation_agent", "f.valuation_agent", "t.valuation_agent"),
           ("extra", "f.extra", "t.extra")]
    base = """FROM pairs p
JOIN snap f ON f.counterparty_id = p.counterparty_id AND f.netting_set_id = p.netting_set_id
  AND f.cob_date = p.from_date
JOIN snap t ON t.counterparty_id = p.counterparty_id AND t.netting_set_id = p.netting_set_id
  AND t.cob_date = p.to_date"""
    parts = []
    for c in num:
        parts.append(f"""SELECT p.counterparty_id, p.netting_set_id, p.from_date, p.to_date, '{c}' AS field,
       f.{c} AS old_number, t.{c} AS new_number, CAST(NULL AS VARCHAR) AS old_text,
       CAST(NULL AS VARCHAR) AS new_text
{base} WHERE NOT (abs(f.{c} - t.{c}) < 1e-9)""")
    for name, a, b in txt:
        col = name
        parts.append(f"""SELECT p.counterparty_id, p.netting_set_id, p.from_date, p.to_date, '{name}',
       CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {a}, {b}
{base} WHERE f.{col} IS DISTINCT FROM t.{col}""")
    return "\nUNION ALL\n".join(parts)


@register("diff_agreement", _pairs_store(noise=True) + _agreement_changes_sql())
def q_diff_agreement(spark, sf):
    snaps = _tampered(domain.order_store(spark, sf)["snapshots"])
    pairs = D.consecutive_pairs(snaps)
    return D.agreement_changes(pairs, snaps)


def _rate_changes_sql(data_type: str, key_name: str) -> str:
    return f""",
rf AS (SELECT p.*, m.key, m.value FROM pairs p JOIN md m ON m.cob_date = p.from_date
       AND m.data_type = '{data_type}'),
rt AS (SELECT p.*, m.key, m.value FROM pairs p JOIN md m ON m.cob_date = p.to_date
       AND m.data_type = '{data_type}')
SELECT coalesce(a.counterparty_id, b.counterparty_id) AS counterparty_id,
       coalesce(a.netting_set_id, b.netting_set_id) AS netting_set_id,
       coalesce(a.from_date, b.from_date) AS from_date, coalesce(a.to_date, b.to_date) AS to_date,
       coalesce(a.key, b.key) AS {key_name}, a.value AS old_value, b.value AS new_value
FROM rf a FULL JOIN rt b ON a.counterparty_id = b.counterparty_id
  AND a.netting_set_id = b.netting_set_id AND a.from_date = b.from_date
  AND a.to_date = b.to_date AND a.key = b.key
WHERE a.value IS NULL OR b.value IS NULL OR NOT (abs(a.value - b.value) < 1e-9)"""


@register("diff_fx", _pairs_store(market=True).rstrip() + _rate_changes_sql("fx_rate", "pair"))
def q_diff_fx(spark, sf):
    st = domain.order_store(spark, sf)
    return D.fx_rate_changes(D.consecutive_pairs(st["snapshots"]), st["snapshots"], st["market_sets"])


@register("diff_inflation", _pairs_store(market=True).rstrip()
          + _rate_changes_sql("inflation_rate", "index_name"))
def q_diff_inflation(spark, sf):
    st = domain.order_store(spark, sf)
    return D.inflation_rate_changes(D.consecutive_pairs(st["snapshots"]), st["snapshots"], st["market_sets"])


_MATRIX_CHANGES_SQL = """,
rf AS (SELECT p.*, r.instrument, r.hash FROM pairs p JOIN refs r
       ON r.counterparty_id = p.counterparty_id AND r.netting_set_id = p.netting_set_id
       AND r.cob_date = p.from_date),
rt AS (SELECT p.*, r.instrument, r.hash FROM pairs p JOIN refs r
       ON r.counterparty_id = p.counterparty_id AND r.netting_set_id = p.netting_set_id
       AND r.cob_date = p.to_date)
SELECT coalesce(a.counterparty_id, b.counterparty_id) AS counterparty_id,
       coalesce(a.netting_set_id, b.netting_set_id) AS netting_set_id,
       coalesce(a.from_date, b.from_date) AS from_date, coalesce(a.to_date, b.to_date) AS to_date,
       coalesce(a.instrument, b.instrument) AS instrument, a.hash AS old_hash, b.hash AS new_hash
FROM rf a FULL JOIN rt b ON a.counterparty_id = b.counterparty_id
  AND a.netting_set_id = b.netting_set_id AND a.from_date = b.from_date
  AND a.to_date = b.to_date AND a.instrument = b.instrument
WHERE a.hash IS NULL OR b.hash IS NULL OR a.hash <> b.hash"""


@register("diff_matrix", _pairs_store().rstrip() + _MATRIX_CHANGES_SQL)
def q_diff_matrix(spark, sf):
    st = domain.order_store(spark, sf)
    return D.matrix_changes(D.consecutive_pairs(st["snapshots"]), st["snapshots"])


@register("diff_exposure_delta", "WITH " + O.feed() + ",\n" + O.pairs_cte("feed") + """
SELECT p.counterparty_id, p.netting_set_id, p.from_date, p.to_date,
       t.exposure_total - f.exposure_total AS exposure_delta
FROM pairs p
JOIN feed f ON f.counterparty_id = p.counterparty_id AND f.netting_set_id = p.netting_set_id
  AND f.cob_date = p.from_date
JOIN feed t ON t.counterparty_id = p.counterparty_id AND t.netting_set_id = p.netting_set_id
  AND t.cob_date = p.to_date""")
def q_diff_exposure_delta(spark, sf):
    feed = domain.event_index(spark, sf)
    return D.exposure_delta(D.consecutive_pairs(feed), feed)


def _summary_sql() -> str:
    def wrap(body: str, name: str) -> str:
        return f"{name} AS (SELECT {PAIR_SQL}, count(*) AS n FROM ({body}) GROUP BY ALL)"
    added = f"""SELECT p.* FROM pairs p JOIN tr t ON t.counterparty_id = p.counterparty_id
  AND t.netting_set_id = p.netting_set_id AND t.cob_date = p.to_date
  WHERE NOT EXISTS (SELECT 1 FROM tr f WHERE f.counterparty_id = p.counterparty_id
  AND f.netting_set_id = p.netting_set_id AND f.cob_date = p.from_date AND f.trade_id = t.trade_id)"""
    removed = f"""SELECT p.* FROM pairs p JOIN tr f ON f.counterparty_id = p.counterparty_id
  AND f.netting_set_id = p.netting_set_id AND f.cob_date = p.from_date
  WHERE NOT EXISTS (SELECT 1 FROM tr t WHERE t.counterparty_id = p.counterparty_id
  AND t.netting_set_id = p.netting_set_id AND t.cob_date = p.to_date AND t.trade_id = f.trade_id)"""
    fx_body = _rate_changes_sql("fx_rate", "pair").split("\n", 1)[1]
    inf_body = _rate_changes_sql("inflation_rate", "index_name").split("\n", 1)[1]
    mx_body = _MATRIX_CHANGES_SQL.split("\n", 1)[1]
    ctes = [wrap(added, "c_add"), wrap(removed, "c_rem"),
            wrap(_agreement_changes_sql(), "c_ag"),
            "c_fx AS (WITH " + fx_body.replace("\nSELECT coalesce", "\nSELECT " + PAIR_SQL
                                               + ", count(*) AS n FROM (SELECT coalesce", 1)
            + f") GROUP BY ALL)",
            "c_inf AS (WITH " + inf_body.replace("\nSELECT coalesce", "\nSELECT " + PAIR_SQL
                                                 + ", count(*) AS n FROM (SELECT coalesce", 1)
            + f") GROUP BY ALL)",
            "c_mx AS (WITH " + mx_body.replace("\nSELECT coalesce", "\nSELECT " + PAIR_SQL
                                               + ", count(*) AS n FROM (SELECT coalesce", 1)
            + f") GROUP BY ALL)"]
    sel = """
SELECT p.counterparty_id, p.netting_set_id, p.from_date, p.to_date,
       CAST(coalesce(a.n, 0) AS BIGINT) AS n_trades_added,
       CAST(coalesce(r.n, 0) AS BIGINT) AS n_trades_removed,
       CAST(coalesce(g.n, 0) AS BIGINT) AS n_agreement_changes,
       CAST(coalesce(x.n, 0) AS BIGINT) AS n_fx_changes,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_inflation_changes,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_matrix_changes,
       p.exposure_delta,
       coalesce(a.n, 0) + coalesce(r.n, 0) + coalesce(g.n, 0) + coalesce(x.n, 0)
         + coalesce(i.n, 0) + coalesce(m.n, 0) > 0 AS has_changes
FROM pe p
LEFT JOIN c_add a USING (counterparty_id, netting_set_id, from_date, to_date)
LEFT JOIN c_rem r USING (counterparty_id, netting_set_id, from_date, to_date)
LEFT JOIN c_ag g USING (counterparty_id, netting_set_id, from_date, to_date)
LEFT JOIN c_fx x USING (counterparty_id, netting_set_id, from_date, to_date)
LEFT JOIN c_inf i USING (counterparty_id, netting_set_id, from_date, to_date)
LEFT JOIN c_mx m USING (counterparty_id, netting_set_id, from_date, to_date)"""
    pe = """pe AS (
  SELECT p.*, t.exposure_total - f.exposure_total AS exposure_delta FROM pairs p
  JOIN snap f ON f.counterparty_id = p.counterparty_id AND f.netting_set_id = p.netting_set_id
    AND f.cob_date = p.from_date
  JOIN snap t ON t.counterparty_id = p.counterparty_id AND t.netting_set_id = p.netting_set_id
    AND t.cob_date = p.to_date)"""
    return O.store(with_market=True, extra=(O.pairs_cte(), pe) + tuple(ctes)) + sel


@register("diff_summary", _summary_sql())
def q_diff_summary(spark, sf):
    st = domain.order_store(spark, sf)
    pairs = D.consecutive_pairs(st["snapshots"])
    return D.snapshot_diff(pairs, st["snapshots"], st["trades"], st["market_sets"])


def _change_log_sql() -> str:
    """The parts of the diff as one list; amounts as text the way both engines print them."""
    def rates(kind):
        body = _rate_changes_sql(kind, "item").split("\n", 1)[1]
        return f"""SELECT {PAIR_SQL}, '{kind}' AS kind, item, CAST(old_value AS VARCHAR) AS old_value,
       CAST(new_value AS VARCHAR) AS new_value FROM (WITH {body})"""
    matrix = _MATRIX_CHANGES_SQL.split("\n", 1)[1]
    trades = "\nUNION ALL\n".join(f"""SELECT p.counterparty_id, p.netting_set_id, p.from_date, p.to_date,
       'trade_{change}' AS kind, t.trade_id AS item,
       {"NULL" if change == "added" else "CAST(t.notional AS VARCHAR)"} AS old_value,
       {"CAST(t.notional AS VARCHAR)" if change == "added" else "NULL"} AS new_value
FROM pairs p JOIN tr t ON t.counterparty_id = p.counterparty_id AND t.netting_set_id = p.netting_set_id
  AND t.cob_date = p.{mine}
WHERE NOT EXISTS (SELECT 1 FROM tr o WHERE o.counterparty_id = p.counterparty_id
  AND o.netting_set_id = p.netting_set_id AND o.cob_date = p.{other} AND o.trade_id = t.trade_id)"""
                                   for change, mine, other in (("added", "to_date", "from_date"),
                                                               ("removed", "from_date", "to_date")))
    agreement = f"""SELECT {PAIR_SQL}, 'agreement' AS kind, field AS item,
       coalesce(CAST(old_number AS VARCHAR), old_text) AS old_value,
       coalesce(CAST(new_number AS VARCHAR), new_text) AS new_value FROM ({_agreement_changes_sql()})"""
    return (_pairs_store(market=True) + trades + "\nUNION ALL\n" + agreement + "\nUNION ALL\n" + rates("fx_rate")
            + "\nUNION ALL\n" + rates("inflation_rate")
            + f"\nUNION ALL\nSELECT {PAIR_SQL}, 'matrix', instrument, old_hash, new_hash FROM (WITH {matrix})")


@register("change_log", _change_log_sql())
def q_change_log(spark, sf):
    st = domain.order_store(spark, sf)
    pairs = D.consecutive_pairs(st["snapshots"])
    return D.change_log(pairs, st["snapshots"], st["trades"], st["market_sets"])


# caller-given pairs: every consecutive pair, its reverse, and a pair that ends a day late
@register("diff_given_pairs", _pairs_store() + """,
given AS (SELECT * FROM pairs
          UNION ALL SELECT counterparty_id, netting_set_id, to_date, from_date FROM pairs
          UNION ALL SELECT counterparty_id, netting_set_id, from_date, CAST(to_date + INTERVAL 1 DAY AS DATE) FROM pairs)
SELECT g.counterparty_id, g.netting_set_id, g.from_date, g.to_date,
       CASE WHEN NOT g.from_date < g.to_date THEN 'INVALID_RANGE'
            WHEN NOT EXISTS (SELECT 1 FROM snap s WHERE s.counterparty_id = g.counterparty_id
              AND s.netting_set_id = g.netting_set_id AND s.cob_date = g.from_date) THEN 'MISSING_FROM'
            WHEN NOT EXISTS (SELECT 1 FROM snap s WHERE s.counterparty_id = g.counterparty_id
              AND s.netting_set_id = g.netting_set_id AND s.cob_date = g.to_date) THEN 'MISSING_TO'
            ELSE 'OK' END AS status
FROM given g""")
def q_diff_given_pairs(spark, sf):
    snaps = domain.order_store(spark, sf)["snapshots"]
    pairs = D.consecutive_pairs(snaps)
    given = pairs.unionByName(pairs.select("counterparty_id", "netting_set_id", F.col("to_date").alias("from_date"),
                                           F.col("from_date").alias("to_date")))
    given = given.unionByName(pairs.withColumn("to_date", F.date_add("to_date", 1)))
    good = D.given_pairs(given, snaps).withColumn("status", F.lit("OK"))
    return good.unionByName(D.rejected_pairs(given, snaps).withColumnRenamed("reason", "status"))


# =========================================================== history E1-E4

@register("agreement_history", O.store(with_trades=False) + """,
l AS (
  SELECT *, lag(cob_date) OVER w AS prev_date,
         lag(threshold_amount) OVER w AS p_th, lag(minimum_transfer_amount) OVER w AS p_mta,
         lag(independent_amount) OVER w AS p_ia, lag(rounding_amount) OVER w AS p_ra,
         lag(currency) OVER w AS p_ccy, lag(eligible_collateral) OVER w AS p_ec,
         lag(valuation_agent) OVER w AS p_va, lag(extra) OVER w AS p_ex
  FROM snap WINDOW w AS (PARTITION BY counterparty_id, netting_set_id ORDER BY cob_date)),
starts AS (
  SELECT * FROM l
  WHERE prev_date IS NULL OR NOT (abs(threshold_amount - p_th) < 1e-9)
     OR NOT (abs(minimum_transfer_amount - p_mta) < 1e-9)
     OR NOT (abs(independent_amount - p_ia) < 1e-9) OR NOT (abs(rounding_amount - p_ra) < 1e-9)
     OR currency IS DISTINCT FROM p_ccy OR eligible_collateral IS DISTINCT FROM p_ec
     OR valuation_agent IS DISTINCT FROM p_va OR extra IS DISTINCT FROM p_ex)
SELECT counterparty_id, netting_set_id, cob_date AS valid_from,
       lead(cob_date) OVER (PARTITION BY counterparty_id, netting_set_id ORDER BY cob_date) AS valid_to,
       agreement_id, threshold_amount, minimum_transfer_amount, independent_amount, currency,
       array_to_string(eligible_collateral, ',') AS eligible_collateral, rounding_amount,
       valuation_agent, extra
FROM starts""")
def q_agreement_history(spark, sf):
    h = E.agreement_history(domain.order_store(spark, sf)["snapshots"])
    return h.withColumn("eligible_collateral", F.array_join("eligible_collateral", ","))


ANOMALY_MIN_HISTORY = 10


@register("exposure_anomalies", "WITH " + O.feed() + f""",
daily AS (SELECT counterparty_id, cob_date,
                 CAST(sum(CAST(exposure_total AS DECIMAL(38,2))) AS DOUBLE) AS exposure_total
          FROM feed GROUP BY ALL),
st AS (SELECT *, row_number() OVER (PARTITION BY counterparty_id ORDER BY cob_date) AS n_history,
              count(*) OVER w AS n_obs, avg(exposure_total) OVER w AS mean,
              stddev_samp(exposure_total) OVER w AS std
       FROM daily WINDOW w AS (PARTITION BY counterparty_id ORDER BY cob_date
            RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT counterparty_id, cob_date, exposure_total, CAST(n_obs AS BIGINT) AS n_obs,
       round(mean, 6) AS mean, round(std, 6) AS std,
       coalesce(abs(exposure_total - mean) > 2 * std, false) AS is_anomaly
FROM st WHERE n_history >= {ANOMALY_MIN_HISTORY}""")
def q_exposure_anomalies(spark, sf):
    return E.exposure_anomalies(domain.event_index(spark, sf), min_history=ANOMALY_MIN_HISTORY)


@register("snapshots_with_matrices", O.store(with_trades=False) + """
SELECT r.counterparty_id, r.netting_set_id, r.cob_date, r.instrument, r.path, r.hash, m.length
FROM refs r JOIN snap s USING (counterparty_id, netting_set_id, cob_date)
LEFT JOIN (SELECT DISTINCT path, length FROM mx) m USING (path)""")
def q_snapshots_with_matrices(spark, sf):
    st = domain.order_store(spark, sf)
    files = td.matrix_objects(spark, sf).select("path", "length").distinct()
    return E.snapshots_with_matrices(st["snapshots"], files).select(
        *KEY, "instrument", "path", "hash", "length")


@register("matrix_contents", O.store(with_trades=False) + """
SELECT r.counterparty_id, r.netting_set_id, r.cob_date, r.instrument, r.hash, m.length, m.actual_hash AS content_hash
FROM refs r JOIN snap s USING (counterparty_id, netting_set_id, cob_date)
LEFT JOIN (SELECT * FROM mx WHERE arrived) m USING (path)""")
def q_matrix_contents(spark, sf):
    """E3 with the files' bytes attached, which must hash to the stored refs."""
    rows = E.snapshots_with_matrices(domain.order_store(spark, sf)["snapshots"], domain.staged(spark, sf)["files"],
                                     with_content=True)
    return rows.select(*KEY, "instrument", "hash", "length", H.file_hash().alias("content_hash"))


@register("extra_json_query", """
SELECT 'CP-' || user_id AS counterparty_id, event_type AS netting_set_id, CAST(ts AS DATE) AS cob_date,
       CAST(count(*) AS BIGINT) AS n_events,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k,
       max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS max_k
FROM events GROUP BY ALL""")
def q_extra_json_query(spark, sf):
    ex = E.extra_json_query(td.event_extras(spark, sf), "$.k", "int")
    return ex.groupBy(*KEY).agg(F.count(F.lit(1)).cast("long").alias("n_events"),
                                F.sum("extra_value").cast("long").alias("sum_k"),
                                F.max("extra_value").alias("max_k"))


# =========================================================== export K5

def _export_sql() -> str:
    """The exported documents: stored column order, nulls kept, ``extra`` as stored."""
    return O.store(with_market=True).rstrip() + _hash_doc_sql() + """,
ptr AS (SELECT counterparty_id, netting_set_id, cob_date,
               string_agg('{"trade_id":"' || trade_id || '","product_type":"' || product_type
                          || '","notional":' || CAST(notional AS VARCHAR) || ',"currency":"' || currency
                          || '","maturity_date":' || coalesce('"' || CAST(maturity_date AS VARCHAR) || '"', 'null')
                          || ',"direction":"' || direction || '","extra":' || extra || '}', ',' ORDER BY trade_id) AS j
        FROM tr GROUP BY ALL),
pmx AS (SELECT counterparty_id, netting_set_id, cob_date,
               '{' || string_agg('"' || instrument || '":{"path":"' || path || '","hash":"' || hash || '"}', ','
                                 ORDER BY instrument) || '}' AS j
        FROM refs GROUP BY ALL)
SELECT s.counterparty_id, s.netting_set_id, s.cob_date,
       '{"counterparty_id":"' || s.counterparty_id || '","netting_set_id":"' || s.netting_set_id
       || '","cob_date":"' || CAST(s.cob_date AS VARCHAR) || '","agreement":{"agreement_id":"' || s.agreement_id
       || '","threshold_amount":' || CAST(s.threshold_amount AS VARCHAR)
       || ',"minimum_transfer_amount":' || CAST(s.minimum_transfer_amount AS VARCHAR)
       || ',"independent_amount":' || CAST(s.independent_amount AS VARCHAR) || ',"currency":"' || s.currency
       || '","eligible_collateral":' || CAST(to_json(s.eligible_collateral) AS VARCHAR)
       || ',"rounding_amount":' || CAST(s.rounding_amount AS VARCHAR)
       || ',"valuation_agent":' || coalesce('"' || s.valuation_agent || '"', 'null') || ',"extra":' || s.extra
       || '},"trades":[' || coalesce(t.j, '') || '],"market_data":{"fx_rates":' || coalesce(f.j, '{}')
       || ',"inflation_rates":' || coalesce(i.j, '{}') || ',"price_matrices":' || coalesce(p.j, '{}')
       || '},"data_hash":"sha256-v1:' || sha256(d.doc) || '"}' AS value
FROM snap s JOIN docs d USING (counterparty_id, netting_set_id, cob_date)
LEFT JOIN fxm f USING (cob_date) LEFT JOIN infm i USING (cob_date)
LEFT JOIN pmx p USING (counterparty_id, netting_set_id, cob_date)
LEFT JOIN ptr t USING (counterparty_id, netting_set_id, cob_date)"""


@register("export_snapshots_json", _export_sql())
def q_export_snapshots_json(spark, sf):
    st = domain.order_store(spark, sf)
    return K.export_snapshots_json(st.full_snapshots(), st["trades"])


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
