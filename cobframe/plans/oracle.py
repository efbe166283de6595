"""DuckDB twins of the domain views, used to write the oracle SQL.

Each function returns the text of one or more CTEs.  They restate, in SQL,
the mapping of ``cobframe.sources.testdata`` and the rules of the operators
(defaults, first-wins, verification, completeness), independently of the
Spark code, so that the driver's comparison checks the Spark plans.
"""

from __future__ import annotations

ID_RE = "[A-Za-z0-9_-]+"


def _ns(clean: bool, alias: str = "") -> str:
    col = f"{alias}o_orderpriority"
    return f"replace({col}, ' ', '_')" if clean else col


def agreements_raw(clean: bool = True, noise: bool = False) -> str:
    rounding = "(CAST(floor(o_totalprice) AS BIGINT) % 7) * 1e-10" if noise else "0.0"
    return f"""ag_raw AS (
  SELECT 'CP-' || o_custkey AS counterparty_id,
         {_ns(clean)} AS netting_set_id,
         CAST(o_orderdate AS DATE) AS cob_date,
         'ISDA-' || o_custkey AS agreement_id,
         CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1000000.0 * (o_orderkey % 3) END AS DOUBLE)
           AS threshold_raw,
         CAST(50000.0 * (o_orderkey % 2) AS DOUBLE) AS minimum_transfer_amount,
         CAST(0.0 AS DOUBLE) AS independent_amount,
         CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS currency_raw,
         CASE WHEN o_orderstatus = 'O' THEN ['USD_CASH', 'US_TREASURY'] ELSE ['USD_CASH'] END
           AS eligible_collateral,
         CAST({rounding} AS DOUBLE) AS rounding_amount,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS valuation_agent,
         '{{"status":"' || o_orderstatus || '"}}' AS extra,
         o_orderkey AS arrival_seq,
         o_totalprice AS exposure_total,
         CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ingested_at
  FROM orders)"""


def agreements_good() -> str:
    """V1 + V3: valid ids, first copy of each key; defaults applied."""
    return f"""ag_valid AS (
  SELECT * FROM ag_raw
  WHERE regexp_full_match(counterparty_id, '{ID_RE}') AND regexp_full_match(netting_set_id, '{ID_RE}')),
ag AS (
  SELECT counterparty_id, netting_set_id, cob_date, agreement_id,
         coalesce(threshold_raw, 0.0) AS threshold_amount, minimum_transfer_amount,
         independent_amount, coalesce(nullif(currency_raw, ''), 'USD') AS currency,
         eligible_collateral, rounding_amount, valuation_agent, extra, arrival_seq,
         exposure_total, ingested_at
  FROM ag_valid
  QUALIFY row_number() OVER (PARTITION BY counterparty_id, netting_set_id, cob_date
                             ORDER BY arrival_seq) = 1)"""


def matrices(clean: bool = True) -> str:
    zero = "'sha256-v1:' || repeat('0', 64)"
    return f"""mx AS (
  SELECT 'matrices/' || CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) || '/CP-' || o.o_custkey || '/'
           || {_ns(clean, 'o.')} || '/' || d.source || '.npy' AS path,
         CAST(strlen(d.text) AS BIGINT) AS length,
         'sha256-v1:' || sha256(d.text) AS actual_hash,
         CASE WHEN d.doc_id % 50 = 0 THEN ''
              WHEN d.doc_id % 37 = 0 THEN {zero}
              ELSE 'sha256-v1:' || sha256(d.text) END AS expected_hash,
         'CP-' || o.o_custkey AS counterparty_id,
         {_ns(clean, 'o.')} AS netting_set_id,
         CAST(o.o_orderdate AS DATE) AS cob_date,
         d.source AS instrument, d.doc_id % 41 <> 0 AS arrived
  FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey),
mxv AS (
  SELECT *, CASE WHEN NOT arrived THEN 'MISSING'
                 WHEN expected_hash = '' THEN 'NO_HASH'
                 WHEN actual_hash <> expected_hash THEN 'MISMATCH' ELSE 'OK' END AS status
  FROM mx),
completeness AS (
  SELECT a.counterparty_id, a.netting_set_id, a.cob_date,
         CAST(count(m.path) AS BIGINT) AS n_expected,
         CAST(count(m.path) FILTER (WHERE m.status <> 'OK') AS BIGINT) AS n_missing
  FROM ag a LEFT JOIN mxv m USING (counterparty_id, netting_set_id, cob_date)
  GROUP BY ALL),
refs AS (
  SELECT counterparty_id, netting_set_id, cob_date, instrument, path, expected_hash AS hash
  FROM mxv WHERE status = 'OK'
  QUALIFY row_number() OVER (PARTITION BY counterparty_id, netting_set_id, cob_date, instrument
                             ORDER BY path DESC, expected_hash DESC) = 1)"""


def snapshots_cte() -> str:
    return """snap AS (
  SELECT a.* FROM ag a JOIN completeness c USING (counterparty_id, netting_set_id, cob_date)
  WHERE c.n_missing = 0)"""


def trades_raw(clean: bool = True) -> str:
    return f"""tr_raw AS (
  SELECT 'CP-' || o_custkey AS counterparty_id, {_ns(clean)} AS netting_set_id,
         CAST(o_orderdate AS DATE) AS cob_date, 'T-' || (l_partkey % 20) AS trade_id,
         p_type AS product_type, l_extendedprice AS notional,
         CASE l_linenumber % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN '' END AS currency,
         CASE l_returnflag WHEN 'R' THEN 'RECEIVE' WHEN 'A' THEN 'PAY' ELSE '' END AS direction,
         CAST(l_shipdate AS DATE) AS maturity_date,
         '{{"line":' || l_linenumber || '}}' AS extra,
         l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate, l_suppkey, l_quantity,
         l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey),
tr_first AS (
  SELECT * FROM tr_raw
  QUALIFY row_number() OVER (PARTITION BY counterparty_id, netting_set_id, cob_date, trade_id
      ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate, l_suppkey,
               l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) = 1)"""


def trades_good() -> str:
    return """tr AS (
  SELECT t.counterparty_id, t.netting_set_id, t.cob_date, t.trade_id,
         coalesce(nullif(t.product_type, ''), 'UNKNOWN') AS product_type, t.notional,
         coalesce(nullif(t.currency, ''), 'USD') AS currency,
         coalesce(nullif(t.direction, ''), 'PAY') AS direction, t.maturity_date, t.extra
  FROM tr_first t JOIN snap s USING (counterparty_id, netting_set_id, cob_date))"""


def market() -> str:
    return """md AS (
  SELECT CAST(l_shipdate AS DATE) AS cob_date,
         CASE l_returnflag WHEN 'A' THEN 'fx_rate' WHEN 'N' THEN 'inflation_rate'
              ELSE 'vol_surface' END AS data_type,
         l_linestatus || l_linenumber AS key,
         min(CASE WHEN l_returnflag = 'A' THEN l_discount ELSE l_tax END) AS value
  FROM lineitem GROUP BY ALL)"""


def pairs_cte(source: str = "snap") -> str:
    return f"""pairs AS (
  SELECT * FROM (
    SELECT counterparty_id, netting_set_id,
           lag(cob_date) OVER (PARTITION BY counterparty_id, netting_set_id ORDER BY cob_date)
             AS from_date,
           cob_date AS to_date
    FROM {source}) WHERE from_date IS NOT NULL)"""


def feed() -> str:
    """Mapping B."""
    return """feed AS (
  SELECT 'CP-' || user_id AS counterparty_id, event_type AS netting_set_id,
         CAST(ts AS DATE) AS cob_date,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS exposure_total,
         max(ts) AS ingested_at
  FROM events GROUP BY ALL)"""


def store(clean: bool = True, noise: bool = False, with_trades: bool = True,
          with_market: bool = False, extra: tuple[str, ...] = ()) -> str:
    """The mapping-A store (accepted snapshots and their trades)."""
    parts = [agreements_raw(clean, noise), agreements_good(), matrices(clean), snapshots_cte()]
    if with_trades:
        parts += [trades_raw(clean), trades_good()]
    if with_market:
        parts.append(market())
    parts += list(extra)
    return "WITH " + ",\n".join(parts) + "\n"
