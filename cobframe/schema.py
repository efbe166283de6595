"""Types, keys, defaults and fixed values of the snapshot data model.

A close-of-business (COB) snapshot is keyed by
(counterparty_id, netting_set_id, cob_date).  Storage is long form:

* ``snapshots``        one row per snapshot: agreement terms (struct), market
                       data (digests of the rate sets, matrix refs), exposure,
                       hash, times
* ``market_sets``      the rate sets of a date, each once, by digest
* ``snapshot_trades``  one row per trade of a snapshot (never an array column,
                       so a netting set with very many trades is spread over
                       many tasks)
* ``exposure_index``   narrow per-date ranking table
* ``trade_index``      trade_id -> snapshot key, per date

The nested document (agreement + trades list + market data) is built only
where a document is the requested output.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["counterparty_id", "netting_set_id", "cob_date"]
NS_KEY = ["counterparty_id", "netting_set_id"]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
HASH_PREFIX = "sha256-v1:"              # version prefix of every content hash
SAFE_ID_PATTERN = r"\A[A-Za-z0-9_-]+\z"  # allowed id characters (anchored on the whole string)
FLOAT_EPSILON = 1e-9                    # diff: floats closer than this are equal
HASH_ROUND_DIGITS = 10                  # canonical form rounds floats to 10 decimals
DEFAULT_CURRENCY = "USD"                # agreement / trade currency when missing or empty
DEFAULT_PRODUCT_TYPE = "UNKNOWN"        # trade product type when missing or empty
DEFAULT_DIRECTION = "PAY"               # trade direction when missing or empty
MARKET_FX = "fx_rate"                   # staging_market_data.data_type values understood
MARKET_INFLATION = "inflation_rate"
PORTFOLIO_DEFAULT_TOP = 20              # default row count of the exposure ranking report
# ---------------------------------------------------------------------------

AGREEMENT = T.StructType([
    T.StructField("agreement_id", T.StringType()),
    T.StructField("threshold_amount", T.DoubleType()),
    T.StructField("minimum_transfer_amount", T.DoubleType()),
    T.StructField("independent_amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("eligible_collateral", T.ArrayType(T.StringType())),
    T.StructField("rounding_amount", T.DoubleType()),
    T.StructField("valuation_agent", T.StringType()),
    T.StructField("extra", T.StringType()),       # JSON object text, kept verbatim
])
AGREEMENT_FIELDS = [f.name for f in AGREEMENT.fields]

TRADE = T.StructType([
    T.StructField("trade_id", T.StringType()),
    T.StructField("product_type", T.StringType()),
    T.StructField("notional", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("maturity_date", T.DateType()),
    T.StructField("direction", T.StringType()),
    T.StructField("extra", T.StringType()),       # JSON object text
])
TRADE_FIELDS = [f.name for f in TRADE.fields]

MATRIX_REF = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("hash", T.StringType()),
])

MARKET_DATA = T.StructType([
    T.StructField("fx_rates", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("inflation_rates", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("price_matrices", T.MapType(T.StringType(), MATRIX_REF)),
])

# What the store keeps of it: rate sets by their digest (``operators.market_sets``).
STORED_MARKET_DATA = T.StructType([
    T.StructField("fx_set", T.StringType()),
    T.StructField("inflation_set", T.StringType()),
    T.StructField("price_matrices", T.MapType(T.StringType(), MATRIX_REF)),
])

# Column lists of the landing CSV files (one directory per date/cp/ns).
# The agreement file carries no independent_amount, rounding_amount or extra;
# those take the staging defaults 0, 0 and {}.
LANDING_AGREEMENT_COLUMNS = ["counterparty_id", "netting_set_id", "cob_date", "agreement_id",
                             "threshold_amount", "minimum_transfer_amount", "currency",
                             "eligible_collateral", "valuation_agent"]
LANDING_TRADE_COLUMNS = ["counterparty_id", "netting_set_id", "cob_date", "trade_id",
                         "product_type", "notional", "currency", "direction", "maturity_date"]
LANDING_MARKET_COLUMNS = ["cob_date", "data_type", "key", "value"]


def landing_csv_schema(columns: list[str]) -> T.StructType:
    """All-text schema for a landing CSV; values are cast with try_cast later."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
