"""Staging sources (S1-S4): whole-table readers with optional date bounds.

Every reader takes either a DataFrame (any connector: parquet, JDBC, a view)
or a path, projects the columns the assembler needs and coerces NUMERIC
to double.  Date bounds become partition / pushed filters on the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobframe.functions.columns import date_range, to_double
from cobframe.schema import (KEY, LANDING_AGREEMENT_COLUMNS, LANDING_MARKET_COLUMNS,
                             LANDING_TRADE_COLUMNS, landing_csv_schema)
from cobframe.sources.files import paths_match


def _dated(df: DataFrame, cob_date=None, from_date=None, to_date=None) -> DataFrame:
    if cob_date is not None:
        from_date = to_date = cob_date
    if from_date is None and to_date is None:
        return df
    return df.where(date_range("cob_date", from_date, to_date))


def _passthrough(df: DataFrame, names: list[str]) -> list:
    return [F.col(n) for n in names if n in df.columns]


def read_staging_agreements(df: DataFrame, cob_date=None, from_date=None, to_date=None,
                            keep: tuple[str, ...] = ("ingested_at", "arrival_seq")) -> DataFrame:
    """Agreement rows, four NUMERIC terms as double with NULL -> 0.0."""
    df = _dated(df, cob_date, from_date, to_date)
    return df.select(
        "counterparty_id", "netting_set_id", "cob_date", "agreement_id",
        to_double("threshold_amount").alias("threshold_amount"),
        to_double("minimum_transfer_amount").alias("minimum_transfer_amount"),
        to_double("independent_amount").alias("independent_amount"),
        "currency", "eligible_collateral",
        to_double("rounding_amount").alias("rounding_amount"),
        "valuation_agent", "extra", *_passthrough(df, list(keep)))


def read_staging_trades(df: DataFrame, cob_date=None, from_date=None, to_date=None,
                        keep: tuple[str, ...] = ("ingested_at", "arrival")) -> DataFrame:
    """Trade rows, ``notional`` NULL -> 0.0."""
    df = _dated(df, cob_date, from_date, to_date)
    return df.select(
        "counterparty_id", "netting_set_id", "cob_date", "trade_id", "product_type",
        to_double("notional").alias("notional"), "currency", "direction", "maturity_date",
        "extra", *_passthrough(df, list(keep)))


def read_staging_market_data(df: DataFrame, cob_date=None, from_date=None,
                             to_date=None) -> DataFrame:
    """S3 (long form): (cob_date, data_type, key, value double)."""
    df = _dated(df, cob_date, from_date, to_date)
    return df.select("cob_date", "data_type", "key", to_double("value").alias("value"),
                     *_passthrough(df, ["ingested_at"]))


# ---------------------------------------------------------------------------
# Landing CSV files -> staging, insert-if-absent
# ---------------------------------------------------------------------------

# What a value's text must look like before it is cast.
NUMBER_TEXT = r"(?i)^[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf(?:inity)?)$"
DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"

# table -> (file, columns, key, required columns, typed columns)
LANDING = {
    "staging_agreements": ("agreement.csv", LANDING_AGREEMENT_COLUMNS, KEY,
                           [*KEY, "agreement_id"],
                           {"cob_date": "date", "threshold_amount": "double",
                            "minimum_transfer_amount": "double"}),
    "staging_trades": ("trades.csv", LANDING_TRADE_COLUMNS, [*KEY, "trade_id"],
                       [*KEY, "trade_id"],
                       {"cob_date": "date", "notional": "double", "maturity_date": "date"}),
    "staging_market_data": ("market_data.csv", LANDING_MARKET_COLUMNS,
                            ["cob_date", "data_type", "key"],
                            ["cob_date", "data_type", "key", "value"],
                            {"cob_date": "date", "value": "double"}),
}
# A row's place in the landed files: file, block and row number, all known at
# the scan, so the order does not depend on any shuffle.
ARRIVAL = ["_file", "_block", "_row"]


# The text of a row whose number of fields is not the table's, else NULL.
MALFORMED = "_malformed"


def read_landing(spark: SparkSession, root: str, table: str,
                 folders: list[str] | None = None, present: set[str] | None = None) -> DataFrame:
    """Text columns of one kind of landing file with each row's place, and the
    whole text of a row that has too few or too many fields (a reader that pads
    and cuts would give it a missing or a shifted value).

    ``folders``: only these ``{date}/{cp}/{ns}`` folders below ``root``;
    ``present``: their files (``folder/name``), where they are known already."""
    file_name, columns = LANDING[table][:2]
    base = root.rstrip("/")
    if folders is not None and present is not None:
        paths = [f"{base}/{f}/{file_name}" for f in folders if f"{f}/{file_name}" in present]
    else:
        paths = [f"{base}/{f}/{file_name}" for f in folders] if folders is not None else [f"{base}/*/*/*/{file_name}"]
        paths = [p for p in paths if paths_match(spark, p)]
    if not paths:
        empty = ", ".join([f"{c} string" for c in [*columns, MALFORMED]] + ["_file string", "_block long", "_row long"])
        return spark.createDataFrame([], empty)
    return (spark.read.schema(landing_csv_schema([*columns, MALFORMED])).option("header", True).option("escape", '"')
            # whole rows are parsed whatever is selected: fields are counted only then
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", False).csv(paths)
            .select(*columns, MALFORMED, F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_row")))


def _parsed(column: str, kind: str) -> Column:
    """The typed value of a text, NULL when the text does not spell one."""
    text = F.trim(column)
    shape = DATE_TEXT if kind == "date" else NUMBER_TEXT
    return F.when(text.rlike(shape), text.try_cast(kind))


def _present(column: str) -> Column:
    return F.coalesce(F.trim(column) != "", F.lit(False))


def parse_collateral(column: str = "eligible_collateral") -> Column:
    """An array literal (``{A,"B, C"}``, ``{}``) or a plain comma list."""
    text = F.trim(column)
    inner = F.regexp_replace(text, r"(?s)^\{(.*)\}$", "$1")
    items = F.regexp_extract_all(inner, F.lit(r'"((?:[^"\\]|\\.)*)"|([^,"]+)'), F.lit(0))
    plain = F.transform(items, lambda x: F.when(
        F.startswith(F.trim(x), F.lit('"')),
        F.regexp_replace(F.substring(F.trim(x), F.lit(2), F.length(F.trim(x)) - 2), r"\\(.)", "$1"))
        .otherwise(F.trim(x)))
    return (F.when(column_is_empty(text), F.lit(None).cast("array<string>"))
            .when(text.rlike(r"(?s)^\{.*\}$"), F.filter(plain, lambda x: x != ""))
            .otherwise(F.split(text, ",")))


def column_is_empty(text: Column) -> Column:
    return F.coalesce(text == "", F.lit(True))


def _folder_part(at: int) -> Column:
    """Date, counterparty or netting set of the folder a file lies in."""
    return F.nullif(F.regexp_extract("_file", r"([^/]+)/([^/]+)/([^/]+)/[^/]+$", at), F.lit(""))


def landing_rows(raw: DataFrame, table: str) -> DataFrame:
    """Every landed row in one pass: the columns of the table typed where its texts
    spell a value, ``_key`` (the key columns as text), ``reject_reason``
    (MALFORMED, UNPARSEABLE or MISSING_FIELD; NULL: the row is typed) and
    ``detail`` (the whole text of a malformed row, else the column and its text).
    The fields of a malformed row may be shifted, so its key is that of its
    folder.  Only a value that is absent is NULL in a typed row."""
    _, columns, _, required, typed = LANDING[table]
    if MALFORMED not in raw.columns:
        raw = raw.withColumn(MALFORMED, F.lit(None).cast("string"))
    # each text is matched and cast once; the rest reads the values
    parsed = raw.withColumn("_value", F.struct(*[_parsed(c, typed[c]).alias(c) for c in columns if c in typed]))
    problem = F.lit(None).cast("string")
    for c in reversed(columns):
        if c in typed:
            bad = _present(c) & F.col(f"_value.{c}").isNull()
            problem = F.when(bad, F.concat(F.lit(f"UNPARSEABLE|{c}="), F.col(c))).otherwise(problem)
    for c in reversed(required):
        problem = F.when(~_present(c), F.lit(f"MISSING_FIELD|{c}")).otherwise(problem)
    malformed = F.col(MALFORMED).isNotNull()
    marked = parsed.withColumn("_problem", F.when(malformed, F.concat(F.lit("MALFORMED|"), MALFORMED)).otherwise(problem))

    def value(c):
        if c in typed:
            return F.col(f"_value.{c}").alias(c)
        return (parse_collateral(c) if c == "eligible_collateral" else F.col(c)).alias(c)

    keys = [F.when(malformed, _folder_part(at)).otherwise(F.col(c) if c in columns else F.lit(None).cast("string")).alias(c)
            for c, at in (("counterparty_id", 2), ("netting_set_id", 3), ("cob_date", 1))]
    return marked.select(*[value(c) for c in columns], *ARRIVAL, F.struct(*keys).alias("_key"),
                         F.substring_index("_problem", "|", 1).alias("reject_reason"),
                         F.expr("substring(_problem, instr(_problem, '|') + 1)").alias("detail"))


def type_landing(raw: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """``landing_rows`` as two tables: typed rows, and the rows that cannot be
    typed with their key columns as text."""
    rows, columns = landing_rows(raw, table), LANDING[table][1]
    good = rows.where(F.col("reject_reason").isNull()).select(*columns, *ARRIVAL)
    if table == "staging_agreements":
        good = good.withColumns({"independent_amount": F.lit(0.0), "rounding_amount": F.lit(0.0)})
    if table != "staging_market_data":
        good = good.withColumn("extra", F.lit("{}"))
    return good, rows.where(F.col("reject_reason").isNotNull()).select(
        F.lit(table).alias("table_name"), "_key.*", "reject_reason", "detail", F.col("_file").alias("source_file"))


def _first_per_key(df: DataFrame, key: list[str], existing: DataFrame | None) -> DataFrame:
    """Insert-if-absent: keys already stored are dropped, then the first row
    (by its place in the files) of each key wins."""
    if existing is not None:
        df = df.join(existing.select(*key).distinct(), key, "left_anti")
    return dedupe_first(df, key, ARRIVAL)


def load_landing_csv(spark: SparkSession, root: str, existing_agreements: DataFrame | None = None,
                     existing_trades: DataFrame | None = None,
                     existing_market: DataFrame | None = None,
                     folders: list[str] | None = None, present: set[str] | None = None) -> dict[str, DataFrame]:
    """Read ``{root}/{date}/{cp}/{ns}/{agreement,trades,market_data}.csv``.

    Returns the rows to append to each staging table (typed, keys already in
    the staging tables skipped, first row per primary key kept) and, as
    ``landing_rejects``, every row of a wrong number of fields, with a missing
    key or with a value that does not parse.
    """
    existing = {"staging_agreements": existing_agreements, "staging_trades": existing_trades,
                "staging_market_data": existing_market}
    out, rejected = {}, None
    for table, (_, _, key, _, _) in LANDING.items():
        good, bad = type_landing(read_landing(spark, root, table, folders, present), table)
        first = _first_per_key(good, key, existing[table])
        out[table] = first.drop(*ARRIVAL).withColumn("ingested_at", F.current_timestamp())
        rejected = bad if rejected is None else rejected.unionByName(bad)
    out["landing_rejects"] = rejected
    return out


def dedupe_first(df: DataFrame, key: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """Keep the first row per key by ``order`` (total order expected), with the
    columns ``keep`` (all) in their order.

    The aggregate combines map-side, so many copies of one key never meet in one
    task; a key's rows cross the shuffle once per task that holds any.  It holds
    each column once: those of the order stand first and are compared first.
    """
    others = [c for c in (df.columns if keep is None else keep) if c not in key]
    kinds = dict(df.dtypes)
    if any("map<" in kinds[c] or "variant" in kinds[c] for c in others):
        first = F.min_by(F.struct(*others), F.struct(*[F.col(c) for c in order]))
    else:
        first = F.min(F.struct(*order, *[c for c in others if c not in order]))
    # rows are sorted for this aggregate: a number that tells nearly all keys apart is compared first
    return (df.withColumn("_key_hash", F.xxhash64(*key)).groupBy("_key_hash", *key).agg(first.alias("_row"))
            .select(*key, *[F.col("_row")[c].alias(c) for c in others]))
