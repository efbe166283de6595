"""Content-addressed rate sets.

All snapshots of a date carry the same FX and inflation rates, and dates often
share them too.  A set of rates is stored once a date, named by the digest of its
sorted entries; snapshots hold the digests.  What depends on a set alone (its
canonical text, its changes against another set) is worked out once a set or once
a pair of sets and joined back.

Stored form of ``market_data``: ``fx_set``, ``inflation_set`` (digests) and
``price_matrices``.  Full form: the two maps in place of the digests.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobframe.functions.columns import floats_differ, map_values_finite, typed_empty_map

SETS = {"fx_rates": "fx_set", "inflation_rates": "inflation_set"}


def is_stored_form(snapshots: DataFrame) -> bool:
    return "fx_set" in snapshots.schema["market_data"].dataType.fieldNames()


def _or_empty(rates: Column) -> Column:
    return F.coalesce(rates, typed_empty_map("string", "double"))


def set_digest(rates: Column) -> Column:
    """Equal for equal sets; a missing set is the empty one."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(_or_empty(rates)))), 256)


EMPTY_SET = hashlib.sha256(b"[]").hexdigest()


def _found(digest: Column, rates: Column) -> Column:
    """The rates a digest names; a digest without its set is an error, but for
    the empty one's."""
    return F.when(digest.isNull() | (digest == EMPTY_SET) | rates.isNotNull(), _or_empty(rates)).otherwise(
        F.raise_error(F.concat(F.lit("no market set "), digest)).cast("map<string,double>"))


def detach_sets(snapshots: DataFrame) -> DataFrame:
    """Snapshots in full form -> stored form."""
    digests = [set_digest(F.col(f"market_data.{field}")).alias(name) for field, name in SETS.items()]
    return snapshots.withColumn("market_data", F.when(
        F.col("market_data").isNotNull(), F.struct(*digests, F.col("market_data.price_matrices").alias("price_matrices"))))


def market_sets(snapshots: DataFrame) -> DataFrame:
    """``cob_date, digest, rates``: the sets that snapshots in full form carry,
    once a date.  Copies of a date's sets are combined before the shuffle."""
    each = snapshots.where("market_data IS NOT NULL").select("cob_date", F.explode(F.array(
        *[_or_empty(F.col(f"market_data.{field}")) for field in SETS])).alias("rates"))
    return (each.select("cob_date", set_digest(F.col("rates")).alias("digest"), "rates")
            .groupBy("cob_date", "digest").agg(F.any_value("rates").alias("rates")))


def dated_sets(rates: DataFrame) -> DataFrame:
    """The rates of each date with the digests of its two sets, made once a date,
    and ``finite``: no value of either is NaN or infinite."""
    return rates.select("cob_date", *SETS, *[set_digest(F.col(field)).alias(name) for field, name in SETS.items()],
                        (map_values_finite("fx_rates") & map_values_finite("inflation_rates")).alias("finite"))


def carried_sets(snapshots: DataFrame, dated: DataFrame) -> DataFrame:
    """As ``market_sets``, for snapshots in stored form whose dates' sets are ``dated``."""
    dates = snapshots.where("market_data IS NOT NULL").select("cob_date").distinct()
    each = dates.join(dated, "cob_date", "left").select("cob_date", F.explode(F.array(
        *[F.struct(F.coalesce(name, F.lit(EMPTY_SET)).alias("digest"), _or_empty(F.col(field)).alias("rates"))
          for field, name in SETS.items()])).alias("s"))
    return each.select("cob_date", "s.*").groupBy("cob_date", "digest").agg(F.any_value("rates").alias("rates"))


def attach_dated_sets(snapshots: DataFrame, dated: DataFrame) -> DataFrame:
    """Snapshots in stored form -> full form, each with the rates of its date."""
    full = F.struct(*[_or_empty(F.col(field)).alias(field) for field in SETS],
                    F.col("market_data.price_matrices").alias("price_matrices"))
    return (snapshots.join(dated.select("cob_date", *SETS), "cob_date", "left")
            .withColumn("market_data", full).select(snapshots.columns))


def distinct_sets(sets: DataFrame) -> DataFrame:
    """One row per digest, whatever dates and batches hold it."""
    return sets.groupBy("digest").agg(F.any_value("rates").alias("rates"))


def attach_sets(snapshots: DataFrame, sets: DataFrame) -> DataFrame:
    """Snapshots in stored form -> full form."""
    order, named = snapshots.columns, distinct_sets(sets)
    rows = snapshots
    for field, name in SETS.items():
        rows = (rows.withColumn("_digest", F.col(f"market_data.{name}"))
                .join(named.select(F.col("digest").alias("_digest"), F.col("rates").alias(f"_{field}")), "_digest", "left")
                .withColumn(f"_{field}", _found(F.col("_digest"), F.col(f"_{field}"))).drop("_digest"))
    full = F.struct(*[F.col(f"_{field}").alias(field) for field in SETS], F.col("market_data.price_matrices").alias("price_matrices"))
    return rows.withColumn("market_data", F.when(F.col("market_data").isNotNull(), full)).select(order)


def rate_changes(old: Column, new: Column) -> Column:
    """key -> (old_value, new_value) for keys missing on a side or moved by >= 1e-9."""
    zipped = F.map_zip_with(_or_empty(old), _or_empty(new), lambda k, a, b: F.struct(a.alias("old_value"), b.alias("new_value")))
    return F.map_filter(zipped, lambda k, v: floats_differ(v["old_value"], v["new_value"]))


def set_changes(pairs: DataFrame, old: str, new: str, sets: DataFrame, out: str) -> DataFrame:
    """``pairs`` with ``out``: the changes between the sets that the digest
    columns ``old`` and ``new`` name (NULL where they are the same set; no
    digest is the empty set).  Each pair of different sets is compared once,
    however many rows have it."""
    named, empty = distinct_sets(sets), F.lit(EMPTY_SET)
    pairs = pairs.withColumns({"_old": F.coalesce(F.col(old), empty), "_new": F.coalesce(F.col(new), empty)})
    ends = pairs.select("_old", "_new").where("_old <> _new").distinct()
    compared = (ends.join(named.select(F.col("digest").alias("_old"), F.col("rates").alias("_a")), "_old", "left")
                .join(named.select(F.col("digest").alias("_new"), F.col("rates").alias("_b")), "_new", "left")
                .select("_old", "_new", rate_changes(_found(F.col("_old"), F.col("_a")), _found(F.col("_new"), F.col("_b"))).alias(out)))
    return pairs.join(compared, ["_old", "_new"], "left").drop("_old", "_new")
