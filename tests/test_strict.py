"""Raising variants: strict reads, argument checks, export format."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cobframe.operators import integrity as H
from cobframe.operators import query as Q
from cobframe.operators.store import export_format
from cobframe.operators.validate import require_range
from cobframe.schema import KEY
from tests.conftest import MON, TUE, populated


def test_verify_on_read_passes_and_raises(spark):
    headers, trades = populated(spark)
    hashed = headers.join(H.snapshot_hashes(headers, trades), KEY)
    assert H.verify_on_read(hashed, trades).count() == 5
    tampered = hashed.withColumn("exposure_total", F.lit(1.0))  # outside the document
    assert H.verify_on_read(tampered, trades).count() == 5
    changed = trades.withColumn("currency", F.lit("JPY"))
    with pytest.raises(Exception, match="IntegrityError"):
        H.verify_on_read(hashed, changed).collect()


def test_require_range():
    d1, d2 = dt.date(2024, 3, 15), dt.date(2024, 3, 16)
    require_range(d1, d2)
    require_range(d1, d1, strict=False)
    with pytest.raises(ValueError):
        require_range(d2, d1)
    with pytest.raises(ValueError):
        require_range(d1, d1)


def test_export_format_only_json():
    assert export_format("json") == "json"
    with pytest.raises(ValueError):
        export_format("csv")


def test_strict_inflation_index_raises(spark):
    headers, _ = populated(spark)
    with pytest.raises(Exception, match="KeyError"):
        Q.inflation_rate_index(headers, "US_CPI", TUE, strict=True).collect()


def test_missing_snapshots_fail_in_strict_form(spark):
    headers, trades = populated(spark)
    never = dt.date(2000, 1, 1)
    assert Q.snapshot(headers, trades, "NORDBANK", "SWAPS", MON, strict=True).count() == 2
    assert Q.fx_rates(headers, MON, strict=True).count() == 1
    for strict in (lambda: Q.snapshot(headers, trades, "NORDBANK", "SWAPS", never, strict=True),
                   lambda: Q.snapshot_document(headers, trades, "NOBODY", strict=True),
                   lambda: Q.fx_rates(headers, never, strict=True), lambda: Q.inflation_rates(headers, never, strict=True)):
        with pytest.raises(Exception, match="NotFound"):
            strict().collect()
