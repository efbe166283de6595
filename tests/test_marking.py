"""Rows whose key comes once are marked in one reading; only repeated keys' rows are compared."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cobframe.functions.canonical_text import date_text, number_text, object_text
from cobframe.operators.validate import mark_agreements
from cobframe.schema import KEY

DAY = dt.date(2024, 1, 5)
SCHEMA = "counterparty_id string, netting_set_id string, cob_date date, agreement_id string, amount double, seq long"


def rows_of(df):
    return sorted(((*[r[c] for c in (*KEY, "agreement_id", "seq")], r["reject_reason"], r["detail"]) for r in df.collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_that_come_once_are_not_shuffled(spark):
    ag = spark.createDataFrame([(f"CP-{i}", "N", DAY, "A", 1.0, i) for i in range(20)] + [("bad id", "N", DAY, "A", 1.0, 99)], SCHEMA)
    marked = mark_agreements(ag, ["seq"])
    assert "Exchange" not in plan_of(marked) and "Aggregate" not in plan_of(marked)
    assert [r[-2:] for r in rows_of(marked) if r[-2]] == [("INVALID_ID", "bad id/N")] and marked.count() == 21


@pytest.mark.parametrize("stored", [False, True])
def test_every_row_keeps_one_status(spark, stored):
    ag = spark.createDataFrame([
        ("CP-1", "N", DAY, "A", 1.0, 2), ("CP-1", "N", DAY, "A", 2.0, 1), ("CP-1", "N", DAY, "A", 2.0, 1),
        ("CP-1", "N", DAY, None, 1.0, 0),  # a bad row of a repeated key
        ("CP-2", "N", DAY, "A", -0.0, 5), ("CP-3", "N", DAY, "A", 1.0, 6),
        (None, "N", DAY, "A", 1.0, 7), ("CP-4", "N", None, "A", 1.0, 8)], SCHEMA)
    existing = spark.createDataFrame([("CP-2", "N", DAY), ("CP-2", "N", DAY)], SCHEMA.split(", agreement_id")[0]) if stored else None
    got = rows_of(mark_agreements(ag, ["seq"], existing))
    copy, held = ("DUPLICATE", "later copy in batch"), ("DUPLICATE", "already stored")
    assert got == sorted([
        ("CP-1", "N", DAY, "A", 2, *copy), ("CP-1", "N", DAY, "A", 1, None, None), ("CP-1", "N", DAY, "A", 1, *copy),
        ("CP-1", "N", DAY, None, 0, "MISSING_FIELD", "CP-1/N"),
        ("CP-2", "N", DAY, "A", 5, *(held if stored else (None, None))), ("CP-3", "N", DAY, "A", 6, None, None),
        (None, "N", DAY, "A", 7, "MISSING_FIELD", "N"), ("CP-4", "N", None, "A", 8, "MISSING_FIELD", "CP-4/N")], key=str)


def test_short_ways_spell_the_same(spark):
    numbers = [12345.67, -0.05, 0.001, 0.0009, 1234567.891, 9999999.5, 1e7, 0.1 + 0.2, 1e-10, 5e-11, 123456.7890123456, 0.0, -0.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(number_text(F.col("x"))).collect()]
    plain = [None if x is None else round(x, 10) for x in numbers]
    assert all(g in (None, "null" if p is None else repr(p)) for g, p in zip(got, plain, strict=True))
    assert [g is None for g in got[:7]] == [False] * 7
    texts = ['{"line":3}', '{"a": 1}', '{"a":"x y"}', '{"b":1,"a":2}', "", "{}", '{"a":01}', '{"a":1}\n']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(object_text(F.col("x"))).collect()]
    assert got == ['{"line":3}', '{"a":1}', '{"a":"x y"}', None, "{}", "{}", None, '{"a":1}']
    days = [dt.date(1, 1, 1), dt.date(1582, 10, 4), DAY, dt.date(9999, 12, 31), None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in days], "x date").select(date_text(F.col("x"))).collect()]
    assert got == ["null" if d is None else f'"{d.isoformat()}"' for d in days]
