"""The expressions that render canonical texts, against the Python rule."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from cobframe.functions import canonical, canonical_text
from cobframe.operators.integrity import native_hashes, snapshot_hashes, streamed_hashes
from tests.conftest import GOLDEN, frames_of, market, populated, sample_document, trade, whole_hash, agreement, HEADER_SCHEMA, TRADE_SCHEMA


def numbers():
    rnd = random.Random(11)
    out = [0.0, -0.0, 1.0, -1.0, 1e7, 1e-5, -1e-5, 1e-4, 9.99999e-5, 1e-10, 4e-11, -4e-11, 5e-11, 6e-11, 1.5e-10, 0.1, 0.30000000000000004,
           1e15, 1e16, 123456789.125, 2.675, 1e22, 999999999999999.9, 99999.9999999999, 1.0000000000499999, 1.00000000005, 3.0e-9,
           123456.7890123456, 1 / 3, 2 / 3, 100.0, 1e5, 5e-324, 1.7976931348623157e308, 8.41e21, 2.0e-3, 0.045]
    for _ in range(3000):
        out.append(rnd.choice([-1, 1]) * round(10 ** rnd.uniform(-11, 16), rnd.randint(0, 12)))
        out.append(rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 17))
        # close to half a unit of the tenth decimal
        out.append((rnd.randint(0, 10 ** rnd.randint(1, 9)) + 0.5) * 1e-10)
        out.append(float(f"{rnd.randint(0, 999)}.{rnd.randint(0, 10 ** 10 - 1):010d}5"))
    return out


def test_numbers_are_spelled_as_python_does(spark):
    xs = numbers()
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [(r.x, r.t) for r in frame.select("x", canonical_text.number_text(F.col("x")).alias("t")).collect()]
    wrong = [(x, t, canonical._number(x)) for x, t in got if t is not None and t != canonical._number(x)]
    assert wrong == []
    plain = {0.0: "0.0", 1e7: "10000000.0", 1e-5: "1e-05", -4e-11: "-0.0", 1e-10: "1e-10", 0.045: "0.045", 2.675: "2.675"}
    assert {x: t for x, t in got if x in plain and str(x) != "-0.0"} == plain
    assert next(t for x, t in got if str(x) == "-0.0") == "-0.0"
    # what cannot be proven is left to Python, and that is the smaller part of ordinary amounts
    ordinary = [t for x, t in got if abs(x) < 1e12 and x == round(x, 2)]
    assert ordinary and None not in ordinary


def test_missing_and_non_finite_numbers(spark):
    frame = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    got = frame.select(canonical_text.number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["null", None, None, None]


def test_strings(spark):
    texts = ["", "plain", "a b~!#[]", 'quo"te', "back\\slash", "é", "tab\t", "\x7f", "line\n", None]
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.t for r in frame.select(canonical_text.string_text(F.col("s")).alias("t")).collect()]
    for text, t in zip(texts, got, strict=True):
        assert t is None or t == canonical._text(text)
    assert got[:3] == ['""', '"plain"', '"a b~!#[]"'] and got[3:9] == [None] * 6 and got[9] == "null"


def test_objects(spark):
    texts = ["{}", " { } ", "", None, '{"a":1}', '{ "a" : 1 , "b" : "x y" }', '{"b":1,"a":2}', '{"a":1,"a":2}', '{"a":-0}', '{"a":-0.0}',
             '{"a":1.50}', '{"a":1.5}', '{"a":0.00001}', '{"a":0.0001}', '{"a":0.12345678901}', '{"a":1e5}', '{"a":[1]}', '{"a":{"b":1}}',
             '{"a":"\\u00e9"}', '{"é":1}', '{"a":true,"b":false,"c":null}', '{"a":"1 ,2"}', '{"a":12345678901234567890}', '{"a":01}', '[1]',
             '{"a":1}}', '{"a":123456.5}', '{"A":1,"a":2}', '{"a":1,"A":2}', '{"a b":"  "}']
    frame = spark.createDataFrame([(t,) for t in texts], "e string")
    got = [r.t for r in frame.select(canonical_text.object_text(F.col("e")).alias("t")).collect()]
    for text, t in zip(texts, got, strict=True):
        if t is not None:
            assert t == canonical._dumps(canonical.loads_rounded(text) if text else {}), text
    proven = {text for text, t in zip(texts, got, strict=True) if t is not None}
    assert proven == {"{}", " { } ", "", None, '{"a":1}', '{ "a" : 1 , "b" : "x y" }', '{"a":-0.0}', '{"a":1.5}', '{"a":0.0001}',
                      '{"a":true,"b":false,"c":null}', '{"a":"1 ,2"}', '{"a":12345678901234567890}', '{"A":1,"a":2}', '{"a b":"  "}'}


def hashes(frame):
    return {(r.counterparty_id, r.netting_set_id, r.cob_date): r.data_hash for r in frame.collect()}


def test_golden_vector_is_native(spark):
    headers, trades = frames_of(spark, sample_document())
    assert set(hashes(native_hashes(headers, trades)).values()) == {GOLDEN} == {whole_hash(sample_document())}


def mixed(spark):
    day = dt.date(2024, 2, 29)
    heads = [("CP", f"N{i}", day, agreement(threshold=x, extra=extra), market(fx={"A/B": x, "Z": 1e-5}, inf={}, matrices={"IR": ("p", "h")}), 0.0, None)
             for i, (x, extra) in enumerate([(1.0, "{}"), (None, '{"b":1,"a":2}'), (1 / 3, '{"a":1}'), (-0.0, ""), (2.5, '{"n":"é"}'), (4.0, None)])]
    trades = [trade("CP", f"N{i % 5}", day, f"T-{i}", "IRS" if i % 7 else "swäp", i * 1.25, "EUR", "PAY", None, '{"line":%d}' % i) for i in range(200)]
    return spark.createDataFrame(heads, HEADER_SCHEMA).repartition(3), spark.createDataFrame(trades, TRADE_SCHEMA).repartition(4)


def test_each_way_gives_the_same_hashes(spark):
    headers, trades = mixed(spark)
    want = hashes(streamed_hashes(headers, trades))
    assert len(want) == 6
    assert hashes(snapshot_hashes(headers, trades)) == want
    assert hashes(snapshot_hashes(headers, trades, most_trades=1)) == want
    assert hashes(snapshot_hashes(headers, trades, most_trades=39)) == want
    native = hashes(native_hashes(headers, trades))
    assert {ns for (_, ns, _), v in native.items() if v is None} == {"N0", "N1", "N2", "N3", "N4"}  # a trade with a letter beyond ASCII
    few = trades.where("product_type = 'IRS'")
    some, all_of = hashes(native_hashes(headers, few)), hashes(streamed_hashes(headers, few))
    assert {ns for (_, ns, _), v in some.items() if v is None} == {"N1", "N4"}
    assert {k: v for k, v in some.items() if v is not None}.items() <= all_of.items()
    assert hashes(snapshot_hashes(headers, few)) == all_of


def test_stored_positions_order_the_trades(spark):
    headers, trades = populated(spark)
    back = trades.withColumn("position", -F.xxhash64("trade_id"))
    assert hashes(snapshot_hashes(headers, back)) == hashes(streamed_hashes(headers, back))
    assert hashes(snapshot_hashes(headers, back)) != hashes(snapshot_hashes(headers, trades))


def test_native_plan_has_no_python(spark):
    headers, trades = populated(spark)
    for part in (native_hashes(headers, trades), snapshot_hashes(headers, trades)):
        plan = part._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_python_dumps_what_the_constants_say():
    assert json.dumps({"x": round(1e-5, 10)}) == '{"x": 1e-05}'


def test_whole_numbers_of_up_to_fifteen_digits_are_proven(spark):
    values = [0.0, -0.0, 1.0, -7.0, 50000.0, 1e6, 123456789012345.0, -999999999999999.0, 0.5, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", canonical_text.number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [json.dumps(r.x) for r in rows]
    big = spark.createDataFrame([(1e15,), (float("nan"),), (float("inf"),)], "x double").select(canonical_text.number_text(F.col("x")).alias("t"))
    assert [r.t for r in big.collect()] == [None] * 3
