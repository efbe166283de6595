import copy
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from cobframe.operators.integrity import audit_integrity, snapshot_hashes
from tests.conftest import (GOLDEN, HEADER_SCHEMA, TRADE_SCHEMA, agreement, frames_of, market, populated,
                            sample_document, trade, whole_hash)


def spark_hash(spark, doc):
    headers, trades = frames_of(spark, doc)
    rows = snapshot_hashes(headers, trades).collect()
    assert len(rows) == 1
    return rows[0].data_hash


def test_golden_vector(spark):
    assert whole_hash(sample_document()) == GOLDEN
    assert spark_hash(spark, sample_document()) == GOLDEN


def _nested_hash_key(doc):
    doc["agreement"]["extra"] = {"data_hash": "x"}


def _amended(doc):
    doc["trades"][0]["notional"] = 10000000.5


def _integer(doc):
    doc["trades"][1]["extra"] = {"a": 1, "b": [1.5, {"c": None}], "ü": "\u2028"}


def _float(doc):
    doc["trades"][1]["extra"] = {"a": 1.0, "b": [1.5, {"c": None}], "ü": "\u2028"}


def _digits(doc):
    doc["agreement"]["threshold_amount"] = 0.12345678901234
    doc["agreement"]["rounding_amount"] = 1e-11
    doc["trades"][0]["notional"] = 1e16
    doc["trades"][1]["notional"] = -1e-7


def test_every_change_tells_and_equals_the_whole_document_hash(spark):
    seen = {GOLDEN}
    for change in (_nested_hash_key, _amended, _integer, _float, _digits):
        doc = copy.deepcopy(sample_document())
        change(doc)
        got = spark_hash(spark, doc)
        assert got == whole_hash(doc)
        seen.add(got)
    assert len(seen) == 6


def test_data_hash_itself_is_left_out():
    assert whole_hash(dict(sample_document(), data_hash="sha256-v1:anything")) == GOLDEN


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_non_finite_has_no_hash(spark, bad):
    doc = sample_document()
    doc["trades"][0]["notional"] = bad
    with pytest.raises(ValueError):
        whole_hash(doc)
    with pytest.raises(Exception, match="Non-finite"):
        spark_hash(spark, doc)


def test_cached_texts_are_bounded_by_their_size():
    from cobframe.functions.canonical import TextCache
    cache = TextCache(most_chars=100)
    for i in range(50):
        assert cache.get(str(i), lambda k: k * 10) == str(i) * 10
        assert cache.held <= 100


def _python_docs(headers, trades):
    """Brute-force reference: nested documents built on the driver from a
    small fixture, hashed with the plain Python rule."""
    docs = {}
    for r in headers.collect():
        ag = r.agreement.asDict()
        ag["extra"] = json.loads(ag["extra"])
        md = r.market_data.asDict(recursive=True)
        docs[(r.counterparty_id, r.netting_set_id, r.cob_date)] = {
            "counterparty_id": r.counterparty_id, "netting_set_id": r.netting_set_id,
            "cob_date": r.cob_date.isoformat(), "agreement": ag, "market_data": md, "trades": []}
    for t in sorted(trades.collect(), key=lambda t: t.trade_id):
        d = t.asDict()
        key = (d.pop("counterparty_id"), d.pop("netting_set_id"), d.pop("cob_date"))
        d["extra"] = json.loads(d["extra"])
        d["maturity_date"] = d["maturity_date"].isoformat() if d["maturity_date"] else None
        docs[key]["trades"].append(d)
    return {k: whole_hash(v) for k, v in docs.items()}


def test_streamed_hash_matches_brute_force_many_partitions(spark):
    rnd = random.Random(7)
    d0 = dt.date(2024, 1, 1)
    heads, trs = [], []
    for i in range(60):
        cp, ns, d = f"CP-{i % 7}", f"NS-{i % 3}", d0 + dt.timedelta(days=i // 21)
        fx = {f"P{j}": round(rnd.random(), 4) for j in range(rnd.randint(0, 3))}
        heads.append((cp, ns, d, agreement(threshold=float(i), extra='{"k":%d,"f":1.5}' % i),
                      market(fx=fx, inf={}, matrices={"IR": ("m/x.npy", "sha256-v1:ab")} if i % 5 == 0
                             else {}), float(i), None))
        # one hot snapshot with many trades, others with a few
        n = 400 if i == 0 else rnd.randint(0, 4)
        for k in range(n):
            trs.append(trade(cp, ns, d, f"T-{k}", "IRS", round(rnd.uniform(-1e6, 1e6), 2), "EUR",
                             "PAY", d if k % 2 else None, '{"line":%d}' % k))
    headers = spark.createDataFrame(heads, HEADER_SCHEMA).repartition(5)
    trades = spark.createDataFrame(trs, TRADE_SCHEMA).repartition(7)
    got = {(r.counterparty_id, r.netting_set_id, r.cob_date): r.data_hash
           for r in snapshot_hashes(headers, trades).collect()}
    want = _python_docs(headers, trades)
    assert len(got) == len(want) == len(set((h[0], h[1], h[2]) for h in heads))
    assert got == want


def test_audit_detects_tampering(spark):
    headers, trades = populated(spark)
    hashed = headers.join(snapshot_hashes(headers, trades),
                          ["counterparty_id", "netting_set_id", "cob_date"])
    ok = audit_integrity(hashed, trades).collect()
    assert {r.status for r in ok} == {"OK"}
    tampered = trades.withColumn("notional", F.when(F.col("trade_id") == "FW-5", 1.0)
                                 .otherwise(F.col("notional")))
    bad = {(r.cob_date.isoformat(), r.status) for r in audit_integrity(hashed, tampered).collect()
           if r.status != "OK"}
    assert bad == {("2023-11-07", "MISMATCH")}
