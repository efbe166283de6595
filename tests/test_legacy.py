import json
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

from cobframe.operators.integrity import audit_integrity
from cobframe.sources.legacy import migrate_json_layout, read_json_layout
from cobframe.sources.stores import read_exposure_index, read_snapshots
from tests.conftest import sample_document, whole_hash


def _write_layout(root, reverse=False):
    doc = sample_document()
    if reverse:
        doc["trades"] = doc["trades"][::-1]
    doc["data_hash"] = whole_hash(doc)
    d = os.path.join(root, "snapshots", doc["counterparty_id"], doc["netting_set_id"])
    os.makedirs(d)
    pq.write_table(pa.table({
        "counterparty_id": [doc["counterparty_id"]], "netting_set_id": [doc["netting_set_id"]],
        "cob_date": [doc["cob_date"]], "agreement_json": [json.dumps(doc["agreement"])],
        "trades_json": [json.dumps(doc["trades"])], "market_data_json": [json.dumps(doc["market_data"])],
        "data_hash": [doc["data_hash"]], "ingested_at": ["2024-03-15T18:00:00+00:00"]}),
        os.path.join(d, "2024-03-15.parquet"))
    for name, table in (("index", {"counterparty_id": ["ACME-CORP"], "netting_set_id": ["RATES-USD"],
                                   "cob_date": ["2024-03-15"], "exposure_total": [1000000.0],
                                   "snapshot_path": ["x"], "ingested_at": ["2024-03-15T18:00:00+00:00"]}),
                        ("trade_index", {"trade_id": ["T-001", "T-002"],
                                         "counterparty_id": ["ACME-CORP"] * 2,
                                         "netting_set_id": ["RATES-USD"] * 2,
                                         "cob_date": ["2024-03-15"] * 2})):
        os.makedirs(os.path.join(root, name))
        pq.write_table(pa.table(table), os.path.join(root, name, "2024-03-15.parquet"))
        pq.write_table(pa.table(table), os.path.join(root, name, "notes.parquet"))  # ignored
    return doc


def test_read_json_layout(spark):
    root = tempfile.mkdtemp(prefix="json-layout-")
    doc = _write_layout(root)
    t = read_json_layout(spark, root)
    snap = t["snapshots"].collect()
    assert len(snap) == 1 and snap[0].agreement.extra == "{}"
    assert snap[0].market_data.fx_rates == {"USD/GBP": 0.79, "USD/EUR": 0.92}
    assert [r.trade_id for r in t["trades"].orderBy("position").collect()] == ["T-001", "T-002"]
    assert t["exposure_index"].count() == 1 and t["trade_index"].count() == 2
    audit = audit_integrity(t["snapshots"], t["trades"]).collect()
    assert [a.status for a in audit] == ["OK"] and audit[0].stored_hash == doc["data_hash"]


def test_stored_trade_order_is_hashed(spark):
    root = tempfile.mkdtemp(prefix="json-layout-")
    doc = _write_layout(root, reverse=True)
    t = read_json_layout(spark, root)
    audit = audit_integrity(t["snapshots"], t["trades"]).collect()
    assert [a.status for a in audit] == ["OK"] and audit[0].stored_hash == doc["data_hash"]
    # without the stored order, trade_id order gives a different document
    assert audit_integrity(t["snapshots"], t["trades"].drop("position")).collect()[0].status == "MISMATCH"


def test_migrate_json_layout(spark):
    root = tempfile.mkdtemp(prefix="json-layout-")
    _write_layout(root)
    store = migrate_json_layout(spark, root, tempfile.mkdtemp(prefix="migrated-"))
    migrate_json_layout(spark, root, store)  # once committed, done
    assert read_snapshots(spark, store).count() == 1
    assert read_exposure_index(spark, store).collect()[0].exposure_total == 1000000.0
