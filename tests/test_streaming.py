import hashlib
import os
import tempfile

from cobframe.sources.stores import read_snapshot_trades, read_snapshots, read_store_table
from cobframe.streaming.landing import READY, start_landing_ingest
from tests.test_ingest import AG_HEAD, TR_HEAD


def _land(root, date, ns, trades, ready=True, matrix=None, arrived=True, broken=""):
    d = os.path.join(root, date, "NORDBANK", ns)
    os.makedirs(d, exist_ok=True)
    files = {"agreement.csv": AG_HEAD + f"NORDBANK,{ns},{date},CSA-1,1000,10,USD,,\n",
             "trades.csv": TR_HEAD + "".join(f"NORDBANK,{ns},{date},{t},IRS,100,USD,PAY,\n" for t in trades) + broken,
             "market_data.csv": f"cob_date,data_type,key,value\n{date},fx_rate,EUR/NOK,11.9\n"}
    if matrix:
        listed = "sha256-v1:" + hashlib.sha256(matrix).hexdigest()
        files["matrices.csv"] = f"path,expected_hash\nmatrices/{date}/NORDBANK/{ns}/VOL.npy,{listed}\n"
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    if matrix and arrived:
        with open(os.path.join(d, "VOL.npy"), "wb") as f:
            f.write(matrix)
    if ready:
        _ready(root, date, ns)


def _ready(root, date, ns):
    with open(os.path.join(root, date, "NORDBANK", ns, READY), "w") as f:
        f.write("ready")


def _run(spark, landing, store, checkpoint):
    start_landing_ingest(spark, landing, store, checkpoint, available_now=True).awaitTermination(300)


def _folders():
    return [tempfile.mkdtemp(prefix=p) for p in ("landing-stream-", "store-stream-", "ckpt-stream-")]


def test_landing_stream_is_write_once(spark):
    landing, store, checkpoint = _folders()
    _land(landing, "2023-11-06", "SWAPS", ["S-1", "S-2"])
    _run(spark, landing, store, checkpoint)
    assert read_snapshots(spark, store).count() == 1
    _land(landing, "2023-11-07", "SWAPS", ["S-1"])
    _run(spark, landing, store, checkpoint)

    def sizes():
        return [read_store_table(spark, store, n).count()
                for n in ("snapshots", "snapshot_trades", "exposure_index", "trade_index")]
    assert sizes() == [2, 3, 2, 3]
    # a fresh checkpoint replays every folder, a new one among them
    _land(landing, "2023-11-08", "SWAPS", ["S-3"])
    _run(spark, landing, store, tempfile.mkdtemp(prefix="ckpt-stream-"))
    assert sizes() == [3, 4, 3, 4]


def test_folder_waits_for_its_marker(spark):
    landing, store, checkpoint = _folders()
    _land(landing, "2023-11-06", "SWAPS", [], ready=False)
    _run(spark, landing, store, checkpoint)
    assert read_snapshots(spark, store).count() == 0
    _land(landing, "2023-11-06", "SWAPS", ["S-1"])  # the trades came late
    _run(spark, landing, store, checkpoint)
    assert read_snapshots(spark, store).count() == 1
    assert read_snapshot_trades(spark, store).count() == 1


def test_matrices_and_broken_rows_come_with_the_folder(spark):
    landing, store, checkpoint = _folders()
    _land(landing, "2023-11-06", "SWAPS", ["S-1"], matrix=b"grid", broken="NORDBANK,SWAPS,2023-11-06,S-9,IRS,much,USD,PAY,\n")
    _land(landing, "2023-11-06", "BONDS", ["S-2"], matrix=b"other", arrived=False)
    _run(spark, landing, store, checkpoint)
    stored = read_snapshots(spark, store).collect()
    assert [s.netting_set_id for s in stored] == ["SWAPS"]
    assert stored[0].market_data.price_matrices["VOL"].path == "matrices/2023-11-06/NORDBANK/SWAPS/VOL.npy"
    assert [(r.reject_reason, r.detail) for r in read_store_table(spark, store, "rejects").collect()] == \
        [("UNPARSEABLE", "staging_trades notional=much")]
