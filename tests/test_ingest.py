import datetime as dt
import hashlib
import json
import os
import tempfile

from pyspark.sql import functions as F

from cobframe.operators import assemble as A
from cobframe.operators import integrity as H
from cobframe.operators import store as K
from cobframe.operators import validate as V
from cobframe.operators.ingest import (backfill_counts, ingest_batch, ingest_outcomes,
                                       ingest_status)
from cobframe.sources.staging import (load_landing_csv, read_staging_agreements,
                                      read_staging_market_data, read_staging_trades)
from cobframe.sources.stores import read_exposure_index, read_snapshots, read_trade_index, \
    scan_matrix_files
from tests.conftest import MON, TUE, whole_hash

AG_COLS = ("counterparty_id string, netting_set_id string, cob_date date, agreement_id string, "
           "threshold_amount decimal(38,10), minimum_transfer_amount decimal(38,10), "
           "independent_amount decimal(38,10), currency string, eligible_collateral array<string>, "
           "rounding_amount decimal(38,10), valuation_agent string, extra string, "
           "ingested_at timestamp")
TR_COLS = ("counterparty_id string, netting_set_id string, cob_date date, trade_id string, "
           "product_type string, notional decimal(38,10), currency string, direction string, "
           "maturity_date date, extra string, ingested_at timestamp")
MD_COLS = "cob_date date, data_type string, key string, value decimal(38,10), ingested_at timestamp"
T0 = dt.datetime(2023, 11, 6, 18, 0)


def dec(x):
    import decimal
    return None if x is None else decimal.Decimal(str(x))


def staging(spark):
    ag = spark.createDataFrame([
        ("ACME", "RATES-USD", MON, "ISDA-1", dec(5e6), None, dec(0), "", None, dec(0), None, None, T0),
        ("ACME", "EMPTY", MON, "ISDA-2", dec(1), dec(2), dec(0), "EUR", ["USD_CASH"], dec(0), "X",
         '{"a":1}', T0),
        ("ACME", "RATES-USD", MON, "ISDA-LATE", dec(9), dec(9), dec(0), "GBP", None, dec(0), None,
         None, T0 + dt.timedelta(hours=1)),
        ("BAD/ID", "NS", MON, "ISDA-3", dec(1), dec(1), dec(0), "USD", None, dec(0), None, None, T0),
        ("ACME\n", "NS", MON, "ISDA-4", dec(1), dec(1), dec(0), "USD", None, dec(0), None, None, T0),
    ], AG_COLS)
    tr = spark.createDataFrame([
        ("ACME", "RATES-USD", MON, "T-1", None, dec(100), "", None, None, None, T0),
        ("ACME", "RATES-USD", MON, "T-1", "IRS", dec(999), "USD", "PAY", None, None,
         T0 + dt.timedelta(hours=1)),
        ("ACME", "RATES-USD", MON, "T-2", "CDS", None, "GBP", "RECEIVE", TUE, '{"x":1.5}', T0),
        ("NOBODY", "NS", MON, "T-9", "IRS", dec(1), "USD", "PAY", None, None, T0),
    ], TR_COLS)
    md = spark.createDataFrame([
        (MON, "fx_rate", "USD/GBP", dec(0.79), T0),
        (MON, "inflation_rate", "UK_RPI", dec(0.031), T0),
        (MON, "vol_surface", "V", dec(1), T0),
    ], MD_COLS)
    return (read_staging_agreements(ag), read_staging_trades(tr), read_staging_market_data(md))


def test_staging_numeric_coercion(spark):
    ag, tr, _ = staging(spark)
    row = ag.where(F.col("agreement_id") == "ISDA-1").collect()[0]
    assert row.minimum_transfer_amount == 0.0 and isinstance(row.threshold_amount, float)
    assert tr.where(F.col("trade_id") == "T-2").collect()[0].notional == 0.0


def test_validate_ids_rejects_paths_and_newline(spark):
    ag, _, _ = staging(spark)
    checked = V.validate_ids(ag)
    assert sorted(r.counterparty_id for r in checked.rejects.collect()) == ["ACME\n", "BAD/ID"]
    assert {r.reject_reason for r in checked.rejects.collect()} == {"INVALID_ID"}


def test_absent_id_is_a_missing_field(spark):
    ag, _, _ = staging(spark)
    none = ag.withColumn("netting_set_id", F.lit(None).cast("string"))
    assert {r.reject_reason for r in V.validate_ids(none).rejects.collect()} == {"MISSING_FIELD"}


def test_tied_copies_are_all_accounted_for(spark):
    ag, _, _ = staging(spark)
    one = ag.where(F.col("agreement_id") == "ISDA-2")
    other = one.withColumn("agreement_id", F.lit("ISDA-1B"))
    checked = V.reject_duplicates(one.unionByName(one).unionByName(one).unionByName(other), ["ingested_at"])
    assert [r.agreement_id for r in checked.good.collect()] == ["ISDA-1B"]
    assert [(r.reject_reason, r.detail) for r in checked.rejects.collect()] == [("DUPLICATE", "later copy in batch")] * 3
    stored = checked.good.select("counterparty_id", "netting_set_id", "cob_date")
    again = V.reject_duplicates(one.unionByName(one), ["ingested_at"], stored)
    assert again.good.count() == 0 and {r.detail for r in again.rejects.collect()} == {"already stored"}
    assert again.rejects.count() == 2


def test_duplicates_first_arrival_wins(spark):
    ag, _, _ = staging(spark)
    good = V.validate_ids(ag).good
    checked = V.reject_duplicates(good, ["ingested_at"])
    ids = {r.agreement_id for r in checked.good.collect()}
    assert ids == {"ISDA-1", "ISDA-2"}
    assert [r.reject_reason for r in checked.rejects.collect()] == ["DUPLICATE"]
    existing = spark.createDataFrame([("ACME", "EMPTY", MON)], "counterparty_id string, netting_set_id string, cob_date date")
    again = V.reject_duplicates(good, ["ingested_at"], existing)
    assert {r.agreement_id for r in again.good.collect()} == {"ISDA-1"}
    assert again.rejects.count() == 2


def test_ingest_assembles_with_defaults(spark):
    ag, tr, md = staging(spark)
    r = ingest_batch(ag, tr, md)
    snaps = {r.netting_set_id: r for r in r.snapshots.collect()}
    assert set(snaps) == {"RATES-USD", "EMPTY"}
    a = snaps["RATES-USD"].agreement
    assert (a.currency, a.eligible_collateral, a.extra, a.minimum_transfer_amount) == \
        ("USD", [], "{}", 0.0)
    assert snaps["RATES-USD"].market_data.fx_rates == {"USD/GBP": 0.79}
    assert "V" not in snaps["RATES-USD"].market_data.inflation_rates
    trades = {t.trade_id: t for t in r.trades.collect()}
    assert set(trades) == {"T-1", "T-2"}             # NOBODY's trade has no agreement
    assert trades["T-1"].notional == 100.0           # first arrival wins
    assert (trades["T-1"].product_type, trades["T-1"].currency, trades["T-1"].direction) == \
        ("UNKNOWN", "USD", "PAY")
    assert r.trades.where(F.col("netting_set_id") == "EMPTY").count() == 0
    outcomes = {o.cob_date: o for o in ingest_outcomes(r).collect()}
    assert (outcomes[MON].posted, outcomes[MON].skipped, outcomes[MON].errors) == (2, 1, 2)


def test_hash_of_ingested_snapshot_matches_python(spark):
    ag, tr, md = staging(spark)
    r = ingest_batch(ag, tr, md)
    got = {x.netting_set_id: x.data_hash for x in r.hashed().collect()}
    doc = {"counterparty_id": "ACME", "netting_set_id": "RATES-USD", "cob_date": "2023-11-06",
           "agreement": {"agreement_id": "ISDA-1", "threshold_amount": 5000000.0,
                         "minimum_transfer_amount": 0.0, "independent_amount": 0.0, "currency": "USD",
                         "eligible_collateral": [], "rounding_amount": 0.0, "valuation_agent": None,
                         "extra": {}},
           "trades": [{"trade_id": "T-1", "product_type": "UNKNOWN", "notional": 100.0, "currency": "USD",
                       "maturity_date": None, "direction": "PAY", "extra": {}},
                      {"trade_id": "T-2", "product_type": "CDS", "notional": 0.0, "currency": "GBP",
                       "maturity_date": "2023-11-07", "direction": "RECEIVE", "extra": {"x": 1.5}}],
           "market_data": {"fx_rates": {"USD/GBP": 0.79}, "inflation_rates": {"UK_RPI": 0.031},
                           "price_matrices": {}}}
    assert got["RATES-USD"] == whole_hash(doc)


def test_non_finite_rejected_but_exposure_not_checked(spark):
    ag, tr, md = staging(spark)
    tr_nan = tr.withColumn("notional", F.when(F.col("trade_id") == "T-2", F.lit(float("nan")))
                           .otherwise(F.col("notional")))
    exp = spark.createDataFrame([("ACME", "EMPTY", MON, float("inf"))],
                                "counterparty_id string, netting_set_id string, cob_date date, exposure_total double")
    r = ingest_batch(ag, tr_nan, md, exposure=exp)
    assert [x.netting_set_id for x in r.snapshots.collect()] == ["EMPTY"]
    assert [(x.reject_reason, x.detail) for x in r.rejects.where("reject_reason = 'NON_FINITE'").collect()] \
        == [("NON_FINITE", "T-2")]


def test_missing_matrix_reference_rejected(spark):
    ag, tr, md = staging(spark)
    refs = spark.createDataFrame([("ACME", "EMPTY", MON, "IR", "matrices/2023-11-06/ACME/EMPTY/lost.npy", "h")],
                                 "counterparty_id string, netting_set_id string, cob_date date, "
                                 "instrument string, path string, hash string")
    inv = spark.createDataFrame([("matrices/other.npy",)], "path string")
    r = ingest_batch(ag, tr, md, matrix_refs=refs, matrix_inventory=inv)
    rej = r.rejects.where("reject_reason = 'MISSING_MATRIX'").collect()
    assert [(x.netting_set_id, x.detail) for x in rej] == [("EMPTY", "matrices/2023-11-06/ACME/EMPTY/lost.npy")]


def test_parse_matrix_key(spark):
    df = spark.createDataFrame([("matrices/2023-11-06/ACME/RATES-USD/IR_SWAP.npy",),
                                ("matrices/2023-11-06/ACME/IR.npy",),
                                ("matrices/2023-11-06/ACME/NS/a/b.v1.npy",),
                                ("matrices/2023-11-06/ACME/NS/plain",)], "path string")
    rows = A.parse_matrix_key(df).collect()
    assert [(r.parsed, r.counterparty_id, r.netting_set_id, r.instrument) for r in rows] == [
        (True, "ACME", "RATES-USD", "IR_SWAP"), (False, None, None, None),
        (True, "ACME", "NS", "a.b.v1"), (True, "ACME", "NS", "plain")]
    assert rows[0].cob_date == MON


def test_matrix_files_verify_and_completeness(spark):
    root = tempfile.mkdtemp(prefix="matrices+(x)-")  # no pattern, a plain name
    base = os.path.join(root, "matrices", "2023-11-06", "ACME")
    files = {"RATES-USD/IR_SWAP.npy": b"grid of fifteen scenarios", "EMPTY/FX.npy": b"\x00\x01 spots",
             "EMPTY/VOL.npy": b"vol"}
    for rel, data in files.items():
        os.makedirs(os.path.dirname(os.path.join(base, rel)), exist_ok=True)
        with open(os.path.join(base, rel), "wb") as f:
            f.write(data)
    scanned = scan_matrix_files(spark, root)
    hashed = H.hash_matrices(scanned)
    got = {r.path: r.actual_hash for r in hashed.collect()}
    assert got["matrices/2023-11-06/ACME/RATES-USD/IR_SWAP.npy"] == \
        "sha256-v1:" + hashlib.sha256(b"grid of fifteen scenarios").hexdigest()
    manifest = spark.createDataFrame([
        ("matrices/2023-11-06/ACME/RATES-USD/IR_SWAP.npy", got["matrices/2023-11-06/ACME/RATES-USD/IR_SWAP.npy"]),
        ("matrices/2023-11-06/ACME/EMPTY/FX.npy", "sha256-v1:" + "0" * 64),
        ("matrices/2023-11-06/ACME/EMPTY/VOL.npy", "")], "path string, expected_hash string")
    listed = manifest.unionByName(spark.createDataFrame(
        [("matrices/2023-11-06/ACME/RATES-USD/NEVER.npy", "sha256-v1:" + "1" * 64)], manifest.schema))
    late = H.verify_matrices(hashed, listed)
    assert {r.path.rsplit("/", 1)[1] for r in late.where("status = 'MISSING'").collect()} == {"NEVER.npy"}
    ag, tr, md = staging(spark)
    waiting = ingest_batch(ag, tr, md, matrix_files=scanned, manifest=listed)
    got = {c.netting_set_id: (c.n_expected, c.n_missing, c.status) for c in waiting.completeness.collect()}
    assert got == {"RATES-USD": (2, 1, "INCOMPLETE"), "EMPTY": (2, 2, "INCOMPLETE")}
    assert waiting.snapshots.count() == 0
    verified = {r.path.rsplit("/", 1)[1]: r.status for r in H.verify_matrices(hashed, manifest).collect()}
    assert verified == {"IR_SWAP.npy": "OK", "FX.npy": "MISMATCH", "VOL.npy": "NO_HASH"}
    ag, tr, md = staging(spark)
    r = ingest_batch(ag, tr, md, matrix_files=scanned, manifest=manifest)
    comp = {c.netting_set_id: c.status for c in r.completeness.collect()}
    assert comp == {"RATES-USD": "COMPLETE", "EMPTY": "INCOMPLETE"}
    snap = r.snapshots.collect()
    assert [s.netting_set_id for s in snap] == ["RATES-USD"]
    assert snap[0].market_data.price_matrices["IR_SWAP"].hash.startswith("sha256-v1:")
    oc = ingest_outcomes(r).collect()[0]
    assert (oc.posted, oc.incomplete, oc.errors) == (1, 1, 3)   # 2 bad ids + 1 mismatching file
    audit = H.audit_matrix_refs(r.snapshots, hashed).collect()
    assert [a.status for a in audit] == ["OK"]


def test_backfill_spine_and_status(spark):
    ag, tr, md = staging(spark)
    r = ingest_batch(ag, tr, md)
    rows = backfill_counts(r, "2023-11-05", "2023-11-07").collect()
    assert [x.cob_date for x in rows] == [dt.date(2023, 11, 5), MON, TUE, None]
    assert rows[0].posted == 0 and rows[-1].posted == 2
    st = {(x.counterparty_id, x.netting_set_id): x.stored for x in ingest_status(ag, r.snapshots).collect()}
    assert st[("ACME", "RATES-USD")] is True and st[("BAD/ID", "NS")] is False


AG_HEAD = ("counterparty_id,netting_set_id,cob_date,agreement_id,threshold_amount,minimum_transfer_amount,currency,"
           "eligible_collateral,valuation_agent\n")
TR_HEAD = "counterparty_id,netting_set_id,cob_date,trade_id,product_type,notional,currency,direction,maturity_date\n"


def land(root, ns, agreements="", trades=None, market=None):
    d = os.path.join(root, "2023-11-06", "ACME", ns)
    os.makedirs(d)
    for name, head, rows in (("agreement.csv", AG_HEAD, agreements), ("trades.csv", TR_HEAD, trades),
                             ("market_data.csv", "cob_date,data_type,key,value\n", market)):
        if rows is not None:
            with open(os.path.join(d, name), "w") as f:
                f.write(head + rows)


def test_landing_csv_insert_if_absent(spark):
    root = tempfile.mkdtemp(prefix="landing-")
    key = "ACME,RATES-USD,2023-11-06"
    land(root, "RATES-USD", f'{key},ISDA-1,5000000,,USD,"{{USD_CASH,US_TREASURY}}",\n',
         f"{key},T-1,IRS,100,USD,PAY,\n{key},T-1,IRS,200,USD,PAY,\n{key},T-2,CDS,5,USD,RECEIVE,2025-01-01\n",
         "2023-11-06,fx_rate,USD/GBP,0.79\n")
    existing = spark.createDataFrame([("ACME", "RATES-USD", MON, "T-2")],
                                     "counterparty_id string, netting_set_id string, cob_date date, trade_id string")
    out = load_landing_csv(spark, root, existing_trades=existing)
    ag = out["staging_agreements"].collect()
    assert len(ag) == 1 and ag[0].minimum_transfer_amount is None   # absent, not spoilt
    assert ag[0].eligible_collateral == ["USD_CASH", "US_TREASURY"]
    assert ag[0].independent_amount == 0 and ag[0].extra == "{}"
    assert [(t.trade_id, t.notional) for t in out["staging_trades"].collect()] == [("T-1", 100.0)]
    assert out["staging_market_data"].count() == 1
    assert out["landing_rejects"].count() == 0


def test_landing_rejects_what_does_not_parse(spark):
    root = tempfile.mkdtemp(prefix="landing-")
    land(root, "A", "ACME,A,2023-11-06,I,1.000.000,1,USD,,\nACME,A,,I,1,1,USD,,\nACME,A,2023-11-06,,1,1,USD,,\n",
         "ACME,A,2023-11-06,T-1,IRS,1e6x,USD,PAY,\nACME,A,15/03/2024,T-2,IRS,1,USD,PAY,\nACME,A,2023,T-3,IRS,1,USD,PAY,\n"
         "ACME,A,2023-11-06,T-4,IRS,1,USD,PAY,soon\nACME,A,2023-11-06,T-5,IRS,,USD,PAY,\n",
         "2023-11-06,fx_rate,P,n/a\n2023-11-06,fx_rate,Q,\n2023-11-06,fx_rate,R,1e999\n")
    out = load_landing_csv(spark, root)
    got = sorted((r.table_name, r.reject_reason, r.detail) for r in out["landing_rejects"].collect())
    assert got == [("staging_agreements", "MISSING_FIELD", "agreement_id"), ("staging_agreements", "MISSING_FIELD", "cob_date"),
                   ("staging_agreements", "UNPARSEABLE", "threshold_amount=1.000.000"),
                   ("staging_market_data", "MISSING_FIELD", "value"), ("staging_market_data", "UNPARSEABLE", "value=n/a"),
                   ("staging_trades", "UNPARSEABLE", "cob_date=15/03/2024"), ("staging_trades", "UNPARSEABLE", "cob_date=2023"),
                   ("staging_trades", "UNPARSEABLE", "maturity_date=soon"), ("staging_trades", "UNPARSEABLE", "notional=1e6x")]
    assert out["staging_agreements"].count() == 0
    assert [(t.trade_id, t.notional) for t in out["staging_trades"].collect()] == [("T-5", None)]
    assert [m.value for m in out["staging_market_data"].collect()] == [float("inf")]  # V2's to reject


def test_landing_rejects_rows_of_a_wrong_shape(spark):
    """Short, long and shifted rows of real files, with their whole text."""
    root = tempfile.mkdtemp(prefix="landing-")
    land(root, "A", "ACME,A,2023-11-06,I,1,1,USD,,\nACME,A,2023-11-06,J,1\n",
         "ACME,A,2023-11-06,T-1,IRS\n"                                        # five of nine fields
         "ACME,A,2023-11-06,T-2,IRS,1,USD,PAY,,x,y\n"                          # two too many
         "ACME,A,2023-11-06,T-3,Swap, fixed,100,USD,PAY,\n"                    # an unquoted comma
         'ACME,A,2023-11-06,T-4,"Swap, fixed",100,USD,PAY,2025-01-01\n'
         "ACME,A,2023-11-06,T-5,IRS,,USD,PAY,\n",
         "2023-11-06,fx_rate,P\n2023-11-06,fx_rate,Q,1.5,7\n2023-11-06,fx_rate,R,2\n")
    out = load_landing_csv(spark, root)
    got = sorted((r.table_name, r.counterparty_id, r.netting_set_id, r.cob_date, r.reject_reason, r.detail)
                 for r in out["landing_rejects"].collect())
    folder = ("ACME", "A", "2023-11-06", "MALFORMED")
    assert got == [("staging_agreements", *folder, "ACME,A,2023-11-06,J,1"),
                   ("staging_market_data", *folder, "2023-11-06,fx_rate,P"), ("staging_market_data", *folder, "2023-11-06,fx_rate,Q,1.5,7"),
                   ("staging_trades", *folder, "ACME,A,2023-11-06,T-1,IRS"),
                   ("staging_trades", *folder, "ACME,A,2023-11-06,T-2,IRS,1,USD,PAY,,x,y"),
                   ("staging_trades", *folder, "ACME,A,2023-11-06,T-3,Swap, fixed,100,USD,PAY,")]
    assert [a.agreement_id for a in out["staging_agreements"].collect()] == ["I"]
    trades = sorted((t.trade_id, t.product_type, t.notional, t.currency) for t in out["staging_trades"].collect())
    assert trades == [("T-4", "Swap, fixed", 100.0, "USD"), ("T-5", "IRS", None, "USD")]
    assert [(m.key, m.value) for m in out["staging_market_data"].collect()] == [("R", 2.0)]
    # a narrow read of the typed rows parses whole rows all the same
    assert out["staging_market_data"].select("key").collect() == [("R",)]
    assert out["landing_rejects"].where("reject_reason = 'MALFORMED'").count() == 6


def test_landing_numbers_keep_their_size(spark):
    root = tempfile.mkdtemp(prefix="landing-")
    land(root, "A", "ACME,A,2023-11-06,I,0.00000000004,1e29,USD,,\n", "ACME,A,2023-11-06,T,IRS,4e-11,USD,PAY,\n")
    out = load_landing_csv(spark, root)
    ag = out["staging_agreements"].collect()[0]
    assert (ag.threshold_amount, ag.minimum_transfer_amount) == (4e-11, 1e29)
    assert out["staging_trades"].collect()[0].notional == 4e-11
    assert out["staging_market_data"].count() == 0  # no such file at all


def test_collateral_literals(spark):
    from cobframe.sources.staging import parse_collateral
    texts = ["{}", "{ }", "{A,B}", '{"A, B",C}', '{"say \\"x\\"",D}', "A,B", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "eligible_collateral string")
    got = [r[0] for r in rows.select(parse_collateral()).collect()]
    assert got == [[], [], ["A", "B"], ["A, B", "C"], ['say "x"', "D"], ["A", "B"], None, None]


def test_quoted_literal_in_a_file(spark):
    root = tempfile.mkdtemp(prefix="landing-")
    land(root, "A", 'ACME,A,2023-11-06,I,1,1,USD,"{""A, B"",C}",\n')
    assert load_landing_csv(spark, root)["staging_agreements"].collect()[0].eligible_collateral == ["A, B", "C"]


def test_store_round_trip_rebuild_and_export(spark):
    ag, tr, md = staging(spark)
    r = ingest_batch(ag, tr, md)
    root = tempfile.mkdtemp(prefix="store-")
    K.append_snapshots(r, root)
    snaps = read_snapshots(spark, root)
    assert snaps.count() == 2
    assert {x.data_hash for x in snaps.collect()} == {x.data_hash for x in r.hashed().collect()}
    assert read_trade_index(spark, root, MON, MON).count() == 2
    # second batch: same keys are duplicates of stored snapshots
    again = ingest_batch(ag, tr, md, existing_keys=snaps)
    assert again.snapshots.count() == 0
    # K4: drop the exposure index, rebuild it from snapshots
    K.rebuild_indexes(spark, root, MON, MON)
    assert read_exposure_index(spark, root).count() == 2
    # K5 export: documents carry extra as an object; hash recomputes from the JSON
    from cobframe.operators.market_sets import attach_sets
    from cobframe.sources.stores import read_market_sets, read_snapshot_trades
    docs = [json.loads(x.value) for x in
            K.export_snapshots_json(attach_sets(snaps, read_market_sets(spark, root)), read_snapshot_trades(spark, root)).collect()]
    doc = [d for d in docs if d["netting_set_id"] == "RATES-USD"][0]
    assert doc["trades"][1]["extra"] == {"x": 1.5}
    assert whole_hash(doc) == doc["data_hash"]


def test_export_keeps_the_stored_numbers(spark):
    ag, tr, md = staging(spark)
    ag = ag.withColumn("extra", F.lit('{"b":1.0,"a":{"n":1e3,"t":"x\\"y"}}'))
    r = ingest_batch(ag, tr, md)
    docs = [json.loads(x.value) for x in K.export_snapshots_json(r.hashed(), r.trades).collect()]
    assert len(docs) == 2 and all(whole_hash(d) == d["data_hash"] for d in docs)
    assert all(isinstance(d["agreement"]["extra"]["b"], float) for d in docs)


def test_assemble_without_market_or_trades(spark):
    ag, _, _ = staging(spark)
    good = V.reject_duplicates(V.validate_ids(ag).good, ["ingested_at"]).good
    asm = A.assemble_snapshots(good)
    rows = asm.headers.collect()
    assert len(rows) == 2 and all(x.market_data.fx_rates == {} for x in rows)
    assert asm.trades.count() == 0


def test_independent_steps_of_the_ingest_run_side_by_side(spark):
    import threading
    ag, tr, md = staging(spark)
    met = threading.Barrier(3, timeout=60)  # broken where one waits for another's end

    def stage(name, df):
        if name in ("agreements", "rates", "trades"):
            met.wait()
        return df
    r = ingest_batch(ag, tr, md, stage=stage)
    assert {x.netting_set_id for x in r.snapshots.collect()} == {"RATES-USD", "EMPTY"}


def test_together_raises_the_failure_of_a_step(spark):
    import pytest

    from cobframe.session import together

    def bad():
        raise ValueError("no")
    assert together(spark, lambda: spark.range(3).count(), lambda: 7) == [3, 7]
    with pytest.raises(ValueError, match="no"):
        together(spark, lambda: spark.range(3).count(), bad)
