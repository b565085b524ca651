import time

import pytest
from pyspark.sql import functions as F

from tollgate import storage
from tollgate.contract import HEADER, ContractError, PatternError
from tollgate.operators import labeling
from tollgate.sources import files, transfers

ROWS = [
    "2022/09/01 00:20,010,8000EBD30,010,8000EBD30,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0",
    "2022/09/01 00:20,03208,8000F4580,001,8000F5340,0.01,US Dollar,0.01,US Dollar,Cheque,0",
    "2022/09/01 00:00,03209,8000F4670,03209,8000F4671,14675.57,US Dollar,14675.57,US Dollar,ACH,1",
    "2022/09/01 00:02,012,8000F5030,012,8000F5031,500.00,Euro,455.00,US Dollar,Wire,0",
]


def _csv(spark, path, rows, header=HEADER):
    files.write_text(spark, str(path), "\n".join([header, *rows]) + "\n")
    return str(path)


def test_positional_read(spark, tmp_path):
    df = transfers.normalize(transfers.read_raw(spark, _csv(spark, tmp_path / "a.csv", ROWS)))
    got = df.orderBy("txn_id").collect()
    assert [r["txn_id"] for r in got] == [1, 2, 3, 4] and got[1]["sender_bank"] == "03208" and got[1]["receiver_id"] == "001_8000F5340"
    assert got[3]["receiving_currency"] == "Euro" and got[3]["amount_paid"] == 455.0 and str(got[2]["event_time"]) == "2022-09-01 00:00:00" and got[2]["is_laundering"] == 1
    assert transfers.assert_identity(df)["rows"] == 4


@pytest.mark.parametrize("header", [HEADER.replace("To Bank,Account", "To Bank,Account.1"), "", HEADER.lower()])
def test_another_header_is_refused(spark, tmp_path, header):
    with pytest.raises(ContractError):
        transfers.read_raw(spark, _csv(spark, tmp_path / "b.csv", ROWS, header))


def test_a_bom_is_no_difference_and_a_bad_row_fails(spark, tmp_path):
    assert transfers.read_raw(spark, _csv(spark, tmp_path / "c.csv", ROWS, "﻿" + HEADER)).count() == 4
    with pytest.raises(Exception):  # noqa: B017
        transfers.read_raw(spark, _csv(spark, tmp_path / "d.csv", [ROWS[0].replace("3697.34", "much")])).collect()


@pytest.mark.parametrize("size", [200, 1000, 10_000_000])
def test_identity_is_the_line_number_for_any_split(spark, tmp_path, size):
    rows = [r.replace("00:20", f"00:{i % 60:02d}") for i in range(40) for r in ROWS] + [ROWS[0]] * 3
    path = _csv(spark, tmp_path / "e.csv", rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = transfers.read_raw(spark, path).orderBy("txn_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert [r["txn_id"] for r in got] == list(range(1, len(rows) + 1))
    assert [(f"{r['event_time']:%H:%M}", r["sender_account"]) for r in got] == [(x.split(",")[0][-5:], x.split(",")[2]) for x in rows]


def _block(rows, shape="FAN-OUT", end="FAN-OUT"):
    return [f"BEGIN LAUNDERING ATTEMPT - {shape}:  Max 2-degree", *rows, f"END LAUNDERING ATTEMPT - {end}"]


def test_patterns(spark, tmp_path):
    path = str(tmp_path / "p.txt")
    files.write_text(spark, path, "\n".join([*_block([ROWS[0], ROWS[2].replace("09/01", "09/03")]), "", *_block([ROWS[3]], "CYCLE", "CYCLE")]) + "\n")
    got = transfers.ring_tables(transfers.read_patterns(spark, path))
    rings = got["rings"].orderBy("ring_id").collect()
    assert [(r["ring_id"], r["typology"], r["n_txns"], r["n_accounts"], r["subtitle"]) for r in rings] == [(0, "FAN-OUT", 2, 3, "Max 2-degree"), (1, "CYCLE", 1, 2, "Max 2-degree")]
    assert rings[0]["duration_days"] == 1.9861 and got["ring_txns"].count() == 3 and got["ring_accounts"].count() == 5
    raw = transfers.normalize(transfers.read_raw(spark, _csv(spark, tmp_path / "t.csv", ROWS)))
    labeled = labeling.attach_rings(raw, got["ring_txns"])
    assert {r["txn_id"]: r["ring_id"] for r in labeled.collect()} == {1: 0, 2: None, 3: None, 4: 1}
    m = labeling.reconcile(labeled, got["ring_txns"]).first()
    assert (m["rows"], m["flagged_txns"], m["flagged_with_ring"], m["unflagged_but_in_a_ring"], m["ring_txns_not_found_in_trans"], m["ambiguous_content_keys"]) == (4, 1, 0, 2, 1, 0)


BAD = {
    "nested BEGIN": _block([ROWS[0]])[:2] + _block([ROWS[0]]), "unknown typology": _block([ROWS[0]], "SPIRAL"), "END without BEGIN": _block([ROWS[0]])[1:], "empty ring block": _block([]),
    "wrong number of fields": _block([ROWS[0] + ",1"]), "not terminated": _block([ROWS[0]])[:2], "no rings": [""],
}


@pytest.mark.parametrize("what", BAD)
def test_malformed_patterns_are_refused(spark, tmp_path, what):
    path = str(tmp_path / "bad.txt")
    files.write_text(spark, path, "\n".join(BAD[what]) + "\n")
    with pytest.raises(PatternError, match=what if what != "END without BEGIN" else "."):
        transfers.read_patterns(spark, path)


def test_ambiguous_content_takes_the_least_ring(spark, txns):
    rows = [{"id": 1, "t": 0, "s": "01_A", "r": "01_B", "ring": 5, "typology": "STACK"}, {"id": 2, "t": 0, "s": "01_A", "r": "01_B", "ring": 3, "typology": "CYCLE"}]
    df = txns(rows)
    out = labeling.attach_rings(df.drop("ring_id", "typology"), df)
    assert out.count() == 2 and {r["ring_id"] for r in out.collect()} == {3} and labeling.reconcile(out, df).first()["ambiguous_content_keys"] == 1


def test_strict_json_and_uris(spark, tmp_path):
    files.write_json(spark, f"file://{tmp_path}/x.json", {"a": float("nan"), "b": [1.5, float("inf")]})
    assert files.read_json(spark, f"{tmp_path}/x.json") == {"a": None, "b": [1.5, None]}
    a, b = (transfers.read_raw(spark, p + _csv(spark, tmp_path / "u.csv", ROWS)) for p in ("", "file://"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert files.listing(spark, f"{tmp_path}/none") == [] and not files.exists(spark, f"{tmp_path}/none")


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    old = held()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()  # held, so that no collection of garbage takes its files
    out = storage.materialize(rows, "swept")
    for _ in range(50):
        if not held() - old:
            break
        time.sleep(0.1)
    assert not held() - old and out.count() == 7 and spark.conf.get(storage._SWEEP) == "false"
