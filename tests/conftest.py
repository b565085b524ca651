from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{shared}", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TXN = (
    "txn_id long, event_time timestamp_ntz, event_date date, sender_id string, receiver_id string, sender_bank string, receiver_bank string, amount_paid double, amount_received double, "
    "payment_format string, payment_currency string, receiving_currency string, is_laundering int, ring_id long, typology string, score double"
)


@pytest.fixture(scope="session")
def txns(spark):
    """Transfers from short tuples (id, when, sender, receiver, ...): ``when`` is a datetime or days after 2022-09-01."""

    def make(rows):
        out = []
        for r in rows:
            r = {"amount": 10.0, "y": 0, "ring": None, "typology": None, "score": 0.0} | r
            t = r["t"] if isinstance(r["t"], datetime) else datetime(2022, 9, 1) + timedelta(days=r["t"])
            bank = lambda a: a.split("_")[0]
            out.append((
                r["id"], t, t.date(), r["s"], r["r"], bank(r["s"]), bank(r["r"]), r["amount"], r.get("received", r["amount"]), r.get("format", "ACH"), "US Dollar", r.get("currency", "US Dollar"),
                r["y"], r["ring"], r["typology"] or ("CYCLE" if r["ring"] is not None else None), float(r["score"]),
            ))
        return spark.createDataFrame(out, TXN)

    return make
