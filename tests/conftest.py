import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from objectlog.session import session

    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--master local[4] --driver-memory 3g pyspark-shell")
    s = session("tests", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def mini(spark):
    """Six events of one day over orders, items and a customer; hand-computed answers are in the tests."""
    from objectlog.log import ObjectLog

    at = lambda h, m=0: f"2024-01-01T{h:02d}:{m:02d}:00Z"
    rows = [("e1", "OrderPlaced", at(9), "alice", "o1 c1"), ("e2", "Pick", at(10), "bob", "o1 i1 i2"), ("e3", "Ship", at(12), "bob", "o1 i1 i2"), ("e4", "OrderPlaced", at(9, 30), "alice", "o2 c1"), ("e5", "Ship", at(11, 30), "carol", "o2"), ("e6", "Note", at(13), None, "")]
    kinds = {"o": "Order", "i": "Item", "c": "User"}
    events = spark.createDataFrame([(e, a, t, {"resource": r} if r else {}) for e, a, t, r, _ in rows], "eid string, activity string, ts string, attrs map<string,string>").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).to_timestamp("ts"))
    objects = spark.createDataFrame([(o, kinds[o[0]]) for o in ("o1", "o2", "i1", "i2", "i3", "c1")], "oid string, otype string")
    e2o = spark.createDataFrame([(e, o, kinds[o[0]], None) for e, _, _, _, os_ in rows for o in os_.split()], "eid string, oid string, otype string, qualifier string")
    return ObjectLog.of(events, objects, e2o)
