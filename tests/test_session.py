import os

import pytest

from quarrymill import session


def test_stored_tables_can_be_dropped(spark):
    session.drop_stored(spark)
    df = session.stored(spark.range(5), "numbers")
    assert df.count() == 5 and os.listdir(session.shared_dir(spark).removeprefix("file:"))
    assert session.drop_stored(spark) == 1 and session.drop_stored(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.inputFiles()[0]).count()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://x:7077", staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    Context.getCheckpointDir = staticmethod(lambda: "hdfs://x/shared/")
    assert session.shared_dir(Session()) == "hdfs://x/shared"
    Context.getCheckpointDir, Session.conf = staticmethod(lambda: None), {"spark.checkpoint.dir": "/named"}
    assert session.shared_dir(Session()) == "/named"
