import os
from types import SimpleNamespace

import pytest

from signalmill.llm import scratch


def session(master, base=None):
    conf = {"spark.checkpoint.dir": base} if base else {}
    return SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master, applicationId="app"))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"])
def test_a_cluster_needs_the_setting(master):
    with pytest.raises(ValueError):
        scratch.shared_dir(session(master))
    assert scratch.shared_dir(session(master, "hdfs://n/check/")).startswith("hdfs://n/check/signalmill-app/")


def test_one_machine_gets_a_folder():
    own = session("local[2]")
    assert scratch.shared_dir(own) != scratch.shared_dir(own)
    assert scratch.shared_dir(own).rpartition("/")[0] == scratch.shared_dir(own).rpartition("/")[0]


def test_tables_are_written_and_deleted(spark):
    df, path = scratch.written(spark.range(5), "t")
    assert df.count() == 5 and path.endswith("/t")
    scratch.discard(spark, path)
    assert not os.path.exists(path.removeprefix("file://"))
    scratch.discard(spark, path)  # nothing there is no error
