"""The shared folder and tables written there."""

import os
from types import SimpleNamespace

import pytest

from plumeria.functions import shared


def session(master, named=None):
    """What shared_dir asks of a session, without a cluster."""
    made = []
    java = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: not made, get=lambda: made[0]))
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: java), setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_needs_a_named_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session(master))
    assert shared.shared_dir(session(master, "hdfs://a/b/")) == "hdfs://a/b"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_machine_makes_its_own(master):
    assert os.path.isdir(shared.shared_dir(session(master)))


def test_written_tables_can_be_deleted(spark):
    paths = []
    df = shared.written(spark.range(5), "five", paths)
    assert df.count() == 5 and len(paths) == 1 and os.path.isdir(paths[0].removeprefix("file:"))
    folder = paths[0].removeprefix("file:")
    shared.delete(spark, paths)
    assert paths == [] and not os.path.exists(folder)
