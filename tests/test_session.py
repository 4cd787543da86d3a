"""Written tables: the shared folder of a cluster, a scratch folder of a local session, nothing else."""

import os
from types import SimpleNamespace

import pytest

from routewise import session
from routewise.plans.materialize import checkpointed


def _fake(master, setting=None):
    sc = SimpleNamespace(master=master, applicationId="app-x", getCheckpointDir=lambda: None)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: setting or d))


def test_cluster_without_shared_folder_raises():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.ensure_checkpoint_dir(_fake(master))


def test_cluster_folder_is_used_as_named():
    assert session.ensure_checkpoint_dir(_fake("yarn", "hdfs://nn/shared")) == "hdfs://nn/shared"
    assert session.written_root(_fake("yarn", "hdfs://nn/shared/")) == "hdfs://nn/shared/routewise-app-x"


def test_local_session_keeps_its_configuration(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    path = session.ensure_checkpoint_dir(spark)
    assert session.ensure_checkpoint_dir(spark) == path == (before or path)
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_scratch_folder_of_a_local_session():
    path = session.ensure_checkpoint_dir(_fake("local[4]"))
    assert os.path.isdir(path) and session.ensure_checkpoint_dir(_fake("local[4]")) == path


def test_written_tables_can_be_dropped(spark):
    df = checkpointed(spark.range(5))
    assert df.count() == 5
    assert session.drop_written(spark)
    assert not os.path.isdir(session.written_root(spark).removeprefix("file://"))
