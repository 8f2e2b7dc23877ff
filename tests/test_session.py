"""Scratch space rules: shared checkpoint folder on clusters, never local."""

import pytest

from hirelake.session import scratch_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Context:
    def __init__(self, master, configured=None, current=None):
        self.master, self._conf, self._current = master, _Conf(configured), current

    def getCheckpointDir(self):
        return self._current

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, path):
        self._current = f"{path}/uuid"


class _Session:
    def __init__(self, sc):
        self.sparkContext = sc


def test_cluster_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(_Session(_Context("spark://cluster:7077")), "x")


def test_configured_checkpoint_dir_is_used():
    sc = _Context("yarn", configured="hdfs://nn/ckpt")
    assert scratch_dir(_Session(sc), "x").startswith("hdfs://nn/ckpt/uuid/hirelake/x-")


def test_existing_checkpoint_dir_wins():
    sc = _Context("k8s://api", configured="hdfs://nn/other", current="s3a://bucket/ckpt/abc")
    assert scratch_dir(_Session(sc), "y").startswith("s3a://bucket/ckpt/abc/hirelake/y-")
