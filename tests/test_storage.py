"""Intermediate tables."""

import os

import pytest

from cairn import storage


def test_tables_are_written_read_and_released(spark):
    storage.release(spark)
    df = storage.materialize(spark.range(10), "ten")
    path = storage._WRITTEN[-1].removeprefix("file://")
    assert df.count() == 10 and os.path.isdir(path)
    assert storage.release(spark) == 1 and not os.path.exists(path) and storage.release(spark) == 0


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        storage.shared_folder(Cluster())
