import os

import pytest

from moorage.settle import settle, settled_for_now, shared_folder


class OnCluster:
    """A session that names no shared folder and runs on a cluster."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_no_folder_on_a_cluster_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(OnCluster)


def folders(spark):
    at = shared_folder(spark).removeprefix("file:")
    return {n for n in os.listdir(at) if n.startswith("settled-")}


def test_tables_of_a_scope_go_with_it(spark):
    settle(spark.range(3))
    before = folders(spark)
    with settled_for_now(spark):
        assert settle(spark.range(3)).count() == 3
        with settled_for_now(spark):
            settle(spark.range(3))
        assert len(folders(spark) - before) == 1
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), settled_for_now(spark):
        settle(spark.range(3))
        1 / 0
    assert folders(spark) == before
