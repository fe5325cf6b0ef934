from types import SimpleNamespace

import pytest

from holdfast import session


def fake(master, root=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: root), sparkContext=context)


def test_the_setting_wins():
    assert session.shared_root(fake("yarn", "hdfs://x/check/")) == "hdfs://x/check"
    assert session.new_folder(fake("yarn", "hdfs://x"), "a").startswith("hdfs://x/a-")


def test_a_cluster_needs_the_setting():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(fake("yarn"))


def test_a_local_session_gets_one_scratch_folder():
    assert session.shared_root(fake("local[2]")) == session.shared_root(fake("local[2]"))


def test_boosting_has_a_checkpoint_folder(spark):
    session.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
