"""The shared folder and the loading of tables."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from corvane import session


def fake(master, setting=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: setting or default), sparkContext=SimpleNamespace(master=master, applicationId=master))


def test_shared_dir():
    assert session.shared_dir(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    one = session.shared_dir(fake("local[2]"))
    assert one.startswith("file://") and one == session.shared_dir(fake("local[2]")) and session.scratch(fake("local[2]"), "a").startswith(one)
    for master in ("yarn", "local-cluster[1,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            session.shared_dir(fake(master))


def test_table(spark):
    assert session.table(spark, "/root/testdata/sf0.001", "nation").count() == 25
