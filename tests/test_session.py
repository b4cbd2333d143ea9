"""Where intermediate tables may be written, and that they can be dropped."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from goldpan import session


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn"])
def test_a_cluster_must_name_the_folder(master):
    context = SimpleNamespace(master=master, applicationId="none", getCheckpointDir=lambda: None)
    stub = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(stub)


def test_intermediate_tables_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", {})
    table = session.written(spark.range(5), "test")
    assert table.count() == 5
    (path,) = session._SCRATCH[spark.sparkContext.applicationId]
    assert os.path.isdir(path)
    assert session.drop_scratch(spark) == 1
    assert not os.path.exists(path) and session.drop_scratch(spark) == 0
