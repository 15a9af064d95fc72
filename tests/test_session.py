"""Tables that cut lineage, and what removes them."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from corpusloom import session


def files(table):
    path = table.stash_path
    return path is not None and os.path.exists(path.removeprefix("file://"))


def test_settled_removes_what_it_passed(spark):
    inner = []

    def make():
        inner.append(session.stash(spark.range(5), "inner"))
        return inner[0].where("id > 1")

    outer = session.settled(make, "outer")
    assert outer.count() == 3 and files(outer) and not files(inner[0])
    session.discard(outer)
    session.discard(spark.range(3))
    assert outer.stash_path is None


def test_no_machine_local_folder_on_a_cluster():
    unset = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert session.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file://")
    given = SimpleNamespace(get=lambda key, default: "hdfs://some/folder/")
    assert session.shared_dir(SimpleNamespace(conf=given)) == "hdfs://some/folder"
