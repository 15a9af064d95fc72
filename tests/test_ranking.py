"""Dense numbers by a global order, however partitions are joined or split."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.ranking import ranked


@pytest.fixture
def small_partitions(spark):
    """Adaptive execution joins partitions by size: with so few bytes wanted, each column's width matters."""
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_numbers_follow_the_order(spark, small_partitions, n):
    rng = random.Random(n)
    rows = [(rng.randrange(50), k, "x" * rng.randrange(200), 5) for k in range(n)]
    df = spark.createDataFrame(rows, "a int, k int, part string, place int").repartition(3)
    found = ranked(df, [F.desc("a"), "k"], "rank", start=1)
    assert found.columns == ["a", "k", "part", "place", "rank"]
    got = sorted((r["rank"], r["k"]) for r in found.collect())
    assert got == [(i, r[1]) for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)]
    assert sorted((r["rank"], r["k"]) for r in found.select("k", "rank").collect()) == got


def test_ties_nulls_and_a_clashing_name(spark):
    df = spark.createDataFrame([(None, 1.5), ("b", 2.5), ("a", 3.5), ("a", 4.5)], "path string, rank double")
    got = sorted((r["rank"], r["path"]) for r in ranked(df, [F.asc_nulls_last("path")], "rank").collect())
    assert got == [(0, "a"), (1, "a"), (2, "b"), (3, None)]
