from __future__ import annotations

import pytest

from spreadrank.operators.skew import found_hot, hot_keys, lookup, salted_join
from spreadrank.params import SkewLimits

TINY = SkewLimits(min_rows=5, max_hot=100)


@pytest.fixture(scope="module")
def left(spark):
    rows = [("hot", i) for i in range(50)] + [("warm", i) for i in range(6)] + [("cold", 1), ("gone", 2)]
    return spark.createDataFrame(rows + [(None, 3)], "k string, v int")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_equals_a_plain_join(spark, left, how):
    right = spark.createDataFrame([("hot", 1.0), ("warm", 2.0), ("cold", 3.0)], "k string, x double")
    plain = sorted(left.join(right, "k", how).collect(), key=str)
    assert sorted(lookup(left, right, ["k"], 59, how, TINY).select("k", "v", "x").collect(), key=str) == plain


def test_salted_join_equals_a_plain_join(spark, left):
    right = spark.createDataFrame([("hot", i) for i in range(7)] + [("cold", 0)], "k string, y int")
    plain = sorted(left.join(right, "k").collect())
    assert sorted(salted_join(left, right, ["k"], ["v"], 59, TINY).select("k", "v", "y").collect()) == plain


def test_hot_keys_are_few(left):
    assert {r.k: r.n for r in hot_keys(left, ["k"], 59, TINY).collect()} == {"hot": 50, "warm": 6}
    bounded = SkewLimits(min_rows=1, max_hot=2)
    assert hot_keys(left, ["k"], 59, bounded).count() <= 2
    # Also where the caller is far off with the number of rows.
    wrong = SkewLimits(min_rows=0, max_hot=1)
    assert [(r.k, r.n) for r in hot_keys(left, ["k"], 0, wrong).collect()] == [("hot", 50)]


def test_hot_keys_of_two_columns(spark, left):
    found = found_hot(left, ["k", "v"], 59, SkewLimits(min_rows=1, max_hot=100))
    assert found is None
    twice = left.unionByName(left.filter("v = 4")).unionByName(left.filter("v = 4"))
    assert {(r.k, r.v): r.n for r in found_hot(twice, ["k", "v"], 59, SkewLimits(min_rows=2, max_hot=100)).collect()} == {
        ("hot", 4): 3, ("warm", 4): 3,
    }
    assert found_hot(left, ["k"], 59, SkewLimits(min_rows=50, max_hot=100)) is None
