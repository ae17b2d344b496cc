"""Blockwise lag and the interval sweep against direct forms, and their plans."""

from __future__ import annotations

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.operators import revenue
from daybook.operators.blocks import lag_in_blocks
from daybook.operators.sweep import cover
from daybook.params import DEFAULT as P
from daybook.plans.registry import QUERIES
from tests.conftest import SF_SMALL


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return re.sub(r"#\d+L?", "", buf.getvalue())


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_blockwise_lag_equals_plain_window(spark, seed):
    rnd = random.Random(seed)
    rows = {(rnd.choice([1, 1, 1, 2, 3, None]), rnd.randrange(-40, 400), rnd.randrange(9)) for _ in range(1500)}
    rows = [(*r, rnd.choice([True, False, None])) for r in rows]
    df = spark.createDataFrame(rows, "a long, d int, link int, flag boolean")
    plain = df.withColumn("prev", F.lag("flag").over(Window.partitionBy("a").orderBy("d", "link")))
    day = [F.floor(F.col("d") / n) for n in (1, 10, 100)]
    for blocks in ([], [[day[0]]], [[day[1]], [day[2]]], [[F.col("d"), F.floor(F.col("link") / 3)], [day[1]], [day[2]]]):
        got = lag_in_blocks(df, ["a"], ["d", "link"], "flag", "prev", blocks)
        assert rows_of(got) == rows_of(plain)
    assert lag_in_blocks(df.limit(0), ["a"], ["d", "link"], "flag", "prev", [[day[1]]]).count() == 0


def test_blockwise_lag_deals_a_hot_key_out(spark):
    """One account holds a third of the rows; no task of the window sees more than a block of them."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"), "id", (F.col("id") % 2 == 0).alias("flag"))
    got = lag_in_blocks(df, ["a"], ["id"], "flag", "prev", [[F.floor(F.col("id") / 300)], [F.floor(F.col("id") / 6000)]])
    plain = df.withColumn("prev", F.lag("flag").over(Window.partitionBy("a").orderBy("id")))
    assert got.exceptAll(plain).isEmpty() and got.count() == 30_000
    windows = re.findall(r"Window\nInput \[\d+\]: .*\nArguments: .*, \[(__key[^\]]*)\], \[id ASC", plan_of(got))
    assert windows and all("__block0" in w for w in windows)


def test_registered_lag_runs_in_blocks(spark):
    plan = plan_of(QUERIES["win_lag_partitioned"](spark, SF_SMALL))
    assert "[__key, __block0], [partition_day ASC" in plan and "[__key], [partition_day ASC" not in plan


def direct(points, intervals):
    return sorted(
        (
            (*p, s, e)
            for p in points
            for k, s, e in set(intervals)
            if None not in (k, s, e, p[0], p[1]) and p[0] == k and s <= p[1] <= e
        ),
        key=repr,
    )


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("disjoint", [True, False])
def test_sweep_equals_direct_form(spark, seed, disjoint):
    rnd = random.Random(seed)
    points = sorted({(rnd.choice([1, 1, 1, 2, 3, 4]), rnd.randrange(-50, 700)) for _ in range(600)})
    points = [(k, d, i) for i, (k, d) in enumerate(points)] + [(None, 5, -1), (1, None, -2)]
    intervals = []
    for k in (1, 2, 3, 9):
        days = sorted(rnd.sample(range(-60, 720), 40 if k == 1 else 3))
        ends = [b - rnd.choice([1, 1, 9]) for b in days[1:]] + [99999]
        intervals += [(k, a, z) for a, z in zip(days, ends)]
    if not disjoint:
        intervals += [(1, rnd.randrange(700), rnd.randrange(99999)) for _ in range(25)] + [(2, 0, 10), (2, 0, 700), (2, 0, 700)]
    intervals += [(None, 1, 2), (1, None, 5), (3, 10, 9), (4, 5, None)]
    p = spark.createDataFrame(points, "k long, d int, v long")
    i = spark.createDataFrame(intervals, "k long, s int, e int")
    for width in (1, 16, 64):
        assert rows_of(cover(p, i, "k", "d", "s", "e", width)) == direct(points, intervals)
    assert cover(p.limit(0), i, "k", "d", "s", "e").count() == 0
    assert cover(p, i.limit(0), "k", "d", "s", "e").count() == 0


ACQ = "account_id long, activation_date_id int, next_event_date_id int, channel string"


def test_interval_join_keeps_repeated_rows_on_both_sides(spark):
    facts = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (1, 9, 2), (1, 2, 3), (2, 5, 4), (None, 5, 5)], "account_id long, date_id int, amount int")
    acq = spark.createDataFrame([(1, 3, 9, "x"), (1, 3, 9, "y"), (1, 3, 6, "z"), (1, 9, None, "x"), (2, 6, None, "x")], ACQ)
    got = revenue.interval_join(facts, acq, P).select("f.account_id", "f.date_id", "f.amount", "a.channel", "a.next_event_date_id")
    want = [(1, 5, 1, c, n) for c, n in (("x", 9), ("y", 9), ("z", 6))] * 2 + [(1, 9, 2, "x", None)]
    assert rows_of(got) == sorted(want, key=repr)


def test_interval_join_has_no_range_condition(spark):
    for key in ("join_interval", "revenue_91d"):
        plan = plan_of(QUERIES[key](spark, SF_SMALL))
        conditions = re.findall(r"Join condition: (.*)", plan)
        assert conditions and set(conditions) == {"None"}, key
        assert "__block ASC" in plan or "[account_id, __block]" in plan
