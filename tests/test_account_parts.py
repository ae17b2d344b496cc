"""Snapshots with links are built in parts whose number follows the events."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daybook.operators import history, presence
from daybook.sources import fixtures


@pytest.fixture
def folder(spark, tmp_path):
    start = datetime(2024, 1, 10, 3)
    rows = [(k, start + timedelta(hours=7 * (k % 40)), k % 3, "error" if k % 5 == 0 else "view", f'{{"k": {k % 11}}}') for k in range(200)]
    rows += [(900, start, None, "view", '{"k": 1}'), (901, None, 7, "view", '{"k": 1}'), (902, start, 8, "view", None), (None, start, 8, None, '{"k": 2}')]
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, props string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_links_of_a_day_are_those_made_so_far(spark, folder, monkeypatch):
    monkeypatch.setattr(fixtures, "EVENTS_A_PART", 15)
    fx = fixtures.Fixtures(spark, folder)
    got = fx.pref_history
    assert got.rdd.getNumPartitions() == 14  # 204 events
    snap, lk = fx.snapshots, fx.links.withColumnRenamed("account_id", "a")
    pairs = snap.join(lk, (F.col("account_id") == F.col("a")) & (F.col("link_day") <= F.col("utc_day")))
    flat = got.select("account_id", "pref_flag", "partition_day", F.explode("device_data").alias("d")).select("account_id", "pref_flag", "partition_day", "d.*")
    want = pairs.select("account_id", "pref_flag", "partition_day", "device_id", F.col("ms").alias("time_linked_with_user_ms"))
    assert sorted(map(repr, flat.collect())) == sorted(map(repr, want.collect()))
    assert got.count() == pairs.select("account_id", "partition_day").distinct().count() > 0


def test_devices_beyond_the_bound_are_those_that_links_name(spark, folder, monkeypatch):
    fx = fixtures.Fixtures(spark, folder)
    devices = spark.createDataFrame([(k, 20) for k in range(40)] + [(3, 30), (None, 20)], "device_id long, size int")
    want = sorted(map(repr, history.explode_links(fx.pref_history, devices, keep=("account_id",)).collect()))
    for bound in (12, 3):
        monkeypatch.setattr(history, "BROADCAST_DEVICES", bound)
        assert sorted(map(repr, history.explode_links(fx.pref_history, devices, keep=("account_id",)).collect())) == want
    assert want


def test_days_are_not_dealt_out_by_day(spark):
    kept = spark.range(40).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("cal_date"))
    days = kept.select(F.lit(1).cast("long").alias("account_id"), F.col("cal_date").alias("partition_date"))
    plan = presence.presence_runs(days, kept)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(day" not in plan
