"""Partitioned snapshot layout (pruning) and plan-shape guards."""

from __future__ import annotations

import contextlib
import io
import re
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

from daybook.operators import history, transitions
from daybook.params import DEFAULT as P
from daybook.plans import boards
from daybook.plans.registry import QUERIES
from daybook.sources import fixtures, snapshots


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return re.sub(r"#\d+L?", "", buf.getvalue())


def test_partitioned_snapshots_prune_and_agree(spark):
    fx = fixtures.Fixtures(spark, SF_SMALL, P)
    path = tempfile.mkdtemp(prefix="daybook-snap-") + "/pref_history"
    snapshots.write_snapshots(fx.pref_history, path)
    stored = snapshots.read_snapshots(spark, path)

    latest = snapshots.latest_snapshot(stored, P.latest_day)
    plan = _plan(latest)
    assert f"PartitionFilters: [isnotnull(partition_day), (partition_day = {P.latest_day})]" in plan
    cols = ["account_id", "pref_flag", "partition_day"]
    assert sorted(map(tuple, latest.select(*cols).collect())) == sorted(map(tuple, fx.pref_latest.select(*cols).collect()))

    rng = snapshots.snapshot_range(stored, 20240110, 20240112)
    assert "(partition_day >= 20240110)" in _plan(rng)
    assert rng.select("partition_day").distinct().count() == 3

    # the operators give the same answer on the stored layout
    days_stored = history.history_days(history.history_normalise(stored, fx.devices, P), P)
    days_fixture = history.history_days(history.history_normalise(fx.pref_history, fx.devices, P), P)
    a = transitions.optout_total_daily(days_stored, latest).collect()
    b = transitions.optout_total_daily(days_fixture, fx.pref_latest).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_no_cross_products_in_boards(spark):
    for key in ["lifecycle_board", "optout_board", "delink_daily", "join_cross", "optout_after_mail_daily"]:
        plan = _plan(QUERIES[key](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key


def test_column_pruning_reaches_scan(spark):
    plan = _plan(QUERIES["sends_daily"](spark, SF_SMALL))
    # only the columns the log derivation needs are read from the events file
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in plan
    pushed = [ln for ln in plan.splitlines() if ln.startswith("PushedFilters")]
    assert pushed and "EqualTo(event_type,signup)" in pushed[0]


def test_board_leaves_no_cache_and_reads_each_log_once(spark):
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()  # caches of other tests in this session
    fx = fixtures.Fixtures(spark, SF_SMALL, P)
    h = boards.History(fx, P)
    board = boards.lifecycle_board(fx, P, hist=h)
    assert board.count() == history.calendar_from_links(fx.pref_current, fx.devices, P).filter(
        F.col("cal_date") < F.lit(P.as_of)
    ).count()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= held
    plan = _plan(board)
    for event in ("view", "click"):
        assert len(re.findall(rf"PushedFilters: \[[^\]]*EqualTo\(event_type,{event}\)", plan)) == 1, event


def test_board_rereads_overwritten_inputs(spark):
    fx = fixtures.Fixtures(spark, SF_SMALL, P)
    path = tempfile.mkdtemp(prefix="daybook-board-")
    names = ["pref_current", "pref_history", "pref_latest", "devices", "sent", "opened", "clicked", "opted_out", "first_mail"]

    def board(history_rows):
        for n in names:
            df = history_rows if n == "pref_history" else getattr(fx, n)
            df.write.mode("overwrite").parquet(f"{path}/{n}")
        src = boards.Inputs(**{n: spark.read.parquet(f"{path}/{n}") for n in names})
        return boards.optout_board(src, P).agg(F.sum("total_opt_out")).first()[0]

    assert board(fx.pref_history) > 0
    assert board(fx.pref_history.limit(0)) is None


def test_no_fixed_partition_counts(spark):
    for key in QUERIES:
        assert "REPARTITION_BY_NUM" not in _plan(QUERIES[key](spark, SF_SMALL)) if key not in ("optout_board", "lifecycle_board") else True, key


def test_flat_tables_and_late_events(spark):
    from dataclasses import replace
    from datetime import datetime, timezone

    from daybook.operators import engagement

    us = int(datetime(2024, 1, 10, 20, tzinfo=timezone.utc).timestamp() * 1e6)
    late = spark.createDataFrame([(1, 0, 5, us, 20231231)], "message_id bigint, campaign_id bigint, account_id bigint, t_us bigint, partition_day bigint")
    assert engagement.sends_by_topic(late, P).first()["music_send"] == 1
    assert engagement.sends_by_topic(late.drop("partition_day"), P).first()["music_send"] == 1
    assert not engagement.sends_by_topic(late, replace(P, partition_day_is_utc_day=True)).count()
    fx = fixtures.Fixtures(spark, SF_SMALL, P)
    names = ["pref_current", "pref_history", "pref_latest", "devices", "sent", "opened", "clicked", "opted_out", "first_mail"]
    flat = {f"flat_{n}": getattr(fx, n).drop("partition_day") for n in ("sent", "opened", "clicked", "opted_out")}
    src = boards.Inputs(**{n: getattr(fx, n) for n in names}, **flat)
    h = boards.History(src, P)
    one, many = boards.lifecycle_board(fx, P, hist=h), boards.lifecycle_board(src, P, hist=h)
    cols = sorted(one.columns)
    assert sorted(map(repr, one.select(cols).collect())) == sorted(map(repr, many.select(cols).collect()))


def test_base_filter_sees_account_link_and_device_columns(spark):
    from dataclasses import replace

    fx = fixtures.Fixtures(spark, SF_SMALL, P)
    everything = history.calendar_from_links(fx.pref_current, fx.devices, P).count()
    for cond in (F.col("country") == "ASIA", F.col("linked_ms") > 0, (F.col("language") != "x") & (F.col("product_name") != "")):
        p = replace(P, base_filter=cond)
        assert 0 < history.calendar_from_links(fx.pref_current, fx.devices, p).count()
    p = replace(P, base_filter=F.col("pref_flag") & (F.col("size") > 10))
    days = history.history_days(history.history_normalise(fx.pref_history, fx.devices, p), p)
    assert {r[0] for r in days.select("pref_flag").distinct().collect()} == {True}
    assert everything > 0


def test_null_segment_is_not_control(spark):
    from daybook.operators import audience

    when = 1704412800000  # 2024-01-05
    link = [{"device_id": 1, "time_linked_with_user_ms": when}]
    kind = "account_id bigint, pref_flag boolean, language string, country string, country_incorrect boolean, segment string, device_data array<struct<device_id:bigint,time_linked_with_user_ms:bigint>>"
    rows = [(1, True, "NATION_1", "ASIA", False, None, link), (2, True, "NATION_1", "ASIA", False, "BUILDING", link)]
    contacts = spark.createDataFrame([(1, "a@x"), (2, "b@x")], "account_id bigint, email string")
    devices = spark.createDataFrame([(1, "LARGE", "Brand#7", 20)], "device_id bigint, model_name string, product_name string, size int")
    got = audience.audience_select(spark.createDataFrame(rows, kind), contacts, devices, P).collect()
    assert {r["opt_out_id"]: r["control"] for r in got} == {1: False, 2: True}


def test_null_account_is_no_delink(spark):
    from datetime import date

    d1, d2 = date(2024, 1, 20), date(2024, 1, 21)
    cal = spark.createDataFrame([(d1,), (d2,)], "cal_date date")
    days = spark.createDataFrame([(None, d1), (3, d1)], "account_id bigint, partition_date date")
    assert {r["delink_date"]: r["delinks"] for r in transitions.delink_daily(cal, days, P).collect()} == {d1: None, d2: 1}


def test_topics_need_a_campaign_each():
    import pytest

    from daybook.params import Params

    with pytest.raises(ValueError):
        Params(topic_campaigns=(1, 2))


def test_event_log_first_day_prunes_partitions(spark):
    from daybook.operators import engagement

    fx = fixtures.Fixtures(spark, SF_SMALL, P)
    path = tempfile.mkdtemp(prefix="daybook-log-") + "/sent"
    snapshots.write_snapshots(fx.sent, path)
    stored = snapshots.read_snapshots(spark, path)
    got = engagement.sends_daily(stored, P)
    first = int(P.first_log_day.strftime("%Y%m%d"))
    assert f"(partition_day >= {first})" in [ln for ln in _plan(got).splitlines() if ln.startswith("PartitionFilters")][0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, engagement.sends_daily(fx.sent, P).collect()))
    from dataclasses import replace

    topic = engagement.sends_by_topic(stored, replace(P, partition_day_is_utc_day=True))
    assert any(ln.startswith("PartitionFilters") and "partition_day >=" in ln for ln in _plan(topic).splitlines())
    assert sorted(map(tuple, topic.collect())) == sorted(map(tuple, engagement.sends_by_topic(fx.sent, P).collect()))
