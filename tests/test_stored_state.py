"""Stored snapshots, carried state, runs, bitmaps, first events and co-located tables against whole recomputation."""

from __future__ import annotations

import contextlib
import io
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.operators import distinct_days, engagement, history, presence, state, transitions
from daybook.operators.first_state import FirstEvents
from daybook.params import DEFAULT as P
from daybook.plans import boards
from daybook.plans.registry import QUERIES
from daybook.sources import snapshots
from daybook.sources.buckets import AccountTables
from daybook.sources.fixtures import Fixtures
from daybook.sources.stored import StoredFixtures
from tests.conftest import SF_SMALL

DAYS = [date(2023, 12, 28) + timedelta(days=i) for i in range(24)]


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return re.sub(r"#\d+L?", "", buf.getvalue())


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def day_int(d: date) -> int:
    return int(d.strftime("%Y%m%d"))


@pytest.fixture(scope="module")
def norm(spark):
    """Normalised rows with gaps, null accounts and flags, and days with several flags."""
    rnd = random.Random(5)
    rows = set()
    for account in [None, *range(1, 60)]:
        for d in DAYS:
            if rnd.random() < 0.7:
                flags = rnd.sample([True, False, None], rnd.choice([1, 1, 1, 2, 3]))
                for f in flags:
                    for _ in range(rnd.randrange(1, 3)):
                        link = None if rnd.random() < 0.05 else d - timedelta(days=rnd.randrange(6))
                        rows.add((account, f, d, link))
    return spark.createDataFrame(sorted(rows, key=repr), "account_id long, pref_flag boolean, partition_date date, link_date date").cache()


@pytest.mark.parametrize("key", ["scan_latest_snapshot", "scan_snapshot_devices", "scan_partition_between", "scan_partition_range"])
def test_stored_scans_prune_directories_and_nested_fields(spark, key):
    plan = plan_of(QUERIES[key](spark, SF_SMALL))
    filters = re.findall(r"PartitionFilters: \[(.*)\]", plan)
    assert filters and all("partition_day" in f for f in filters), plan
    if key != "scan_partition_range":
        assert "device_data:array<struct<device_id:bigint>>" in plan and "time_linked_with_user_ms" not in plan


def test_a_day_delivered_again_replaces_only_itself(spark, tmp_path):
    fx = Fixtures(spark, SF_SMALL, P)
    path = str(tmp_path / "family")
    snapshots.write_snapshots(fx.pref_history, path)
    before = snapshots.read_snapshots(spark, path, snapshots.SNAPSHOT_SCHEMA)
    whole = before.count()
    day = before.where("partition_day = 20240112").limit(3)
    kept = [tuple(r) for r in day.select("account_id", "pref_flag", "partition_day").collect()]
    again = spark.createDataFrame([(a, f, [], d) for a, f, d in kept], snapshots.SNAPSHOT_SCHEMA)
    old = before.where("partition_day = 20240112").count()
    snapshots.replace_days(again, path)
    now = snapshots.read_snapshots(spark, path, snapshots.SNAPSHOT_SCHEMA)
    assert now.where("partition_day = 20240112").count() == len(kept)
    assert now.count() == whole - old + len(kept)


@pytest.mark.parametrize("cuts", [(8,), (1, 2, 15), (5, 11, 12, 20)])
def test_ranges_with_carried_state_equal_the_whole_run(spark, norm, tmp_path, cuts):
    whole = history.history_days(norm, P).cache()
    states = state.StateStore(spark, str(tmp_path))
    edges = [0, *cuts, len(DAYS)]
    since, got, net = None, None, None
    for a, z in zip(edges, edges[1:]):
        part = norm.where(F.col("partition_date").between(F.lit(DAYS[a]), F.lit(DAYS[z - 1])))
        carried = None if since is None else states.read("history", since)
        stock = None if since is None else states.read("stock", since)
        days = history.history_days(part, P, carried)
        subs = transitions.subscribers_net_daily(days, P, stock)
        got, net = (days, subs) if got is None else (got.unionByName(days), net.unionByName(subs))
        states.save(day_int(DAYS[z - 1]), days, since)
        since = day_int(DAYS[z - 1])
    assert rows_of(got) == rows_of(whole)
    assert rows_of(net) == rows_of(transitions.subscribers_net_daily(whole, P))
    assert rows_of(states.read("history", since)) == rows_of(state.history_state(whole))


def test_range_board_reads_only_its_partitions(spark, tmp_path):
    fx = StoredFixtures(spark, SF_SMALL, P)
    old = snapshots.snapshot_range(fx.pref_history, 0, 20240109)
    states = state.StateStore(spark, str(tmp_path))
    states.save(20240109, history.history_days(history.history_normalise(old, fx.devices, P), P))
    h = boards.RangeHistory(fx, P, 20240110, 20240119, states, 20240109, keep=False)
    plan = plan_of(h.days)
    scans = re.findall(r"PartitionFilters: \[(.*)\]", plan)
    family = [f for f in scans if "partition_day" in f]
    assert family and all("(partition_day >= 20240110), (partition_day <= 20240119)" in f for f in family)
    board = boards.optout_board(fx, P, hist=h)
    full = boards.optout_board(fx, P).where(F.col("cal_date").between(F.lit(date(2024, 1, 10)), F.lit(date(2024, 1, 19))))
    assert rows_of(board) == rows_of(full)


def calendar(spark, days):
    return spark.createDataFrame([(d,) for d in days], "cal_date date")


def test_runs_equal_direct_form_and_merge(spark, norm):
    kept_days = [d for i, d in enumerate(DAYS) if i not in (3, 4, 10)]
    kept = calendar(spark, kept_days)
    seen = {}
    for r in norm.select("account_id", "partition_date").distinct().collect():
        if r[0] is not None and r[1] in kept_days:
            seen.setdefault(r[0], set()).add(kept_days.index(r[1]))
    want = []
    for a, places in seen.items():
        for p in sorted(places):
            if p - 1 in places:
                want[-1][2] = p
            else:
                want.append([a, p, p])
    runs = presence.presence_runs(norm, kept)
    assert rows_of(runs) == sorted(map(tuple, want), key=repr)
    for cut in (1, 7, 12, 23):
        low = F.col("partition_date") < F.lit(DAYS[cut])
        merged = presence.merge_runs(presence.presence_runs(norm.where(~low), kept), presence.presence_runs(norm.where(low), kept))
        assert rows_of(merged) == rows_of(runs)
    gone = {}
    for _, _, last in want:
        if last + 1 < len(kept_days):
            gone[kept_days[last + 1]] = gone.get(kept_days[last + 1], 0) + 1
    assert rows_of(presence.run_ends_daily(runs, kept)) == sorted([(d, gone.get(d)) for d in kept_days], key=repr)
    assert presence.presence_runs(norm.limit(0), kept).count() == 0


def test_delinks_do_not_double_the_rows(spark):
    assert "Generate" not in plan_of(transitions.delink_daily(calendar(spark, DAYS), spark.createDataFrame([], "account_id long, partition_date date"), P))


def test_bitmaps_append_equals_recomputation(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(DAYS), rnd.choice([None, rnd.randrange(100_000), rnd.randrange(-5, 5), 2**40 + rnd.randrange(9)])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "d date, id long")
    kept = distinct_days.daily_bitmaps(df.where(F.col("d") < F.lit(DAYS[9])), "d", "id")
    for d in DAYS[9:]:
        kept = distinct_days.merge_bitmaps(kept, distinct_days.daily_bitmaps(df.where(F.col("d") == F.lit(d)), "d", "id"), "d").checkpoint()
    late = spark.createDataFrame([(DAYS[2], 7), (DAYS[2], 7), (DAYS[2], 10**7)], "d date, id long")
    kept = distinct_days.merge_bitmaps(kept, distinct_days.daily_bitmaps(late, "d", "id"), "d")
    want = df.unionByName(late).where("id IS NOT NULL").groupBy("d").agg(F.countDistinct("id").alias("n"))
    assert rows_of(distinct_days.distinct_daily(kept, "d", "n")) == rows_of(want)


@pytest.mark.parametrize("seed", range(2))
def test_first_events_arriving_in_any_order(spark, tmp_path, seed):
    rnd = random.Random(seed)
    day_us = 86_400_000_000
    base = 19_724 * day_us
    rows = [(rnd.choice([0, 1, None]), rnd.choice([None, *range(40)]), base + rnd.randrange(6 * day_us)) for _ in range(400)]
    rows += [(0, 1, None)]
    batches = [[r for r in rows if r[2] is None or (r[2] - base) // day_us == d] for d in range(6)]
    rnd.shuffle(batches)
    first = FirstEvents(spark, str(tmp_path / "first"))
    schema = "campaign_id bigint, message_id bigint, t_us bigint"
    first.create(spark.createDataFrame(batches[0], schema))
    for b in batches[1:] + [batches[2], []]:
        first.arrive(spark.createDataFrame(b, schema))
    log = spark.createDataFrame(rows, schema).where("t_us IS NOT NULL")
    assert rows_of(first.read()) == rows_of(engagement.first_events(log))
    assert rows_of(first.opens_daily(P)) == rows_of(engagement.daily_distinct_messages(engagement.first_events(log), P, "open_day", "emails_opened"))


def test_only_touched_days_are_written_again(spark, tmp_path):
    day_us = 86_400_000_000
    schema = "campaign_id bigint, message_id bigint, t_us bigint"
    first = FirstEvents(spark, str(tmp_path / "first"))
    first.create(spark.createDataFrame([(0, m, (100 + m) * day_us) for m in range(6)], schema))

    def files():
        return {p.parent.name: p.name for p in (tmp_path / "first").glob("first_day=*/part-*")}

    before = files()
    first.arrive(spark.createDataFrame([(0, 5, 101 * day_us + 7), (0, 9, 103 * day_us)], schema))
    after = files()
    changed = {k for k in after if before.get(k) != after[k]}
    assert changed == {"first_day=101", "first_day=103", "first_day=105"}
    assert sorted((r["message_id"], r["t_us"] // day_us) for r in first.read().collect()) == [(0, 100), (1, 101), (2, 102), (3, 103), (4, 104), (5, 101), (9, 103)]


def test_co_located_tables_shuffle_nothing(spark, norm, tmp_path):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        stored = AccountTables(spark, str(tmp_path / "accounts"), 4)
        rows, some = stored.put("rows", norm), stored.put("some", norm.where("pref_flag").select("account_id").distinct())
        day = stored.put("day", norm.select("account_id", "partition_date").distinct())
        w = Window.partitionBy("account_id").orderBy("partition_date", "link_date", "pref_flag")
        out = (
            rows.withColumn("prev", F.lag("pref_flag").over(w))
            .join(some, "account_id", "left_semi")
            .join(day.withColumn("there", F.lit(True)), ["account_id", "partition_date"], "left")
        )
        plan = plan_of(out)
        assert "Exchange" not in plan and "Bucketed: true" in plan
        plain = (
            norm.withColumn("prev", F.lag("pref_flag").over(w))
            .join(norm.where("pref_flag").select("account_id").distinct(), "account_id", "left_semi")
            .withColumn("there", F.lit(True))
        )
        assert rows_of(out) == rows_of(plain)
        stacked = plan_of(QUERIES["join_semi_stacked"](spark, SF_SMALL))
        assert "hashpartitioning(account_id" not in stacked
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
