"""Snapshot days that hold several flags for one account, against the row-level lag."""

from __future__ import annotations

import random
from datetime import date, timedelta

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tests import handmade as H
from tests.conftest import assert_same

from daybook.operators import cohort, history, transitions
from daybook.params import DEFAULT as P
from daybook.plans.oracle import Oracle

O = Oracle(P)
DAYS = [date(2024, 1, 3) + timedelta(days=i) for i in range(14)]


def dd(*days):
    return [{"device_id": i % 2 + 1, "time_linked_with_user_ms": H.ms_at_noon_la(x)} for i, x in enumerate(days)]


def mixed_rows():
    rnd = random.Random(11)
    rows = []
    for account in [None, *range(1, 60)]:
        for d in DAYS:
            for flag in rnd.sample([True, False, None], rnd.choice([0, 1, 1, 1, 2, 3])):
                rows.append((account, flag, dd(*sorted(rnd.sample(DAYS, rnd.randrange(0, 4)))), H.day_int(d)))
    # one account with a third of all rows, several flags a day
    for i in range(len(rows) // 2):
        rows.append((99, rnd.choice([True, False]), dd(rnd.choice(DAYS)), H.day_int(rnd.choice(DAYS))))
    return rows


def test_transitions_equal_the_row_level_lag(spark):
    rows = mixed_rows()
    mail = [(a, H.day_int(DAYS[a % 9])) for a in range(1, 60, 2)] + [(99, H.day_int(DAYS[2]))]
    c = duckdb.connect()
    c.register("t", pa.Table.from_pylist([dict(zip(H.HIST_SCHEMA.names, r)) for r in rows], schema=H.HIST_SCHEMA))
    c.execute("CREATE VIEW pref_history AS SELECT * FROM t")
    c.execute(f"CREATE VIEW pref_latest AS SELECT * FROM t WHERE partition_day = {H.day_int(DAYS[-1])}")
    c.execute("CREATE TABLE devices AS SELECT unnest([1, 2]) AS device_id, 20 AS size")
    c.execute("CREATE TABLE first_mail (account_id BIGINT, partition_day BIGINT)")
    c.executemany("INSERT INTO first_mail VALUES (?, ?)", mail)
    hist = spark.createDataFrame(rows, H.SPARK_HIST)
    latest = hist.filter(F.col("partition_day") == H.day_int(DAYS[-1]))
    devices = spark.createDataFrame([(1, "x", "y", 20), (2, "x", "y", 20)], "device_id bigint, model_name string, product_name string, size int")
    first = spark.createDataFrame(mail, "account_id bigint, partition_day bigint")
    days = history.history_days(history.history_normalise(hist, devices, P), P).cache()
    steps = O.sql(f"SELECT * FROM ({O.flags_body()}) f", ["hl"], with_fx=False)

    def direct(body):
        return c.sql(O.sql(body, ["hl", "ahl", "still_out"], with_fx=False))

    assert_same(transitions.optout_strict(days), direct("SELECT account_id, pref_flag, partition_date, prev_flag FROM hl WHERE prev_flag AND NOT pref_flag"))
    assert_same(transitions.optout_total_daily(days, latest), direct(O._strict_daily("total_opt_out")))
    assert_same(transitions.pref_ledger_daily(days, P), direct(O.ledger_body()))
    assert_same(transitions.subscribers_net_daily(days, P), direct(O.subs_body()))
    assert_same(cohort.optout_after_mail_daily(days, latest, first, P), direct(O.after_body()))
    loose = days.filter(transitions.optout_loose(F.col("prev_flag"), F.col("pref_flag")) == 1)
    assert_same(loose.select("account_id", "partition_date"), c.sql(f"SELECT account_id, partition_date FROM ({steps}) WHERE optout = 1"))
    flags = transitions.pref_changes(days, P).agg(F.sum("optin").alias("i"), F.sum("setup_optin").alias("s"), F.sum("setup_optout").alias("o"))
    assert_same(flags, c.sql(f"SELECT sum(optin) AS i, sum(setup_optin) AS s, sum(setup_optout) AS o FROM ({steps})"))
    days.unpersist()


def test_mixed_day(spark):
    d1, d2, d3 = date(2024, 1, 20), date(2024, 1, 21), date(2024, 1, 22)
    l_early, l_late = date(2024, 1, 15), date(2024, 1, 18)

    def dd(*days):
        return [{"device_id": i + 1, "time_linked_with_user_ms": H.ms_at_noon_la(x)} for i, x in enumerate(days)]

    rows = [
        (1, True, dd(l_early), H.day_int(d1)),
        (1, False, dd(l_early, l_late), H.day_int(d1)),  # same day, other flag: rows (early,F) (early,T) (late,F)
        (1, False, dd(l_early, l_late), H.day_int(d2)),
        (1, True, dd(l_early, l_late), H.day_int(d3)),
    ]
    hist = spark.createDataFrame(rows, H.SPARK_HIST)
    devices = spark.createDataFrame([(1, "x", "y", 20), (2, "x", "y", 20)], "device_id bigint, model_name string, product_name string, size int")
    days = history.history_days(history.history_normalise(hist, devices, P), P)
    got = {r.partition_date: r for r in days.collect()}
    # first row of d1 in (link day, flag) order is (early, False); its last row is (late, False)
    of_d1 = sorted((r.row_key, r.prev_flag, r.pref_flag) for r in days.collect() if r.partition_date == d1)
    assert [x[1:] for x in of_d1] == [(None, False), (False, True), (True, False)]
    # d2's predecessor is d1's last row (False): no strict opt-out on d2
    assert got[d2].prev_flag is False
    assert transitions.optout_strict(days).filter(F.col("partition_date") == F.lit(d2)).count() == 0
    # d3 goes from False to True: a loose opt-in on the day grain
    assert got[d3].prev_flag is False and got[d3].pref_flag is True
    subs = {r.stock_day: r.subscribers for r in transitions.subscribers_net_daily(days, P).collect()}
    # d1 (not the seed day, first listed) has no previous stock; d3 holds 2 opted-in rows against d1's 1
    assert subs[d1] is None and subs[d3] == 1 and d2 not in subs
