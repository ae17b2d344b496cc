"""Seeded random snapshot histories: the day-grain rewrites against the direct-form SQL.

Accounts appear on random subsets of days (gaps and late first sightings),
flags are random with nulls, device lists grow over time and some are empty,
link days fall inside outage and backlog ranges, and some devices fail the
base filter.
"""

from __future__ import annotations

import os
import random
from datetime import date, timedelta

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import handmade as H
from tests.conftest import assert_same

from daybook.operators import cohort, history, transitions
from daybook.params import DEFAULT as P
from daybook.plans.oracle import Oracle

O = Oracle(P)
DAYS = [date(2023, 12, 30) + timedelta(days=i) for i in range(20)]
LAST = DAYS[-1]
DEVICES = [(i, "LARGE", "Brand#1", 5 if i % 7 == 0 else 11 + i) for i in range(1, 30)]


def make_rows(seed: int = 7, n_accounts: int = 300):
    rnd = random.Random(seed)
    rows, mail = [], []
    for acct in range(1, n_accounts + 1):
        start = rnd.randrange(len(DAYS))
        present = [i for i in range(start, len(DAYS)) if rnd.random() < 0.8]
        links = []
        for _ in range(rnd.randrange(0, 6)):
            ld = DAYS[rnd.randrange(min(len(DAYS), start + 3))] if rnd.random() < 0.7 else DAYS[min(len(DAYS) - 1, start + rnd.randrange(8))]
            links.append((rnd.randrange(1, 30), ld))
        for i in present:
            d = DAYS[i]
            flag = rnd.choice([True, False, True, None]) if rnd.random() < 0.9 else None
            dd = [{"device_id": dev, "time_linked_with_user_ms": H.ms_at_noon_la(ld)} for dev, ld in links if ld <= d]
            if rnd.random() < 0.05:
                dd = []
            rows.append((acct, flag, dd, H.day_int(d)))
        if present and rnd.random() < 0.5:
            for _ in range(rnd.randrange(1, 3)):
                mail.append((acct, H.day_int(DAYS[rnd.randrange(len(DAYS))])))
    return rows, mail


ROWS, MAIL = make_rows(int(os.environ.get("DAYBOOK_TEST_SEED", "7")))


@pytest.fixture(scope="module")
def src(spark):
    class S:
        pass

    s = S()
    s.pref_history = spark.createDataFrame(ROWS, H.SPARK_HIST)
    s.pref_latest = s.pref_history.filter(F.col("partition_day") == H.day_int(LAST))
    s.devices = spark.createDataFrame(DEVICES, "device_id bigint, model_name string, product_name string, size int")
    s.first_mail = spark.createDataFrame(MAIL, "account_id bigint, partition_day bigint")
    s.calendar = spark.createDataFrame([(d,) for d in DAYS], "cal_date date")
    s.days = history.history_days(history.history_normalise(s.pref_history, s.devices, P), P).cache()
    return s


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.register("pref_history_t", pa.Table.from_pylist([dict(zip(H.HIST_SCHEMA.names, r)) for r in ROWS], schema=H.HIST_SCHEMA))
    c.execute("CREATE VIEW pref_history AS SELECT * FROM pref_history_t")
    c.execute(f"CREATE VIEW pref_latest AS SELECT * FROM pref_history WHERE partition_day = {H.day_int(LAST)}")
    c.execute("CREATE TABLE devices (device_id BIGINT, model_name VARCHAR, product_name VARCHAR, size INTEGER)")
    c.executemany("INSERT INTO devices VALUES (?, ?, ?, ?)", DEVICES)
    c.execute("CREATE TABLE first_mail (account_id BIGINT, partition_day BIGINT)")
    c.executemany("INSERT INTO first_mail VALUES (?, ?)", MAIL)
    c.execute("CREATE TABLE cal (cal_date DATE)")
    c.executemany("INSERT INTO cal VALUES (?)", [(d,) for d in DAYS])
    return c


def q(con, body, ctes):
    return con.sql(O.sql(body, ctes, with_fx=False))


def test_data_has_the_edges(src):
    flags = {r[1] for r in ROWS}
    assert flags == {True, False, None}
    assert any(not r[2] for r in ROWS)


def test_strict_optouts_random(src, con):
    assert_same(transitions.optout_total_daily(src.days, src.pref_latest), q(con, O._strict_daily("total_opt_out"), ["hl", "still_out"]))


def test_subscribers_random(src, con):
    assert_same(transitions.subscribers_net_daily(src.days, P), q(con, O.subs_body(), ["hl"]))


def test_ledger_random(src, con):
    assert_same(transitions.pref_ledger_daily(src.days, P), q(con, O.ledger_body(), ["hl"]))


def test_loose_rows_random(src, con):
    got = src.days.filter(transitions.optout_loose(F.col("prev_flag"), F.col("pref_flag")) == 1).select(
        "account_id", "partition_date", "prev_flag", "pref_flag"
    )
    assert_same(got, q(con, f"SELECT account_id, partition_date, prev_flag, pref_flag FROM ({O.flags_body()}) f WHERE optout = 1", ["hl"]))


def test_delinks_random(src, con):
    assert_same(transitions.delink_daily(src.calendar, src.days, P), q(con, O.delink_body(), ["hx"]))


def test_after_mail_random(src, con):
    assert_same(cohort.cohort_vs_optout(src.days, src.pref_latest, src.first_mail, P), q(con, O.cohort_vs_optout_body(), ["ahl"]))
