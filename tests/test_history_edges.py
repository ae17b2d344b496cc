"""Day-grain rewrites against the row-level direct form on hand-made rows.

The DuckDB side runs the reference's direct SQL (row-level ``lag``, cross
join, inequality join) over the same hand-made tables.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import handmade as H
from tests.conftest import assert_same

from daybook.operators import cohort, history, transitions
from daybook.params import DEFAULT as P
from daybook.plans import boards
from daybook.plans.oracle import Oracle

O = Oracle(P)


class Src:
    pass


@pytest.fixture(scope="module")
def src(spark):
    s = Src()
    rows = H.history_rows()
    s.pref_history = spark.createDataFrame(rows, H.SPARK_HIST)
    s.pref_latest = s.pref_history.filter(F.col("partition_day") == H.day_int(H.LAST))
    s.devices = spark.createDataFrame(H.DEVICES, "device_id bigint, model_name string, product_name string, size int")
    s.first_mail = spark.createDataFrame(H.FIRST_MAIL, "account_id bigint, partition_day bigint")
    s.sent = spark.createDataFrame(H.SENT, H.LOG_SCHEMA)
    s.opted_out = spark.createDataFrame(H.OPTED, H.LOG_SCHEMA)
    s.calendar = spark.createDataFrame([(d,) for d in H.DAYS], "cal_date date")
    s.days = history.history_days(history.history_normalise(s.pref_history, s.devices, P), P)
    return s


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    hist = pa.Table.from_pylist(
        [dict(zip(H.HIST_SCHEMA.names, r)) for r in H.history_rows()], schema=H.HIST_SCHEMA
    )
    c.register("pref_history_t", hist)
    c.execute("CREATE VIEW pref_history AS SELECT * FROM pref_history_t")
    c.execute(f"CREATE VIEW pref_latest AS SELECT * FROM pref_history WHERE partition_day = {H.day_int(H.LAST)}")
    c.execute("CREATE TABLE devices (device_id BIGINT, model_name VARCHAR, product_name VARCHAR, size INTEGER)")
    c.executemany("INSERT INTO devices VALUES (?, ?, ?, ?)", H.DEVICES)
    c.execute("CREATE TABLE first_mail (account_id BIGINT, partition_day BIGINT)")
    c.executemany("INSERT INTO first_mail VALUES (?, ?)", H.FIRST_MAIL)
    for name, rows in [("sent", H.SENT), ("opted_out", H.OPTED)]:
        c.execute(f"CREATE TABLE {name} (message_id BIGINT, campaign_id BIGINT, account_id BIGINT, t_us BIGINT, partition_day BIGINT)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?, ?)", rows)
    c.execute("CREATE TABLE cal (cal_date DATE)")
    c.executemany("INSERT INTO cal VALUES (?)", [(d,) for d in H.DAYS])
    return c


def q(con, body, ctes):
    return con.sql(O.sql(body, ctes, with_fx=False))


def test_strict_optouts(src, con):
    assert_same(transitions.optout_strict(src.days), q(con, O.optout_strict().split("WITH", 1)[0] or "SELECT account_id, pref_flag, partition_date, prev_flag FROM hl WHERE (CASE WHEN prev_flag IS TRUE AND pref_flag IS FALSE THEN 1 ELSE 0 END) = 1", ["hl"]))


def test_strict_daily_with_semi_filters(src, con):
    assert_same(transitions.optout_total_daily(src.days, src.pref_latest), q(con, O._strict_daily("total_opt_out"), ["hl", "still_out"]))
    assert_same(
        transitions.optout_attributed_daily(src.days, src.pref_latest, src.opted_out, src.sent),
        q(con, O._strict_daily("email_opt_out", O._attr()), ["hl", "still_out"]),
    )
    assert_same(
        transitions.optout_campaign_daily(src.days, src.pref_latest, src.opted_out, src.sent, P),
        q(con, O._strict_daily("onboarding_opt_out", O._attr() + " " + O._camp()), ["hl", "still_out"]),
    )


def test_subscribers(src, con):
    assert_same(transitions.subscribers_net_daily(src.days, P), q(con, O.subs_body(), ["hl"]))


def test_ledger_with_nulls_backlogs_and_outages(src, con):
    got = transitions.pref_ledger_daily(src.days, P)
    assert_same(got, q(con, O.ledger_body(), ["hl"]))
    # the backlog and day-before first sightings really occur in the fixture
    tot = got.agg(F.sum("setup_optin"), F.sum("setup_optout")).collect()[0]
    assert tot[0] >= 2 and tot[1] >= 1


def test_delinks_rewrite_equals_cross_join(src, con):
    got = transitions.delink_daily(src.calendar, src.days, P)
    assert_same(got, q(con, O.delink_body(), ["hx"]))
    assert got.filter(F.col("delinks") > 0).count() > 0


def test_after_mail_min_first_equals_inequality_join(src, con):
    assert_same(cohort.optout_after_mail_daily(src.days, src.pref_latest, src.first_mail, P), q(con, O.after_body(), ["ahl"]))
    assert_same(
        cohort.cohort_vs_optout(src.days, src.pref_latest, src.first_mail, P),
        q(con, O.cohort_vs_optout_body(), ["ahl"]),
    )


def test_opt_out_invariant_total_ge_attributed_ge_campaign(src):
    class S(Src):
        pass

    s = S()
    s.__dict__.update(src.__dict__)
    s.pref_current = src.pref_latest
    b = boards.optout_board(s, P, calendar=src.calendar).collect()
    assert len(b) == len(H.DAYS)  # the spine keeps its row count
    for r in b:
        t, e, o = (r["total_opt_out"] or 0), (r["email_opt_out"] or 0), (r["onboarding_opt_out"] or 0)
        assert t >= e >= o


def test_semi_join_with_null_keys_behaves_like_in(spark, src, con):
    acc = transitions.attributed_accounts(src.opted_out, src.sent)
    assert None in {r[0] for r in acc.collect()}  # the key set itself holds a null
    left = spark.createDataFrame([(None,), (1,), (3,), (8,)], "account_id bigint")
    got = left.join(acc, "account_id", "left_semi")
    exp = con.sql(
        "SELECT account_id FROM (VALUES (NULL::BIGINT), (1), (3), (8)) t(account_id) "
        "WHERE account_id IN (SELECT a.account_id FROM opted_out a JOIN sent b ON a.message_id = b.message_id)"
    )
    assert_same(got, exp)
