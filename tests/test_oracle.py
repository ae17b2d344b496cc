"""Every registered query against its DuckDB oracle at sf0.001 (the driver does the same at sf0.01)."""

from __future__ import annotations

import pytest

from tests.conftest import SF_SMALL, assert_same

from daybook.plans.registry import ORACLE, QUERIES

KEYS = sorted(QUERIES)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    assert_same(QUERIES[key](spark, SF_SMALL), duck.sql(ORACLE[key]))


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert "cal_date" in df.columns and "month" in df.columns
    assert set(QUERIES) <= set(e.oracle_sql()) <= set(e.queries())


ZONE_KEYS = ["lifecycle_board", "optout_board", "sends_daily", "opens_by_topic", "calendar_from_links", "audience_select", "revenue_91d", "fn_local_day_us", "fn_utc_day_us", "fn_day_epoch_offset"]


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/Los_Angeles"])
def test_results_do_not_depend_on_session_zone(spark, duck, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for key in ZONE_KEYS:
            assert_same(QUERIES[key](spark, SF_SMALL), duck.sql(ORACLE[key]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
