"""Revenue edges: zero and negative proration divisors, the A+91 = C boundary, open and closed intervals."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest

from tests.conftest import assert_same

from daybook.operators import revenue
from daybook.params import Params
from daybook.plans.oracle import Oracle

P = Params(cutoff_date_id=2403, activation_year=2001, date_epoch=Params().date_epoch)
O = Oracle(P)

# activation ids in 2001 (date ids 2192..2556 for 1995 epoch)
ACQ = [
    # account, activation, next, channel, subchannel, billing, service country, fraud, country
    (1, 2403, None, "A", "F", "Billable", "NATION_1", False, 1),  # A = C: zero divisor -> null
    (2, 2450, None, "A", "F", "Billable", "NATION_1", False, 2),  # A > C: negative factor kept
    (3, 2312, 2330, "B", "O", "Billable", "NATION_2", False, 21),  # A + 91 = C, closed interval, no region
    (3, 2330, None, "B", "O", "Billable", "NATION_2", False, 21),  # next interval of the same account
    (4, 2200, None, "C", "P", "Billable", "NATION_4", False, 4),  # window closed before the cutoff
    (5, 2200, None, "C", "P", "Unbilled", "NATION_4", False, 4),  # filtered: billing
    (6, 2200, None, "C", "P", "Billable", "NATION_3", False, 4),  # filtered: service country
    (7, 2200, None, "C", "P", "Billable", "NATION_4", True, 4),  # filtered: fraud
    (8, 2100, None, "C", "P", "Billable", "NATION_4", False, 4),  # filtered: year 2000
    (9, 2300, None, "D", "F", "Billable", "NATION_5", False, 5),  # only facts after the window: sum 0
]
FACTS = [
    (1, 2403, "100.10"), (1, 2404, "5.00"),
    (2, 2451, "80000.00"),
    (3, 2312, "40000.00"), (3, 2329, "1.00"), (3, 2330, "7000.00"), (3, 2500, "3.00"),
    (4, 2199, "9.99"), (4, 2200, "5000.00"), (4, 2290, "1.00"), (4, 2291, "100000.00"),
    (5, 2200, "1.00"), (6, 2200, "1.00"), (7, 2200, "1.00"), (8, 2100, "1.00"),
    (9, 2400, "12.00"),
]
GEO = [(1, "EUROPE"), (2, "ASIA"), (4, "AFRICA"), (5, "AMERICA")]


@pytest.fixture(scope="module")
def frames(spark):
    acq = spark.createDataFrame(
        ACQ,
        "account_id bigint, activation_date_id int, next_event_date_id int, channel string, subchannel string, "
        "billing_category string, service_country string, is_fraud boolean, country_code int",
    )
    facts = spark.createDataFrame([(a, d, Decimal(x)) for a, d, x in FACTS], "account_id bigint, date_id int, amount decimal(18,2)")
    geo = spark.createDataFrame(GEO, "country_code int, region string")
    return facts, acq, geo


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(
        "CREATE TABLE acquisitions (account_id BIGINT, activation_date_id INTEGER, next_event_date_id INTEGER, channel VARCHAR, "
        "subchannel VARCHAR, billing_category VARCHAR, service_country VARCHAR, is_fraud BOOLEAN, country_code INTEGER)"
    )
    c.executemany("INSERT INTO acquisitions VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", ACQ)
    c.execute("CREATE TABLE revenue_facts (account_id BIGINT, date_id INTEGER, amount DECIMAL(18,2))")
    c.executemany("INSERT INTO revenue_facts VALUES (?, ?, ?)", [(a, d, Decimal(x)) for a, d, x in FACTS])
    c.execute("CREATE TABLE geo (country_code INTEGER, region VARCHAR)")
    c.executemany("INSERT INTO geo VALUES (?, ?)", GEO)
    return c


def test_revenue_matches_direct_sql(frames, con):
    got = revenue.revenue_91d(*frames, P)
    assert_same(got, con.sql(O.revenue_select()))


def test_revenue_edge_values(frames):
    rows = {(r.account_id, r.activation_date_id): r for r in revenue.revenue_91d(*frames, P).collect()}
    assert rows[(1, 2403)].gross_revenue_91d is None and rows[(1, 2403)].adjusted == 1
    assert rows[(2, 2450)].gross_revenue_91d < 0 and rows[(2, 2450)].tier == "Top"
    r3 = rows[(3, 2312)]
    assert r3.adjusted == 1 and r3.gross_revenue_91d == pytest.approx(40001.0) and r3.region is None and r3.tier == "Mid"
    r4 = rows[(4, 2200)]
    assert r4.adjusted == 0 and r4.gross_revenue_91d == pytest.approx(5001.0) and r4.tier == "Bottom"
    r9 = rows[(9, 2300)]  # joined, but its only fact is past the window
    assert r9.gross_revenue_91d == 0.0 and r9.adjusted == 0 and r9.tier == "Longtail"
    assert {a for a, _ in rows} == {1, 2, 3, 4, 9}
