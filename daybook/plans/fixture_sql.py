"""DuckDB mirror of the fixture views in ``daybook.sources.fixtures``.

The oracle queries in ``daybook.plans.oracle`` are written against these
CTEs, which derive the neutral input tables (FIXTURES.md) from the
driver-generated parquet views.  Only the CTEs a query needs (and their
dependencies) are emitted.
"""

from __future__ import annotations

LOCAL_TZ = "America/Los_Angeles"


def local_day_sql(ts_expr: str, tz: str = LOCAL_TZ) -> str:
    """Local calendar day of a naive UTC timestamp expression."""
    return f"CAST(timezone('{tz}', timezone('UTC', {ts_expr})) AS DATE)"


def local_day_us_sql(us_expr: str, tz: str = LOCAL_TZ) -> str:
    return local_day_sql(f"make_timestamp({us_expr})", tz)


def local_day_ms_sql(ms_expr: str, tz: str = LOCAL_TZ) -> str:
    return local_day_sql(f"make_timestamp(({ms_expr}) * 1000)", tz)


def day_from_int_sql(expr: str) -> str:
    """yyyymmdd integer -> DATE."""
    e = f"CAST({expr} AS BIGINT)"
    return f"make_date(CAST({e} // 10000 AS INTEGER), CAST(({e} // 100) % 100 AS INTEGER), CAST({e} % 100 AS INTEGER))"


# name -> (dependencies, body)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "revenue_facts": ((), """
        SELECT o.o_custkey AS account_id,
               CAST(date_diff('day', DATE '1995-01-01', CAST(l.l_shipdate AS DATE)) AS INTEGER) AS date_id,
               CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""),
    "acq_days": ((), """
        SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS d, min(o_orderstatus) AS subchannel
        FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2"""),
    "acquisitions": (("acq_days",), """
        SELECT a.account_id,
               CAST(date_diff('day', DATE '1995-01-01', a.d) AS INTEGER) AS activation_date_id,
               CAST(date_diff('day', DATE '1995-01-01',
                    lead(a.d) OVER (PARTITION BY a.account_id ORDER BY a.d)) AS INTEGER) AS next_event_date_id,
               c.c_mktsegment AS channel,
               a.subchannel,
               CASE WHEN c.c_acctbal >= 0 THEN 'Billable' ELSE 'Unbilled' END AS billing_category,
               n.n_name AS service_country,
               (c.c_custkey % 50 = 0) AS is_fraud,
               c.c_nationkey AS country_code
        FROM acq_days a
        JOIN customer c ON a.account_id = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey"""),
    "geo": ((), """
        SELECT n.n_nationkey AS country_code, r.r_name AS region
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "ev": ((), """
        SELECT user_id, event_id, event_type, epoch_us(ts) AS us, CAST(ts AS DATE) AS utc_day,
               CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS partition_day,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
        FROM events"""),
    "links": (("ev",), f"""
        SELECT user_id AS account_id, k AS device_id, min(us) // 1000 AS ms,
               min({local_day_sql('make_timestamp(us)')}) AS link_day
        FROM ev GROUP BY 1, 2"""),
    "snap": (("ev",), """
        SELECT user_id AS account_id, utc_day, partition_day,
               arg_max(event_type, event_id) <> 'error' AS pref_flag
        FROM ev GROUP BY 1, 2, 3"""),
    "pref_history": (("snap", "links"), """
        SELECT s.account_id, s.pref_flag,
               list({'device_id': l.device_id, 'time_linked_with_user_ms': l.ms} ORDER BY l.device_id) AS device_data,
               s.partition_day
        FROM snap s JOIN links l ON l.account_id = s.account_id AND l.link_day <= s.utc_day
        GROUP BY s.account_id, s.pref_flag, s.partition_day"""),
    "pref_latest": (("pref_history",), """
        SELECT * FROM pref_history WHERE partition_day = {latest_day}"""),
    "pref_current": (("pref_history",), """
        SELECT h.account_id, h.pref_flag, n.n_name AS language, r.r_name AS country,
               CASE WHEN h.account_id % 7 = 0 THEN NULL ELSE h.account_id % 11 = 0 END AS country_incorrect,
               c.c_mktsegment AS segment, h.device_data
        FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY partition_day DESC) AS rn
              FROM pref_history) h
        LEFT JOIN customer c ON c.c_custkey = h.account_id
        LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
        LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
        WHERE h.rn = 1"""),
    "contacts": ((), """
        SELECT c_custkey AS account_id,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name || '@example.com' END AS email,
               CAST(c_nationkey AS BIGINT) AS contact_key
        FROM customer"""),
    "devices": ((), """
        SELECT p_partkey AS device_id, p_type AS model_name, p_brand AS product_name, p_size AS size
        FROM part"""),
    "sent": (("ev",), """
        SELECT user_id * 10 + k % 10 AS message_id, k % 10 AS campaign_id, user_id AS account_id,
               us AS t_us, partition_day FROM ev WHERE event_type = 'signup'"""),
    "opened": (("ev",), """
        SELECT user_id * 10 + k % 10 AS message_id, k % 10 AS campaign_id, user_id AS account_id,
               us AS t_us, partition_day FROM ev WHERE event_type = 'view'"""),
    "clicked": (("ev",), """
        SELECT user_id * 10 + k % 10 AS message_id, k % 10 AS campaign_id, user_id AS account_id,
               us AS t_us, partition_day FROM ev WHERE event_type = 'click'"""),
    "opted_out": (("ev",), """
        SELECT user_id * 10 + k % 10 AS message_id, k % 10 AS campaign_id, user_id AS account_id,
               us AS t_us, partition_day FROM ev WHERE event_type = 'error'"""),
    "first_mail": (("sent",), """
        SELECT DISTINCT account_id, partition_day FROM sent"""),
}

FIXTURE_NAMES = tuple(_CTES)

# Materialised once per query: DuckDB 2.0 fails with an internal
# dictionary-vector error when this CTE is inlined into the audience joins.
_MATERIALIZED = {"pref_current"}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for dep in _CTES[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_fixtures(body: str, needs, latest_day: int = 20240130) -> str:
    """Prefix ``body`` with the fixture CTEs it reads (plus dependencies)."""
    parts = []
    for name in _order(needs):
        text = _CTES[name][1].replace("{latest_day}", str(int(latest_day)))
        mat = "MATERIALIZED " if name in _MATERIALIZED else ""
        parts.append(f"{name} AS {mat}({text}\n)")
    if not parts:
        return body
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
