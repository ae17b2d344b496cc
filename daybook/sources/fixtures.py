"""Neutral input tables (FIXTURES.md F1-F13) derived from the driver's parquet.

Each property is a lazy DataFrame: nothing but a count of the events runs until a query acts on it,
so Catalyst prunes columns and pushes filters down into these derivations.
The DuckDB mirror used by the oracle lives in ``daybook.plans.fixture_sql``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.functions.timeutil import date_id, day_int, local_day_us, micros_of
from daybook.params import DEFAULT, Params

#: Events whose accounts' snapshots and links one task handles.
EVENTS_A_PART = 25_000
EVENT_LOGS = {"sent": "signup", "opened": "view", "clicked": "click", "opted_out": "error"}


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = DEFAULT):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.p = params

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- F1-F3: revenue -----------------------------------------------------
    @cached_property
    def revenue_facts(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
        o = self.table("orders").select("o_orderkey", "o_custkey")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.col("o_custkey").alias("account_id"),
            date_id(F.to_date("l_shipdate"), self.p.date_epoch).alias("date_id"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        )

    @cached_property
    def acquisitions(self) -> DataFrame:
        days = (
            self.table("orders")
            .filter(F.col("o_orderpriority") == "1-URGENT")
            .groupBy(F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("d"))
            .agg(F.min("o_orderstatus").alias("subchannel"))
        )
        nxt = F.lead("d").over(Window.partitionBy("account_id").orderBy("d"))
        days = days.withColumn("next_d", nxt)
        c = self.table("customer")
        n = self.table("nation")
        return (
            days.join(c, days.account_id == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .select(
                "account_id",
                date_id("d", self.p.date_epoch).alias("activation_date_id"),
                date_id("next_d", self.p.date_epoch).alias("next_event_date_id"),
                F.col("c_mktsegment").alias("channel"),
                "subchannel",
                F.when(F.col("c_acctbal") >= 0, "Billable").otherwise("Unbilled").alias("billing_category"),
                F.col("n_name").alias("service_country"),
                (F.col("c_custkey") % 50 == 0).alias("is_fraud"),
                F.col("c_nationkey").alias("country_code"),
            )
        )

    @cached_property
    def geo(self) -> DataFrame:
        n = self.table("nation")
        r = self.table("region")
        return (
            n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").alias("country_code"), F.col("r_name").alias("region"))
        )

    # -- events -> snapshots and logs -----------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            "user_id",
            "event_id",
            "event_type",
            micros_of("ts").alias("us"),
            F.to_date("ts").alias("utc_day"),
            day_int(F.to_date("ts")).alias("partition_day"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
        )

    @cached_property
    def links(self) -> DataFrame:
        """First link of each (account, device): epoch ms and local link day."""
        return (
            self.events.groupBy(F.col("user_id").alias("account_id"), F.col("k").alias("device_id"))
            .agg(F.min("us").alias("min_us"), F.min(local_day_us("us", self.p.local_tz)).alias("link_day"))
            .select("account_id", "device_id", F.expr("min_us div 1000").alias("ms"), "link_day")
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Flag per (account, UTC day): the day's last event (by id) is not an error."""
        return self.events.groupBy(F.col("user_id").alias("account_id"), "utc_day", "partition_day").agg(
            F.max_by(F.col("event_type") != "error", "event_id").alias("pref_flag")
        )

    @cached_property
    def account_parts(self) -> int:
        """Parts that the accounts' rows are dealt into: as many as the events need, whatever bytes a shuffle holds."""
        return max(1, -(-self.table("events").count() // EVENTS_A_PART))

    def _with_links(self, snap: DataFrame) -> DataFrame:
        """Attach to each snapshot row the account's links made on or before its day.

        An account's links are gathered once, as many as its last snapshot holds, and each of its snapshot rows
        takes those made so far, so the pairs of days and links are never sorted or held.  The parts' number is stated:
        adaptive execution sizes tasks by the bytes before the links of a day are repeated on every later day.
        """
        lk = self.links.repartition(self.account_parts, "account_id")
        own = lk.groupBy("account_id").agg(F.collect_list(F.struct("link_day", "device_id", "ms")).alias("links"))
        j = snap.repartition(self.account_parts, "account_id").join(own, "account_id")
        made = F.filter("links", lambda x: x["link_day"] <= F.col("utc_day"))
        each = F.transform(made, lambda x: F.struct(x["device_id"].alias("device_id"), x["ms"].alias("time_linked_with_user_ms")))
        return j.select("account_id", "pref_flag", "partition_day", each.alias("device_data")).where(F.size("device_data") > 0)

    @cached_property
    def pref_history(self) -> DataFrame:
        """one snapshot row per (account, UTC day) holding the links made so far."""
        return self._with_links(self.snapshots).select("account_id", "pref_flag", "device_data", "partition_day")

    @cached_property
    def pref_latest(self) -> DataFrame:
        return latest_of(self.pref_history, self.p.latest_day)

    @cached_property
    def pref_current(self) -> DataFrame:
        """each account's last snapshot, with locale and segment of the same-key customer."""
        last = self.snapshots.groupBy("account_id").agg(
            F.max_by(F.struct("pref_flag", "utc_day", "partition_day"), "partition_day").alias("s")
        )
        last = last.select("account_id", "s.pref_flag", "s.utc_day", "s.partition_day")
        cur = self._with_links(last)
        c = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        n = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.table("region").select("r_regionkey", "r_name")
        acct = F.col("account_id")
        return (
            cur.join(c, cur.account_id == c.c_custkey, "left")
            .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
            .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
            .select(
                "account_id",
                "pref_flag",
                F.col("n_name").alias("language"),
                F.col("r_name").alias("country"),
                F.when(acct % 7 == 0, F.lit(None).cast("boolean")).otherwise(acct % 11 == 0).alias("country_incorrect"),
                F.col("c_mktsegment").alias("segment"),
                "device_data",
            )
        )

    @cached_property
    def contacts(self) -> DataFrame:
        c = self.table("customer")
        return c.select(
            F.col("c_custkey").alias("account_id"),
            F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.col("c_name"), F.lit("@example.com")))
            .alias("email"),
            F.col("c_nationkey").cast("bigint").alias("contact_key"),
        )

    @cached_property
    def devices(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("device_id"),
            F.col("p_type").alias("model_name"),
            F.col("p_brand").alias("product_name"),
            F.col("p_size").alias("size"),
        )

    def _log(self, event_type: str) -> DataFrame:
        e = self.events.filter(F.col("event_type") == event_type)
        return e.select(
            (F.col("user_id") * 10 + F.col("k") % 10).alias("message_id"),
            (F.col("k") % 10).alias("campaign_id"),
            F.col("user_id").alias("account_id"),
            F.col("us").alias("t_us"),
            "partition_day",
        )

    @cached_property
    def sent(self) -> DataFrame:
        return self._log(EVENT_LOGS["sent"])

    @cached_property
    def opened(self) -> DataFrame:
        return self._log(EVENT_LOGS["opened"])

    @cached_property
    def clicked(self) -> DataFrame:
        return self._log(EVENT_LOGS["clicked"])

    @cached_property
    def opted_out(self) -> DataFrame:
        return self._log(EVENT_LOGS["opted_out"])

    @cached_property
    def first_mail(self) -> DataFrame:
        return self.sent.select("account_id", "partition_day").distinct()


def latest_of(history: DataFrame, latest_day: int) -> DataFrame:
    return history.filter(F.col("partition_day") == F.lit(int(latest_day)))
