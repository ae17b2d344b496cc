"""Mail engagement per local day: sends, first opens and clicks, opt-out events.

Distinct counts are exact (``count(DISTINCT)``); Spark plans them as a
partial aggregate on (day, type, message) before the shuffle, so a hot day
or campaign is spread by message id.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.timeutil import local_day_us
from daybook.params import CAMPAIGN_TYPES, DEFAULT, TOPICS, Params


def campaign_type(campaign: Column, params: Params = DEFAULT) -> Column:
    """'onboarding' / 'welcome' / 'newsletter' by campaign list, else null (checked in that order)."""
    return (
        F.when(campaign.isin(list(params.campaigns_onboarding_end)), F.lit("onboarding"))
        .when(campaign.isin(list(params.campaigns_welcome)), F.lit("welcome"))
        .when(campaign.isin(list(params.campaigns_newsletter)), F.lit("newsletter"))
    )


def topic_type(campaign: Column, params: Params = DEFAULT) -> Column:
    expr = None
    for label, cid in params.topic_pairs():
        cond = campaign == F.lit(cid)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def log_since(log: DataFrame, params: Params = DEFAULT, campaigns=None) -> DataFrame:
    """Partitions from the first log day on (typed partition filter), campaign list applied."""
    campaigns = params.campaigns_all if campaigns is None else campaigns
    first = int(params.first_log_day.strftime("%Y%m%d"))
    return log.filter((F.col("partition_day") >= F.lit(first)) & F.col("campaign_id").isin(list(campaigns)))


def first_events(log: DataFrame) -> DataFrame:
    """Earliest event time per (campaign, message)."""
    return log.groupBy("campaign_id", "message_id").agg(F.min("t_us").alias("t_us"))


def local_day(log: DataFrame, params: Params, name: str) -> Column:
    return local_day_us(F.col("t_us"), params.local_tz).alias(name)


def daily_distinct_messages(log: DataFrame, params: Params, day_name: str, count_name: str) -> DataFrame:
    return log.groupBy(local_day(log, params, day_name)).agg(F.countDistinct("message_id").alias(count_name))


def sends_daily(sent: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return daily_distinct_messages(log_since(sent, params), params, "send_day", "emails_sent")


def opens_first_daily(opened: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return daily_distinct_messages(first_events(log_since(opened, params)), params, "open_day", "emails_opened")


def _pivot(log: DataFrame, typ: Column, labels, params: Params, day_name: str, suffix: str) -> DataFrame:
    """Distinct messages per (day, type), one column per label; a missing cell is null."""
    per_type = log.groupBy(local_day(log, params, day_name), typ.alias("type")).agg(
        F.countDistinct("message_id").alias("n")
    )
    wide = per_type.groupBy(day_name).pivot("type", list(labels)).agg(F.max("n"))
    return wide.select(day_name, *[F.col(lbl).alias(f"{lbl}_{suffix}") for lbl in labels])


def by_type(log: DataFrame, params: Params, day_name: str, suffix: str, first_only: bool) -> DataFrame:
    rows = log_since(log, params)
    if first_only:
        rows = first_events(rows)
    return _pivot(rows, campaign_type(F.col("campaign_id"), params), CAMPAIGN_TYPES, params, day_name, suffix)


def sends_by_type(sent: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return by_type(sent, params, "send_day", "send", first_only=False)


def opens_by_type(opened: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return by_type(opened, params, "open_day", "open", first_only=True)


def clicks_by_type(clicked: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return by_type(clicked, params, "click_day", "click", first_only=True)


def optouts_by_type(opted_out: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return by_type(opted_out, params, "optout_day", "optout", first_only=False)


def by_topic(log: DataFrame, params: Params, day_name: str, suffix: str) -> DataFrame:
    """Onboarding-campaign events by topic, from the first log day (local day), no first-event step."""
    rows = log.filter(F.col("campaign_id").isin(list(params.campaigns_onboarding)))
    if params.partition_day_is_utc_day:
        # a local day >= D then lies in a partition >= D - 1, whatever the zone
        earliest = int((params.first_log_day - timedelta(days=1)).strftime("%Y%m%d"))
        rows = rows.filter(F.col("partition_day") >= F.lit(earliest))
    rows = rows.filter(local_day_us(F.col("t_us"), params.local_tz) >= F.lit(params.first_log_day))
    return _pivot(rows, topic_type(F.col("campaign_id"), params), TOPICS, params, day_name, suffix)


def sends_by_topic(sent: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return by_topic(sent, params, "send_day", "send")


def clicks_by_topic(clicked: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return by_topic(clicked, params, "click_day", "click")


def opens_by_topic(opened: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return by_topic(opened, params, "open_day", "open")


def optouts_by_topic(opted_out: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return by_topic(opted_out, params, "optout_day", "opt_out")


def log_block(
    log: DataFrame, params: Params, day_name: str, first_only: bool, total: str | None, type_suffix: str, topic_suffix: str
) -> DataFrame:
    """The daily total, the type and the topic columns of one log, in one scan and one wide shuffle.

    The same values as the blocks above (a cell without rows is null, null
    message ids make a cell but are not counted), for a log that serves all of them.
    """
    campaign = F.col("campaign_id")
    first = int(params.first_log_day.strftime("%Y%m%d"))
    recent = (F.col("partition_day") >= F.lit(first)) & campaign.isin(list(params.campaigns_all))
    d = local_day_us(F.col("t_us"), params.local_tz)
    topical = campaign.isin(list(params.campaigns_onboarding)) & (d >= F.lit(params.first_log_day))
    rows = log.filter(recent | topical).groupBy("campaign_id", "message_id", d.alias(day_name)).agg(
        F.max(F.coalesce(recent, F.lit(False))).alias("hit"), F.max(F.coalesce(topical, F.lit(False))).alias("topical")
    )
    if first_only:
        w = Window.partitionBy("campaign_id", "message_id")
        begun = F.min(F.when(F.col("hit"), F.col(day_name))).over(w)
        rows = rows.withColumn("begun", begun).withColumn("hit", F.col("hit") & F.col(day_name).eqNullSafe(F.col("begun")))
    flags = {total: F.col("hit")} if total else {}
    flags |= {f"{t}_{type_suffix}": F.col("hit") & (campaign_type(campaign, params) == t) for t in CAMPAIGN_TYPES}
    flags |= {f"{t}_{topic_suffix}": F.col("topical") & (topic_type(campaign, params) == t) for t in TOPICS}
    per = rows.groupBy(day_name, "message_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    known = F.col("message_id").isNotNull()
    return per.groupBy(day_name).agg(
        *[F.when(F.max(n), F.count(F.when(F.col(n) & known, 1))).alias(n) for n in flags]
    )


def activations_daily(pref_current_links: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Distinct devices linked per local day; input is ``explode_links`` of the current table."""
    return pref_current_links.groupBy(local_day_us(F.col("linked_ms") * 1000, params.local_tz).alias("activation_date")).agg(
        F.countDistinct("device_id").alias("device_activations")
    )


def linked_accounts_daily(pref_current_links: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Accounts counted on their first link day (first per (account, flag))."""
    first = pref_current_links.groupBy("account_id", "pref_flag").agg(
        F.min(local_day_us(F.col("linked_ms") * 1000, params.local_tz)).alias("link_date")
    )
    return first.groupBy("link_date").agg(F.countDistinct("account_id").alias("current_linked"))


