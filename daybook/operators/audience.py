"""Mailing audience: opted-in accounts with the right locale, tenure and device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.timeutil import utc_day_us
from daybook.params import DEFAULT, Params


def audience_select(pref_current: DataFrame, contacts: DataFrame, devices: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per recipient: account, address, language, country, reporting copy of the id, control flag."""
    linked_day = utc_day_us(F.col("lnk.time_linked_with_user_ms") * 1000)
    a = (
        pref_current.select(
            "account_id", "pref_flag", "language", "country", "country_incorrect", "segment",
            F.explode("device_data").alias("lnk"),
        )
        .filter(
            (F.datediff(F.lit(params.as_of), linked_day) > params.tenure_days)
            & (linked_day >= F.lit(params.launch_date))
            & (F.col("pref_flag") == True)  # noqa: E712
            & F.lower("language").isin(list(params.languages))
            & F.lower("country").isin(list(params.countries))
            & (F.col("country_incorrect") != True)  # noqa: E712  (null drops the row)
        )
        .select(
            "account_id",
            F.col("lnk.device_id").alias("device_id"),
            "language",
            "country",
            F.when(F.col("segment").isin(list(params.control_segments)), True).otherwise(False).alias("control"),
        )
    )
    b = contacts.filter(F.col("email").isNotNull()).select("account_id", "email")
    c = devices.filter(
        (F.lower("model_name") == params.device_model) & F.lower("product_name").isin(list(params.device_products))
    ).select("device_id")
    # Device test first, then drop the device: one row per account and locale
    # remains (the partial aggregate collapses a many-device account before
    # the shuffle), and only that row meets the contact join.
    owners = a.join(c, "device_id", "left_semi").select("account_id", "language", "country", "control").distinct()
    rows = owners.join(b, "account_id")
    return rows.select(
        F.col("account_id").alias("opt_out_id"),
        F.col("email").alias("email_address"),
        F.col("language").alias("language_preference"),
        "country",
        F.col("account_id").alias("reporting1"),
        "control",
    ).distinct()


def preview(recipients: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` recipients in a fixed order (the reference previews one arbitrary row)."""
    return recipients.orderBy("opt_out_id", "email_address", "language_preference", "country", "control").limit(n)
