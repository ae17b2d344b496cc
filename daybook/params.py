"""All tunable values of the analyses in one frozen dataclass.

Nothing here reads the clock: ``as_of`` is always an explicit value so that
results are reproducible.  Defaults are the values the fixtures in
``daybook.sources.fixtures`` are built for (see FIXTURES.md).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pivot labels of the campaign-type and topic breakdowns.
# They name output columns (``welcome_send``, ``music_open`` ...).
CAMPAIGN_TYPES = ("welcome", "onboarding", "newsletter")
TOPICS = ("music", "tasks", "answers", "devices", "personality")
# Spend tiers, highest first.
TIER_LABELS = ("Top", "Mid", "Bottom", "Longtail")


@dataclass(frozen=True)
class Params:
    # -- revenue and tier ---------------------------------------------------
    date_epoch: date = date(1995, 1, 1)  # day 0 of the integer date id
    cutoff_date_id: int = 2403  # observation cutoff, as a date id
    open_end_sentinel: int = 99999  # end of an open acquisition interval
    window_days: int = 91
    tier_floors: tuple[int, int, int] = (75000, 30000, 5000)
    billing_category: str = "Billable"
    excluded_service_country: str = "NATION_3"
    activation_year: int = 2001

    # -- snapshots, calendar and boards ------------------------------------
    local_tz: str = "America/Los_Angeles"
    base_min_size: int = 10  # default base filter: device size > 10
    base_filter: Column | None = field(default=None, compare=False, hash=False)
    as_of: date = date(2024, 2, 1)
    latest_day: int = 20240130  # newest snapshot partition (yyyymmdd)
    seed_day: date = date(2024, 1, 1)  # keeps its raw subscriber stock
    first_log_day: date = date(2024, 1, 2)  # first day read from the event logs
    # changes seen on these link days are booked on the link day itself
    outages: tuple[tuple[date, date], ...] = (
        (date(2024, 1, 4), date(2024, 1, 9)),
        (date(2024, 1, 12), date(2024, 1, 13)),
    )
    # (first link day, last link day, resume snapshot day) of set-up backlogs
    backlogs: tuple[tuple[date, date, date], ...] = (
        (date(2024, 1, 4), date(2024, 1, 10), date(2024, 1, 10)),
        (date(2024, 1, 11), date(2024, 1, 12), date(2024, 1, 14)),
    )
    # promise that a log's partition day is the UTC day of its events: lets topic blocks prune partitions
    partition_day_is_utc_day: bool = False

    # -- campaigns -----------------------------------------------------------
    campaigns_all: tuple[int, ...] = tuple(range(10))
    campaigns_onboarding_end: tuple[int, ...] = (0, 1, 2, 3, 4)
    campaigns_welcome: tuple[int, ...] = (5,)
    campaigns_newsletter: tuple[int, ...] = (6, 7)
    campaigns_onboarding: tuple[int, ...] = (0, 1, 2, 3, 4)
    # topic label -> campaign id, in TOPICS order
    topic_campaigns: tuple[int, ...] = (0, 1, 2, 3, 4)
    attributed_campaigns: tuple[int, ...] = (0, 1)

    # -- audience ------------------------------------------------------------
    tenure_days: int = 21
    launch_date: date = date(2024, 1, 2)
    languages: tuple[str, ...] = tuple(f"nation_{i}" for i in range(15))
    countries: tuple[str, ...] = ("asia", "europe", "america")
    device_model: str = "large"
    device_products: tuple[str, ...] = ("brand#7", "brand#10", "brand#11", "brand#17", "brand#24")
    control_segments: tuple[str, ...] = ("BUILDING", "MACHINERY")

    def __post_init__(self) -> None:
        if len(self.topic_campaigns) != len(TOPICS):
            raise ValueError(f"topic_campaigns needs one campaign for each of {TOPICS}")

    def base_predicate(self) -> Column:
        """Predicate over (account, device link, device) rows."""
        if self.base_filter is not None:
            return self.base_filter
        return F.col("size") > F.lit(self.base_min_size)

    def topic_pairs(self) -> list[tuple[str, int]]:
        return list(zip(TOPICS, self.topic_campaigns, strict=True))


DEFAULT = Params()
