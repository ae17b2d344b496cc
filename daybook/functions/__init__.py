from daybook.functions.timeutil import (  # noqa: F401
    date_id,
    date_of_id,
    day_epoch_ms,
    day_from_int,
    day_int,
    local_day_ms,
    local_day_us,
    micros_of,
    month_name,
    ntz_from_micros,
    period_quarter,
    period_year,
    utc_day_us,
)
