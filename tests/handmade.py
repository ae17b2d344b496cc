"""Hand-made snapshot rows for edges the generated data lacks.

Null flags, an empty ``device_data``, an account missing from later
snapshots, a device failing the base filter, duplicate link days, first
sightings on set-up backlog resume days and on link day + 1, outage link days.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pyarrow as pa

D0 = date(2024, 1, 1)
DAYS = [D0 + timedelta(days=i) for i in range(16)]
LAST = DAYS[-1]


def day_int(d: date) -> int:
    return int(d.strftime("%Y%m%d"))


def ms_at_noon_la(d: date) -> int:
    # 20:00 UTC is 12:00 in Los Angeles in winter: same calendar day
    return int(datetime(d.year, d.month, d.day, 20, 0, tzinfo=timezone.utc).timestamp() * 1000)


T, F_, N = True, False, None

# account -> (list of (day index, flag), links (device, link day), days with an empty device_data)
ACCOUNTS = {
    1: ([(i, f) for i, f in enumerate([T, T, F_, F_, T, T, F_, F_] + [F_] * 8)], [(1, DAYS[0]), (2, DAYS[4]), (3, DAYS[4])], set()),
    2: ([(0, N), (1, T), (2, N), (3, F_), (4, T)] + [(i, F_) for i in range(5, 16)], [(1, DAYS[0]), (4, DAYS[2])], set()),
    3: ([(2, F_), (3, T), (4, F_)] + [(i, F_) for i in range(5, 16)], [(2, DAYS[3])], {2}),
    4: ([(0, T), (1, T), (2, F_), (3, F_), (4, F_)], [(1, DAYS[0]), (2, DAYS[1])], set()),
    5: ([(i, T) for i in range(16)], [(9, DAYS[0])], set()),  # device 9 fails the base filter
    6: ([(i, T) for i in range(9, 16)], [(1, DAYS[6]), (2, DAYS[9])], set()),  # backlog 1, seen on resume day 01-10
    7: ([(i, F_) for i in range(13, 16)], [(3, DAYS[10])], set()),  # backlog 2, seen on resume day 01-14
    8: ([(i, f) for i, f in zip(range(8, 16), [T, T, F_, T, T, F_, F_, F_])], [(1, DAYS[7])], set()),  # link day = day - 1
    9: ([(i, T if i < 12 else F_) for i in range(16)], [(1, DAYS[0]), (2, DAYS[0]), (4, DAYS[5]), (3, DAYS[11])], set()),
    10: ([(i, F_) for i in range(16)], [(1, DAYS[0])], set()),
}

DEVICES = [(1, "LARGE", "Brand#7", 20), (2, "LARGE", "Brand#10", 30), (3, "SMALL", "Brand#7", 11), (4, "MEDIUM", "Brand#1", 12), (9, "LARGE", "Brand#7", 5)]

LINK_T = pa.struct([("device_id", pa.int64()), ("time_linked_with_user_ms", pa.int64())])
HIST_SCHEMA = pa.schema(
    [("account_id", pa.int64()), ("pref_flag", pa.bool_()), ("device_data", pa.list_(LINK_T)), ("partition_day", pa.int64())]
)
SPARK_HIST = "account_id bigint, pref_flag boolean, device_data array<struct<device_id:bigint,time_linked_with_user_ms:bigint>>, partition_day bigint"


def history_rows():
    rows = []
    for acct, (flags, links, empty) in ACCOUNTS.items():
        for i, flag in flags:
            d = DAYS[i]
            dd = [] if i in empty else [{"device_id": dev, "time_linked_with_user_ms": ms_at_noon_la(ld)} for dev, ld in links if ld <= d]
            rows.append((acct, flag, dd, day_int(d)))
    return rows


FIRST_MAIL = [(1, day_int(DAYS[2])), (10, day_int(DAYS[2])), (10, day_int(DAYS[4])), (2, day_int(DAYS[1])), (8, day_int(DAYS[12])), (6, day_int(DAYS[9]))]
# (message, campaign, account, t_us, partition_day)
SENT = [(11, 0, 1, 0, 0), (101, 1, 10, 0, 0), (21, 5, 2, 0, 0), (81, 0, 8, 0, 0), (None, 3, 3, 0, 0)]
OPTED = [(11, 0, 1, 0, 0), (101, 1, 10, 0, 0), (99, 0, 8, 0, 0), (21, 5, 2, 0, 0), (None, 0, None, 0, 0), (81, 0, None, 0, 0)]
LOG_SCHEMA = "message_id bigint, campaign_id bigint, account_id bigint, t_us bigint, partition_day bigint"
