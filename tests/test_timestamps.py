from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from taxoflow.functions.zones import zone_table
from taxoflow.operators.timestamps import normalise_timestamps

DESKS = [("D1", "America/New_York", "MDY"), ("D2", "Europe/Berlin", "DMY"), ("D3", "Asia/Seoul", "YMD"), ("D4", None, None), ("D5", "Nowhere/City", "DMY")]
LABELS = [("EST", -300), ("KST", 540), ("UTC", 0), ("Z", 0), ("GMT", 0), ("IST", 330)]

CASES = [
    ("2024-05-06", "D1", "2024-05-06T04:00:00.000000Z"),
    (" 2024-05-06 ", "D2", "2024-05-05T22:00:00.000000Z"),
    ("20240506", "D3", "2024-05-05T15:00:00.000000Z"),
    ("05/06/2024", "D1", "2024-05-06T04:00:00.000000Z"),
    ("05/06/2024", "D2", "2024-06-04T22:00:00.000000Z"),
    ("24.05.06", "D3", "2024-05-05T15:00:00.000000Z"),
    ("5.6.24", "D2", "2024-06-04T22:00:00.000000Z"),
    ("2024/5/6 2:42 PM", "D3", "2024-05-06T05:42:00.000000Z"),
    ("2024년 5월 6일 오후 12시 5분", "D3", "2024-05-06T03:05:00.000000Z"),
    ("2024년 5월 6일 오전 12시 05분", "D3", "2024-05-05T15:05:00.000000Z"),
    ("16. März 2020, 10.51 Uhr", "D2", "2020-03-16T09:51:00.000000Z"),
    ("1. Sept. 2020", "D2", "2020-08-31T22:00:00.000000Z"),
    ("December 26th, 2017", "D1", "2017-12-26T05:00:00.000000Z"),
    ("15-JUN-2021", "D1", "2021-06-15T04:00:00.000000Z"),
    ("Fri, 27 Mar 2020 20:50:18 +0100", "D1", "2020-03-27T19:50:18.000000Z"),
    ("May 25, 2020, 9:27 PM IST", "D1", "2020-05-25T15:57:00.000000Z"),
    ("2020-03-27T02:00:55.1234567+05:30", "D1", "2020-03-26T20:30:55.123456Z"),
    ("2020-03-27 02:00 [Asia/Seoul]", "D1", "2020-03-26T17:00:00.000000Z"),
    ("2020-03-27 02:00:01 America/New_York", "D2", "2020-03-27T06:00:01.000000Z"),
    ("20210218T030220Z", "D1", "2021-02-18T03:02:20.000000Z"),
    ("2021-W50-7", "D3", "2021-12-18T15:00:00.000000Z"),
    ("1639951292", "D1", "2021-12-19T22:01:32.000000Z"),
    ("1639951292123", "D1", "2021-12-19T22:01:32.123000Z"),
    ("1639951292123456", "D1", "2021-12-19T22:01:32.123456Z"),
    # twice: the earlier instant; skipped: the offset from before
    ("2021-11-07 01:30", "D1", "2021-11-07T05:30:00.000000Z"),
    ("2021-03-14 02:30", "D1", "2021-03-14T07:30:00.000000Z"),
    ("2021-10-31 02:30", "D2", "2021-10-31T00:30:00.000000Z"),
    ("2021-03-28 02:30", "D2", "2021-03-28T01:30:00.000000Z"),
    ("2024-02-29T00:00Z", "D4", "2024-02-29T00:00:00.000000Z"),
]
NONE = [
    ("2024-05-06", "D4"), ("2024-05-06", "D5"), ("2024-05-06", None), ("2024-05-06", "D9"), ("2023-02-29", "D1"), ("0000-00-00", "D1"), ("31.06.2025", "D2"), ("2025", "D1"), ("2025-10", "D1"),
    ("spring 2024", "D1"), ("Q3 2025", "D1"), ("", "D1"), ("   ", "D1"), (None, "D1"), ("n/a", "D1"), ("2024-05-06 25:00", "D1"), ("2024-05-06 10:61", "D1"), ("2020-W53-9", "D1"), ("2021-W53-1", "D1"),
    ("13:00 PM", "D1"), ("2024-05-06 13:00 PM", "D1"), ("x" * 5000, "D1"), ("123456789012345", "D1"), ("2024-05-06 10:00 Mars/Olympus", "D1"), ("٢٠٢٤-٠٥-٠٦", "D1"), ("2024-05-06T10:00+99:00", "D1"),
]


def tables(spark):
    return spark.createDataFrame(DESKS, "desk_id string, time_zone string, date_order string"), spark.createDataFrame(LABELS, "label string, utc_offset_minutes int")


def test_notations(spark):
    desks, labels = tables(spark)
    rows = [(i, v, d) for i, (v, d, _) in enumerate(CASES)] + [(1000 + i, v, d) for i, (v, d) in enumerate(NONE)]
    out = normalise_timestamps(spark.createDataFrame(rows, "row_id long, date string, desk_id string"), "row_id", ["date"], desks, "desk_id", labels).collect()
    got = {r.row_id: r.utc for r in out}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: u for i, (_, _, u) in enumerate(CASES)}
    assert not [NONE[i - 1000] for i in got if i >= 1000]


def test_repeats_empty_and_clashing_columns(spark):
    desks, labels = tables(spark)
    df = spark.createDataFrame([(1, "2024-05-06", "D1", "x", 3, "y"), (1, "2024-05-06", "D1", "x", 3, "y")], "row_id long, date string, desk_id string, time_zone string, field int, utc string")
    out = normalise_timestamps(df, "row_id", ["date"], desks, "desk_id", labels).collect()
    assert [tuple(r) for r in out] == [(1, "date", "2024-05-06T04:00:00.000000Z")] * 2
    assert normalise_timestamps(df.limit(0), "row_id", ["date"], desks, "desk_id", labels).count() == 0


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr("taxoflow.operators.timestamps.MAX_LABELS", 2)
    desks, labels = tables(spark)
    with pytest.raises(ValueError):
        normalise_timestamps(spark.createDataFrame([(1, "a", "D1")], "row_id long, date string, desk_id string"), "row_id", ["date"], desks, "desk_id", labels)


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Dublin", "Australia/Lord_Howe", "Asia/Kathmandu", "Africa/Casablanca"])
def test_zone_table_agrees_with_folds(zone):
    table, info = zone_table([zone]), ZoneInfo(zone)
    wall = np.random.default_rng(3).integers(0, 2_050_000_000, 4000)
    wall = np.concatenate([wall, table.walls[zone][:200] + 5, table.walls[zone][:200] - 5, table.walls[zone][:200] - 1800])
    wall = wall[(wall > 0) & (wall < 2_100_000_000)]
    # fold 0 is the earlier instant of a doubled time and the offset from before a gap
    expected = [int(datetime.fromtimestamp(int(w), timezone.utc).replace(tzinfo=info, fold=0).utcoffset().total_seconds()) for w in wall]
    assert table.offset(zone, wall).tolist() == expected


def test_offsets_of_any_year_equal_the_zone_database():
    rng = np.random.default_rng(3)
    for zone in ("Europe/Berlin", "America/New_York", "Asia/Seoul", "Asia/Gaza", "Africa/Casablanca", "Australia/Lord_Howe", "America/Nuuk", "UTC", "Europe/Dublin", "Asia/Tehran"):
        table = zone_table([zone])
        walls = np.concatenate([rng.integers(-60_000_000_000, 253_402_200_000, 200), rng.integers(-2_000_000_000, 4_102_444_800, 300), *[table.walls[zone][:200] + d for d in (-7200, -1, 0, 1, 3599)]])
        for wall, offset in zip(walls.tolist(), table.offset(zone, walls).tolist()):
            clock = datetime(1970, 1, 1) + timedelta(seconds=wall)
            assert clock.replace(tzinfo=ZoneInfo(zone)).utcoffset().total_seconds() == offset, (zone, clock)


def test_offsets_before_1970_and_after_2100():
    def offset(zone, *clock):
        return int(zone_table([zone]).offset(zone, np.array([int((datetime(*clock) - datetime(1970, 1, 1)).total_seconds())]))[0])

    assert offset("Europe/Berlin", 1945, 7, 1) == 10800 and offset("America/New_York", 1968, 7, 1) == -14400 and offset("Europe/Berlin", 2150, 7, 1) == 7200
