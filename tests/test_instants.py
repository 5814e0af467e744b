"""Times: forms, calendar, repeated hours; against datetime and zoneinfo."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.instants import read_times
from quern.operators.instants import log_instants, message_instants

UTC = dt.UTC
FORMS = {
    "2025-09-15T00:48:11.299000+00:00": (dt.datetime(2025, 9, 15, 0, 48, 11, 299000, UTC), True),
    "Tue, 16 Sep 2025 12:33:39 +0100": (dt.datetime(2025, 9, 16, 11, 33, 39, tzinfo=UTC), True),
    "1758052471396": (dt.datetime(2025, 9, 16, 19, 54, 31, 396000, UTC), True),
    "1757902922": (dt.datetime(2025, 9, 15, 2, 22, 2, tzinfo=UTC), True),
    "1758021577.544": (dt.datetime(2025, 9, 16, 11, 19, 37, 544000, UTC), True),
    "1757940408594400646": (dt.datetime(2025, 9, 15, 12, 46, 48, 594400, UTC), True),
    "2025-09-16 20:04:49,536+1000": (dt.datetime(2025, 9, 16, 10, 4, 49, 536000, UTC), True),
    "20250915T043606Z": (dt.datetime(2025, 9, 15, 4, 36, 6, tzinfo=UTC), True),
    "2025-09-15T04:44Z": (dt.datetime(2025, 9, 15, 4, 44, tzinfo=UTC), True),
    "2025-09-23 01:40:53+10": (dt.datetime(2025, 9, 22, 15, 40, 53, tzinfo=UTC), True),
    "10/03/2025 06:27:54 AM PDT": (dt.datetime(2025, 10, 3, 13, 27, 54, tzinfo=UTC), True),
    "12/19/2025 12:05:00 PM EST": (dt.datetime(2025, 12, 19, 17, 5, tzinfo=UTC), True),
    "2024-02-29T00:00:00Z": (dt.datetime(2024, 2, 29, tzinfo=UTC), True),
    "17.09.2025 04:10:32": (dt.datetime(2025, 9, 17, 4, 10, 32, tzinfo=UTC), False),
    "2025/09/15 18:42:55": (dt.datetime(2025, 9, 15, 18, 42, 55, tzinfo=UTC), False),
}
NO_TIMES = [None, "", "  ", "--", "n/a", "unknown", "Invalid Date", "0000-00-00T00:00:00Z", "2026-02-30T10:00:00Z", "2026-13-04 08:11:52", "2025-02-29 00:00:00", "09:00", "2025-09-15T25:00:00Z", "13/13/2025 06:27:54 AM PDT", "2025-09-15 10:00:00 QQQ"]


def seconds(when):
    return int(when.timestamp() // 1)


def test_forms(spark):
    rows = [(t,) for t in [*FORMS, *NO_TIMES]]
    got = {r["t"]: (r["t_sec"], r["t_local"], r["t_nano"]) for r in read_times(spark.createDataFrame(rows, "t string"), F.col("t")).collect()}
    for text, (when, zoned) in FORMS.items():
        sec, local, nano = got[text]
        assert (sec if zoned else local) == seconds(when), text
        assert (local if zoned else sec) is None, text
        assert nano // 1000 == when.microsecond, text
    for text in NO_TIMES:
        assert got[text][:2] == (None, None), text


@settings(max_examples=1, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1971, 1, 1), dt.datetime(2199, 12, 31)), min_size=200, max_size=200))
def test_day_arithmetic(spark, whens):
    rows = [(w.strftime("%Y-%m-%d %H:%M:%S"), seconds(w.replace(tzinfo=UTC))) for w in whens]
    df = read_times(spark.createDataFrame(rows, "t string, want bigint"), F.col("t"))
    assert df.where("t_local is null or t_local <> want").count() == 0


def expected(lines, zone):
    """The rule line by line."""
    last, out = None, {}
    for number, local in lines:
        readings = sorted({seconds(local.replace(tzinfo=ZoneInfo(zone), fold=f)) for f in (0, 1)})
        fit = [r for r in readings if last is None or r >= last]
        last = out[number] = fit[0] if fit else readings[-1]
    return out


@pytest.mark.parametrize("block", [2, 4096])
def test_repeated_hour(spark, block):
    from quern.operators import instants

    at = dt.datetime(2025, 10, 26, 1, 50)  # Berlin shows 2:00 to 3:00 twice
    steps = [0, 20, 30, 45, 50, 60, 75, 100, 130, 140]
    real = [(i + 1, (at + dt.timedelta(minutes=m)) if m <= 69 else at + dt.timedelta(minutes=m - 60)) for i, m in enumerate(steps)]
    rows = [(i, "f", n, "m", w.strftime("%Y-%m-%d %H:%M:%S")) for i, (n, w) in enumerate(real)] + [(99, "f", 3, "m", real[2][1].strftime("%Y-%m-%d %H:%M:%S"))]
    df = spark.createDataFrame(rows, "row_id bigint, log_file string, line_no int, machine string, text string")
    zones = spark.createDataFrame([("m", "Europe/Berlin")], "machine string, zone_name string")
    got = instants.settle_twice(instants.with_readings(df, F.col("text"), zones), block)
    assert {(r["line_no"], r["sec"]) for r in got.collect()} == set(expected(real, "Europe/Berlin").items())


def test_skipped_hour_and_unknown_machine(spark):
    rows = [(1, "f", 1, "m", "2025-03-30 02:30:00"), (2, "g", 1, "other", "2025-03-30 02:30:00"), (3, "g", 2, None, None)]
    df = spark.createDataFrame(rows, "row_id bigint, log_file string, line_no int, machine string, text string")
    zones = spark.createDataFrame([("m", "Europe/Berlin")], "machine string, zone_name string")
    got = {r["row_id"]: r["sec"] for r in log_instants(df, F.col("text"), zones).collect()}
    assert got == {1: None, 2: seconds(dt.datetime(2025, 3, 30, 2, 30, tzinfo=UTC)), 3: None}


def test_empty(spark):
    df = spark.createDataFrame([], "row_id bigint, log_file string, line_no int, machine string, text string, extra string")
    zones = spark.createDataFrame([], "machine string, zone_name string")
    assert log_instants(df, F.col("text"), zones).count() == 0


def test_whole_numbers_like_their_digits(spark):
    numbers = [None, 0, -1, -1_700_000_000, 99_999_999, 100_000_000, 2**63 - 1, -(2**63)]
    numbers += [sign * (int("1712345678912345678"[:n]) + k) for n in range(1, 20) for k in (-1, 0, 1) for sign in (1, -1)] + [10**n - k for n in range(1, 19) for k in (0, 1)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "row_id bigint, time_created bigint")
    rows = lambda df: {tuple(r) for r in message_instants(df).select("row_id", "sec", "nano", "time_text").collect()}
    assert rows(df) == rows(df.withColumn("time_created", F.col("time_created").cast("string")))
    small = df.where(F.col("time_created").between(-(2**31), 2**31 - 1))
    assert rows(small.withColumn("time_created", F.col("time_created").cast("int"))) == rows(small)
    assert "regexp" not in message_instants(df)._jdf.queryExecution().optimizedPlan().toString()
