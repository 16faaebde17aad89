import datetime as dt
import random

import pytest

from tidemark.functions.worktime import WorkCalendar, iso_week

DAY = dt.datetime(2026, 3, 2)


def naive_between(cal, a, b):
    total, day = 0.0, a.date()
    while day <= b.date():
        if day.weekday() in cal.weekdays and day not in cal.holidays:
            open_ = dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=cal.start_hour)
            shut = dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=cal.end_hour)
            total += max(0.0, (min(b, shut) - max(a, open_)).total_seconds())
        day += dt.timedelta(days=1)
    return total / 3600


CALENDARS = [WorkCalendar(), WorkCalendar(holidays=(dt.date(2026, 8, 31), dt.date(2026, 9, 1), dt.date(2026, 9, 5))), WorkCalendar(8, 20, (0, 2, 5)), WorkCalendar(0, 24, tuple(range(7)))]


@pytest.mark.parametrize("cal", CALENDARS)
def test_matches_a_day_by_day_loop(spark, cal):
    r = random.Random(1)
    rows = []
    for _ in range(150):
        a = dt.datetime(2026, 8, 20) + dt.timedelta(seconds=r.randrange(30 * 86400))
        rows.append((a, a + dt.timedelta(seconds=r.randrange(20 * 86400)), r.choice([0.0, 0.5, 3.0, 7.75, 40.0, 123.5])))
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, h double")
    got = df.select("a", "b", "h", cal.hours_between("a", "b").alias("w"), cal.add_hours("a", "h").alias("t"), cal.next_moment("a").alias("n")).collect()
    for x in got:
        assert x.w == pytest.approx(naive_between(cal, x.a, x.b), abs=1e-9)
        assert naive_between(cal, x.a, x.t) == pytest.approx(x.h, abs=1e-9)
        assert naive_between(cal, x.a, x.n) == 0.0 and x.n >= x.a and naive_between(cal, x.n, x.n + dt.timedelta(minutes=1)) > 0


def test_named_cases(spark):
    cal = WorkCalendar()
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    from pyspark.sql import functions as F

    t = lambda *a: F.lit(dt.datetime(*a)).cast("timestamp_ntz")
    assert one(cal.hours_between(t(2026, 8, 28, 16, 30), t(2026, 8, 31, 9, 30))) == 1.0
    assert one(cal.hours_between(t(2026, 8, 24, 9), t(2026, 8, 28, 17))) == 40.0
    assert one(cal.hours_between(t(2026, 8, 28, 17), t(2026, 8, 24, 9))) == 0.0
    assert one(cal.add_hours(t(2026, 8, 28, 16, 30), F.lit(1.0))) == dt.datetime(2026, 8, 31, 9, 30)
    assert one(cal.add_hours(t(2026, 8, 28, 16, 30), F.lit(0.5))) == dt.datetime(2026, 8, 31, 9, 0)
    assert one(cal.next_moment(t(2026, 8, 29, 3))) == dt.datetime(2026, 8, 31, 9)
    assert one(iso_week(t(2027, 1, 1, 0))) == "2026-W53"


def test_validation(spark):
    for bad in ((9, 9), (17, 9), (-1, 5), (9, 25)):
        with pytest.raises(ValueError):
            WorkCalendar(*bad)
    with pytest.raises(ValueError):
        WorkCalendar(9, 17, ())
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(WorkCalendar().add_hours(F.lit(DAY), F.lit(-1.0))).collect()
