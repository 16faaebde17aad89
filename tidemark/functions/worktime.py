"""Working-hours clock as closed-form column expressions: no loop, no UDF, no calendar table.

A day's number n counts from Monday 1970-01-05. With k working weekdays, the working days before day n
are k * floor(n / 7) plus those earlier in its week, less the holidays among them. W(t), the working
microseconds before t, follows, and both directions of the clock are arithmetic on W.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOUR = 3_600_000_000
_MONDAY = dt.date(1970, 1, 5)


def _ntz(t) -> Column:
    return (F.col(t) if isinstance(t, str) else t).cast("timestamp_ntz")


@dataclass(frozen=True)
class WorkCalendar:
    start_hour: int = 9
    end_hour: int = 17
    weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)  # Monday is 0
    holidays: tuple[dt.date, ...] = ()
    _plain: tuple[int, ...] = field(init=False, default=())

    def __post_init__(self):
        if not 0 <= self.start_hour < self.end_hour <= 24:
            raise ValueError("working hours must satisfy 0 <= start < end <= 24")
        if not set(self.weekdays) & set(range(7)):
            raise ValueError("a calendar needs at least one working weekday")
        days = sorted({(h - _MONDAY).days for h in self.holidays if h.weekday() in self.weekdays})
        object.__setattr__(self, "_plain", tuple(self._before_py(n) for n in days))

    def _before_py(self, n: int) -> int:
        return len(set(self.weekdays)) * (n // 7) + sum(w < n % 7 for w in set(self.weekdays))

    @property
    def hours_per_day(self) -> float:
        return float(self.end_hour - self.start_hour)

    def _unit(self):
        return (self.end_hour - self.start_hour) * _HOUR

    def _plain_before(self, n: Column) -> Column:
        """Working weekdays before day n, holidays counted too."""
        upto = F.array(*[F.lit(sum(w < i for w in set(self.weekdays))) for i in range(7)])
        return F.floor(n / 7) * len(set(self.weekdays)) + F.get(upto, F.pmod(n, F.lit(7)))

    def _passed(self, at: Column, marks) -> Column:
        return F.size(F.filter(F.array(*[F.lit(int(m)) for m in marks]), lambda m: m <= at)) if marks else F.lit(0)

    def is_working_day(self, day) -> Column:
        d = (F.col(day) if isinstance(day, str) else day).cast("date")
        ok = F.weekday(d).isin(*sorted(set(self.weekdays)))
        return ok & ~d.isin(*self.holidays) if self.holidays else ok

    def _elapsed(self, t: Column) -> Column:
        day = t.cast("date")
        n = F.datediff(day, F.lit(_MONDAY))
        plain = self._plain_before(n)
        tod = F.timestamp_diff("MICROSECOND", day.cast("timestamp_ntz"), t)
        today = F.greatest(F.lit(0), F.least(tod - self.start_hour * _HOUR, F.lit(self._unit())))
        return (plain - self._passed(plain - 1, self._plain)) * self._unit() + F.when(self.is_working_day(day), today).otherwise(F.lit(0))

    def hours_between(self, start, end) -> Column:
        """Working hours from start to end; 0 when end is not after start."""
        a, b = self._elapsed(_ntz(start)), self._elapsed(_ntz(end))
        return F.greatest(F.lit(0), b - a) / float(_HOUR)

    def _at(self, micros: Column) -> Column:
        day = F.floor(micros / self._unit()).cast("long")
        rest = micros - day * self._unit()
        # holidays at or before: the i-th has plain ordinal p, and is passed once day >= p - i
        plain = day + self._passed(day, [p - i for i, p in enumerate(self._plain)])
        k, order = len(set(self.weekdays)), sorted(set(self.weekdays))
        n = F.floor(plain / k) * 7 + F.get(F.array(*[F.lit(w) for w in order]), F.pmod(plain, F.lit(k)).cast("int"))
        return F.timestamp_add("MICROSECOND", rest + self.start_hour * _HOUR, F.date_add(F.lit(_MONDAY), n.cast("int")).cast("timestamp_ntz"))

    def add_hours(self, t, hours) -> Column:
        """The moment after so many working hours; time that just fills a day ends at the next day's start."""
        h = F.col(hours) if isinstance(hours, str) else hours
        h = F.when(h < 0, F.raise_error(F.lit("hours must not be negative")).cast("double")).otherwise(h)
        return self._at(self._elapsed(_ntz(t)) + F.round(h * float(_HOUR)).cast("long"))

    def next_moment(self, t) -> Column:
        """t itself inside working hours, else the start of the next working day."""
        return self._at(self._elapsed(_ntz(t)))


def iso_week(day) -> Column:
    d = (F.col(day) if isinstance(day, str) else day).cast("date")
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))
