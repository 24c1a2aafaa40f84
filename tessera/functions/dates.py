"""Date and time functions. Names of months and days are English; timestamps without zone are kept as they are."""

from __future__ import annotations


from pyspark.sql import functions as F

from .registry import add, lit
from .scalar import date_format

MONTHS = "january february march april may june july august september october november december".split()


def _shift(unit: float):
    """Adds a number, fractional too, of units of so many seconds."""
    return lambda ts, n: ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (lit(n) * unit).cast("decimal(18,6)"))


def micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


def _between(unit: float):
    return lambda a, b: (micros(b) - micros(a)) / unit


def day_start(ts):
    return F.date_trunc("day", ts)


def create_date(year=None, month=None, month_name=None, day=None, hour=None, minute=None, second=None, now=None):
    """Missing parts are the current year, 1, and 0; a month may be given by its English name or its first three letters."""
    now = F.current_timestamp() if now is None else now
    part = lambda v, d: F.coalesce(lit(v).cast("int"), d) if v is not None else d
    m = part(month, F.lit(1))
    if month_name is not None:
        key = F.lower(F.substring(lit(month_name), 1, 3))
        m = F.coalesce(F.element_at(F.create_map(*[x for i, n in enumerate(MONTHS) for x in (F.lit(n[:3]), F.lit(i + 1))]), key), m)
    zero = F.lit(0)
    return F.make_timestamp_ntz(part(year, F.year(now)), m, part(day, F.lit(1)), part(hour, zero), part(minute, zero), part(second, zero))


def to_date_exact(x, *formats):
    return F.coalesce(*[F.try_to_timestamp(F.when(F.trim(x) != "", x), F.lit(date_format(f))) for f in formats])


def to_offset(x, parse=None):
    """Struct of the instant and the offset as it was written."""
    at = F.try_to_timestamp(x) if parse is None else parse
    return F.struct(at.cast("timestamp").alias("instant"), F.coalesce(F.nullif(F.regexp_extract(x, r"(Z|[+-]\d\d:?\d\d)$", 1), F.lit("")), F.lit("Z")).alias("offset"))


def offset_hours(ts, hours):
    """The instant of a local time so many hours ahead of UTC."""
    return _shift(3600)(ts.cast("timestamp"), -lit(hours))


def week_of_year(d):
    """Weeks start on Sunday; the week of 1 January is week 1."""
    first = F.trunc(d, "year")
    return F.floor((F.dayofyear(d) - 1 + F.dayofweek(first) - 1) / 7).cast("int") + 1


def age_at(start, end):
    years = F.year(end) - F.year(start)
    early = (start.cast("timestamp_ntz") + F.make_ym_interval(years, F.lit(0))) > end.cast("timestamp_ntz")
    return years - early.cast("int")


def date_parts(d):
    quarter = F.quarter(d)
    first_week = F.floor((F.dayofyear(d) - F.dayofyear(F.trunc(d, "quarter"))) / 7).cast("int")
    return F.struct(
        (F.dayofweek(d) - 1).alias("day_of_week"), F.dayofmonth(d).alias("day_of_month"), F.dayofyear(d).alias("day_of_year"),
        F.floor((F.dayofmonth(d) - 1) / 7).cast("int").alias("week_of_month"), first_week.alias("week_of_quarter"), week_of_year(d).alias("week_of_year"),
        F.month(d).alias("month"), quarter.alias("quarter"), F.year(d).alias("year"),
    )


def time_parts(ts):
    return F.struct(F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"), (F.unix_millis(ts.cast("timestamp")) % 1000).alias("millisecond"))


def fiscal(d, start, calendar: str = "445"):
    """Fiscal parts of a date: struct year, quarter, month, week, day (of the month), day_of_year, from the first day of a fiscal year.

    calendar: months of a quarter in weeks, as 445, 454 or 544, a year having 52 weeks and, as the 53rd, one more whenever the year's end would
    otherwise fall 7 or more days before the day it began on in the calendar; or "calendar": months of the calendar, from the start's month.
    """
    start = lit(start).cast("date")
    if calendar == "calendar":
        months = (F.year(d) - F.year(start)) * 12 + F.month(d) - F.month(start)
        year = F.floor(months / 12).cast("int")
        month = (F.pmod(months, F.lit(12)) + 1).cast("int")
        first = F.add_months(F.trunc(start, "month"), year * 12)
        days = F.datediff(d, first)
        return F.struct(
            (F.year(start) + year).alias("year"), (F.floor((month - 1) / 3) + 1).cast("int").alias("quarter"), month.alias("month"),
            (F.floor(days / 7) + 1).cast("int").alias("week"), F.dayofmonth(d).alias("day"), (days + 1).alias("day_of_year"),
        )
    # The year that holds the date starts on the weekday of the start, nearest from above to 364-day steps: k years are 52k weeks
    # plus one week for every 7 days that the calendar has gained.
    def starts(k):
        anniversary = F.add_months(start, k * 12)
        drift = F.pmod(F.datediff(anniversary, start), F.lit(7))
        back = F.date_sub(anniversary, drift.cast("int"))
        return F.when(drift > 3, F.date_add(back, 7)).otherwise(back)

    k = F.floor(F.datediff(d, start) / 365.2425).cast("int")
    k = F.when(starts(k + 1) <= d, k + 1).when(starts(k) > d, k - 1).otherwise(k)
    days = F.datediff(d, starts(k))
    week = F.least(F.floor(days / 7).cast("int"), F.lit(52))
    quarter = F.least(F.floor(week / 13).cast("int"), F.lit(3))
    in_quarter = week - quarter * 13
    a, b = int(calendar[0]), int(calendar[0]) + int(calendar[1])
    m = F.when(in_quarter < a, 0).when(in_quarter < b, 1).otherwise(2)
    begin = quarter * 91 + F.when(m == 0, 0).when(m == 1, a * 7).otherwise(b * 7)
    return F.struct(
        (F.year(start) + k).alias("year"), (quarter + 1).alias("quarter"), (quarter * 3 + m + 1).alias("month"), (week + 1).alias("week"),
        (days - begin + 1).alias("day"), (days + 1).alias("day_of_year"),
    )


_now = F.current_timestamp
add(
    "date", "map",
    ToDate=lambda x: F.to_timestamp(x), ToDateOffset=to_offset, ToDateExact=to_date_exact, ToDateOffsetExact=lambda x, *f: to_offset(x, to_date_exact(x, *f)),
    ToDateOffsetHour=offset_hours, CreateDate=create_date, AddDays=_shift(86400), AddHours=_shift(3600), AddMilliseconds=_shift(0.001), AddMinutes=_shift(60),
    AddMonths=lambda ts, n: ts + F.make_ym_interval(F.lit(0), lit(n).cast("int")), AddSeconds=_shift(1), AddYears=lambda ts, n: ts + F.make_ym_interval(lit(n).cast("int"), F.lit(0)),
    DaysInMonth=lambda d: F.dayofmonth(F.last_day(d)), DayOfMonth=F.dayofmonth, DayOfWeekName=lambda d: F.date_format(d, "EEEE"), DayOfWeekNumber=lambda d: F.dayofweek(d) - 1,
    WeekOfYear=week_of_year, DayOfYear=F.dayofyear, Month=F.month, ShortMonth=lambda d: F.date_format(d, "MMM"), LongMonth=lambda d: F.date_format(d, "MMMM"), Year=F.year, Quarter=F.quarter,
    DateOnly=F.to_date, TimeNow=lambda: _now().cast("timestamp_ntz") - day_start(_now()).cast("timestamp_ntz"), TimeOnly=lambda ts: ts.cast("timestamp_ntz") - day_start(ts).cast("timestamp_ntz"),
    ToLongDateString=lambda d: F.date_format(d, "EEEE, dd MMMM yyyy"), ToLongTimeString=lambda d: F.upper(F.date_format(d, "h:mm:ss a")),
    ToShortDateString=lambda d: F.date_format(d, "d/MM/yyyy"), ToShortTimeString=lambda d: F.upper(F.date_format(d, "h:mm a")),
    DateToString=lambda d, f: F.date_format(d, date_format(f)), DateTimeNow=_now, DateTimeNowUtc=lambda: F.to_utc_timestamp(_now(), F.current_timezone()), DateNow=F.current_date,
    DateNowUtc=lambda: F.to_date(F.to_utc_timestamp(_now(), F.current_timezone())), DaysBetween=_between(86400e6), TimeBetweenDates=lambda a, b: b - a, TimeBetweenTimes=lambda a, b: b - a,
    HoursBetween=_between(3600e6), MinutesBetween=_between(60e6), SecondsBetween=_between(1e6), MillisecondsBetween=_between(1e3),
    AgeInYears=lambda d, now=None: age_at(d, now if now is not None else F.current_date()), AgeInYearsAtDate=age_at, UnixTimeStampToDate=F.timestamp_seconds,
    DateComponents=date_parts, TimeComponents=time_parts, FiscalDateComponents=fiscal,
)
