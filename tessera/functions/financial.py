"""Financial functions. Closed forms are Columns; bonds and iterations are kernels in Arrow batches.

Dates are dates; bases of day counts are 0 (US 30/360), 1 (actual/actual), 2 (actual/360), 3 (actual/365), 4 (European 30/360); frequencies
are 1, 2 or 4 coupons a year; `due` is 1 for payments at the start of a period, 0 at its end.
"""

from __future__ import annotations

import calendar
import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .registry import add, arrow_udf, lit

# --- annuities ------------------------------------------------------------------------------------------------------


def _f(x):
    return lit(x).cast("double")


def fv(rate, nper, pmt, pv, due=0):
    r, n, p, v = map(_f, (rate, nper, pmt, pv))
    g = F.pow(1 + r, n)
    return F.when(r == 0, -(v + p * n)).otherwise(-(v * g + p * (1 + r * due) * (g - 1) / F.when(r != 0, r)))


def pv(rate, nper, pmt, fv_, due=0):
    r, n, p, v = map(_f, (rate, nper, pmt, fv_))
    g = F.pow(1 + r, n)
    return F.when(r == 0, -(v + p * n)).otherwise(-(v + p * (1 + r * due) * (g - 1) / F.when(r != 0, r)) / g)


def pmt(rate, nper, pv_, fv_=0.0, due=0):
    r, n, v, w = map(_f, (rate, nper, pv_, fv_))
    g = F.pow(1 + r, n)
    return F.when(r == 0, -(w + v) / n).otherwise(-(w + v * g) * r / ((1 + r * due) * F.when(r != 0, g - 1)))


def ipmt(rate, per, nper, pv_, fv_=0.0, due=0):
    r, k = _f(rate), _f(per)
    p = pmt(rate, nper, pv_, fv_, due)
    i = fv(rate, k - 1, p, pv_, due) * r
    if due:
        return F.when(k == 1, 0.0).otherwise((fv(rate, k - 2, p, pv_, 1) - p) * r)
    return i


def ppmt(rate, per, nper, pv_, fv_=0.0, due=0):
    return pmt(rate, nper, pv_, fv_, due) - ipmt(rate, per, nper, pv_, fv_, due)


def nper(rate, pmt_, pv_, fv_=0.0, due=0):
    r, p, v, w = map(_f, (rate, pmt_, pv_, fv_))
    q = p * (1 + r * due)
    return F.when(r == 0, -(w + v) / p).otherwise(F.ln((q - w * r) / (v * r + q)) / F.when(r != 0, F.ln(1 + r)))


def cumulative(part):
    """Sum of interest or principal of periods first..last, by the balance's closed form."""

    def build(rate, nper_, pv_, first, last, due=0):
        p = pmt(rate, nper_, pv_, 0.0, due)
        a, b = _f(first), _f(last)
        paid = p * (b - a + 1)
        # The balance after k payments; principal is its fall. A payment at the start of the first period is all principal.
        start = _f(pv_) / (1 + _f(rate)) if due else _f(pv_)
        left = lambda k: -fv(rate, k, p, start)
        principal = left(b) - (F.when(a == 1, _f(pv_)).otherwise(left(a - 1)) if due else left(a - 1))
        return principal if part == "principal" else paid - principal

    return build


# --- kernels over rows ----------------------------------------------------------------------------------------------


def _date(x):
    return x if isinstance(x, dt.date) and not isinstance(x, dt.datetime) else x.date() if isinstance(x, dt.datetime) else pd.Timestamp(x).date()


def each(f, kind: str, xs, options: dict) -> pd.Series:
    """A function's values over the rows of a batch; rows of equal arguments are computed once."""

    def one(v):
        if any(x is None or x is pd.NaT or x != x for x in v):
            return None
        try:
            return f(*v, **options)
        except (ValueError, ZeroDivisionError, OverflowError):
            return None if kind == "date" else math.nan

    known: dict = {}
    return pd.Series([known[v] if v in known else known.setdefault(v, one(v)) for v in zip(*xs, strict=True)], dtype=object if kind == "date" else "float64")


def kernel(f, kind: str = "double"):
    """Column function of a Python function; nulls give null, what can't be computed NaN (null for dates)."""

    def build(*args, **options):
        @pandas_udf(kind)
        def run(*xs: pd.Series) -> pd.Series:
            return each(f, kind, xs, options)

        def column(a):
            return F.lit(a) if not hasattr(a, "_jc") and not hasattr(a, "alias") else a

        return run(*[column(a) for a in args])

    return build


_LENGTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _last(year: int, month: int) -> int:
    """The last day of a month; faster than calendar.monthrange, which also finds the weekday."""
    return 29 if month == 2 and calendar.isleap(year) else _LENGTHS[month - 1]


def _end(d: dt.date) -> bool:
    return d.day == _last(d.year, d.month)


def days360(a: dt.date, b: dt.date, european: bool = False) -> int:
    d1, d2 = a.day, b.day
    if european:
        d1, d2 = min(d1, 30), min(d2, 30)
    else:
        if a.month == 2 and _end(a):
            if b.month == 2 and _end(b):
                d2 = 30
            d1 = 30
        if d2 == 31 and d1 >= 30:
            d2 = 30
        d1 = min(d1, 30)
    return (b.year - a.year) * 360 + (b.month - a.month) * 30 + d2 - d1


def days(a, b, basis: int) -> int:
    return days360(a, b, basis == 4) if basis in (0, 4) else (b - a).days


def year_fraction(a, b, basis: int) -> float:
    a, b = _date(a), _date(b)
    if basis != 1:
        return days(a, b, basis) / (365 if basis == 3 else 360)
    if a > b:
        return -year_fraction(b, a, basis)
    if b <= shift(a, 12):
        leap = any(a <= dt.date(y, 2, 29) <= b for y in range(a.year, b.year + 1) if calendar.isleap(y))
        return (b - a).days / (366 if leap else 365)
    years = range(a.year, b.year + 1)
    return (b - a).days / (sum(366 if calendar.isleap(y) else 365 for y in years) / len(years))


def shift(d: dt.date, months: int, end: bool | None = None) -> dt.date:
    m = d.year * 12 + d.month - 1 + months
    last = _last(m // 12, m % 12 + 1)
    return dt.date(m // 12, m % 12 + 1, last if (_end(d) if end is None else end) else min(d.day, last))


def coupons(settle, mature, freq):
    """(previous coupon date, next one, number still to come)."""
    settle, mature, step = _date(settle), _date(mature), 12 // int(freq)
    n = max(0, ((mature.year - settle.year) * 12 + mature.month - settle.month) // step - 1)  # dates before are of later months
    while shift(mature, -step * (n + 1), _end(mature)) > settle:
        n += 1
    return shift(mature, -step * (n + 1), _end(mature)), shift(mature, -step * n, _end(mature)), n + 1


def coup_days(settle, mature, freq=1, basis=0) -> float:
    if basis == 1:
        a, b, _ = coupons(settle, mature, freq)
        return float((b - a).days)
    return (365 if basis == 3 else 360) / freq


def coup_bs(settle, mature, freq=1, basis=0) -> float:
    return float(days(coupons(settle, mature, freq)[0], _date(settle), basis))


def coup_nc(settle, mature, freq=1, basis=0) -> float:
    if basis in (0, 4):
        return coup_days(settle, mature, freq, basis) - coup_bs(settle, mature, freq, basis)
    return float(days(_date(settle), coupons(settle, mature, freq)[1], basis))


def pricer(settle, mature, rate, redemption, freq=1, basis=0):
    """The price as a function of the yield; what doesn't depend on the yield is computed once."""
    n = coupons(settle, mature, freq)[2]
    e, a = coup_days(settle, mature, freq, basis), coup_bs(settle, mature, freq, basis)
    dsc, c = e - a if basis in (0, 4) else coup_nc(settle, mature, freq, basis), 100 * rate / freq

    def at(yld: float) -> float:
        y = yld / freq
        if n == 1:
            return (redemption + c) / (1 + dsc / e * y) - a / e * c
        worth = 0.0
        for _ in range(n):
            worth = worth / (1 + y) + c
        return redemption / (1 + y) ** (n - 1 + dsc / e) + worth / (1 + y) ** (dsc / e) - c * a / e

    return at


def price(settle, mature, rate, yld, redemption, freq=1, basis=0) -> float:
    return pricer(settle, mature, rate, redemption, freq, basis)(yld)


def solve(f, lo: float, hi: float) -> float:
    """A root by bisection, where the signs at the bounds differ."""
    a, b = f(lo), f(hi)
    if a * b > 0:
        return math.nan
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):  # no number lies between
            break
        m = f(mid)
        if a * m <= 0:
            hi = mid
        else:
            lo, a = mid, m
    return (lo + hi) / 2


def bond_yield(settle, mature, rate, pr, redemption, freq=1, basis=0) -> float:
    at = pricer(settle, mature, rate, redemption, freq, basis)
    return solve(lambda y: at(y) - pr, -0.99 * freq, 100.0)


def duration(settle, mature, coupon, yld, freq=1, basis=0) -> float:
    n = coupons(settle, mature, freq)[2]
    dsc, c, y = coup_nc(settle, mature, freq, basis) / coup_days(settle, mature, freq, basis), 100 * coupon / freq, 1 + yld / freq
    flows = [(k + dsc, c + (100 if k == n - 1 else 0)) for k in range(n)]
    worth = sum(x / y**t for t, x in flows)
    return sum(t * x / y**t for t, x in flows) / worth / freq


def accr_int(issue, first, settle, rate, par=1000.0, freq=1, basis=0, from_issue=True) -> float:
    """Interest over the quasi-coupon periods between issue and settlement, counted back from the first interest date."""
    issue, first, settle, step = _date(issue), _date(first), _date(settle), 12 // int(freq)
    begin = issue if from_issue else max(issue, first if settle > first else issue)
    total, k = 0.0, 0
    while shift(first, -step * (k), _end(first)) > begin:
        k += 1
    edge = shift(first, -step * k, _end(first))
    while edge < settle:
        after = shift(first, -step * (k - 1), _end(first))
        a, b = max(edge, begin), min(after, settle)
        length = (after - edge).days if basis == 1 else (365 if basis == 3 else 360) / freq
        total += days(a, b, basis) / length
        edge, k = after, k - 1
    return par * rate / freq * total


def price_mat(settle, mature, issue, rate, yld, basis=0) -> float:
    dim, a, dsm = year_fraction(issue, mature, basis), year_fraction(issue, settle, basis), year_fraction(settle, mature, basis)
    return (100 + dim * rate * 100) / (1 + dsm * yld) - a * rate * 100


def yield_mat(settle, mature, issue, rate, pr, basis=0) -> float:
    dim, a, dsm = year_fraction(issue, mature, basis), year_fraction(issue, settle, basis), year_fraction(settle, mature, basis)
    return ((1 + dim * rate) / (pr / 100 + a * rate) - 1) / dsm


def odd_first_pricer(settle, mature, issue, first, rate, redemption, freq=1, basis=0):
    """The price as a function of the yield; what doesn't depend on the yield is computed once."""
    settle, mature, issue, first, step = _date(settle), _date(mature), _date(issue), _date(first), 12 // int(freq)
    n = coupons(first, mature, freq)[2] if first < mature else 0
    c = 100 * rate / freq
    edges = [first]
    while edges[-1] > issue:
        edges.append(shift(first, -step * len(edges), _end(first)))
    length = lambda a, b: (b - a).days if basis == 1 else (365 if basis == 3 else 360) / freq
    odd = accrued = wait = 0.0
    for b, a in zip(edges, edges[1:], strict=False):
        e = length(a, b)
        odd += days(max(a, issue), b, basis) / e
        if settle > max(a, issue):
            accrued += days(max(a, issue), min(b, settle), basis) / e
        if settle < b:
            wait += (days(settle, b, basis) if settle > a else days(a, b, basis)) / e

    def at(yld: float) -> float:
        y, worth = 1 + yld / freq, 0.0
        for _ in range(n):
            worth = (worth + c) / y
        return redemption / y ** (n + wait) + (c * odd + worth) / y**wait - c * accrued

    return at


def odd_first_price(settle, mature, issue, first, rate, yld, redemption, freq=1, basis=0) -> float:
    return odd_first_pricer(settle, mature, issue, first, rate, redemption, freq, basis)(yld)


def odd_last(settle, mature, last, freq, basis):
    settle, mature, last, step = _date(settle), _date(mature), _date(last), 12 // int(freq)
    edges = [last]
    while edges[-1] < mature:
        edges.append(shift(last, step * len(edges), _end(last)))
    full = accrued = left = 0.0
    for a, b in zip(edges, edges[1:], strict=False):
        e = (b - a).days if basis == 1 else (365 if basis == 3 else 360) / freq
        full += days(a, min(b, mature), basis) / e
        if settle > a:
            accrued += days(a, min(b, settle, mature), basis) / e
        if settle < min(b, mature):
            left += days(max(a, settle), min(b, mature), basis) / e
    return full, accrued, left


def odd_last_price(settle, mature, last, rate, yld, redemption, freq=1, basis=0) -> float:
    full, accrued, left = odd_last(settle, mature, last, freq, basis)
    c = 100 * rate / freq
    return (redemption + full * c) / (1 + left * yld / freq) - accrued * c


def odd_last_yield(settle, mature, last, rate, pr, redemption, freq=1, basis=0) -> float:
    full, accrued, left = odd_last(settle, mature, last, freq, basis)
    c = 100 * rate / freq
    return ((redemption + full * c) / (pr + accrued * c) - 1) * freq / left


def odd_first_yield(settle, mature, issue, first, rate, pr, redemption, freq=1, basis=0) -> float:
    at = odd_first_pricer(settle, mature, issue, first, rate, redemption, freq, basis)
    return solve(lambda y: at(y) - pr, -0.99 * freq, 100.0)


def amor_linc(cost, bought, first, salvage, period, rate, basis=0) -> float:
    head, each = cost * rate * year_fraction(bought, first, basis), cost * rate
    if period == 0:
        return head
    left = cost - salvage - head
    whole = int(left / each)
    return each if period <= whole else left - each * whole if period == whole + 1 else 0.0


def amor_degrc(cost, bought, first, salvage, period, rate, basis=0) -> float:
    life = 1 / rate
    factor = rate * (1.0 if life < 3 else 1.5 if life < 5 else 2.0 if life <= 6 else 2.5)
    head = round(factor * cost * year_fraction(bought, first, basis))
    left, rest = cost - head, cost - head - salvage
    if period == 0:
        return float(head)
    for k in range(int(period)):
        head = round(factor * left)
        rest -= head
        if rest < 0:
            return float(round(left * 0.5)) if int(period) - k in (1, 2) else 0.0
        left -= head
    return float(head)


def db(cost, salvage, life, period, month=12.0) -> float:
    rate = round(1 - (salvage / cost) ** (1 / life), 3)
    first = cost * rate * month / 12
    if period == 1:
        return first
    total, out = first, 0.0
    for _ in range(2, int(min(period, life)) + 1):
        out = (cost - total) * rate
        total += out
    return (cost - total) * rate * (12 - month) / 12 if period > life else out


def ddb(cost, salvage, life, period, factor=2.0) -> float:
    rate = min(1.0, factor / life)
    before, after = cost * (1 - rate) ** (period - 1), cost * (1 - rate) ** period
    return max(0.0, before - max(after, salvage))


def vdb(cost, salvage, life, start, end, factor=2.0, no_switch=False) -> float:
    def until(t):
        total, book, k = 0.0, cost, 0.0
        while k < t:
            part = min(1.0, t - k)
            d = min(book * min(1.0, factor / life), book - salvage)
            if not no_switch and life > k:
                d = max(d, (book - salvage) / (life - k))
            d = max(0.0, min(d, book - salvage))
            total += d * part
            book -= d
            k += 1
        return total

    return until(end) - until(start)


def rate_of(nper_, pmt_, pv_, fv_=0.0, due=0, guess=0.1) -> float:
    def f(r):
        g = (1 + r) ** nper_
        return pv_ + pmt_ * nper_ + fv_ if abs(r) < 1e-12 else pv_ * g + pmt_ * (1 + r * due) * (g - 1) / r + fv_

    r = guess
    for _ in range(100):
        h = 1e-7 * max(1, abs(r))
        slope = (f(r + h) - f(r - h)) / (2 * h)
        if not slope:
            break
        new = max(r - f(r) / slope, -0.999999)
        if abs(new - r) < 1e-13:
            return new
        r = new
    return r if abs(f(r)) < 1e-6 else math.nan


#: Distances from the guess, in ln(1 + rate), at which a rate of return is looked for where Newton's method finds none
_REACH = np.concatenate([np.arange(0, 1, 0.01), np.geomspace(1, 20, 40)])
_LEAST = -0.999999


def irr_of(flows, times, guess=0.1) -> float:
    """Newton's method; where that fails, the change of sign nearest to the guess. Only the sign of the worth and its ratio to the slope
    count, so powers are scaled by the largest: no number of flows overflows them."""
    c, t = np.asarray(flows, float), np.asarray(times, float)

    def at(d):
        """By d = ln(1 + rate): the worth and its slope, and the logarithm of what both are to be multiplied by."""
        p = -t * d
        top = p.max()
        x = c * np.exp(p - top)
        return float(x.sum()), float(-(t * x).sum() / math.exp(d)), float(top)

    if not (np.isfinite(c).all() and np.isfinite(t).all() and (c > 0).any() and (c < 0).any()):
        return math.nan
    r = guess
    for _ in range(100):
        worth, slope, _ = at(math.log1p(r))
        if not slope:
            break
        new = max(r - worth / slope, _LEAST)
        if not new < 1e9:
            break
        if abs(new - r) < 1e-13 and new > _LEAST:
            return new
        r = new
    worth, _, top = at(math.log1p(r))
    if not worth or math.log(abs(worth)) + top < math.log(1e-6):
        return r
    mid, low = math.log1p(guess), math.log1p(_LEAST)
    up, down = [(d, at(d)[0]) for d in mid + _REACH], [(d, at(d)[0]) for d in mid - _REACH if d >= low]
    for i in range(1, len(up)):
        for side in (up, down):
            if i < len(side) and side[i - 1][1] * side[i][1] <= 0:
                return math.expm1(solve(lambda d: at(d)[0], *sorted((float(side[i - 1][0]), float(side[i][0])))))
    return math.nan


# --- aggregates over ordered flows: the group's flows as an array, then a kernel ------------------------------------


def flows(value, order):
    return F.array_sort(F.collect_list(F.struct(order.alias("o"), value.cast("double").alias("v"))))


@arrow_udf("double")
def _irr(v: pd.Series, guess: pd.Series) -> pd.Series:
    return pd.Series([irr_of(x, np.arange(len(x)), g) if len(x) else math.nan for x, g in zip(v, guess, strict=True)])


@arrow_udf("double")
def _xirr(v: pd.Series, t: pd.Series, guess: pd.Series) -> pd.Series:
    return pd.Series([irr_of(x, y, g) if len(x) else math.nan for x, y, g in zip(v, t, guess, strict=True)])


def _values(a):
    return F.transform(a, lambda s: s["v"])


def irr(value, order, guess=0.1):
    """A Column of an aggregate's result: apply to the output of `flows`, or to a value and its order within agg."""
    return _irr(_values(flows(value, order)), F.lit(float(guess)))


def _years(a):
    return F.transform(a, lambda s: F.datediff(s["o"], a[0]["o"]) / 365.0)


def xirr(value, date, guess=0.1):
    a = flows(value, date)
    return _xirr(_values(a), _years(a), F.lit(float(guess)))


def discounted(a, rate, times):
    return F.aggregate(F.zip_with(_values(a), times, lambda v, t: v / F.pow(1 + _f(rate), t)), F.lit(0.0), lambda x, y: x + y)


def npv(rate, value, order):
    a = flows(value, order)
    return discounted(a, rate, F.transform(a, lambda _, i: i + 1.0))


def xnpv(rate, value, date):
    a = flows(value, date)
    return discounted(a, rate, _years(a))


def mirr(value, order, finance, reinvest):
    a = flows(value, order)
    n = F.size(a)
    out = lambda f: F.aggregate(F.transform(a, f), F.lit(0.0), lambda x, y: x + y)
    gain = out(lambda s, i: F.greatest(s["v"], F.lit(0.0)) * F.pow(1 + _f(reinvest), n - 1 - i))
    loss = out(lambda s, i: F.least(s["v"], F.lit(0.0)) / F.pow(1 + _f(finance), i.cast("double")))
    return F.pow(-gain / loss, 1.0 / (n - 1)) - 1


def fv_schedule(principal, rate):
    return _f(principal) * F.product(1 + rate)


add("financial", "aggregate", FvSchedule=fv_schedule, IrrGuess=irr, Irr=irr, Mirr=mirr, Npv=npv, XIrrGuess=xirr, XIrr=xirr, XNpv=xnpv)




def _fraction(a, b, basis=0):
    if basis in (2, 3):
        return F.datediff(b, a) / (365.0 if basis == 3 else 360.0)
    return kernel(lambda x, y: year_fraction(x, y, basis))(a, b)


def dollar(x, fraction, to_decimal: bool):
    n, d = lit(x), F.floor(_f(fraction))
    whole = F.signum(n) * F.floor(F.abs(n))
    scale = F.pow(F.lit(10.0), F.ceil(F.log10(d)))
    return whole + (n - whole) * scale / d if to_decimal else whole + (n - whole) * d / scale


def tbill_days(a, b):
    return F.datediff(b, a)


add(
    "financial", "map",
    AccrInt=kernel(accr_int), AccrIntM=lambda issue, settle, rate, par, basis=0: lit(par) * lit(rate) * _fraction(issue, settle, basis), AmorDegrc=kernel(amor_degrc), AmorLinc=kernel(amor_linc),
    CoupDaysBS=kernel(coup_bs), CoupDays=kernel(coup_days), CoupDaysNC=kernel(coup_nc), CoupNCD=kernel(lambda s, m, f=1, b=0: coupons(s, m, f)[1], "date"),
    CoupNum=kernel(lambda s, m, f=1, b=0: float(coupons(s, m, f)[2])), CoupPCD=kernel(lambda s, m, f=1, b=0: coupons(s, m, f)[0], "date"), CumIPmt=cumulative("interest"), CumPrinc=cumulative("principal"),
    Db=kernel(db), Ddb=kernel(ddb), Disc=lambda s, m, pr, red, basis=0: (lit(red) - lit(pr)) / lit(red) / _fraction(s, m, basis), DollarDe=lambda x, f: dollar(x, f, True),
    DollarFr=lambda x, f: dollar(x, f, False), Duration=kernel(duration), Effect=lambda r, n: F.pow(1 + _f(r) / F.floor(_f(n)), F.floor(_f(n))) - 1, Fv=fv,
    IntRate=lambda s, m, inv, red, basis=0: (lit(red) - lit(inv)) / lit(inv) / _fraction(s, m, basis), IPmt=ipmt, ISPmt=lambda r, per, n, v: -_f(v) * _f(r) * (1 - _f(per) / _f(n)),
    MDuration=kernel(lambda s, m, c, y, f=1, b=0: duration(s, m, c, y, f, b) / (1 + y / f)), Nominal=lambda r, n: F.floor(_f(n)) * (F.pow(1 + _f(r), 1 / F.floor(_f(n))) - 1), NPer=nper,
    OddFPrice=kernel(odd_first_price), OddFYield=kernel(odd_first_yield), OddLPrice=kernel(odd_last_price), OddLYield=kernel(odd_last_yield), Pmt=pmt, PPmt=ppmt, Price=kernel(price),
    PriceDisc=lambda s, m, d, red, basis=0: lit(red) - lit(d) * lit(red) * _fraction(s, m, basis), PriceMat=kernel(price_mat), Pv=pv, Rate=kernel(rate_of),
    Received=lambda s, m, inv, d, basis=0: lit(inv) / (1 - lit(d) * _fraction(s, m, basis)), Sln=lambda c, s, n: (_f(c) - _f(s)) / _f(n),
    Syd=lambda c, s, n, k: (_f(c) - _f(s)) * (_f(n) - _f(k) + 1) * 2 / (_f(n) * (_f(n) + 1)), TBillEq=lambda s, m, d: 365 * _f(d) / (360 - _f(d) * tbill_days(s, m)),
    TBillPrice=lambda s, m, d: 100 * (1 - _f(d) * tbill_days(s, m) / 360), TBillYield=lambda s, m, pr: (100 - _f(pr)) / _f(pr) * 360 / tbill_days(s, m), Vdb=kernel(vdb),
    Yield=kernel(bond_yield), YieldDisc=lambda s, m, pr, red, basis=0: (lit(red) - lit(pr)) / lit(pr) / _fraction(s, m, basis), YieldMat=kernel(yield_mat),
    RRI=lambda n, v, w: F.pow(_f(w) / _f(v), 1 / _f(n)) - 1,
)
