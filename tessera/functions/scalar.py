"""Arithmetic, maths, conditions, strings, arrays, categories, units, validation, security, points."""

from __future__ import annotations

import hashlib
import hmac
import os
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from .registry import add, arrow_udf, lit

# --- arithmetic -----------------------------------------------------------------------------------------------------


def divide(a, b, by_zero: str = "error"):
    b = lit(b)
    other = {"error": F.raise_error(F.lit("division by zero")), "zero": F.lit(0.0), "infinity": F.lit(float("inf")) * F.signum(lit(a)), "null": F.lit(None)}[by_zero]
    return F.when(b == 0, other).otherwise(lit(a) / F.when(b != 0, b))


add(
    "arithmetic", "map",
    Sign=lambda x: F.signum(x).cast("int"),
    Add=lambda a, *b: reduce(lambda x, y: x + lit(y), b, lit(a)),
    Subtract=lambda a, *b: reduce(lambda x, y: x - lit(y), b, lit(a)),
    Multiply=lambda a, *b: reduce(lambda x, y: x * lit(y), b, lit(a)),
    Divide=divide,
    Negate=lambda x: -x,
)

# --- maths ----------------------------------------------------------------------------------------------------------

add(
    "math", "map",
    Abs=F.abs, Acos=F.acos, Asin=F.asin, Atan=F.atan, Atan2=F.atan2, Cos=F.cos, Cosh=F.cosh, Exp=F.exp,
    DivRem=lambda a, b: F.struct(((lit(a) - lit(a) % lit(b)) / lit(b)).cast("long").alias("quotient"), (lit(a) % lit(b)).alias("remainder")),
    IeeeRemainder=lambda x, y: x - lit(y) * F.rint(x / lit(y)),
    Log=F.ln, Log10=F.log10, Pow=lambda x, y: F.pow(x, lit(y)), Round=F.rint, Sin=F.sin, Sinh=F.sinh, Sqrt=F.sqrt, Tan=F.tan, Tanh=F.tanh,
    Truncate=lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)),
    Ceiling=F.ceil, Floor=F.floor, Remainder=lambda a, b: lit(a) % lit(b),
)

# --- conditions -----------------------------------------------------------------------------------------------------


def _all_equal(*xs):
    return reduce(lambda a, b: a & b, [lit(xs[0]).eqNullSafe(lit(x)) for x in xs[1:]])


def _text(op):
    def build(x, s, ignore_case: bool = False):
        return op(F.lower(x), F.lower(lit(s))) if ignore_case else op(x, lit(s))

    return build


def like(x, pattern, escape=None):
    return x.like(pattern) if escape is None else F.like(x, F.lit(pattern), F.lit(escape))


def pattern_match(x, pattern: str):
    """A an upper-case letter, a a lower-case one, Z any letter, 9 a digit; other characters stand for themselves."""
    kinds = {"A": r"\p{Lu}", "a": r"\p{Ll}", "Z": r"\p{L}", "9": r"\p{Nd}"}
    return x.rlike("^" + "".join(kinds.get(c, "\\" + c if not c.isalnum() else c) for c in pattern) + "$")


_TOKENS = [("dddd", "EEEE"), ("ddd", "EEE"), ("tt", "a"), ("fff", "SSS"), ("ff", "SS"), ("zzz", "xxx")]


def date_format(fmt: str) -> str:
    """A .NET date format as Spark writes it."""
    out, at = "", 0
    while at < len(fmt):
        for a, b in _TOKENS:
            if fmt.startswith(a, at):
                out, at = out + b, at + len(a)
                break
        else:
            c = fmt[at]
            out, at = out + (c if c in "yMdHhmsS" or not c.isalpha() else f"'{c}'"), at + 1
    return out


@arrow_udf("boolean")
def _daylight(ts: pd.Series, zone: pd.Series) -> pd.Series:
    from zoneinfo import ZoneInfo

    return pd.Series([None if pd.isna(t) else bool(t.to_pydatetime().replace(tzinfo=ZoneInfo(z)).dst()) for t, z in zip(ts, zone, strict=True)], dtype=object)


def number(x):
    return F.regexp_replace(F.trim(x.cast("string")), ",(?=\\d{3})", "").try_cast("decimal(38,18)")


add(
    "condition", "condition",
    LessThan=lambda a, b: a < lit(b), LessThanOrEqual=lambda a, b: a <= lit(b), GreaterThan=lambda a, b: a > lit(b), GreaterThanOrEqual=lambda a, b: a >= lit(b),
    IsEqual=_all_equal, ArrayContains=lambda x, *v: F.array_contains(v[0], x) if len(v) == 1 and not isinstance(v[0], (int, str, float)) else x.isin(*v),
    IsDate=lambda x: F.try_to_timestamp(F.when(F.trim(x) != "", x)).isNotNull(),
    IsDateFormatExact=lambda x, fmt: F.try_to_timestamp(F.when(F.trim(x) != "", x), F.lit(date_format(fmt))).isNotNull(),
    IsNumber=lambda x: number(x).isNotNull(), IsNull=lambda x: x.isNull(), IsNullOrEmpty=lambda x: x.isNull() | (x == ""),
    IsNullOrWhitespace=lambda x: x.isNull() | x.rlike(r"^\s*$"), IsBetween=lambda x, lo, hi: (x > lit(lo)) & (x < lit(hi)),
    IsBetweenInclusive=lambda x, lo, hi: x.between(lit(lo), lit(hi)), IsBetweenRange=lambda x, lo, hi: (x >= lit(lo)) & (x < lit(hi)),
    RegexMatch=lambda x, p: x.rlike(p), Contains=_text(lambda x, s: F.contains(x, s)), Like=like, EndsWith=_text(lambda x, s: F.endswith(x, s)),
    StartsWith=_text(lambda x, s: F.startswith(x, s)),
    IsUpper=lambda x, skip=False: ~x.rlike(r"\p{Ll}") if skip else x.rlike(r"^\p{Lu}*$"), IsLower=lambda x, skip=False: ~x.rlike(r"\p{Lu}") if skip else x.rlike(r"^\p{Ll}*$"),
    IsAlpha=lambda x: x.rlike(r"^\p{L}*$"), IsAlphaNumeric=lambda x: x.rlike(r"^[\p{L}\p{N}]*$"), IsPattern=pattern_match,
    IsDaylightSavingTime=lambda x, zone="UTC": _daylight(x, F.lit(zone)), IsLeapYear=lambda d: (F.year(d) % 4 == 0) & ((F.year(d) % 100 != 0) | (F.year(d) % 400 == 0)),
    IsWeekend=lambda d: F.dayofweek(d).isin(1, 7), IsWeekDay=lambda d: ~F.dayofweek(d).isin(1, 7),
    IsDecimalEqual=lambda a, b, precision=6: F.bround(a, precision) == F.bround(lit(b), precision),
    IsDateBetweenNow=lambda lo, hi, now=None: ((now if now is not None else F.current_timestamp()) > lo) & ((now if now is not None else F.current_timestamp()) < hi),
    RangeIntersect=lambda lo1, hi1, lo2, hi2: (lit(lo1) < lit(hi2)) & (lit(lo2) < lit(hi1)), IsEven=lambda x: x % 2 == 0, IsOdd=lambda x: F.abs(x % 2) == 1,
    And=lambda *c: reduce(lambda a, b: a & b, c), Or=lambda *c: reduce(lambda a, b: a | b, c), Xor=lambda *c: reduce(lambda a, b: a != b, c), Not=lambda x: ~x,
    IsPowerOfTwo=lambda x: (x > 0) & (x.bitwiseAND(x - 1) == 0), IsPerfectSquare=lambda x: (x >= 0) & (F.pow(F.floor(F.sqrt(F.greatest(x, F.lit(0))) + 0.5), 2).cast("long") == x),
    SwitchOr=lambda when, equals: reduce(lambda a, b: a | b, [lit(w).eqNullSafe(lit(e)) for w, e in zip(when, equals, strict=True)]),
    SwitchAnd=lambda when, equals: reduce(lambda a, b: a & b, [lit(w).eqNullSafe(lit(e)) for w, e in zip(when, equals, strict=True)]),
)

# --- strings --------------------------------------------------------------------------------------------------------


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in chars) + "]"


def words(x):
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def switch(value, when, then, default=None):
    out = F.when(lit(value).eqNullSafe(lit(when[0])), lit(then[0]))
    for w, t in list(zip(when, then, strict=True))[1:]:
        out = out.when(lit(value).eqNullSafe(lit(w)), lit(t))
    return out.otherwise(lit(default))


def json_path(path: str) -> str:
    return path if path.startswith("$") else ("$" + path if path.startswith("[") else "$." + path)


def fixed_width(x, positions):
    edges = [0, *positions]
    parts = [F.substring(x, a + 1, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return F.array(*parts, x.substr(F.lit(edges[-1] + 1), F.greatest(F.length(x) - edges[-1], F.lit(0))))


def json_columns(json, json_path_: str, name_path: str, value_path: str, columns):
    items = F.from_json(F.get_json_object(json, json_path(json_path_)) if json_path_ else json, "array<string>")
    pairs = F.map_from_arrays(
        F.transform(items, lambda i: F.get_json_object(i, json_path(name_path))), F.transform(items, lambda i: F.get_json_object(i, json_path(value_path)))
    )
    return F.struct(*[F.element_at(pairs, F.lit(c)).alias(c) for c in columns])


add(
    "string", "map",
    Concat=lambda *x: F.concat(*[F.coalesce(lit(v).cast("string"), F.lit("")) for v in x]), IndexOf=lambda x, s: F.instr(x, s) - 1,
    Insert=lambda x, at, s: F.overlay(x, lit(s), F.lit(at + 1), F.lit(0)), Join=lambda sep, *x: F.concat_ws(sep, *[F.coalesce(lit(v).cast("string"), F.lit("")) for v in x]),
    RegExMatch=lambda x, p, r: F.regexp_replace(x, p, r), PadLeft=lambda x, w, c=" ": F.when(F.length(x) < w, F.lpad(x, w, c)).otherwise(x),
    PadRight=lambda x, w, c=" ": F.when(F.length(x) < w, F.rpad(x, w, c)).otherwise(x), Remove=lambda x, at, n: F.overlay(x, F.lit(""), F.lit(at + 1), F.lit(n)),
    Replace=lambda x, a, b: F.when(x != "", F.replace(x, F.lit(a), F.lit(b))),
    Split=lambda x, chars, count=-1: F.struct(F.size(F.split(x, _class(chars), count)).alias("count"), F.split(x, _class(chars), count).alias("values")),
    SplitReverse=lambda x, chars: F.struct(F.size(F.split(x, _class(chars))).alias("count"), F.reverse(F.split(x, _class(chars))).alias("values")),
    Substring=lambda x, at, n: F.coalesce(F.substring(x, at + 1, n), F.when(x.isNotNull(), "")), ToLower=F.lower, ToUpper=F.upper,
    Trim=lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""), TrimEnd=lambda x: F.regexp_replace(x, r"\s+$", ""), TrimStart=lambda x: F.regexp_replace(x, r"^\s+", ""),
    Length=F.length, WordCount=lambda x: F.size(words(x)), WordExtract=lambda x, n: F.coalesce(F.get(words(x), F.lit(n)), F.when(x.isNotNull(), "")),
    XPathValues=lambda x, *paths: F.array(*[F.xpath_string(x, F.lit(p)) for p in paths]),
    JsonValues=lambda x, *paths: F.struct(
        reduce(lambda a, b: a & b, [F.get_json_object(x, json_path(p)).isNotNull() for p in paths]).alias("found"),
        F.array(*[F.get_json_object(x, json_path(p)) for p in paths]).alias("values"),
    ),
    JsonArrayToColumns=json_columns, SplitFixedWidth=fixed_width, CreateSHA1=lambda x: F.sha1(x.cast("binary")), MaxValue=lambda *x: F.greatest(*x) if len(x) > 1 else F.array_max(x[0]),
    MinValue=lambda *x: F.least(*x) if len(x) > 1 else F.array_min(x[0]), Switch=switch,
)

# --- arrays ---------------------------------------------------------------------------------------------------------


def numeric_sequence(start, end, step):
    """From start, by step, short of end; empty where it can't get there."""
    n = F.greatest(F.lit(0), F.ceil((lit(end) - lit(start)) / lit(step))).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n), lambda i: lit(start) + i * lit(step))


add(
    "array", "map",
    ValueAt=lambda at, x: F.element_at(x, at + 1), ArrayLength=F.size, ArrayConcat=lambda a, b: F.concat(a, b), ArraySearch=lambda s, x: F.filter(x, lambda v: v.cast("string").contains(s)),
    ArraySort=lambda x, ascending=True: F.sort_array(x, ascending), CreateArray=lambda *x: F.array(*[lit(v) for v in x]),
    CreateRange=lambda start, n: F.when(lit(n) > 0, F.sequence(lit(start), lit(start) + F.greatest(lit(n), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>")),
    CreateNumericSequence=numeric_sequence,
)

# --- categories -----------------------------------------------------------------------------------------------------


def _g(v) -> str:
    return f"{v:g}"


def range_categorize(x, edges, inclusive=False):
    """Struct in_range, low, high, label; below the first edge `< e`, above the last `> e`. Upper bounds are exclusive unless inclusive."""
    under = (lambda e: x <= e) if inclusive else (lambda e: x < e)
    kind = "struct<in_range:boolean,low:double,high:double,label:string>"
    pack = lambda ok, lo, hi, label: F.struct(F.lit(ok).alias("in_range"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"), F.lit(label).alias("label"))
    out = F.when(x.isNull(), F.lit(None).cast(kind)).when((x < edges[0]), pack(False, None, edges[0], f"< {_g(edges[0])}"))
    for lo, hi in zip(edges, edges[1:], strict=False):
        out = out.when(under(hi), pack(True, lo, hi, f"{_g(lo)} - {_g(hi)}"))
    return out.otherwise(pack(False, edges[-1], None, f"> {_g(edges[-1])}"))


def interval_categorize(x, interval, low=None, high=None):
    base = float(low or 0)
    floor = F.floor((x - base) / interval) * interval + base
    at = F.struct(F.lit(True).alias("in_range"), floor.cast("double").alias("low"), (floor + interval).cast("double").alias("high"), F.concat(F.format_string("%.0f", floor.cast("double")), F.lit(" - "), F.format_string("%.0f", (floor + interval).cast("double"))).alias("label"))
    out = F.when(x.isNull(), F.lit(None).cast("struct<in_range:boolean,low:double,high:double,label:string>"))
    null = F.lit(None).cast("double")
    if low is not None:
        out = out.when(x < low, F.struct(F.lit(False).alias("in_range"), null.alias("low"), F.lit(float(low)).alias("high"), F.lit(f"< {_g(low)}").alias("label")))
    if high is not None:
        out = out.when(x >= high, F.struct(F.lit(False).alias("in_range"), F.lit(float(high)).alias("low"), null.alias("high"), F.lit(f"> {_g(high)}").alias("label")))
    return out.otherwise(at)


add("categorize", "map", RangeCategorize=range_categorize, IntervalCategorize=interval_categorize, DiscreteRangeCategorize=lambda x, edges: range_categorize(x, edges, inclusive=True))

# --- units ----------------------------------------------------------------------------------------------------------

LENGTH = {"millimeter": 1e-3, "centimeter": 1e-2, "meter": 1.0, "kilometer": 1e3, "inch": 0.0254, "feet": 0.3048, "yard": 0.9144, "mile": 1609.344}
MASS = {"milligram": 1e-6, "gram": 1e-3, "kilogram": 1.0, "tonne": 1e3, "ounce": 0.028349523125, "pound": 0.45359237, "stone": 6.35029318}
TIME = {"ticks": 1e-7, "milliseconds": 1e-3, "seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}


def temperature(x, a: str, b: str):
    celsius = {"celsius": x, "fahrenheit": (x - 32) * (5.0 / 9), "kelvin": x - 273.15, "rankine": (x - 491.67) * (5.0 / 9)}[a.lower()]
    return {"celsius": celsius, "fahrenheit": celsius * 1.8 + 32, "kelvin": celsius + 273.15, "rankine": (celsius + 273.15) * 1.8}[b.lower()]


def _convert(units):
    return lambda x, a, b: x * (units[a.lower()] / units[b.lower()])


def _convert_by(units):
    def build(x, unit, b):
        table = F.create_map(*[v for k, f in units.items() for v in (F.lit(k), F.lit(f))])
        return x * F.element_at(table, F.lower(unit)) / units[b.lower()]

    return build


add(
    "convert", "map",
    ConvertTemperature=temperature, ConvertLength=_convert(LENGTH), ConvertLengthString=_convert_by(LENGTH), ConvertMass=_convert(MASS), ConvertMassString=_convert_by(MASS),
    ConvertTime=_convert(TIME), ConvertTimeString=_convert_by(TIME),
)

# --- validation: struct(ok, cleaned) --------------------------------------------------------------------------------

EMAIL = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"


def checked(ok, cleaned):
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), cleaned.alias("cleaned"))


add(
    "validation", "validate",
    CleanBlankString=lambda x, d: checked(F.coalesce(x, F.lit("")) != "", F.when(F.coalesce(x, F.lit("")) == "", lit(d)).otherwise(x)),
    CleanNull=lambda x, d: checked(x.isNotNull(), F.coalesce(x, lit(d))), NullToBlank=lambda x: checked(x.isNotNull(), F.coalesce(x, F.lit(""))),
    MaxLength=lambda x, n: checked(F.length(x) <= n, F.substring(x, 1, n)),
    MinLength=lambda x, n, pad=" ", before=False: checked(F.length(x) > n, F.when(F.length(x) < n, (F.lpad if before else F.rpad)(x, n, pad)).otherwise(x)),
    MaxValue=lambda x, m: checked(x <= lit(m), F.least(x, lit(m))), MinValue=lambda x, m: checked(x >= lit(m), F.greatest(x, lit(m))),
    IsValidEmail=lambda x: checked(x.rlike(EMAIL), x),
)

# --- security -------------------------------------------------------------------------------------------------------


def _key(key: str, rounds: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", key.encode(), b"tessera", rounds, 32)


def encrypt(x, key: str, rounds: int = 1000):
    """Base64 of AES-GCM under a key derived by PBKDF2; the key is derived once, on the driver."""
    return F.base64(F.aes_encrypt(x.cast("binary"), F.lit(_key(key, rounds))))


def decrypt(x, key: str, rounds: int = 1000):
    return F.try_aes_decrypt(F.unbase64(x), F.lit(_key(key, rounds))).cast("string")


@arrow_udf("string", deterministic=False)
def _secure_hash(x: pd.Series) -> pd.Series:
    def one(v):
        salt = os.urandom(16)
        return None if v is None else salt.hex() + hashlib.pbkdf2_hmac("sha256", v.encode(), salt, 1000).hex()

    return x.map(one)


@arrow_udf("boolean")
def _valid_hash(x: pd.Series, h: pd.Series) -> pd.Series:
    def one(v, t):
        if v is None or t is None:
            return False
        return hmac.compare_digest(hashlib.pbkdf2_hmac("sha256", v.encode(), bytes.fromhex(t[:32]), 1000).hex(), t[32:])

    return pd.Series([one(v, t) for v, t in zip(x, h, strict=True)])


add(
    "security", "map",
    Encrypt=encrypt, Decrypt=decrypt, StrongEncrypt=lambda x, key: encrypt(x, key, 1000), StrongDecrypt=lambda x, key: decrypt(x, key, 1000),
    FastEncrypt=lambda x, key: encrypt(x, key, 5), FastDecrypt=lambda x, key: decrypt(x, key, 5), SecureHash=_secure_hash, ValidateSecureHash=_valid_hash,
)

# --- points and shapes: struct(x, y, z); lines, rings and collections are arrays ------------------------------------


def point(x=None, y=None, z=None):
    nan = F.lit(float("nan"))
    return F.struct(*[(lit(v).cast("double") if v is not None else nan).alias(n) for n, v in (("x", x), ("y", y), ("z", z))])


def geographic(lat1, lon1, lat2, lon2):
    """Metres by the spherical law of cosines, one minute of arc being 1853.159616 m."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lit(lon1) - lit(lon2))
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))) * 60 * 1853.159616


def distance(p, q):
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def _gather(value, order=None):
    """Values of a group as an array, by an order where one is given."""
    if order is None:
        return F.collect_list(value)
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def polygon(x, y, order=None):
    ring = _gather(point(x, y), order)
    return F.when((F.size(ring) > 0) & (F.element_at(ring, 1) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


add("geometry", "map", ExtractCoordinate=lambda g: F.struct(g["x"], g["y"], g["z"]), CreatePoint=point, GeographicDistance=geographic,
    GeographicDistancePoints=lambda p, q: geographic(p["y"], p["x"], q["y"], q["x"]), Distance=distance, IsWithinDistance=lambda p, q, d: distance(p, q) <= d)
add("geometry", "aggregate", CreateMultiPoint=_gather, CreateMultiPointXYZ=lambda x, y, z=None, order=None: _gather(point(x, y, z), order),
    CreateLineString=lambda x, y, order=None: _gather(point(x, y), order), CreatePolygon=polygon, CreateMultiLineString=_gather, CreateMultiPolygon=_gather, CreateGeometryCollection=_gather)
add("geometry", "rows", ExtractMultiPoint=F.explode_outer, ExtractLineString=F.explode_outer, ExtractPolygon=F.explode_outer, ExtractMultiLinePoint=F.explode_outer,
    ExtractMultiPolygon=F.explode_outer, ExtractGeometryCollection=F.explode_outer)

# --- integer maths --------------------------------------------------------------------------------------------------


def gcd(*xs):
    """Greatest common divisor; Euclid's steps over at most 93 rounds, enough for 64 bits."""
    step = lambda a, b: F.aggregate(
        F.sequence(F.lit(1), F.lit(93)),
        F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"]).otherwise(1)).alias("b"))),
        lambda s: s["a"],
    )
    return reduce(step, [lit(x) for x in xs])


def lcm(*xs):
    def two(a, b):
        g = gcd(a, b)
        return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.floor(F.abs(a) / F.when(g != 0, g)).cast("long") * F.abs(b).cast("long"))

    return reduce(two, [lit(x).cast("long") for x in xs])


@arrow_udf("gcd long, x long, y long")
def _egcd(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    def one(a, b):
        x0, x1, y0, y1 = 1, 0, 0, 1
        while b:
            q, a, b = a // b, b, a % b
            x0, x1, y0, y1 = x1, x0 - q * x1, y1, y0 - q * y1
        return (a, x0, y0)

    return pd.DataFrame([one(int(p), int(q)) for p, q in zip(a, b, strict=True)], columns=["gcd", "x", "y"])


add("integer", "map", GreatestCommonDivisor=gcd, LeastCommonMultiple=lcm, ExtendedGreatestCommonDivisor=_egcd)
