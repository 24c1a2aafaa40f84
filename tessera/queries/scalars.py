"""Queries that apply scalar functions, by category, to the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import call as f

C = F.col


def register(name: str, source: str, columns: dict, where: str | None = None, key: str | None = None):
    """A query of many columns, name: (Column maker, SQL), over one table."""
    sql = f"SELECT {', '.join([key] * bool(key) + [f'{s} AS {n}' for n, (_, s) in columns.items()])} FROM {source}" + (f" WHERE {where}" if where else "")

    @query(name, sql)
    def run(spark, d):
        df = table(spark, d, source)
        if where:
            df = df.filter(where)
        return df.select(*[C(key)] * bool(key), *[make().alias(n) for n, (make, _) in columns.items()])

    return run


register("fn_arithmetic", "lineitem", {
    "a": (lambda: f("arithmetic.Sign", C("l_quantity") - 25), "sign(l_quantity - 25)::INTEGER"),
    "b": (lambda: f("arithmetic.Add", C("l_orderkey"), C("l_partkey"), 5), "l_orderkey + l_partkey + 5"),
    "c": (lambda: f("arithmetic.Subtract", C("l_orderkey"), C("l_partkey"), 5), "l_orderkey - l_partkey - 5"),
    "d": (lambda: f("arithmetic.Multiply", C("l_linenumber"), 3, 2), "l_linenumber * 3 * 2"),
    "e": (lambda: F.round(f("arithmetic.Divide", C("l_quantity"), C("l_linenumber") - 1, by_zero="zero"), 6), "CASE WHEN l_linenumber = 1 THEN 0 ELSE round(l_quantity / (l_linenumber - 1), 6) END"),
    "g": (lambda: f("arithmetic.Negate", C("l_partkey")), "-l_partkey"),
}, key="l_orderkey")

register("fn_math", "part", {
    "a": (lambda: f("math.Abs", C("p_size") - 20.0), "abs(p_size - 20.0::DOUBLE)"),
    **{n: (lambda n=n, s=s: F.round(f(f"math.{n}", C("p_size") / 60.0), 8), f"round({s}(p_size / 60.0::DOUBLE), 8)") for n, s in (("Acos", "acos"), ("Asin", "asin"), ("Atan", "atan"), ("Cos", "cos"), ("Cosh", "cosh"), ("Exp", "exp"), ("Log", "ln"), ("Log10", "log10"), ("Sin", "sin"), ("Sinh", "sinh"), ("Sqrt", "sqrt"), ("Tan", "tan"), ("Tanh", "tanh"))},
    "atan2": (lambda: F.round(f("math.Atan2", C("p_size"), C("p_retailprice")), 8), "round(atan2(p_size, p_retailprice), 8)"),
    "quot": (lambda: f("math.DivRem", C("p_partkey"), F.lit(7))["quotient"], "p_partkey // 7"),
    "rem": (lambda: f("math.DivRem", C("p_partkey"), F.lit(7))["remainder"], "p_partkey % 7"),
    "ieee": (lambda: F.round(f("math.IeeeRemainder", C("p_size").cast("double"), 7.0), 8), "round(p_size - 7 * round_even(p_size / 7.0::DOUBLE, 0), 8)"),
    "pow": (lambda: f("math.Pow", C("p_size"), 3), "pow(p_size, 3)::DOUBLE"),
    "rnd": (lambda: f("math.Round", C("p_size") / 2.0), "round_even(p_size / 2.0::DOUBLE, 0)"),
    "trunc": (lambda: f("math.Truncate", C("p_retailprice") - 1200).cast("long"), "trunc(p_retailprice - 1200)::BIGINT"),
    "ceil": (lambda: f("math.Ceiling", C("p_retailprice")).cast("long"), "ceil(p_retailprice)::BIGINT"),
    "flr": (lambda: f("math.Floor", C("p_retailprice")).cast("long"), "floor(p_retailprice)::BIGINT"),
    "rmd": (lambda: f("math.Remainder", C("p_partkey"), 9), "p_partkey % 9"),
}, key="p_partkey")

_T = "l_shipdate"
register("fn_conditions", "lineitem", {
    "lt": (lambda: f("condition.LessThan", C("l_quantity"), 10), "l_quantity < 10"), "le": (lambda: f("condition.LessThanOrEqual", C("l_quantity"), 10), "l_quantity <= 10"),
    "gt": (lambda: f("condition.GreaterThan", C("l_quantity"), 10), "l_quantity > 10"), "ge": (lambda: f("condition.GreaterThanOrEqual", C("l_quantity"), 10), "l_quantity >= 10"),
    "eq": (lambda: f("condition.IsEqual", C("l_returnflag"), C("l_linestatus")), "l_returnflag IS NOT DISTINCT FROM l_linestatus"), "isin": (lambda: f("condition.ArrayContains", C("l_returnflag"), "A", "N"), "l_returnflag IN ('A', 'N')"),
    "nul": (lambda: f("condition.IsNull", C("l_tax")), "l_tax IS NULL"), "betw": (lambda: f("condition.IsBetween", C("l_quantity"), 5, 9), "l_quantity > 5 AND l_quantity < 9"),
    "bi": (lambda: f("condition.IsBetweenInclusive", C("l_quantity"), 5, 9), "l_quantity BETWEEN 5 AND 9"), "br": (lambda: f("condition.IsBetweenRange", C("l_quantity"), 5, 9), "l_quantity >= 5 AND l_quantity < 9"),
    "leap": (lambda: f("condition.IsLeapYear", C(_T)), f"(year({_T}) % 4 = 0 AND (year({_T}) % 100 <> 0 OR year({_T}) % 400 = 0))"), "wend": (lambda: f("condition.IsWeekend", C(_T)), f"dayofweek({_T}) IN (0, 6)"),
    "wday": (lambda: f("condition.IsWeekDay", C(_T)), f"dayofweek({_T}) NOT IN (0, 6)"), "de": (lambda: f("condition.IsDecimalEqual", C("l_tax"), C("l_discount"), precision=1), "round_even(l_tax, 1) = round_even(l_discount, 1)"),
    "ri": (lambda: f("condition.RangeIntersect", C("l_quantity"), C("l_quantity") + 5, 20, 30), "l_quantity < 30 AND 20 < l_quantity + 5"), "ev": (lambda: f("condition.IsEven", C("l_partkey")), "l_partkey % 2 = 0"),
    "od": (lambda: f("condition.IsOdd", C("l_partkey")), "l_partkey % 2 = 1"), "an": (lambda: f("condition.And", C("l_tax") > 0.02, C("l_discount") > 0.02, C("l_quantity") > 9), "l_tax > 0.02 AND l_discount > 0.02 AND l_quantity > 9"),
    "orr": (lambda: f("condition.Or", C("l_tax") > 0.07, C("l_discount") > 0.09), "l_tax > 0.07 OR l_discount > 0.09"), "xo": (lambda: f("condition.Xor", C("l_tax") > 0.04, C("l_discount") > 0.05), "(l_tax > 0.04) <> (l_discount > 0.05)"),
    "nt": (lambda: f("condition.Not", C("l_tax") > 0.04), "NOT l_tax > 0.04"), "p2": (lambda: f("condition.IsPowerOfTwo", C("l_partkey")), "l_partkey > 0 AND (l_partkey & (l_partkey - 1)) = 0"),
    "sq": (lambda: f("condition.IsPerfectSquare", C("l_partkey")), "pow(floor(sqrt(l_partkey) + 0.5), 2)::BIGINT = l_partkey"), "so": (lambda: f("condition.SwitchOr", [C("l_returnflag"), C("l_linestatus")], ["A", "F"]), "l_returnflag = 'A' OR l_linestatus = 'F'"),
    "sa": (lambda: f("condition.SwitchAnd", [C("l_returnflag"), C("l_linestatus")], ["A", "F"]), "l_returnflag = 'A' AND l_linestatus = 'F'"),
}, key="l_orderkey")

register("fn_text_conditions", "customer", {
    "d": (lambda: f("condition.IsDate", C("c_name")), "try_cast(c_name AS TIMESTAMP) IS NOT NULL"), "df": (lambda: f("condition.IsDateFormatExact", F.format_string("2020-%02d-10", C("c_nationkey")), "yyyy-MM-dd"), "c_nationkey BETWEEN 1 AND 12"),
    "nb": (lambda: f("condition.IsNumber", F.substring("c_name", -3, 3)), "try_cast(right(c_name, 3) AS DOUBLE) IS NOT NULL"), "ne": (lambda: f("condition.IsNullOrEmpty", C("c_name")), "c_name IS NULL OR c_name = ''"),
    "nw": (lambda: f("condition.IsNullOrWhitespace", C("c_name")), "c_name IS NULL OR trim(c_name) = ''"), "rx": (lambda: f("condition.RegexMatch", C("c_name"), "[1-3]5"), "regexp_matches(c_name, '[1-3]5')"),
    "ct": (lambda: f("condition.Contains", C("c_name"), "CUST", ignore_case=True), "contains(lower(c_name), 'cust')"), "lk": (lambda: f("condition.Like", C("c_name"), "C%7_"), "c_name LIKE 'C%7_'"),
    "ew": (lambda: f("condition.EndsWith", C("c_name"), "9"), "ends_with(c_name, '9')"), "sw": (lambda: f("condition.StartsWith", C("c_mktsegment"), "B"), "starts_with(c_mktsegment, 'B')"),
    "up": (lambda: f("condition.IsUpper", C("c_mktsegment")), "regexp_full_match(c_mktsegment, '[A-Z]*')"), "lo": (lambda: f("condition.IsLower", C("c_mktsegment")), "regexp_full_match(c_mktsegment, '[a-z]*')"),
    "al": (lambda: f("condition.IsAlpha", C("c_name")), "regexp_full_match(c_name, '[A-Za-z]*')"), "aln": (lambda: f("condition.IsAlphaNumeric", C("c_name")), "regexp_full_match(c_name, '[A-Za-z0-9]*')"),
    "pt": (lambda: f("condition.IsPattern", C("c_mktsegment"), "AAAAAAAAA"), "regexp_full_match(c_mktsegment, '[A-Z]{9}')"), "dst": (lambda: f("condition.IsDaylightSavingTime", F.lit("2020-07-01 00:00:00").cast("timestamp_ntz"), zone="Europe/Berlin"), "true"),
    "bn": (lambda: f("condition.IsDateBetweenNow", F.lit("2000-01-01").cast("timestamp"), F.lit("2090-01-01").cast("timestamp")), "true"),
}, key="c_custkey")

register("fn_strings", "customer", {
    "cc": (lambda: f("string.Concat", C("c_name"), "/", C("c_nationkey"), F.lit(None)), "concat(c_name, '/', c_nationkey, NULL)"), "ix": (lambda: f("string.IndexOf", C("c_name"), "1"), "instr(c_name, '1') - 1"),
    "ins": (lambda: f("string.Insert", C("c_name"), 2, "__"), "c_name[:2] || '__' || c_name[3:]"), "jn": (lambda: f("string.Join", "-", C("c_mktsegment"), C("c_name")), "concat_ws('-', c_mktsegment, c_name)"),
    "rr": (lambda: f("string.RegExMatch", C("c_name"), "[0-9]+", "#"), "regexp_replace(c_name, '[0-9]+', '#', 'g')"), "pl": (lambda: f("string.PadLeft", C("c_mktsegment"), 12, "*"), "lpad(c_mktsegment, greatest(12, length(c_mktsegment))::INTEGER, '*')"),
    "pr": (lambda: f("string.PadRight", C("c_mktsegment"), 5, "*"), "rpad(c_mktsegment, greatest(5, length(c_mktsegment))::INTEGER, '*')"), "rm": (lambda: f("string.Remove", C("c_name"), 1, 3), "c_name[:1] || c_name[5:]"),
    "rp": (lambda: f("string.Replace", C("c_name"), "0", "o"), "replace(c_name, '0', 'o')"), "sp": (lambda: F.array_join(f("string.Split", C("c_name"), "#0")["values"], "|"), "regexp_replace(c_name, '[#0]', '|', 'g')"),
    "spn": (lambda: f("string.Split", C("c_name"), "#0")["count"], "len(regexp_split_to_array(c_name, '[#0]'))::INTEGER"), "spr": (lambda: f("string.SplitReverse", C("c_name"), "#")["values"][0], "split_part(c_name, '#', -1)"),
    "sb": (lambda: f("string.Substring", C("c_name"), 4, 3), "substring(c_name, 5, 3)"), "low": (lambda: f("string.ToLower", C("c_name")), "lower(c_name)"), "upp": (lambda: f("string.ToUpper", C("c_name")), "upper(c_name)"),
    "tr": (lambda: f("string.Trim", F.concat(F.lit("  "), C("c_name"), F.lit(" "))), "c_name"), "te": (lambda: f("string.TrimEnd", F.concat(F.lit(" "), C("c_name"), F.lit(" "))), "' ' || c_name"), "ts": (lambda: f("string.TrimStart", F.concat(F.lit(" "), C("c_name"))), "c_name"),
    "ln": (lambda: f("string.Length", C("c_name")), "length(c_name)::INTEGER"), "wc": (lambda: f("string.WordCount", F.concat_ws(" ", C("c_name"), C("c_mktsegment"))), "2"), "we": (lambda: f("string.WordExtract", F.concat_ws("  ", C("c_mktsegment"), C("c_name")), 1), "c_name"),
    "xp": (lambda: f("string.XPathValues", F.concat(F.lit("<a><b>"), C("c_nationkey"), F.lit("</b></a>")), "a/b")[0], "c_nationkey::VARCHAR"), "fw": (lambda: F.array_join(f("string.SplitFixedWidth", C("c_mktsegment"), [2, 5]), "|"), "c_mktsegment[:2] || '|' || c_mktsegment[3:5] || '|' || c_mktsegment[6:]"),
    "sh": (lambda: f("string.CreateSHA1", C("c_name")), "sha1(c_name)"), "mx": (lambda: f("string.MaxValue", C("c_custkey"), C("c_nationkey").cast("long")), "greatest(c_custkey, c_nationkey::BIGINT)"), "mn": (lambda: f("string.MinValue", C("c_custkey"), C("c_nationkey").cast("long")), "least(c_custkey, c_nationkey::BIGINT)"),
    "sw": (lambda: f("string.Switch", C("c_mktsegment"), ["BUILDING", "MACHINERY"], ["b", "m"], "other"), "CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END"),
}, key="c_custkey")

register("fn_json", "events", {
    "v": (lambda: f("string.JsonValues", C("props"), "k")["values"][0], "json_extract_string(props, '$.k')"), "ok": (lambda: f("string.JsonValues", C("props"), "k", "missing")["found"], "false"),
    "ac": (lambda: f("string.JsonArrayToColumns", F.lit('[{"n":"a","v":"1"},{"n":"b","v":"2"}]'), None, "n", "v", ["a", "b"])["b"], "'2'"),
}, key="event_id")

_M = "o_orderdate"
register("fn_dates", "orders", {
    "td": (lambda: f("date.ToDate", F.lit("2020-02-03 04:05:06")).cast("timestamp_ntz"), "TIMESTAMP '2020-02-03 04:05:06'"), "te": (lambda: f("date.ToDateExact", F.lit("03/02/2020"), "yyyy-MM-dd", "dd/MM/yyyy").cast("timestamp_ntz"), "TIMESTAMP '2020-02-03'"),
    "ad": (lambda: f("date.AddDays", C(_M), 1.5), f"{_M} + INTERVAL 36 HOUR"), "ah": (lambda: f("date.AddHours", C(_M), 2), f"{_M} + INTERVAL 2 HOUR"), "ams": (lambda: f("date.AddMilliseconds", C(_M), 1500), f"{_M} + INTERVAL 1500 MILLISECOND"),
    "ami": (lambda: f("date.AddMinutes", C(_M), -3), f"{_M} - INTERVAL 3 MINUTE"), "amo": (lambda: f("date.AddMonths", C(_M), 1), f"{_M} + INTERVAL 1 MONTH"), "as_": (lambda: f("date.AddSeconds", C(_M), 30), f"{_M} + INTERVAL 30 SECOND"),
    "ay": (lambda: f("date.AddYears", C(_M), -4), f"{_M} - INTERVAL 4 YEAR"), "dim": (lambda: f("date.DaysInMonth", C(_M)), f"day(last_day({_M}))::INTEGER"), "dom": (lambda: f("date.DayOfMonth", C(_M)), f"day({_M})::INTEGER"),
    "dwn": (lambda: f("date.DayOfWeekName", C(_M)), f"dayname({_M})"), "dw": (lambda: f("date.DayOfWeekNumber", C(_M)), f"dayofweek({_M})::INTEGER"),
    "wy": (lambda: f("date.WeekOfYear", C(_M)), f"((dayofyear({_M}) - 1 + dayofweek(date_trunc('year', {_M}))) // 7 + 1)::INTEGER"), "dy": (lambda: f("date.DayOfYear", C(_M)), f"dayofyear({_M})::INTEGER"), "mo": (lambda: f("date.Month", C(_M)), f"month({_M})::INTEGER"),
    "sm": (lambda: f("date.ShortMonth", C(_M)), f"strftime({_M}, '%b')"), "lm": (lambda: f("date.LongMonth", C(_M)), f"monthname({_M})"), "yr": (lambda: f("date.Year", C(_M)), f"year({_M})::INTEGER"), "qt": (lambda: f("date.Quarter", C(_M)), f"quarter({_M})::INTEGER"),
    "dt": (lambda: f("date.DateOnly", C(_M)), f"{_M}::DATE"), "ld": (lambda: f("date.ToLongDateString", C(_M)), f"strftime({_M}, '%A, %d %B %Y')"), "lt": (lambda: f("date.ToLongTimeString", C(_M)), f"strftime({_M}, '%-I:%M:%S %p')"),
    "sd": (lambda: f("date.ToShortDateString", C(_M)), f"strftime({_M}, '%-d/%m/%Y')"), "st": (lambda: f("date.ToShortTimeString", C(_M)), f"strftime({_M}, '%-I:%M %p')"), "ds": (lambda: f("date.DateToString", C(_M), "dddd yyyy-MM-dd HH:mm"), f"strftime({_M}, '%A %Y-%m-%d %H:%M')"),
    "db": (lambda: F.round(f("date.DaysBetween", F.lit("1990-01-01").cast("timestamp_ntz"), C(_M)), 6), f"round(epoch_us({_M} - TIMESTAMP '1990-01-01') / 86400e6, 6)"), "hb": (lambda: F.round(f("date.HoursBetween", F.lit("1990-01-01").cast("timestamp_ntz"), C(_M)), 6), f"round(epoch_us({_M} - TIMESTAMP '1990-01-01') / 3600e6, 6)"),
    "mb": (lambda: F.round(f("date.MinutesBetween", F.lit("1990-01-01").cast("timestamp_ntz"), C(_M)), 6), f"round(epoch_us({_M} - TIMESTAMP '1990-01-01') / 60e6, 6)"), "sb": (lambda: f("date.SecondsBetween", F.lit("1990-01-01").cast("timestamp_ntz"), C(_M)), f"epoch_us({_M} - TIMESTAMP '1990-01-01') / 1e6"),
    "msb": (lambda: f("date.MillisecondsBetween", F.lit("1990-01-01").cast("timestamp_ntz"), C(_M)), f"epoch_us({_M} - TIMESTAMP '1990-01-01') / 1e3"), "age": (lambda: f("date.AgeInYearsAtDate", C(_M), F.lit("2020-06-15").cast("timestamp_ntz")), f"date_sub('year', {_M}, TIMESTAMP '2020-06-15')::INTEGER"),
    "ux": (lambda: f("date.UnixTimeStampToDate", C("o_orderkey")).cast("timestamp_ntz"), "make_timestamp(o_orderkey * 1000000)"), "dq": (lambda: f("date.DateComponents", C(_M))["quarter"], f"quarter({_M})::INTEGER"), "th": (lambda: f("date.TimeComponents", C(_M))["hour"], f"hour({_M})::INTEGER"),
    "cd": (lambda: f("date.CreateDate", F.year(_M), None, "march", 5), f"make_timestamp(year({_M}), 3, 5, 0, 0, 0)"), "now": (lambda: f("date.DateTimeNow") >= f("date.DateNow"), "true"),
}, key="o_orderkey")

register("fn_arrays", "nation", {
    "at": (lambda: f("array.ValueAt", F.lit(1), F.array("n_nationkey", "n_regionkey")), "n_regionkey"), "ln": (lambda: f("array.ArrayLength", F.array("n_nationkey", "n_regionkey")), "2"),
    "cc": (lambda: F.array_join(f("array.ArrayConcat", F.array("n_nationkey"), F.array("n_regionkey")), ","), "n_nationkey || ',' || n_regionkey"), "se": (lambda: F.size(f("array.ArraySearch", "A", F.array("n_name", F.lit("B")))), "contains(n_name, 'A')::INTEGER"),
    "so": (lambda: F.array_join(f("array.ArraySort", F.array("n_nationkey", "n_regionkey"), False), ","), "greatest(n_nationkey, n_regionkey) || ',' || least(n_nationkey, n_regionkey)"), "cr": (lambda: F.size(f("array.CreateArray", C("n_nationkey"), 1, 2)), "3"),
    "rg": (lambda: F.array_join(f("array.CreateRange", C("n_regionkey"), F.lit(3)), ","), "n_regionkey || ',' || (n_regionkey + 1) || ',' || (n_regionkey + 2)"), "sq": (lambda: F.size(f("array.CreateNumericSequence", F.lit(0), C("n_nationkey"), F.lit(4))), "ceil(n_nationkey / 4)::INTEGER"),
}, key="n_nationkey")

register("fn_categories", "part", {
    "r": (lambda: f("categorize.RangeCategorize", C("p_size"), [10, 20, 30])["label"], "CASE WHEN p_size < 10 THEN '< 10' WHEN p_size < 20 THEN '10 - 20' WHEN p_size < 30 THEN '20 - 30' ELSE '> 30' END"),
    "i": (lambda: f("categorize.IntervalCategorize", C("p_size"), 5)["label"], "(p_size // 5 * 5) || ' - ' || (p_size // 5 * 5 + 5)"), "d": (lambda: f("categorize.DiscreteRangeCategorize", C("p_size"), [10, 20, 30])["label"], "CASE WHEN p_size < 10 THEN '< 10' WHEN p_size <= 20 THEN '10 - 20' WHEN p_size <= 30 THEN '20 - 30' ELSE '> 30' END"),
    "cf": (lambda: F.round(f("convert.ConvertTemperature", C("p_size"), "celsius", "fahrenheit"), 6), "round(p_size * 1.8::DOUBLE + 32, 6)"), "fc": (lambda: F.round(f("convert.ConvertTemperature", C("p_size"), "fahrenheit", "celsius"), 6), "round((p_size - 32) * 5 / 9.0::DOUBLE, 6)"),
    "km": (lambda: F.round(f("convert.ConvertLength", C("p_size"), "kilometer", "mile"), 6), "round(p_size * 1000 / 1609.344::DOUBLE, 6)"), "lb": (lambda: F.round(f("convert.ConvertMass", C("p_size"), "kilogram", "pound"), 6), "round(p_size / 0.45359237::DOUBLE, 6)"),
    "ms": (lambda: f("convert.ConvertTime", C("p_size"), "hours", "milliseconds").cast("long"), "(p_size * 3600000)::BIGINT"), "ls": (lambda: F.round(f("convert.ConvertLengthString", C("p_size"), F.lit("inch"), "centimeter"), 6), "round(p_size * 2.54::DOUBLE, 6)"),
    "mss": (lambda: F.round(f("convert.ConvertMassString", C("p_size"), F.lit("tonne"), "kilogram"), 6), "round(p_size * 1000.0::DOUBLE, 6)"), "tss": (lambda: F.round(f("convert.ConvertTimeString", C("p_size"), F.lit("days"), "hours"), 6), "round(p_size * 24.0::DOUBLE, 6)"),
}, key="p_partkey")

register("fn_validation", "customer", {
    "b": (lambda: f("validation.CleanBlankString", C("c_name"), "?")["ok"], "true"), "n": (lambda: f("validation.CleanNull", F.nullif(C("c_nationkey"), F.lit(3)), -1)["cleaned"], "CASE WHEN c_nationkey = 3 THEN -1 ELSE c_nationkey END"),
    "nb": (lambda: f("validation.NullToBlank", F.nullif(C("c_mktsegment"), F.lit("BUILDING")))["cleaned"], "CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END"), "ml": (lambda: f("validation.MaxLength", C("c_mktsegment"), 8)["cleaned"], "left(c_mktsegment, 8)"),
    "mlo": (lambda: f("validation.MaxLength", C("c_mktsegment"), 8)["ok"], "length(c_mktsegment) <= 8"), "mi": (lambda: f("validation.MinLength", C("c_mktsegment"), 9, "*")["cleaned"], "rpad(c_mktsegment, greatest(9, length(c_mktsegment))::INTEGER, '*')"),
    "mv": (lambda: f("validation.MaxValue", C("c_acctbal"), 100.0)["cleaned"], "least(c_acctbal, 100.0::DOUBLE)"), "nv": (lambda: f("validation.MinValue", C("c_acctbal"), 100.0)["ok"], "c_acctbal >= 100"),
    "em": (lambda: f("validation.IsValidEmail", F.concat(F.lower(C("c_mktsegment")), F.lit("@example.com")))["ok"], "true"), "em2": (lambda: f("validation.IsValidEmail", C("c_name"))["ok"], "false"),
}, key="c_custkey")

register("fn_security", "nation", {
    "a": (lambda: f("security.Decrypt", f("security.Encrypt", C("n_name"), "k", 10), "k", 10), "n_name"), "b": (lambda: f("security.StrongDecrypt", f("security.StrongEncrypt", C("n_name"), "k"), "k"), "n_name"),
    "c": (lambda: f("security.FastDecrypt", f("security.FastEncrypt", C("n_name"), "k"), "k"), "n_name"), "d": (lambda: f("security.ValidateSecureHash", C("n_name"), f("security.SecureHash", C("n_name"))), "true"),
    "e": (lambda: f("security.Decrypt", f("security.Encrypt", C("n_name"), "k"), "wrong").isNull(), "true"),
}, key="n_nationkey")

register("fn_geometry", "customer", {
    "g": (lambda: F.round(f("geometry.GeographicDistance", F.lit(-38.0), F.lit(-145.0), C("c_nationkey").cast("double"), F.lit(-151.0)), 3), "round(degrees(acos(greatest(-1, least(1, sin(radians(-38)) * sin(radians(c_nationkey)) + cos(radians(-38)) * cos(radians(c_nationkey)) * cos(radians(6)))))) * 60 * 1853.159616, 3)"),
    "p": (lambda: F.round(f("geometry.GeographicDistancePoints", f("geometry.CreatePoint", F.lit(6.0), F.lit(0.0)), f("geometry.CreatePoint", F.lit(6.0), C("c_nationkey"))), 3), "round(c_nationkey * 60 * 1853.159616::DOUBLE, 3)"),
    "d": (lambda: F.round(f("geometry.Distance", f("geometry.CreatePoint", C("c_custkey"), F.lit(0)), f("geometry.CreatePoint", F.lit(0), C("c_nationkey"))), 6), "round(sqrt(c_custkey * c_custkey + c_nationkey * c_nationkey), 6)"),
    "w": (lambda: f("geometry.IsWithinDistance", f("geometry.CreatePoint", C("c_custkey"), F.lit(0)), f("geometry.CreatePoint", F.lit(0), F.lit(0)), 50), "c_custkey <= 50"), "x": (lambda: f("geometry.ExtractCoordinate", f("geometry.CreatePoint", C("c_custkey"), F.lit(0)))["x"], "c_custkey::DOUBLE"),
}, key="c_custkey")

register("fn_integers", "orders", {
    "g": (lambda: f("integer.GreatestCommonDivisor", C("o_orderkey"), C("o_custkey")), "gcd(o_orderkey, o_custkey)"), "l": (lambda: f("integer.LeastCommonMultiple", C("o_orderkey"), C("o_custkey")), "lcm(o_orderkey, o_custkey)"),
    "e": (lambda: f("integer.ExtendedGreatestCommonDivisor", C("o_orderkey"), C("o_custkey"))["x"] * C("o_orderkey") + f("integer.ExtendedGreatestCommonDivisor", C("o_orderkey"), C("o_custkey"))["y"] * C("o_custkey"), "gcd(o_orderkey, o_custkey)"),
}, where="o_orderkey > 0 AND o_custkey > 0", key="o_orderkey")

register("fn_special", "part", {
    "gl": (lambda: F.round(f("special.GammaLn", C("p_size") / 3.0), 8), "round(lgamma(p_size / 3.0::DOUBLE), 8)"), "gm": (lambda: F.round(f("special.Gamma", C("p_size") / 10.0), 6), "round(gamma(p_size / 10.0::DOUBLE), 6)"),
    "fa": (lambda: f("special.Factorial", C("p_size") % 15).cast("long"), "factorial(p_size % 15)::BIGINT"), "lo": (lambda: F.round(f("special.Logistic", C("p_size") / 10), 8), "round(1 / (1 + exp(-(p_size / 10.0::DOUBLE))), 8)"),
    "lg": (lambda: F.round(f("special.Logit", C("p_size") / 100), 8), "round(ln((p_size / 100.0::DOUBLE) / (1 - p_size / 100.0::DOUBLE)), 8)"), "hy": (lambda: F.round(f("special.Hypotenuse", C("p_size"), F.lit(3)), 8), "round(sqrt(p_size * p_size + 9.0::DOUBLE), 8)"),
    "em": (lambda: F.round(f("special.ExponentialMinusOne", C("p_size") / 10), 6), "round(exp(p_size / 10.0::DOUBLE) - 1, 6)"), "pi": (lambda: F.round(f("special.MathConstant", "Pi"), 10), "round(pi(), 10)"),
    "ha": (lambda: F.round(f("special.Harmonic", C("p_size")), 8), "round(list_sum(list_transform(range(1, p_size + 1), lambda i: 1.0::DOUBLE / i)), 8)"), "gh": (lambda: F.round(f("special.GeneralHarmonic", C("p_size"), 2), 8), "round(list_sum(list_transform(range(1, p_size + 1), lambda i: 1.0::DOUBLE / (i * i))), 8)"),
    "bi": (lambda: f("special.Binomial", C("p_size"), F.lit(2)).cast("long"), "(p_size * (p_size - 1) // 2)::BIGINT"), "bt": (lambda: F.round(f("special.Beta", C("p_size"), F.lit(2)), 8), "round(1.0::DOUBLE / (p_size * (p_size + 1)), 8)"),
}, where="p_size > 0", key="p_partkey")

_X = "p_size / 10.0"
register("fn_distributions", "part", {
    "ex": (lambda: F.round(f("distribution.ExponentialDistribution", "cdf", F.lit(0.5), C("p_size") / 10), 8), f"round(1 - exp(-0.5 * ({_X})::DOUBLE), 8)"), "ed": (lambda: F.round(f("distribution.ExponentialDistribution", "density", F.lit(0.5), C("p_size") / 10), 8), f"round(0.5 * exp(-0.5 * ({_X})::DOUBLE), 8)"),
    "nd": (lambda: F.round(f("distribution.NormalDistribution", "density", F.lit(2.0), F.lit(1.5), C("p_size") / 10), 8), f"round(exp(-pow((({_X})::DOUBLE - 2) / 1.5, 2) / 2) / (1.5 * sqrt(2 * pi())), 8)"), "ca": (lambda: F.round(f("distribution.CauchyDistribution", "cdf", F.lit(1.0), F.lit(2.0), C("p_size") / 10), 8), f"round(0.5 + atan((({_X})::DOUBLE - 1) / 2) / pi(), 8)"),
    "un": (lambda: F.round(f("distribution.ContinuousUniformDistribution", "cdf", F.lit(1.0), F.lit(3.0), C("p_size") / 10), 8), f"round(least(1, greatest(0, (({_X})::DOUBLE - 1) / 2)), 8)"), "we": (lambda: F.round(f("distribution.WeibullDistribution", "cdf", F.lit(2.0), F.lit(3.0), C("p_size") / 10), 8), f"round(1 - exp(-pow(({_X})::DOUBLE / 3, 2)), 8)"),
    "ra": (lambda: F.round(f("distribution.RayleighDistribution", "cdf", F.lit(2.0), C("p_size") / 10), 8), f"round(1 - exp(-pow(({_X})::DOUBLE, 2) / 8), 8)"), "la": (lambda: F.round(f("distribution.LaplaceDistribution", "density", F.lit(1.0), F.lit(2.0), C("p_size") / 10), 8), f"round(exp(-abs(({_X})::DOUBLE - 1) / 2) / 4, 8)"),
    "ge": (lambda: F.round(f("distribution.GeometricDistribution", "cdf", F.lit(0.3), C("p_size")), 8), "round(1 - pow(0.7::DOUBLE, p_size), 8)"), "er": (lambda: F.round(f("distribution.ErlangDistribution", "cdf", F.lit(2), F.lit(1.0), C("p_size") / 10), 8), f"round(1 - exp(-({_X})::DOUBLE) * (1 + ({_X})::DOUBLE), 8)"),
    "po": (lambda: F.round(f("distribution.PoissonDistribution", "probability", F.lit(2.0), C("p_size") % 10), 8), "round(exp(-2.0::DOUBLE) * pow(2.0::DOUBLE, p_size % 10) / factorial(p_size % 10), 8)"),
}, key="p_partkey")

_N = "(l_linenumber * 12)"
register("fn_financial", "lineitem", {
    "fv": (lambda: F.round(f("financial.Fv", F.lit(0.01), C("l_linenumber") * 12, -C("l_quantity"), F.lit(0.0)), 4), f"round(l_quantity * (pow(1.01::DOUBLE, {_N}) - 1) / 0.01, 4)"), "pv": (lambda: F.round(f("financial.Pv", F.lit(0.01), C("l_linenumber") * 12, -C("l_quantity"), F.lit(0.0)), 4), f"round(l_quantity * (1 - pow(1.01::DOUBLE, -{_N})) / 0.01, 4)"),
    "pm": (lambda: F.round(f("financial.Pmt", F.lit(0.01), C("l_linenumber") * 12, C("l_extendedprice")), 4), f"round(-l_extendedprice * 0.01 / (1 - pow(1.01::DOUBLE, -{_N})), 4)"), "np": (lambda: F.round(f("financial.NPer", F.lit(0.01), F.lit(-100.0), C("l_quantity") * 10), 6), "round(-ln(1 - l_quantity * 10 * 0.01 / 100.0::DOUBLE) / ln(1.01::DOUBLE), 6)"),
    "i1": (lambda: F.round(f("financial.IPmt", F.lit(0.01), F.lit(1), C("l_linenumber") * 12, C("l_extendedprice")), 4), "round(-l_extendedprice * 0.01, 4)"), "ip": (lambda: F.round(f("financial.ISPmt", F.lit(0.01), F.lit(1), F.lit(7), C("l_extendedprice")), 5), "round(-l_extendedprice * 0.01 * (1 - 1 / 7.0::DOUBLE), 5)"),
    "sl": (lambda: F.round(f("financial.Sln", C("l_extendedprice"), F.lit(100.0), F.lit(10)), 4), "round((l_extendedprice - 100) / 10, 4)"), "sy": (lambda: F.round(f("financial.Syd", C("l_extendedprice"), F.lit(100.0), F.lit(10), C("l_linenumber")), 4), "round((l_extendedprice - 100) * (10 - l_linenumber + 1) * 2 / 110.0::DOUBLE, 4)"),
    "ef": (lambda: F.round(f("financial.Effect", C("l_tax"), F.lit(12)), 8), "round(pow(1 + l_tax / 12, 12) - 1, 8)"), "no": (lambda: F.round(f("financial.Nominal", C("l_tax"), F.lit(12)), 8), "round(12 * (pow(1 + l_tax, 1 / 12.0::DOUBLE) - 1), 8)"),
    "rr": (lambda: F.round(f("financial.RRI", F.lit(8), F.lit(100.0), C("l_quantity") + 100), 8), "round(pow((l_quantity + 100) / 100.0::DOUBLE, 1 / 8.0::DOUBLE) - 1, 8)"), "tp": (lambda: F.round(f("financial.TBillPrice", F.lit("2020-01-01").cast("date"), F.lit("2020-06-01").cast("date"), C("l_tax")), 6), "round(100 * (1 - l_tax * 152 / 360), 6)"),
    "dp": (lambda: F.round(f("financial.PriceDisc", F.lit("2020-01-01").cast("date"), F.lit("2020-06-01").cast("date"), C("l_tax"), F.lit(100.0), basis=2), 6), "round(100 - l_tax * 100 * 152 / 360, 6)"), "dd": (lambda: F.round(f("financial.DollarDe", F.lit(1.02), F.lit(16)), 6), "1.125"),
}, key="l_orderkey")
