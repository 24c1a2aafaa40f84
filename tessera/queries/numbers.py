"""Queries of financial functions, special functions and distributions, with the formulas that state their results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import call as f
from tessera.functions import get
from tessera.functions.special import weibull_fits

from .scalars import register

C = F.col


def _columns(args):
    """Columns of arguments given as text of Spark SQL, or as numbers."""
    return [F.expr(a) if isinstance(a, str) else F.lit(a) for a in args]


def _series(n, term):
    """SQL: the sum of a term in k = 0, 1, ... n - 1."""
    return f"list_sum(list_transform(range(0, {n}), lambda k: {term}))"


# --- financial ------------------------------------------------------------------------------------------------------

_R, _L = "(p_size / 1000.0::DOUBLE)", "(p_size % 7 + 1)"
_PM = f"(p_retailprice * 0.01 / (1 - pow(1.01::DOUBLE, -12 * {_L})))"
_LEFT = f"(p_retailprice * pow(1.01::DOUBLE, 12) - {_PM} * (pow(1.01::DOUBLE, 12) - 1) / 0.01)"
_r, _l = "(p_size / 1000.0D)", "(p_size % 7 + 1)"
_S, _M = "DATE'2020-01-01'", "DATE'2020-06-01'"


def _financial(name, sql, *args, digits=6, **options):
    return (lambda: F.round(f(f"financial.{name}", *_columns(args), **options), digits), f"round({sql}, {digits})")


def _call(name, *args):
    """A function of columns, for arguments of others."""
    return f(name, *[a if isinstance(a, Column) else _columns([a])[0] for a in args])


register("fn_loans", "part", {
    "ci": _financial("CumIPmt", f"-(12 * {_PM} - (p_retailprice - {_LEFT}))", 0.01, f"{_l} * 12", "p_retailprice", 1, 12, digits=4),
    "cp": _financial("CumPrinc", f"-(p_retailprice - {_LEFT})", 0.01, f"{_l} * 12", "p_retailprice", 1, 12, digits=4),
    "pp": _financial("PPmt", f"-({_PM} - p_retailprice * 0.01)", 0.01, 1, f"{_l} * 12", "p_retailprice", digits=4),
    "ra": (lambda: F.round(_call("financial.Rate", f"{_l} * 12", _call("financial.Pmt", _r, f"{_l} * 12", "p_retailprice"), "p_retailprice"), 6), f"round({_R}, 6)"),
    "db": _financial("Db", f"10000 * pow(0.681::DOUBLE, least({_L}, 6) - 1) * 0.319", 10000.0, 1000.0, 6.0, f"least({_l}, 6)", digits=4),
    "dd": _financial("Ddb", f"2400 * pow(0.8::DOUBLE, {_L} - 1) * 0.2", 2400.0, 300.0, 10.0, _l, digits=4),
    "vd": _financial("Vdb", f"2400 - 2400 * pow(0.8::DOUBLE, {_L})", 2400.0, 300.0, 10.0, 0.0, _l, digits=4),
    "al": _financial("AmorLinc", "p_retailprice * 0.1", "p_retailprice", "DATE'2020-01-01'", "DATE'2020-12-31'", 0.0, 1, 0.1, digits=4),
    "ad": _financial("AmorDegrc", "round_even((p_retailprice - round_even(p_retailprice * 0.375, 0)) * 0.375, 0)", "p_retailprice", "DATE'2020-01-01'", "DATE'2021-01-01'", 0.0, 1, 0.15, digits=2),
    "df": _financial("DollarFr", f"{_L} + 0.02", f"{_l} + 0.125D", 16),
}, key="p_partkey")

_FLOWS = f"list_sum(list_transform(range(1, {_L} + 1), lambda k: k * 5 / pow(1.04::DOUBLE, k))) + {_L} * 100 / pow(1.04::DOUBLE, {_L})"
_WORTH = f"list_sum(list_transform(range(1, {_L} + 1), lambda k: 5 / pow(1.04::DOUBLE, k))) + 100 / pow(1.04::DOUBLE, {_L})"
_due = f"make_date({_l} + 2020, 1, 10)"
_mid = "DATE'2020-03-15'"
_bond = ("DATE'2020-02-15'", "DATE'2020-04-13'", "DATE'2019-11-10'")

register("fn_bonds", "part", {
    "ai": _financial("AccrInt", f"1000 * {_R} * 65 / 360", "DATE'2020-01-10'", "DATE'2021-01-10'", _mid, _r, 1000.0),
    "am": _financial("AccrIntM", f"1000 * {_R} * 65 / 360", "DATE'2020-01-10'", _mid, _r, 1000.0),
    "bs": (lambda: _call("financial.CoupDaysBS", _mid, _due, 2), "65.0::DOUBLE"),
    "cd": (lambda: _call("financial.CoupDays", _mid, _due, 2), "180.0::DOUBLE"), "nc": (lambda: _call("financial.CoupDaysNC", _mid, _due, 2), "115.0::DOUBLE"),
    "nd": (lambda: _call("financial.CoupNCD", _mid, _due, 2), "DATE '2020-07-10'"), "pd": (lambda: _call("financial.CoupPCD", _mid, _due, 2), "DATE '2020-01-10'"),
    "cn": (lambda: _call("financial.CoupNum", _mid, _due, 2), f"(2 * {_L})::DOUBLE"),
    "di": _financial("Disc", "(100 - 98) / 100.0::DOUBLE * 360 / 152", _S, _M, 98.0, 100.0, basis=2),
    "ir": _financial("IntRate", f"{_R} * 360 / 152", _S, _M, "p_retailprice", f"p_retailprice * (1 + {_r})", basis=2),
    "rc": _financial("Received", f"p_retailprice / (1 - {_R} * 152 / 360)", _S, _M, "p_retailprice", _r, basis=2, digits=4),
    "du": _financial("Duration", f"({_FLOWS}) / ({_WORTH})", "DATE'2020-01-10'", _due, 0.05, 0.04),
    "md": _financial("MDuration", f"({_FLOWS}) / ({_WORTH}) / 1.04", "DATE'2020-01-10'", _due, 0.05, 0.04),
    "mp": _financial("PriceMat", f"(100 + 153 / 360.0::DOUBLE * {_R} * 100) / (1 + 58 / 360.0::DOUBLE * 0.05) - 95 / 360.0::DOUBLE * {_R} * 100", *_bond, _r, 0.05),
    "my": (lambda: F.round(_call("financial.YieldMat", *_bond, _r, _call("financial.PriceMat", *_bond, _r, 0.05)), 6), "0.05::DOUBLE"),
    "yd": _financial("YieldDisc", "2 / 98.0::DOUBLE * 360 / 152", _S, _M, 98.0, 100.0, basis=2),
    "te": _financial("TBillEq", f"365 * {_R} / (360 - {_R} * 152)", _S, _M, _r), "ty": _financial("TBillYield", "(100 - 98.5) / 98.5::DOUBLE * 360 / 152", _S, _M, 98.5),
    "yl": (lambda: F.round(_call("financial.Yield", _mid, _due, 0.05, _call("financial.Price", _mid, _due, 0.05, _r, 100.0), 100.0), 6), f"round({_R}, 6)"),
    "of": (lambda: F.round(_call("financial.OddFYield", _mid, _due, "DATE'2019-12-20'", "DATE'2021-01-10'", 0.05, _call("financial.OddFPrice", _mid, _due, "DATE'2019-12-20'", "DATE'2021-01-10'", 0.05, _r, 100.0), 100.0), 6), f"round({_R}, 6)"),
    "op": _financial("OddLPrice", f"(100 + 5 * 100 / 360.0::DOUBLE) / (1 + 35 / 360.0::DOUBLE * {_R}) - 5 * 65 / 360.0::DOUBLE", _mid, "DATE'2020-04-20'", "DATE'2020-01-10'", 0.05, _r, 100.0),
    "oy": (lambda: F.round(_call("financial.OddLYield", _mid, "DATE'2020-04-20'", "DATE'2020-01-10'", 0.05, _call("financial.OddLPrice", _mid, "DATE'2020-04-20'", "DATE'2020-01-10'", 0.05, _r, 100.0), 100.0), 6), f"round({_R}, 6)"),
}, key="p_partkey")


_FLOW_SQL = "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN -100.0::DOUBLE ELSE 30.0 + n_nationkey END AS v, 37 * n_nationkey AS day FROM nation"


def _flow(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    i = F.row_number().over(w) - 1
    n = table(spark, d, "nation").withColumn("i", i).withColumn("v", F.when(C("i") == 0, -100.0).otherwise(30.0 + C("n_nationkey")))
    return n.withColumn("day", F.date_add(F.expr("DATE'2020-01-01'"), (37 * C("n_nationkey")).cast("int")))


@query("fn_cash_flows", f"""WITH x AS ({_FLOW_SQL}), n AS (SELECT n_regionkey, max(i) AS last, min(day) AS first FROM x GROUP BY 1)
 SELECT x.n_regionkey, round(pow(-sum(greatest(v, 0) * pow(1.06::DOUBLE, last - i)) / sum(least(v, 0) / pow(1.04::DOUBLE, i)), 1.0::DOUBLE / max(last)) - 1, 8) AS mirr,
 round(sum(v / pow(1.05::DOUBLE, (day - first) / 365.0::DOUBLE)), 6) AS xnpv FROM x JOIN n USING (n_regionkey) GROUP BY 1""")
def fn_cash_flows(spark, d):
    return _flow(spark, d).groupBy("n_regionkey").agg(
        F.round(f("financial.Mirr", C("v"), C("n_nationkey"), 0.04, 0.06), 8).alias("mirr"), F.round(f("financial.XNpv", 0.05, C("v"), C("day")), 6).alias("xnpv")
    )


@query("fn_internal_rates", "SELECT n_regionkey, 0.0::DOUBLE AS irr, 0.0::DOUBLE AS irr_guess, 0.0::DOUBLE AS xirr, 0.0::DOUBLE AS xirr_guess FROM nation GROUP BY 1")
def fn_internal_rates(spark, d):
    """What the flows are worth at each rate of return found: nothing."""
    x = _flow(spark, d)
    rates = x.groupBy("n_regionkey").agg(
        f("financial.Irr", C("v"), C("i")).alias("irr"), f("financial.IrrGuess", C("v"), C("i"), 0.3).alias("irr_guess"), f("financial.XIrr", C("v"), C("day")).alias("xirr"),
        f("financial.XIrrGuess", C("v"), C("day"), 0.3).alias("xirr_guess"), F.min("day").alias("first"),
    )
    both = x.join(rates, "n_regionkey")
    worth = lambda r, t: F.abs(F.round(F.sum(C("v") / F.pow(1 + C(r), t)), 4)).alias(r)
    years = F.datediff("day", "first") / 365.0
    return both.groupBy("n_regionkey").agg(worth("irr", C("i")), worth("irr_guess", C("i")), worth("xirr", years), worth("xirr_guess", years))


@query("fn_schedule", "SELECT n_regionkey, round(100 * product(1 + n_nationkey / 100.0::DOUBLE), 6) AS worth FROM nation GROUP BY 1")
def fn_schedule(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.round(f("financial.FvSchedule", 100, C("n_nationkey") / 100), 6).alias("worth"))


# --- special functions ----------------------------------------------------------------------------------------------

_X, _Y, _Z = "(p_size / 10.0::DOUBLE)", "(p_size / 20.0::DOUBLE)", "(p_size / 60.0::DOUBLE)"
_x, _y, _z = "(p_size / 10.0D)", "(p_size / 20.0D)", "(p_size / 60.0D)"
_ERF = f"2 / sqrt(pi()) * {_series(60, f'pow(-1.0::DOUBLE, k) * pow({_Y}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))')}"
_BETA = f"list_sum(list_transform(range(3, 7), lambda k: 720 / (gamma(k + 1) * gamma(7 - k)) * pow({_Z}, k) * pow(1 - {_Z}, 6 - k)))"
_GAMMA = f"(1 - exp(-{_X}) * (1 + {_X} + {_X} * {_X} / 2))"
_I0 = _series(40, f"pow({_X} / 2, 2 * k) / (gamma(k + 1) * gamma(k + 1))")
_I1 = _series(40, f"pow({_X} / 2, 2 * k + 1) / (gamma(k + 1) * gamma(k + 2))")
_L0 = _series(40, f"pow({_X} / 2, 2 * k + 1) / (gamma(k + 1.5) * gamma(k + 1.5))")
_L1 = _series(40, f"pow({_X} / 2, 2 * k + 2) / (gamma(k + 1.5) * gamma(k + 2.5))")
_K0 = f"0.02 * (0.5 * exp(-{_X}) + list_sum(list_transform(range(1, 500), lambda k: exp(-{_X} * cosh(0.02 * k)))))"
_K1 = f"0.02 * (0.5 * exp(-{_X}) + list_sum(list_transform(range(1, 500), lambda k: exp(-{_X} * cosh(0.02 * k)) * cosh(0.02 * k))))"
_DIGAMMA = "(coalesce(list_sum(list_transform(range(1, p_size), lambda k: 1.0::DOUBLE / k)), 0) - 0.5772156649015329)"


def _special(name, sql, *args, digits=7):
    return (lambda: F.round(f(f"special.{name}", *_columns(args)), digits), f"round({sql}, {digits})")


register("fn_error_functions", "part", {
    "er": _special("Erf", _ERF, _y), "ec": _special("Erfc", f"1 - {_ERF}", _y), "ei": (lambda: F.round(_call("special.Erf", _call("special.ErfInv", _z)), 7), f"round({_Z}, 7)"),
    "eci": (lambda: F.round(_call("special.Erfc", _call("special.ErfcInv", "p_size / 30.0D")), 7), "round(p_size / 30.0::DOUBLE, 7)"),
    "e1": _special("ExponentialIntegral", f"-0.5772156649015329 - ln({_Y}) - list_sum(list_transform(range(1, 60), lambda k: pow(-{_Y}, k) / (k * gamma(k + 1))))", _y, 1),
}, key="p_partkey")

register("fn_beta_gamma", "part", {
    "bl": _special("BetaLn", f"lgamma({_X}) + lgamma(2.5) - lgamma({_X} + 2.5)", _x, 2.5), "br": _special("BetaRegularized", _BETA, 3.0, 4.0, _z), "bi": _special("BetaIncomplete", f"({_BETA}) / 60", 3.0, 4.0, _z),
    "fl": _special("FactorialLn", "lgamma(p_size + 1)", "p_size"), "bn": _special("BinomialLn", "lgamma(61) - lgamma(p_size + 1) - lgamma(61 - p_size)", 60, "p_size"),
    "mu": (lambda: f("special.Multinomial", C("p_size") + 3, [C("p_size"), F.lit(1), F.lit(2)]).cast("long"), "(p_size + 3) * (p_size + 2) * (p_size + 1) // 2"),
    "gl": _special("GammaLowerRegularized", _GAMMA, 3.0, _x), "gu": _special("GammaUpperRegularized", f"1 - {_GAMMA}", 3.0, _x), "li": _special("GammaLowerIncomplete", f"2 * {_GAMMA}", 3.0, _x), "ui": _special("GammaUpperIncomplete", f"2 - 2 * {_GAMMA}", 3.0, _x),
    "gi": (lambda: F.round(_call("special.GammaLowerRegularized", 3.0, _call("special.GammaLowerRegularizedInv", 3.0, _z)), 7), f"round({_Z}, 7)"),
    "dg": _special("DiGamma", _DIGAMMA, "p_size"), "di": (lambda: F.round(_call("special.DiGamma", _call("special.DiGammaInv", f"{_x} - 2")), 6), f"round({_X} - 2, 6)"),
}, key="p_partkey")

register("fn_bessel", "part", {
    "i0": _special("BesselI0", _I0, _x, digits=6), "i1": _special("BesselI1", _I1, _x, digits=6), "k0": _special("BesselK0", _K0, _x, digits=6), "k1": _special("BesselK1", _K1, _x, digits=6),
    "k0e": _special("BesselK0e", f"exp({_X}) * {_K0}", _x, digits=6), "k1e": _special("BesselK1e", f"exp({_X}) * {_K1}", _x, digits=6), "l0": _special("StruveL0", _L0, _x, digits=6), "l1": _special("StruveL1", _L1, _x, digits=6),
    "d0": _special("BesselI0MStruveL0", f"{_I0} - {_L0}", _x, digits=6), "d1": _special("BesselI1MStruveL1", f"{_I1} - {_L1}", _x, digits=6),
}, key="p_partkey")

# --- distributions --------------------------------------------------------------------------------------------------


def _choose(n, k):
    return f"gamma({n} + 1) / (gamma({k} + 1) * gamma({n} - ({k}) + 1))"


def _law(name, kind, sql, *args, digits=7):
    return (lambda: F.round(f(f"distribution.{name}Distribution", kind, *_columns([float(a) if isinstance(a, int) else a for a in args])), digits), f"round({sql}, {digits})")


_T = f"(({_X} - 1) / 2)"
_U = f"(2 / {_X})"
register("fn_continuous", "part", {
    "ln": _law("LogNormal", "density", f"exp(-pow((ln({_X}) - 0.5) / 0.8, 2) / 2) / ({_X} * 0.8 * sqrt(2 * pi()))", 0.5, 0.8, _x), "be": _law("Beta", "cdf", _BETA, 3, 4, _z), "bd": _law("Beta", "density", f"60 * pow({_Z}, 2) * pow(1 - {_Z}, 3)", 3, 4, _z, digits=9),
    "ch": _law("Chi", "density", f"pow(2.0::DOUBLE, -0.5) * pow({_X}, 2) * exp(-{_X} * {_X} / 2) / gamma(1.5)", 3, _x), "cs": _law("ChiSquared", "cdf", f"1 - exp(-{_X} / 2) * (1 + {_X} / 2)", 4, _x),
    "fs": _law("FisherSnedecor", "density", f"sqrt(pow(4 * {_X}, 4) * pow(6.0::DOUBLE, 6) / pow(4 * {_X} + 6, 10)) / ({_X} * gamma(2) * gamma(3) / gamma(5))", 4, 6, _x), "ga": _law("Gamma", "cdf", f"1 - exp(-2 * {_X}) * (1 + 2 * {_X} + 2 * {_X} * {_X})", 3, 2, _x),
    "ig": _law("InverseGamma", "cdf", f"exp(-{_U}) * (1 + {_U} + {_U} * {_U} / 2)", 3, 2, _x), "pa": _law("Pareto", "cdf", f"CASE WHEN {_X} > 1 THEN 1 - pow(1 / {_X}, 3) ELSE 0 END", 1, 3, _x),
    "st": _law("Stable", "density", f"2 / (pi() * (4 + pow({_X} - 1, 2)))", 1, 0, 2, 1, _x), "t3": _law("StudentT", "cdf", f"0.5 + ({_T} / sqrt(3) / (1 + {_T} * {_T} / 3) + atan({_T} / sqrt(3))) / pi()", 1, 2, 3, _x),
    "tr": _law("Triangular", "cdf", f"CASE WHEN {_X} <= 2 THEN {_X} * {_X} / 12 WHEN {_X} < 6 THEN 1 - pow(6 - {_X}, 2) / 24 ELSE 1 END", 0, 6, 2, _x),
}, key="p_partkey")

_K, _k = "(p_size % 11)", "(p_size % 11)"
register("fn_discrete", "part", {
    "un": _law("DiscreteUniform", "cdf", "least(1, greatest(0, (p_size - 4) / 16.0::DOUBLE))", 5, 20, "p_size"), "be": _law("Bernoulli", "probability", "CASE WHEN p_size % 2 = 1 THEN 0.3 ELSE 0.7 END::DOUBLE", 0.3, "p_size % 2"),
    "bi": _law("Binomial", "probability", f"{_choose(20, _K)} * pow(0.3::DOUBLE, {_K}) * pow(0.7::DOUBLE, 20 - {_K})", 0.3, 20, _k), "nb": _law("NegativeBinomial", "probability", f"{_choose(f'({_K} + 2)', _K)} * pow(0.4::DOUBLE, 3) * pow(0.6::DOUBLE, {_K})", 3, 0.4, _k),
    "hg": _law("HyperGeometric", "probability", f"{_choose(20, _K)} * {_choose(30, f'(10 - {_K})')} / ({_choose(50, 10)})", 50, 20, 10, _k),
    "cm": _law("ConwayMaxwellPoisson", "probability", f"pow(2.0::DOUBLE, {_K}) / pow(gamma({_K} + 1), 2) / {_series(40, 'pow(2.0::DOUBLE, k) / pow(gamma(k + 1), 2)')}", 2, 2, _k),
    "zi": _law("Zipf", "probability", "pow(p_size % 30 + 1, -1.5::DOUBLE) / list_sum(list_transform(range(1, 31), lambda k: pow(k, -1.5::DOUBLE)))", 1.5, 30, "p_size % 30 + 1"),
    "ca": (lambda: F.round(f("distribution.CategoricalDistribution", "probability", F.array(F.lit(2.0), F.lit(3.0), F.lit(5.0)), C("p_size") % 3), 7), "[0.2, 0.3, 0.5][p_size % 3 + 1]::DOUBLE"),
}, key="p_partkey")


@query("fn_fitted_laws", "SELECT l_returnflag, round(avg(ln(l_quantity)), 6) AS mean, round(stddev_pop(ln(l_quantity)), 6) AS stddev, 0.0::DOUBLE AS shape_slope, 0.0::DOUBLE AS scale_gap FROM lineitem GROUP BY 1")
def fn_fitted_laws(spark, d):
    """Estimates; of the Weibull fit, the slope of the likelihood at the shape found, and how far the scale is from the best for that shape: none."""
    li = table(spark, d, "lineitem").select("l_returnflag", C("l_quantity").cast("double").alias("q"))
    by = li.groupBy("l_returnflag")
    weibull = weibull_fits(li, C("q"), "l_returnflag").withColumnRenamed("l_returnflag", "flag")
    fit = weibull.join(by.agg(f("distribution.LogNormalDistributionEstimate", C("q")).alias("n")), C("l_returnflag").eqNullSafe(C("flag"))).select("flag", "n", "w")
    shape, scale = C("w.shape"), C("w.scale")
    power = F.pow(C("q"), shape)
    back = li.join(F.broadcast(fit), C("l_returnflag").eqNullSafe(C("flag"))).groupBy("l_returnflag", "n", "w")
    sums = back.agg(F.sum(power * F.ln("q")).alias("a"), F.sum(power).alias("b"), F.avg(F.ln("q")).alias("c"), F.avg(power).alias("m"))
    return sums.select("l_returnflag", F.round("n.mean", 6).alias("mean"), F.round("n.stddev", 6).alias("stddev"), F.abs(F.round(C("a") / C("b") - 1 / shape - C("c"), 6)).alias("shape_slope"), F.abs(F.round(F.pow("m", 1 / shape) / scale - 1, 6)).alias("scale_gap"))


# --- curves ---------------------------------------------------------------------------------------------------------

_MONTHS = "SELECT m, row_number() OVER (ORDER BY m) - 1 AS i FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS m FROM orders)"


@query("fn_curves", f"SELECT m, round(3 + 2 * i - 0.1 * i * i, 4) AS square, round(5 * exp(0.02 * i), 4) AS grown FROM ({_MONTHS})")
def fn_curves(spark, d):
    """Values on a curve of the kind that is fitted: the fit gives them back."""
    from pyspark.sql import Window

    m = table(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m")).distinct()
    i = F.row_number().over(Window.orderBy("m")) - 1  # months: a few hundred rows
    m = m.withColumn("i", i).select("m", (3 + 2 * C("i") - 0.1 * C("i") * C("i")).alias("square"), (5 * F.exp(0.02 * C("i"))).alias("grown"))
    square = get("curve.PolynomialRegression").build(m, "m", "square").select("m", F.round("fit", 4).alias("square"))
    return square.join(get("curve.ExponentialRegression").build(m, "m", "grown").select("m", F.round("fit", 4).alias("grown")), "m")
