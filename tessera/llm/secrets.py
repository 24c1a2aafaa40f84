"""Secret scans in SQL functions only, with a battery of randomness tests.

Base kinds are matched by pattern: `assign`, `access` and `hex`. Positions are in code points: a pattern's matches and the
pieces between them (extract and split by the same pattern) give lengths, and their running sums give starts.

The battery adds spans of kind `random`. A candidate is a run of 20 or more characters of the base64 alphabets. Its encoding is inferred
from its characters (hex, base32, digits and letters of one case, else base64; runs of letters of one case alone, or of digits alone, have none). Against "uniform
over that alphabet" it is tested by chi-squared over character counts, by the number of runs above and below the alphabet's
middle, and by lag-one serial correlation; the smallest p-value, times three, is the combined one, and under `REJECT` it ends the matter. Against "ordinary
text in that alphabet" the chi-squared statistic has a noncentrality that grows with the length, so its lower tail is a p-value
that takes length into account; within each document Benjamini-Hochberg, weighted by length, holds the false-discovery rate of these at
`FDR`. Candidates that touch a base span add nothing.

Defined results: null and empty texts have no spans and the digest of the empty text, and redact leaves them as they are. Every row, repeated ones and
those with a null id as well, gets a row; an empty table gives an empty one. Other columns are handed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
FDR, REJECT = 0.01, 0.001
AS = "__found"
#: Alphabet in order, its size, excess of the chi-squared statistic per character for ordinary text, and the size of the alphabet that this is stated over.
ENCODINGS = {
    "hex": ("0123456789abcdef", 16, 1.2, 16),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32, 1.1, 32),
    # text of one case is told apart as over base64, where the test is stronger for short runs
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", 36, 2.9, 64),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64, 2.9, 64),
}


def let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def prefix(values: Column, zero: Column, op) -> Column:
    """op (of sums, greatest, least) over all earlier elements, `zero` at the first; in blocks, so that long arrays take little more than linear time.

    `values` is a variable. (Blocks of blocks would be deeper than the analyzer goes.)
    """
    step = 64
    block = lambda k: F.floor(k / step).cast("int")

    def fold(a):
        return F.aggregate(a, zero, op)

    def inner(blocks):
        before = F.transform(blocks, lambda _, k: fold(F.slice(blocks, F.lit(1), k)))
        return let(before, lambda x: F.transform(values, lambda _, k: op(x[block(k)], fold(F.slice(values, block(k) * step + 1, k % step)))))

    blocks = F.transform(F.sequence(F.lit(0), block(F.size(values) - 1)), lambda b: fold(F.slice(values, b * step + 1, step)))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(blocks, inner))


def running(sizes: Column) -> Column:
    """Sums of all earlier elements."""
    return let(sizes, lambda x: prefix(x, F.lit(0), lambda a, v: a + v))


def found(text: Column, pattern: str, order: int, keep=None) -> Column:
    """Spans (s, k, e, hit) of a pattern's matches that keep() accepts."""
    none = F.array().cast("array<struct<s:int,k:int,e:int,hit:string>>")

    def spans(x):
        sizes = F.zip_with(x["hits"], F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), lambda h, g: F.length(h) + F.length(g))
        starts = F.zip_with(running(sizes), F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), lambda r, g: r + F.length(g))
        both = F.zip_with(
            starts,
            x["hits"],
            lambda s, h: F.struct(s.alias("s"), F.lit(order).alias("k"), (s + F.length(h)).alias("e"), h.alias("hit")),
        )
        return F.filter(both, lambda m: keep(m["hit"])) if keep else both

    pair = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), let(pair, spans)).otherwise(none)


def phi(z: Column) -> Column:
    """Normal distribution function, to about 1e-4."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def encoding(hit: Column) -> Column:
    body = F.regexp_replace(hit, "[-_]", "")
    return (
        F.when(body.rlike("^([a-z]+|[A-Z]+|[0-9]+|[A-Z]?[a-z]+)$"), F.lit(None).cast("string"))
        .when(hit.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(hit.rlike("^[A-Z2-7]+$"), "base32")
        .when(hit.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "base36")
        .otherwise("base64")
    )


def battery(hit: Column) -> Column:
    """Struct of p_random (combined p-value against randomness) and p_text (against ordinary text); null without an encoding."""

    def chosen(name):
        def pick(values):
            out = F.when(name == "hex", F.lit(values["hex"]))
            for k, v in values.items():
                out = out.when(name == k, F.lit(v))
            return out

        column = lambda i, kind: pick({k: kind(v[i]) for k, v in ENCODINGS.items()})
        letters, size, excess, over = column(0, str), column(1, float), column(2, float), column(3, float)
        plain = F.when(name.isin("hex", "base36"), F.lower(hit)).otherwise(F.translate(hit, "-_", "+/"))
        idx = F.filter(F.transform(F.split(plain, ""), lambda c: F.when(c == "", -1).otherwise(F.instr(letters, c) - 1)), lambda v: v >= 0)
        known = F.struct(F.transform(idx, lambda v: v.cast("double")).alias("idx"), size.alias("size"), excess.alias("excess"), over.alias("over"))
        return F.when(name.isNotNull(), let(known, tests))

    def tests(k):
        idx, size, over = k["idx"], k["size"], k["over"]
        n = F.size(idx).cast("double")
        zero = F.lit(0.0)
        # squares of the characters' counts, summed over sorted characters: a count that grows by one adds twice the old one and one
        start = F.struct(F.lit(-1.0).alias("last"), zero.alias("run"), zero.alias("sum"))
        step = lambda a, v: F.struct(v.alias("last"), F.when(v == a["last"], a["run"] + 1).otherwise(1.0).alias("run"), (a["sum"] + F.when(v == a["last"], 2 * a["run"] + 1).otherwise(1.0)).alias("sum"))
        squares = F.aggregate(F.array_sort(idx), start, step, lambda a: a["sum"])
        total = lambda a: F.aggregate(a, zero, lambda x, v: x + v)
        pairs = lambda f: F.zip_with(F.slice(idx, F.lit(1), F.size(idx) - 1), F.slice(idx, F.lit(2), F.size(idx) - 1), f)
        n1 = total(F.transform(idx, lambda v: (v >= size / 2).cast("double")))
        turns = total(pairs(lambda a, b: ((a >= size / 2) != (b >= size / 2)).cast("double"))) + 1
        sums = F.struct((squares * size / n - n).alias("x"), n1.alias("n1"), turns.alias("turns"), (total(idx) / n).alias("m"))

        def judged(y):
            x, n1, m = y["x"], y["n1"], y["m"]
            n0 = n - n1
            mean = 1 + 2 * n0 * n1 / n
            spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
            runs = F.when((n0 == 0) | (n1 == 0), F.lit(8.0)).otherwise(F.abs((y["turns"] - mean) / spread))
            var = F.aggregate(idx, zero, lambda a, v: a + (v - m) * (v - m))
            cov = total(pairs(lambda a, b: (a - m) * (b - m)))
            serial = F.abs(cov / F.greatest(var, F.lit(1e-9))) * F.sqrt(n)
            df = size - 1.0
            chi = (x - df) / F.sqrt(2 * df)
            p = [1 - phi(chi), 2 * (1 - phi(runs)), 2 * (1 - phi(serial))]
            away = n * k["excess"]
            text = phi(((x + n) * (over / size) - n - (over - 1.0) - away) / F.sqrt(2 * (over - 1.0 + 2 * away)))
            return F.struct(F.least(F.least(*p) * 3, F.lit(1.0)).alias("p_random"), text.alias("p_text"))

        return let(sums, judged)

    return let(encoding(hit), chosen)


def random_spans(text: Column) -> Column:
    """Candidates that pass the battery, after false-discovery control within the document."""
    tested = let(
        found(text, TOKEN, 3, lambda h: encoding(h).isNotNull()),
        lambda cs: F.filter(
            F.transform(cs, lambda c: F.struct(c.alias("c"), battery(c["hit"]).alias("p"))), lambda x: x["p"].isNotNull()
        ),
    )

    def control(xs):
        m = F.size(xs)
        total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.length(x["c"]["hit"]))
        weighted = F.transform(
            xs, lambda x: F.struct((x["p"]["p_text"] * total / (m * F.length(x["c"]["hit"]))).alias("q"), x["p"]["p_random"].alias("r"), x["c"].alias("c"))
        )

        def cutoff(ws):
            ranked = F.array_sort(F.transform(ws, lambda w: w["q"]))
            last = F.coalesce(F.array_max(F.transform(ranked, lambda q, k: F.when(q <= (k + 1) * FDR / m, q))), F.lit(-1.0))
            return let(last, lambda t: F.transform(F.filter(ws, lambda w: (w["q"] <= t) & (w["r"] >= REJECT)), lambda w: w["c"]))

        return let(weighted, cutoff)

    return let(tested, control)


def apart(spans: Column) -> Column:
    """Sorted spans without the random ones that touch a base span: one that starts before and ends after their start, or starts before their end."""
    random = len(KINDS) - 1
    far = F.lit(2**31 - 1)
    ends = F.transform(spans, lambda m: F.when(m["k"] == random, -1).otherwise(m["e"]))
    starts = F.transform(F.reverse(spans), lambda m: F.when(m["k"] == random, far).otherwise(m["s"]))
    before = let(ends, lambda x: prefix(x, F.lit(-1), lambda a, v: F.greatest(a, v)))
    after = F.reverse(let(starts, lambda x: prefix(x, far, lambda a, v: F.least(a, v))))
    both = F.struct(before.alias("before"), after.alias("after"))
    return let(both, lambda x: F.filter(spans, lambda m, i: (m["k"] != random) | (x["before"][i] <= m["s"]) & (x["after"][i] >= m["e"])))


def scan(docs: DataFrame, *keep: str, text: str = "text", name: str = AS) -> DataFrame:
    """The kept columns and a struct `name` of base and spans: arrays of (s, k, e, hit), k an index of KINDS, by start, then kind. No shuffle."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(
        found(t, ASSIGN, 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 12), found(t, ACCESS, 1), found(t, HEX, 2)
    )

    def all_spans(x):
        return F.struct(x["base"].alias("base"), F.when(F.size(x["more"]) == 0, x["base"]).otherwise(let(F.array_sort(F.concat(x["base"], x["more"])), apart)).alias("spans"))

    both = let(F.struct(F.array_sort(base).alias("base"), random_spans(t).alias("more")), all_spans)
    return docs.select(*[F.col(f"`{c}`") for c in keep], both.alias(name))


def listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", kind[m["k"]], m["s"], m["e"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda m: m["k"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with every span of the text replaced by a mark; n_chars, where present, is the new text's length where there was one."""
    at, new = free(docs, "found", "clean")
    spans = F.col(f"{at}.spans")
    text = F.col("text").cast("string")

    def cleaned(spans):
        # gaps between spans: from the furthest end so far to the next start
        ends = let(F.transform(spans, lambda m: m["e"]), lambda x: prefix(x, F.lit(0), lambda a, v: F.greatest(a, v)))
        gaps = F.zip_with(ends, spans, lambda a, m: F.when(m["s"] >= a, F.concat(text.substr(a + 1, m["s"] - a), F.lit(mark))).otherwise(""))
        end = F.array_max(F.transform(spans, lambda m: m["e"]))
        return F.concat(F.array_join(gaps, ""), text.substr(end + 1, F.length(text)))

    rows = scan(docs, *docs.columns, name=at).withColumn(new, F.when(F.size(spans) == 0, text).otherwise(cleaned(spans)))

    def column(c):
        if c == "text":
            return F.col(new)
        return F.when(F.size(spans) == 0, F.col(f"`{c}`")).otherwise(F.length(new)).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"`{c}`")

    return rows.select(*[column(c).alias(c) for c in docs.columns])
