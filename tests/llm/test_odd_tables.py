"""All ten operators and all stages over odd tables: clashing column names and types, empty tables, nulls everywhere, repeated rows, very long texts."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, ctw, decontam, licenses, pieces, quality, render, secrets, simhash, toxicity
from tessera.llm.queries import MODEL

r = random.Random(12)
WORDS = [f"{a}{b}" for a in ("red", "green", "blue", "vile", "scum") for b in range(40)]
#: Names that the operators use themselves.
CLASHES = "__id __y __t __found __row __one row node root key n unit slot i y t found clean spans fp h id u v word times known base score codes rows kind cell share label quality toxic items benchmark drop_id one_id best".split()


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(k, " ".join(r.choice(WORDS) for _ in range(r.choice([3, 40, 120]))), "en", "s", 1) for k in range(60)]
    rows += [(7, rows[7][1], "en", "s", 1), (7, rows[7][1], "en", "s", 1), (61, None, None, None, None), (62, "", "en", "s", 0), (63, "token = abcdefghijklmnop1", "de", "s", 0)]
    rows += [(None, rows[3][1], "en", "s", 1), (None, None, None, None, None), (64, " ".join(r.choice(WORDS) for _ in range(60_000)), "en", "s", 0), (65, "x" * 300_000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(60)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, rows[9][1]), (2, None), (None, "red1 red2"), (1, rows[9][1])], "item_id long, text string")
    return docs, labels, bench


def odd(df):
    taken = {c.lower() for c in df.columns}
    more = {c: F.lit("clash") for c in CLASHES if c.lower() not in taken}
    return df.withColumns(more | {"a map": F.create_map(F.lit("k"), F.lit("v")), "a.dot": F.lit(1)})


@pytest.fixture(scope="module")
def operators(tables):
    """name: function from documents to a frame, and whether it hands other columns through."""
    docs, labels, bench = tables
    net, gam, model = toxicity.fit(docs, labels), quality.fit(docs, labels), pieces.load(MODEL)
    return {
        "1": (lambda d: ctw.score(d, ~ctw.held_out(), depth=2), False),
        "2": (lambda d: quality.score(d, gam), False),
        "2 fit": (lambda d: quality.score(d, quality.fit(d, labels)), False),
        "2 keep": (lambda d: quality.keep_good(d, gam), True),
        "3": (lambda d: decontam.search(d, bench, 5), False),
        "3 parts": (lambda d: decontam.search(d, bench, 5, 500), False),
        "3 drop": (lambda d: decontam.decontaminate(d, bench, 5), True),
        "5": (lambda d: toxicity.score(d, net), False),
        "5 fit": (lambda d: toxicity.score(d, toxicity.fit(d, labels)), False),
        "6": (lambda d: secrets.scan(d, "doc_id"), False),
        "6 redact": (secrets.redact, True),
        "8": (licenses.scan, False),
        "9": (simhash.near_duplicates, False),
        "9 keep": (simhash.keep_one, True),
        "10": (lambda d: pieces.encode(d, model), False),
    }


def rows(df, columns=None):
    df = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    floats = [c for c, t in df.dtypes if t == "double"]
    return sorted(map(str, df.withColumns({c: F.round(c, 9) for c in floats}).collect()))


@pytest.mark.parametrize("name", ["1", "2", "2 fit", "2 keep", "3", "3 parts", "3 drop", "5", "5 fit", "6", "6 redact", "8", "9", "9 keep", "10"])
def test_documents(tables, operators, name):
    docs = tables[0]
    f, through = operators[name]
    plain, clashing = f(docs), f(odd(docs))
    want = rows(plain)
    assert rows(clashing, plain.columns if through else None) == want
    if through:
        assert clashing.dtypes == odd(docs).dtypes
        extra = clashing.filter("`a map`['k'] <> 'v' OR `a.dot` <> 1 OR __t <> 'clash' OR __found <> 'clash'")
        assert extra.count() == 0 and plain.columns == docs.columns
    else:
        assert len(want) == docs.count()
    empty = f(odd(docs).limit(0))
    assert empty.count() == 0 and empty.dtypes == clashing.dtypes
    if name.endswith("fit") or name == "3 parts":
        return
    nulls = docs.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    assert f(nulls).count() in ((0, 3) if name == "2 keep" else (3,))


def test_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None), (None, "<b>x"), (3, ""), (4, "<table><tr><td>" + "y " * 200_000)], "page_id long, html string")
    assert rows(render.extract(odd(pages))) == rows(render.extract(pages)) and render.extract(pages).count() == 6
    assert render.extract(odd(pages).limit(0)).count() == 0


def test_vectors(spark):
    data = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(120)] + [(None, [1.0] * 8), (50, None), (120, None), (7, [1.0] * 8), (7, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = rows(ann.nearest(df))
    assert rows(ann.nearest(odd(df))) == want == rows(ann.nearest(df.repartition(5)))
    assert ann.nearest(odd(df).limit(0)).count() == 0 and ann.nearest(df.filter("embedding IS NULL")).count() == 0


def test_stages(spark, tables, tmp_path):
    """Each stage on tables with columns of its own names, on an empty one and on one of nulls only."""
    docs, labels, bench = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        run = partial(stage, spark, sf_dir=sf)
        out = run(odd(docs))
        if name == "encode":
            assert rows(out) == rows(run(docs))
        else:
            assert out.dtypes == odd(docs).dtypes and rows(out, docs.columns) == rows(run(docs))
        assert run(odd(docs).limit(0)).count() == 0
        assert run(docs.limit(2).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])).count() in (0, 2)
