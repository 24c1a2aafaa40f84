"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read

#: The model that the queries encode with: a file of this machine, handed to the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_decontaminate(spark, sf_dir):
    from .decontam import hit_words, search

    found = search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op3_decontaminate"] = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 v AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0),
 p AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM v),
 x AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p)),
 h AS (SELECT doc_id, item_id, k, p.n FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM x) y JOIN p ON y.n = p.n AND y.s = p.s),
 t AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY 1),
 i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN i USING (doc_id)"""


@query
def op9_simhash(spark, sf_dir):
    from .simhash import fingerprint_hex, near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


@query
def op10_pieces(spark, sf_dir):
    from .pieces import encode, load

    return encode(read(spark, sf_dir, "documents"), load(MODEL), with_ids=False)


@query
def op6_secrets(spark, sf_dir):
    from .secrets import AS, count, listed, scan

    found = scan(read(spark, sf_dir, "documents"), "doc_id")
    base, spans = F.col(f"{AS}.base"), F.col(f"{AS}.spans")
    return found.select(
        "doc_id",
        *[count(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


@query
def op8_licenses(spark, sf_dir):
    from .licenses import scan

    return scan(read(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark, sf_dir):
    from .common import split_of
    from .toxicity import fit, score

    docs = read(spark, sf_dir, "documents")
    found = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    held = (split_of("doc_id", 5) == 0).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_threshold", "flagged")


@query
def op2_quality(spark, sf_dir):
    from .common import split_of
    from .quality import fit, score

    docs = read(spark, sf_dir, "documents")
    found = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    held = (split_of("doc_id", 3) == 1).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_render(spark, sf_dir):
    from .render import extract

    found = extract(read(spark, sf_dir, "pages"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines"))


@query
def op4_neighbours(spark, sf_dir):
    from .ann import nearest

    return nearest(read(spark, sf_dir, "embeddings"))


@query
def op1_context_trees(spark, sf_dir):
    from .ctw import held_out, score

    # the score is of the text as operator 1 reads it: lower-cased words joined by single spaces, and a line feed
    found = score(read(spark, sf_dir, "documents"), ~held_out())
    return found.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"
    )
