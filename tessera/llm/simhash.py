"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits; a bit is 1 if it is set in more than half of the XXH64 values (seed 42) of a text's word
shingles, repeats included. Two fingerprints link at 2 or fewer differing bits. Cut into four blocks of 16 bits, such a
pair agrees in at least two whole blocks, so every fingerprint is filed under its six pairs of blocks and only
fingerprints filed together are compared. Distinct fingerprints are compared, not documents: a thousand copies are one.

A key under which more than `MOST` fingerprints are filed is not compared pair by pair. Its fingerprints take the
second way: each is filed under itself and its 64 one-bit neighbours. Any two that meet differ in at most 2 bits, any two
that differ in at most 2 bits meet, and no more than 65 can ever meet at one value, so nothing is lost or capped.

Links of documents by similarity, as the pipeline wants them (`keep_one`), can't rest on fingerprints: at 0.8 of the five-word shingles in common, texts
differ in 15 % of the bits, where no blocks are sure to agree. There the shingles themselves are joined (`similar`), and exactly: in one order of all shingles, two sets of
that similarity have one of their first fifths in common. Sets are filed under each shingle of that prefix; of those that meet, sizes and places leave out what can't be
similar, then sketches that bound the difference from below, and the rest is counted over whole sets. First each is compared with the smallest id under its keys, then only those that aren't in one
component yet, each with each, whatever their number: no key is capped and no pair that could join two groups is left out. Shingles are held as XXH64, so
two different ones count as one with a probability of 2^-64.

Defined results: null and empty texts have fingerprint zero or no shingles, and link like others; repeated rows each get their row; a null
doc_id gets a row, and its component is the smallest id of the others in it (null if there is none). Columns of docs other than doc_id and
text take no part; keep_one hands them through, whatever their names and types.
"""

from __future__ import annotations

from fractions import Fraction
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, join_skewed, space_words, texts, tidied

MOST = 32
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    words = space_words(text)
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in parts], dtype="<u8")
    at = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    ones = (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed 64 bits) of each row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    src = texts(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    return src.mapInArrow(tidied(run), "doc_id long, fp long")


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Pairs (u, v) that link the distinct fingerprints fp; their components are those of all pairs within 2 bits."""
    part = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [
        F.lit(k << 32).bitwiseOR(F.shiftleft(part[i], 16)).bitwiseOR(part[j]) for k, (i, j) in enumerate(combinations(range(4), 2))
    ]
    filed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    often = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    filed = cut(filed.join(often, "key"))
    few = (
        filed.filter(F.col("n") <= most)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("fps"))
        .select(F.explode("fps").alias("u"), "fps")
        .select("u", F.explode("fps").alias("v"))
        .filter("u > v AND bit_count(u ^ v) <= 2")
    )
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    many = (
        filed.filter(F.col("n") > most)
        .select("fp")
        .distinct()
        .select("fp", F.explode(near).alias("at"))
        .groupBy("at")
        .agg(F.min("fp").alias("v"), F.collect_list("fp").alias("fps"))
        .select(F.explode("fps").alias("u"), "v")
        .filter("u > v")
    )
    return few.union(many).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v), the root the smallest node reachable; alternating large and small stars.

    Each round is written to the shared folder. The rounds needed grow with the logarithm of the longest path.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = cut(small.select("e.u", F.col("e.m").alias("v")).filter("u > v").distinct())
        was, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was or state[0] == 0:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = MOST) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, itself included) of every row."""
    rows = cut(fingerprints(docs, shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    linked = components(links(distinct.select("fp"), most))
    linked = cut(linked.join(distinct.select(F.col("fp").alias("node"), "rep"), "node"))
    total = distinct.agg(F.sum("n"), F.count("*")).first()
    heads = linked.groupBy("root").agg(F.min("rep").alias("head"), F.count("*").alias("size"))
    owner = join_skewed(linked.select("node", "root"), heads, "root", "size", total[1] or 0)
    owner = distinct.join(owner.select(F.col("node").alias("fp"), "head"), "fp", "left")
    owner = cut(owner.select("fp", "n", F.coalesce("head", "rep").alias("component_id")))
    return join_skewed(rows, owner, "fp", "n", total[0] or 0).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# --- similarity of 0.8 or more --------------------------------------------------------------------------------------

#: Rows that common shingles are learnt from; times that such a one occurs there at least, and how many are taken at most. They only order
#: the shingles: any order gives the same links.
SAMPLE, OFTEN, COMMON = 20_000, 5, 100_000
#: Members of a key that are compared with others in one piece.
ROOM = 256


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """XXH64 (seed 42) of the distinct shingles, ascending; fewer words: of the whole sequence; no words: none."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in parts), np.uint64, max(1, len(words) - shingle + 1)))


def prefixes(common: np.ndarray, t: Fraction):
    """Function from a set to so many of its items, the least common first, that sets of a similarity of t or more share one of theirs.

    Sets of n items have at least t * n of them in common with such a set, so the first n - ceil(t * n) + 1 of both in one order can't be apart.
    The order: items that aren't in `common` by value, then those in it as they stand there.
    """
    by = np.argsort(common)
    ascending = common[by]

    def choose(items):
        n = len(items)
        size = n - -(-t.numerator * n // t.denominator) + 1 if n else 0
        if not len(common):
            return items[:size]
        at = np.minimum(np.searchsorted(ascending, items), len(common) - 1)
        known = ascending[at] == items
        return np.concatenate([items[~known], common[np.sort(by[at[known]])]])[:size]

    return choose


def listed(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def sets(rows: DataFrame, shingle: int, choose=None, only: np.ndarray | None = None) -> DataFrame:
    """id, sig (16 bytes that name the set), n (its size) and items (all, or what the function that choose() makes once a task takes of them) of rows (id, text).

    With bits of ids (`bits_of`), of rows that these let pass only.
    """

    def batch(held):
        ids, sigs, ns, items = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(ns, pa.int64()), listed(items)], ["id", "sig", "n", "items"])

    def run(batches):
        pick = choose() if choose else None
        held, size = [], 0
        for b in batches:
            if only is not None:
                h = b.column(2).to_numpy()
                b = b.filter(pa.array((only[h % len(only)] >> (h >> 58 & 63) & 1).astype(bool)))
            for i, text in zip(b.column(0), b.column(1), strict=True):
                h = shingle_set(text.as_py(), shingle)
                items = pick(h) if pick else h
                held.append((i.as_py(), blake2b(h.tobytes(), digest_size=16).digest(), len(h), items))
                size += len(items)
                if size > 1_000_000 or len(held) >= 10_000:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    rows = rows.select("id", "text", *([] if only is None else [F.xxhash64("id").alias("h")]))
    return rows.mapInArrow(tidied(run), "id long, sig binary, n long, items array<long>")


def bits_of(ids: DataFrame) -> np.ndarray:
    """Words of 64 bits, one for eight ids: all ids pass them and about one in eight others. So texts needn't be shuffled to find those of the ids."""
    words = ids.count() // 8 + 1
    h = F.xxhash64("id")
    found = ids.groupBy(F.pmod(h, F.lit(words)).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 58).bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def common_shingles(rows: DataFrame, shingle: int, sample: int = SAMPLE) -> np.ndarray:
    """The shingles that occur often in a sample of rows (id, text), ascending by how often."""
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, rows.count() // sample))) == 0)
    found = sets(some, shingle).select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    found = found.orderBy(F.desc("n"), "item").limit(COMMON).collect()
    return np.array([r["item"] for r in reversed(found)], np.int64).view(np.uint64)


def similar(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, room: int = ROOM, sample: int = SAMPLE) -> DataFrame:
    """Edges (u, v) of ids of rows (id, text) whose components are those of all pairs of the similarity or more. Equal ids are one node, null ones none."""
    t = Fraction(str(similarity))
    rows = rows.filter("id IS NOT NULL")
    common = common_shingles(rows, shingle, sample)
    every = cut(sets(rows, shingle, lambda: prefixes(common, t)))
    # one row for each set, with the smallest id; the other ids hang on that one
    different = every.groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("items").alias("items"))
    hang = every.select("id", "sig").join(every.groupBy("sig").agg(F.min("id").alias("v")), "sig").filter("id > v").select(F.col("id").alias("u"), "v").distinct()

    # each key's members: the size of the set above the place of the key in it, the number of members, the leader (smallest id)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = different.select("id", "n", F.posexplode("items").alias("pos", "key"))
    filed = filed.select("key", "id", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("at")).repartition(n, "key")
    keys = filed.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("v"), F.min_by("at", "id").alias("v_at")).filter("m > 1")
    members = cut(filed.join(keys, "key"))

    def may(a, b):
        """Whether sizes and places allow the similarity: beyond the first common key, only what comes after it can be common."""
        (x, i), (y, j) = ((F.shiftright(c, 32), F.col(c).bitwiseAND(0xFFFFFFFF)) for c in (a, b))
        near = F.greatest(x, y) * t.numerator <= F.least(x, y) * t.denominator
        return near & (F.least(x - i, y - j) * (t.numerator + t.denominator) >= (x + y) * t.numerator)

    # first each with its leader; then, of those in different components still, each with each
    first = cut(members.filter(F.col("id") > F.col("v")).filter(may("at", "v_at")).select(F.col("id").alias("u"), "v").distinct())
    linked = cut(alike(first, rows, shingle, t).union(hang))
    left = members.select("key", "id", "at", "m").join(components(linked).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    left = cut(left)
    roots = left.groupBy("key", "root").agg(F.count("*").alias("times")).groupBy("key").agg(F.max_by("root", "times").alias("main"), F.count("*").alias("roots"))
    left = cut(left.join(roots.filter("roots > 1").select("key", "main"), "key").withColumn("parts", F.ceil(F.col("m") / room)))
    # members outside the key's largest component go to all parts of the key, and meet there the part's members
    mine = left.select("key", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.col("id").alias("b"), F.col("at").alias("b_at"), F.col("root").alias("b_root"), (F.col("root") == F.col("main")).alias("b_main"))
    theirs = left.filter("root <> main").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("id").alias("a"), F.col("at").alias("a_at"), F.col("root").alias("a_root"))
    pairs = theirs.join(mine, ["key", "part"]).filter("a_root <> b_root AND (b_main OR a > b)").filter(may("a_at", "b_at"))
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs.join(first, ["u", "v"], "left_anti"))
    return linked.union(alike(pairs, rows, shingle, t)).distinct()


def sketch(items: np.ndarray) -> np.ndarray:
    """8,192 bits as 128 longs: whether a set has an odd number of items there. Sets differ in as many items as their sketches in bits, at least."""
    odd = np.bincount((items & np.uint64(8191)).astype(np.int64), minlength=8192) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def alike(pairs: DataFrame, rows: DataFrame, shingle: int, t: Fraction) -> DataFrame:
    """The pairs (u, v) of which some sets have the similarity t or more, by all their shingles; those whose sketches differ too much are left out before."""
    bits = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, k: s + k)
    less, both = t.denominator - t.numerator, t.denominator + t.numerator
    near = cut(met(pairs, rows, shingle, lambda: sketch).filter(bits * both <= (F.col("x") + F.col("y")) * less).select("u", "v").distinct())
    same = F.size(F.array_intersect("a", "b"))
    return met(near, rows, shingle).filter(same * both >= (F.col("x") + F.col("y")) * t.numerator).select("u", "v").distinct()


def met(pairs: DataFrame, rows: DataFrame, shingle: int, choose=None) -> DataFrame:
    """Pairs (u, v) with the sizes x, y of their sets and their items a, b (or what is chosen of them)."""
    wanted = cut(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = cut(sets(rows, shingle, choose, bits_of(wanted))).repartition(n, "id").dropDuplicates(["id", "sig"])
    u, v = (whole.select(F.col("id").alias(c), F.col("n").alias(k), F.col("items").alias(i)) for c, k, i in (("u", "x", "a"), ("v", "y", "b")))
    # the leaders' side first: a leader of many has them all in one task, but without their sets
    return pairs.join(v, "v").join(u, "u")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows whose doc_id is the smallest of its group of near duplicates, columns as given.

    Groups are the components of documents that have at least the similarity. Of repeated rows of one id a single one stays (the smallest as
    JSON), and they link as one document; rows with a null id stay and link nothing.
    """
    rows = texts(docs, "doc_id").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = components(similar(rows, shingle, similarity))
    out, one, times, best = free(docs, "drop_id", "one_id", "times", "best")
    ids = F.col("doc_id").cast("long")
    gone = found.filter("node <> root").select(F.col("node").alias(out))
    kept = docs.join(gone, ids == F.col(out), "left_anti")
    again = rows.filter("id IS NOT NULL").groupBy(F.col("id").alias(one)).agg(F.count("*").alias(times)).filter(F.col(times) > 1).select(one)
    single = kept.join(again, ids == F.col(one), "left_anti")
    several = kept.join(again, ids == F.col(one), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = several.groupBy(ids.alias(one)).agg(F.min_by(row, F.to_json(row)).alias(best)).select(f"{best}.*")
    return single.unionByName(several)
