"""Benchmark decontamination by Wu-Manber search for many strings at once.

Texts and benchmark items become their words, lower-cased and joined by single spaces, with one space at each end. Each
window of `size` words of an item is a pattern ` w1 ... wn ` in that form, so that an occurrence of the bytes is an occurrence of
the words. Wu-Manber: the search reads the last `block` bytes of a window as long as the shortest pattern; a table says how far it
may shift (blocks in no pattern shift by nearly the whole window); at shift zero the block selects a bucket of patterns, and each is
compared directly. Patterns are searched by length class (a class spans a factor of two) so that one short item doesn't
shorten the shifts of all others; patterns too short for a block are looked up as whole words.

The benchmark is shipped in parts of at most `PART_BYTES` of patterns, whose size is measured first: a benchmark beyond one
part is searched part by part, each over all texts, and the hits are merged by document row.

Defined results: null and empty texts have no words, are never hit and get the digest of the empty list; items without words have
no window; an item id that repeats counts once, a null one is no id, though its words are hit; the benchmark may be empty. Every row, repeated ones
and those with a null id as well, gets a row; an empty table gives an empty one. Columns other than doc_id and text aren't read by search, and
handed through by decontaminate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, keep_rows, texts, tidied

BLOCK = 8
PART_BYTES = 32 << 20


def windows(text: bytes | None, size: int = 10) -> set[bytes]:
    words = alnum_words(text)
    n = max(1, len(words) - size + 1) if words else 0
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(n)}


class WuManber:
    """Finds all occurrences of patterns of at least `block` bytes."""

    def __init__(self, patterns, block: int = BLOCK):
        self.m = min(map(len, patterns))
        self.block, self.default = block, self.m - block + 1
        shift: dict[bytes, int] = {}
        for p in patterns:
            for end in range(block, self.m + 1):
                key = p[end - block : end]
                shift[key] = min(shift.get(key, self.m), self.m - end)
        self.shift = shift
        self.bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            self.bucket.setdefault(p[self.m - block : self.m], []).append(p)

    def find(self, text: bytes):
        """(start, pattern) of each occurrence."""
        get, default, block, m, end, n = self.shift.get, self.default, self.block, self.m, self.m, len(text)
        while end <= n:
            key = text[end - block : end]
            skip = get(key, default)
            if skip:
                end += skip
                continue
            at = end - m
            for p in self.bucket[key]:
                if text.startswith(p, at):
                    yield at, p
            end += 1


class Searcher:
    """Patterns with the item ids that have them."""

    def __init__(self, patterns: dict[bytes, list]):
        self.items = patterns
        self.words = {p[1:-1] for p in patterns if len(p) < BLOCK}
        by: dict[int, list[bytes]] = {}
        for p in patterns:
            if len(p) >= BLOCK:
                by.setdefault(len(p).bit_length(), []).append(p)
        self.classes = [WuManber(ps) for ps in by.values()]

    def search(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, spans of hit words (start, end), ids of the items found."""
        words = alnum_words(text)
        if not words:
            return 0, [], set()
        flat = b" " + b" ".join(words) + b" "
        found = [hit for c in self.classes for hit in c.find(flat)]
        if self.words:
            at = 0
            for p in self.words:
                needle = b" " + p + b" "
                at = flat.find(needle)
                while at >= 0:
                    found.append((at, needle))
                    at = flat.find(needle, at + 1)
        if not found:
            return len(words), [], set()
        spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        starts = np.searchsorted(spaces, [at for at, _ in found])
        spans = sorted({(int(s), int(s) + p.count(b" ") - 1) for s, (_, p) in zip(starts, found, strict=True)})
        return len(words), spans, {i for _, p in found for i in self.items[p]}


def parts_of(benchmark: DataFrame, size: int, part_bytes: int):
    """Yields the benchmark's patterns in parts of bounded size, read one item at a time; one part, perhaps empty, at least."""
    part: dict[bytes, list] = {}
    used = 0
    for r in texts(benchmark, "item_id").distinct().toLocalIterator():
        for p in windows(bytes(r["text"]) if r["text"] is not None else None, size):
            if used + len(p) > part_bytes and part:
                yield part
                part, used = {}, 0
            ids = part.setdefault(p, [])
            if r["item_id"] not in ids:
                ids.append(r["item_id"])
            used += len(p) + 64
    yield part


def search(docs: DataFrame, benchmark: DataFrame, size: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, spans (array of [start, end) in words), items (array of ids as text) of every row of docs."""
    sc = docs.sparkSession.sparkContext
    # the driver holds one part at a time: what is broadcast goes to a file
    parts = [sc.broadcast(p) for p in parts_of(benchmark, size, part_bytes)]
    schema = "row long, doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<string>"
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    src = texts(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if len(parts) > 1:
        src = cut(src)  # the passes must number the rows alike

    def job(held):
        def run(batches):
            searcher = Searcher(held.value)
            for b in batches:
                out = [searcher.search(t.as_py()) for t in b.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(1),
                        pa.array([n for n, _, _ in out], pa.int64()),
                        pa.array([[{"s": s, "e": e} for s, e in spans] for _, spans, _ in out], kind),
                        pa.array([sorted(map(str, items - {None})) for _, _, items in out], pa.list_(pa.string())),
                    ],
                    ["row", "doc_id", "n_words", "spans", "items"],
                )

        return src.mapInArrow(tidied(run), schema)

    found = job(parts[0])
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.union(job(p))
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return found.drop("row")


def hit_words():
    """Number of words in the union of sorted spans; without a loop over words."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["to"], x["s"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")
    )
    zero = F.lit(0).cast("long")
    return F.aggregate("spans", F.struct(zero.alias("n"), zero.alias("to")), step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs with no word inside an occurrence of a benchmark window; columns as given."""
    spark = docs.sparkSession
    for patterns in parts_of(benchmark, size, PART_BYTES):
        held = spark.sparkContext.broadcast(patterns)

        def judge(held=held):
            searcher = Searcher(held.value)
            return lambda ts: [not searcher.search(t)[1] for t in ts]

        docs = keep_rows(docs, judge)
    return docs
