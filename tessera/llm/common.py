"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words of the "letters and digits" kind; every byte of a non-ASCII character belongs to a word.
ALNUM = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters of UTF-8 bytes."""
    return (text or b"").translate(ALNUM).split()


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return (text or b"").lower().split()


def texts(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and the text as bytes; nothing else is read or shipped to Python."""
    return df.select(*[F.col(c) for c in keep], F.col(text).cast("string").cast("binary").alias("text"))


def split_of(doc_id: str = "doc_id", mod: int = 10):
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not d and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame, *partition: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later plans start there, and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(*partition) if partition else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column of df has them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def worker_cache(key: str, build):
    """One value a Python worker process, kept from task to task; holds the latest four keys."""
    held = sys.__dict__.setdefault("_tessera_held", {})
    if key not in held:
        while len(held) >= 4:
            held.pop(next(iter(held)))
        held[key] = build()
    return held[key]


def join_skewed(left: DataFrame, right: DataFrame, key: str, n: str, total: int, hot: int = 1000) -> DataFrame:
    """Inner join of left with right, whose keys are unique and which has the number n of left's rows of each key.

    Keys that hold more than total / hot rows number fewer than hot, so they are broadcast; no other key is large
    enough to unbalance the shuffle that joins the rest. Null keys match nothing.
    """
    least = max(1, total // hot)
    big = F.broadcast(right.filter(F.col(n) > least).drop(n))
    rest = left.join(F.broadcast(right.filter(F.col(n) > least).select(key)), key, "left_anti")
    return left.join(big, key).unionByName(rest.join(right.filter(F.col(n) <= least).drop(n), key))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def here(name: str) -> Path:
    return Path(__file__).parent / name


def tidied(run):
    """A function over batches that gives its memory back to the system when a task ends, for workers live on."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass

    return whole


def keep_rows(docs: DataFrame, judge, step: int = 1000) -> DataFrame:
    """The rows of docs that judge() accepts, columns as given; judge() makes, once a task, a function from a list of texts to booleans."""
    at = docs.columns.index("text")
    as_text = docs.schema["text"].dataType.typeName() == "string"

    def run(batches):
        accept = judge()
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                texts_ = part.column(at).cast(pa.binary()).to_pylist() if as_text else [None if t is None else str(t).encode() for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(accept(texts_), pa.bool_()))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots can't be sent
    return plain.mapInArrow(tidied(run), plain.schema).toDF(*docs.columns)
