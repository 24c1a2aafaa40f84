"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors of unit length are projected to `DIMS` dimensions by a Gaussian (2-stable) matrix: a projected squared distance, over the true one,
follows a chi-square law with `DIMS` degrees of freedom. A kd-tree holds the projections. For a query its cells are visited by distance, so
projected neighbours come nearest first, and each is verified on the original vectors, until the chi-square test holds: a point of which
the projection lies so far out would, with probability `SURE`, not have been among the nearest found. Each true neighbour is thus missed with a
probability under 1 - `SURE`.

The tree has two levels. The upper one, fitted on the projections of at most `SAMPLE` rows of each vector length (those of the smallest
hash), deals every row to a cell of about `BLOCK`; the lower one is a cell's own tree, built in the task that holds the cell. A query goes to its own
cell first. What it finds there bounds how far it must look, and it goes on to the cells of which the box of projections lies within that
reach, and to no others. In a task the cell's rows come first, then the queries are streamed by, so each cell is built once a round, whatever
the number of its queries; a cell of too many rows (copies) is split by row, one that too many queries ask is built in several tasks. The matrix is drawn from a
fixed seed.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, take no part; vectors are compared with those of
their own length only; rows with the query's vec_id (repeated ones as well) aren't its candidates; other rows that repeat stand in the result as
often; of rows that repeat a query's id one, the smallest vector, is the query; ties go to the smaller vec_id; null ids take no part. Columns
other than vec_id and embedding aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidied

DIMS, SURE, LEAF = 10, 0.98, 512
#: Added to squared distances, as copies are apart by rounding.
ROUNDING = 1e-12
BLOCK, SAMPLE = 32_768, 16_384
#: Queries that a task is sent for one cell, about.
ASKED = 65_536
STEP = 2_048


def chi_square_quantile(p: float, dims: int) -> float:
    """For an even number of degrees of freedom, where the distribution function is a finite sum."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Tree:
    """Leaves of a kd-tree with their boxes; splits the widest dimension at the median."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        parts, todo = [], [np.arange(len(x))]
        while todo:
            at = todo.pop()
            spread = np.ptp(x[at], axis=0) if len(at) > leaf else np.zeros(1)
            if len(at) <= leaf or spread.max() == 0:
                parts.append(at)
                continue
            d = int(np.argmax(spread))
            half = len(at) // 2
            at = at[np.argpartition(x[at, d], half)]
            todo += [at[:half], at[half:]]
        self.leaves = parts
        self.low = np.array([x[p].min(0) for p in parts])
        self.high = np.array([x[p].max(0) for p in parts])
        self.points = [x[p] for p in parts]


def matrix(length: int, dims: int) -> np.ndarray:
    return np.random.default_rng(20_000 + length).normal(size=(length, dims))


class Block:
    """Rows of one cell, laid out leaf by leaf."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, dims: int = DIMS):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        tree = Tree((x / norm[:, None]) @ matrix(x.shape[1], dims))
        order = np.concatenate(tree.leaves)
        self.ids, self.x, self.norm = ids[order], x[order], norm[order]
        self.points = np.concatenate(tree.points)
        self.ends = np.cumsum([len(p) for p in tree.leaves])
        self.low, self.high = tree.low, tree.high

    def search(self, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, sure: float = SURE):
        """(query id, id, cosine) of the k nearest rows found for each query, by cosine, then id. floor: cosines that k others have, -inf where unknown."""
        m, dims = len(qids), self.points.shape[1]
        limit = chi_square_quantile(sure, dims)
        qnorm = np.sqrt(np.einsum("ij,ij->i", q, q))
        unit = q / qnorm[:, None]
        pq = unit @ matrix(q.shape[1], dims)
        reach = reach_of(floor, limit)
        best_s, best_i = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
        gap = gaps(pq, self.low, self.high)
        order = np.argsort(gap, axis=1, kind="stable")
        for r in range(gap.shape[1]):
            leaf = order[:, r]
            act = np.flatnonzero(gap[np.arange(m), leaf] <= reach)
            if not len(act):
                break
            act = act[np.argsort(leaf[act], kind="stable")]
            for group in np.split(act, np.flatnonzero(np.diff(leaf[act])) + 1):
                end = self.ends[leaf[group[0]]]
                begin = self.ends[leaf[group[0]] - 1] if leaf[group[0]] else 0
                for lo in range(begin, end, STEP):
                    self._verify(slice(lo, min(lo + STEP, end)), group, qids, q, qnorm, unit, pq, reach, best_s, best_i, k)
                reach[group] = np.minimum(reach[group], reach_of(best_s[group, -1], limit))
        hit = best_s > -np.inf
        return np.repeat(qids, hit.sum(1)), best_i[hit], best_s[hit]

    def _verify(self, rows: slice, group, qids, q, qnorm, unit, pq, reach, best_s, best_i, k):
        """Takes those of some rows that are among the best of some queries into best_s and best_i."""
        ids, x, norm, points = self.ids[rows], self.x[rows], self.norm[rows], self.points[rows]
        far = np.einsum("ij,ij->i", points, points) + np.einsum("ij,ij->i", pq[group], pq[group])[:, None] - 2 * pq[group] @ points.T
        rough = unit[group] @ x.T / norm
        rough[(far > reach[group][:, None] * (1 + 1e-9) + 1e-9) | (ids == qids[group][:, None])] = -np.inf
        least = best_s[group, -1]
        if rough.shape[1] > k:
            least = np.maximum(least, np.partition(rough, -k, axis=1)[:, -k])
        # products of matrices round differently from place to place: what comes near is computed again, row by row
        at, who = np.nonzero((rough >= least[:, None] - 1e-9) & (rough > -np.inf))
        if not len(at):
            return
        exact = np.einsum("ij,ij->i", x[who], q[group[at]]) / (norm[who] * qnorm[group[at]])
        some = np.unique(at)
        g = np.concatenate([np.repeat(some, k), at])
        s = np.concatenate([best_s[group[some]].ravel(), exact])
        i = np.concatenate([best_i[group[some]].ravel(), ids[who]])
        o = np.lexsort((i, -s, g))
        first = np.searchsorted(g[o], some)
        take = o[(first[:, None] + np.arange(k)).ravel()]
        best_s[group[some]], best_i[group[some]] = s[take].reshape(-1, k), i[take].reshape(-1, k)


def reach_of(score: np.ndarray, limit: float) -> np.ndarray:
    """Projected squared distance beyond which nothing is looked for, once the k-th best cosine is known."""
    with np.errstate(invalid="ignore"):
        return np.where(score > -np.inf, limit * np.maximum(2 - 2 * score, 0) * (1 + 1e-9) + ROUNDING, np.inf)


def gaps(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes."""
    out = np.zeros((len(p), len(low)))
    for d in range(p.shape[1]):
        g = np.maximum(0, np.maximum(low[:, d] - p[:, d, None], p[:, d, None] - high[:, d]))
        out += g * g
    return out


class Upper:
    """The upper level of the tree: cuts of the sample's projections at the medians, until there are so many cells."""

    def __init__(self, x: np.ndarray, cells: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # dimension, value, what is below and above it: a cut, or ~cell
        self.cells = 0

        def grow(at, n):
            spread = np.ptp(x[at], axis=0) if n > 1 and len(at) > 1 else np.zeros(1)
            if spread.max() == 0:
                self.cells += 1
                return ~(self.cells - 1)
            d = int(np.argmax(spread))
            value = float(np.quantile(x[at, d], (n // 2) / n))
            here = len(self.cuts)
            self.cuts.append((d, value, 0, 0))
            low = x[at, d] < value
            self.cuts[here] = (d, value, grow(at[low], n // 2), grow(at[~low], n - n // 2))
            return here

        self.top = grow(np.arange(len(x)), cells)

    def cell(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(self.top, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = ~node
            elif len(at):
                d, value, low, high = self.cuts[node]
                below = x[at, d] < value
                todo += [(low, at[below]), (high, at[~below])]
        return out


def usable(df: DataFrame) -> DataFrame:
    """vec_id, the vector and its length of rows that take part."""
    v = F.col("embedding").cast("array<double>")
    kind = df.schema["embedding"].dataType.simpleString()
    given = F.col("embedding") if kind in ("array<float>", "array<double>") else v
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter((F.size("embedding") > 0) & fine & F.exists(v, lambda x: x != 0) & F.col("vec_id").cast("long").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), given.alias("v"), F.size("embedding").alias("length"))


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _by_length(b: pa.RecordBatch, f):
    """f of the vectors of each length in a batch, put together in the batch's order."""
    length = b.column(b.schema.get_field_index("length")).to_numpy()
    out = None
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        value = f(int(n), _matrix(b.column(b.schema.get_field_index("v")).take(pa.array(at))))
        if out is None:
            out = np.zeros((b.num_rows, *value.shape[1:]), value.dtype)
        out[at] = value
    return out


def project(x: np.ndarray, dims: int) -> np.ndarray:
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ matrix(x.shape[1], dims)


def _rows(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], pa.int32()), pa.array(p.ravel(), pa.float64()))


def placed(rows: DataFrame, block: int, dims: int) -> tuple[DataFrame, dict[int, Upper]]:
    """The rows with their cells and projections, written to the shared folder."""
    spark = rows.sparkSession
    sizes = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first = Window.partitionBy("length").orderBy(F.xxhash64("vec_id", "v"), "vec_id")
    some = rows.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= SAMPLE).drop("at") if max(sizes.values(), default=0) > block else rows.limit(0)

    def sampled(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(2), _rows(_by_length(b, lambda n, x: project(x, dims)))], ["length", "p"])

    got = some.mapInArrow(sampled, "length int, p array<double>").toArrow()
    upper = {}
    for n, size in sizes.items():
        own = got.filter(pa.compute.equal(got.column("length"), n)).column("p").combine_chunks()
        p = _matrix(own) if len(own) else np.zeros((0, dims))
        p = p[np.lexsort(p.T)] if len(p) else p
        upper[n] = Upper(p, math.ceil(size / block))
    held = spark.sparkContext.broadcast(upper)

    def run(batches):
        for b in batches:
            if b.num_rows:
                p = _by_length(b, lambda n, x: project(x, dims))
                cell = np.zeros(b.num_rows, np.int32)
                length = b.column(2).to_numpy()
                for n in np.unique(length):
                    cell[length == n] = held.value[int(n)].cell(p[length == n])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), _rows(p)], ["vec_id", "v", "length", "cell", "p"])

    kind = rows.schema["v"].dataType.simpleString()
    out = rows.mapInArrow(tidied(run), f"vec_id long, v {kind}, length int, cell int, p array<double>")
    # a row's share of its cell, should the cell be split: by where the row stands, so that copies are spread as well
    return cut(out.withColumn("share", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "vec_id"), F.lit(1 << 20)).cast("int"))), upper


def visit(data: DataFrame, queries: DataFrame, subs: dict, k: int, asked: int, dims: int) -> DataFrame:
    """query_id, vec_id, score: what queries (query_id, v, length, cell, floor) find in their cells."""
    spark = data.sparkSession
    calls = queries.groupBy("length", "cell").agg(F.count("*").alias("n")).collect()
    slots = {(r["length"], r["cell"]): math.ceil(r["n"] / asked) for r in calls if r["n"] > asked}
    number = lambda m: F.coalesce(F.create_map(*[F.lit(x) for (n, c), v in m.items() for x in (n << 32 | c, v)])[(F.col("length").cast("long") * (1 << 32)).bitwiseOR(F.col("cell"))], F.lit(1)) if m else F.lit(1)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = data.select("length", "cell", (F.col("share") % number(subs)).alias("sub"), every(number(slots)).alias("slot"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("double").alias("floor"))
    theirs = queries.withColumn("slot", F.pmod(F.xxhash64("query_id"), number(slots)).cast("int"))
    theirs = theirs.select("length", "cell", every(number(subs)).alias("sub"), "slot", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v", "floor")
    by = ["length", "cell", "sub", "slot"]
    sent = own.unionByName(theirs).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, "kind")

    def run(batches):
        here, rows, block = None, [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(5)], axis=1)
            for lo, hi in zip(*_runs(keys), strict=True):
                key, kind = tuple(keys[lo, :4]), keys[lo, 4]
                if key != here:
                    here, rows, block = key, [], None
                part = b.slice(lo, hi - lo)
                ids, x = part.column(5).to_numpy(), _matrix(part.column(6))
                if kind == 0:
                    rows.append((ids, x))
                    continue
                if block is None and rows:
                    block = Block(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), dims)
                    rows = []
                if block is None:
                    continue
                floor = part.column(7).to_numpy(zero_copy_only=False)
                floor = np.where(np.isnan(floor), -np.inf, floor)
                for at in range(0, len(ids), 1024):
                    q, i, s = block.search(ids[at : at + 1024], x[at : at + 1024], floor[at : at + 1024], k)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return sent.mapInArrow(tidied(run), "query_id long, vec_id long, score double")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal rows."""
    if not len(keys):
        return np.array([], int), np.array([], int)
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return start, np.append(start[1:], len(keys))


def nearest(df: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK, asked: int = ASKED, dims: int = DIMS, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose vec_id is divisible by `every`."""
    spark = df.sparkSession
    data, upper = placed(usable(df), block, dims)
    cells = data.groupBy("length", "cell").agg(F.count("*").alias("n"), *[f(F.col("p")[d]).alias(f"{name}{d}") for name, f in (("low", F.min), ("high", F.max)) for d in range(dims)]).collect()
    subs = {(r["length"], r["cell"]): math.ceil(r["n"] / (2 * block)) for r in cells if r["n"] > 2 * block}
    queries = data.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "length", "cell", "p")).alias("q"))
    queries = queries.select(F.col("vec_id").alias("query_id"), "q.*")
    found = visit(data, queries.withColumn("floor", F.lit(None).cast("double")), subs, k, asked, dims)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if max((u.cells for u in upper.values()), default=0) > 1:
        found = cut(found)
        limit = chi_square_quantile(sure, dims)
        fifth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        boxes = {}
        for n in upper:
            own = [r for r in cells if r["length"] == n]
            boxes[n] = (np.array([r["cell"] for r in own]), *(np.array([[r[f"{name}{d}"] for d in range(dims)] for r in own]) for name in ("low", "high")))
        held = spark.sparkContext.broadcast(boxes)

        def others(batches):
            for b in batches:
                floor = b.column(4).to_numpy(zero_copy_only=False)
                reach = reach_of(np.where(np.isnan(floor), -np.inf, floor), limit)
                length, own, p = b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3))
                for lo in range(0, b.num_rows, 256):
                    for n in np.unique(length[lo : lo + 256]):
                        at = lo + np.flatnonzero(length[lo : lo + 256] == n)
                        number, low, high = held.value[int(n)]
                        a, c = np.nonzero((gaps(p[at], low, high) <= reach[at][:, None]) & (number != own[at][:, None]))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[a])), pa.array(number[c].astype(np.int32))], ["query_id", "cell"])

        bounded = queries.join(fifth, "query_id", "left")
        going = bounded.select("query_id", "length", "cell", "p", "floor").mapInArrow(others, "query_id long, cell int")
        going = cut(going.join(bounded.drop("cell", "p"), "query_id"))
        found = found.unionByName(visit(data, going, subs, k, asked, dims))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
