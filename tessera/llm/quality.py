"""Quality by a generalised additive model with pairwise interactions.

A text becomes `FEATURES`; each is cut into at most `BINS` quantile bins. Boosting visits the features in turn and adds, a small step
at a time, a shallow tree of that feature alone (four leaves at most) to the feature's lookup table. Then the pairs of features whose
residuals gain most from a joint split get tables of their own (`PAIR_BINS` by `PAIR_BINS`), boosted in turn likewise. A score is
the logistic function of the intercept plus the looked-up values of all bins: additions only.

Learns from at most `ROWS` labelled rows, those with the smallest hash of doc_id, whole texts. Defined results: null and empty texts have all
features zero and the score of those; without both labels in the sample the score is the share of label 1 (0.5 of none). Every row, repeated ones
and those with a null id as well, gets a score or is kept or dropped by it; an empty table gives an empty one. Rows with null labels or ids aren't
learnt from, and of labels that contradict each other the larger counts. Scores read no column but the text; keep_good hands the others through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, split_of, texts, tidied
from .toxicity import sample, sigmoid

ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 200, 80, 0.1
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "non_ascii", "space", "newline", "punctuation", "symbols", "marks",
    "bars", "distinct_words", "top_word", "distinct_lines", "line_length", "sentence_length", "entropy", "longest_word", "repeats",
    "short_words", "capitalised",
)

_KIND = np.zeros((256, 8))
for _k, _s in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:'\"?-()", "#$%&*@^_~=+<>\\/[]{}`", "!")):
    _KIND[list(_s.encode()), _k] = 1


def features(text: bytes | None) -> np.ndarray:
    out = np.zeros(len(FEATURES))
    words = (text or b"").split()
    if not words:
        return out
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    n = hist.sum() - hist[128:192].sum()
    lower, upper, digit, space, line, point, symbol, bang = hist @ _KIND
    w = len(words)
    sizes = np.fromiter(map(len, words), np.int64, w)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    p = hist[hist > 0] / hist.sum()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    sentences = hist[46] + hist[63] + hist[33] + 1
    out[:] = (
        np.log1p(n), np.log1p(w), sizes.mean(), upper / n, digit / n, hist[192:].sum() / n, space / n, line / n, point / n, symbol / n, bang / n,
        hist[124] / n, len(counts) / w, max(counts.values()) / w, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), np.log1p(w / sentences),
        -(p * np.log2(p)).sum(), np.log1p(sizes.max()), same / w, (sizes <= 3).mean(), upper / w,
    )
    return out


class Gam:
    """Cuts, lookup tables of features and of pairs."""

    def __init__(self):
        self.constant: float | None = None
        self.base = 0.0
        self.cuts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.coarse: list[np.ndarray] = []
        self.pair_tables: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else sigmoid(self.logits(x))


def _split(g: np.ndarray, h: np.ndarray, least: float = 1.0):
    """Best cut of ordered bins by gain; None where there is none."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(cg):
        return None
    tg, th = g.sum(), h.sum()
    gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1)
    gain[(ch < least) | (th - ch < least)] = -1
    k = int(np.argmax(gain))
    return (k + 1, gain[k]) if gain[k] > 1e-9 else None


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of depth two over ordered bins."""
    out = np.zeros(len(g))
    first = _split(g, h)
    edges = [0, len(g)]
    if first:
        edges.insert(1, first[0])
        for lo, hi in ((0, first[0]), (first[0], len(g))):
            if again := _split(g[lo:hi], h[lo:hi]):
                edges.append(lo + again[0])
    edges = sorted(set(edges))
    for lo, hi in zip(edges, edges[1:], strict=False):
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a tree over a grid that splits one axis, then the other in each part; its gain."""
    best, value = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        first = _split(a.sum(1), b.sum(1))
        out, gain = np.zeros_like(a), 0.0
        for lo, hi in ((0, first[0]), (first[0], len(a))) if first else ((0, len(a)),):
            pg, ph = a[lo:hi].sum(0), b[lo:hi].sum(0)
            cut = _split(pg, ph)
            for x, y in ((0, cut[0]), (cut[0], len(pg))) if cut else ((0, len(pg)),):
                s, t = pg[x:y].sum(), ph[x:y].sum()
                out[lo:hi, x:y] = -s / (t + 1)
                gain += s * s / (t + 1)
        if gain > best:
            best, value = gain, out if axis == 0 else out.T
    return value, best


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    m = Gam()
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        m.constant = float(y.mean()) if len(y) else 0.5
        return m
    m.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    b = m.bins(x)
    size = [len(c) + 1 for c in m.cuts]
    m.tables = [np.zeros(s) for s in size]
    m.base = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), m.base)
    for _ in range(ROUNDS):
        for k, t in enumerate(m.tables):
            p = sigmoid(z)
            step = RATE * _tree(np.bincount(b[:, k], p - y, size[k]), np.bincount(b[:, k], p * (1 - p), size[k]))
            t += step
            z += step[b[:, k]]
    m.coarse = [np.minimum(np.arange(s) * PAIR_BINS // s, PAIR_BINS - 1) for s in size]
    flat = lambda i, j: m.coarse[i][b[:, i]] * PAIR_BINS + m.coarse[j][b[:, j]]
    grid = lambda v, at: np.bincount(at, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    p = sigmoid(z)
    gains = sorted(((_tree2(grid(p - y, flat(i, j)), grid(p * (1 - p), flat(i, j)))[1], i, j) for i, j in combinations(range(len(size)), 2)), reverse=True)
    m.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    m.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in m.pairs]
    at = [flat(i, j) for i, j in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, t in enumerate(m.pair_tables):
            p = sigmoid(z)
            step = RATE * _tree2(grid(p - y, at[k]), grid(p * (1 - p), at[k]))[0]
            t += step
            z += step.ravel()[at[k]]
    return m


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, out: int = 1, rows: int = ROWS) -> Gam:
    """A model learnt from labelled rows whose crc32(doc_id as text) mod `mod` isn't `out`."""
    got = sample(docs, labels, "quality", rows, split_of("doc_id", mod) == out)
    got = got.select("i", "y", "text")

    def run(batches):
        for b in batches:
            f = [features(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], ["i", "y", "f"])

    rows_ = got.mapInArrow(run, "i long, y int, f binary").toArrow().to_pylist()
    rows_.sort(key=lambda r: (r["i"], r["f"]))
    x = np.array([np.frombuffer(r["f"]) for r in rows_]).reshape(-1, len(FEATURES))
    return train(x, np.array([r["y"] for r in rows_]))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, score of every row; the model is a few tables of fixed size; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(x))], ["doc_id", "score"])

    return texts(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidied(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Gam, least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least `least`; columns as given."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        model = held.value
        return lambda ts: model.score(np.array([features(t) for t in ts]).reshape(-1, len(FEATURES))) >= least

    return keep_rows(docs, judge)
