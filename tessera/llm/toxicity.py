"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed into three embedding tables at once, a word's vector being the three rows side by side, so that two words
share a whole vector only if they meet in all three. Filters of widths 1, 2 and 3 run over the words, each takes its maximum over
the whole text, and a logistic layer weighs the maxima. Only rows whose words go with the label in the sample (absolute score `LEAST` or more,
in `SEEN` texts or more) are trained; all other rows stay zero, so rare and new words say nothing, and a text's convolution is
computed only where a window holds a trained row. The maximum counts the empty window beside the text as well.

Training uses at most `ROWS` labelled rows, those with the smallest hash of doc_id, and of these, in that order, each that fits into
`CHARS` characters together with those taken before (so that the driver holds them); they are whole texts. A part of them (one in five) is not
trained on: a logistic fit on it makes scores probabilities, and the threshold of each language is the one of best F1 there (0.5 where a
language has fewer than `PER_LANG` toxic rows in it). A score never depends on lang; thresholds are applied afterwards.

Defined results: null and empty texts get the score of no words; rows with null labels or ids aren't learnt from; of labels that contradict each other
the larger counts; without both labels in the sample the score is the share of toxic rows (0.5 of none) everywhere. Every row, repeated ones and
those with a null id as well, gets a row; an empty table gives an empty one. Columns other than doc_id, text and lang aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, split_of, texts, tidied

ROWS, CHARS = 16_000, 100_000_000
TABLES, SIZE, DIM = 3, 1 << 17, 4
WIDTHS, FILTERS = (1, 2, 3), 8
LEAST, SEEN = 2.5, 3
EPOCHS, BATCH, RATE = 12, 64, 0.05
PER_LANG = 20


def hashes(text: bytes | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 7) for w in alnum_words(text)), np.uint64)


def buckets(h: np.ndarray) -> np.ndarray:
    """Rows of the three tables, one column a table."""
    return np.stack([(h >> np.uint64(20 * t)) & np.uint64(SIZE - 1) for t in range(TABLES)], axis=-1).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Net:
    """Embedding tables, filters, output weights; `live` marks the trained rows."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.emb = np.zeros((TABLES, SIZE, DIM), np.float32)
        self.live = np.zeros((TABLES, SIZE), bool)
        self.filters = [rng.normal(0, 0.3, (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base, self.scale, self.shift = 0.0, 1.0, 0.0
        self.constant: float | None = None
        self.lang: dict[str, float] = {}

    def sparse(self, h: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words, positions of words with a live row, their rows."""
        b = buckets(h)
        at = np.flatnonzero(np.logical_or.reduce([self.live[t, b[:, t]] for t in range(TABLES)])) if len(h) else np.array([], int)
        return len(h), at, b[at] if len(h) else np.zeros((0, TABLES), int)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.emb[t, rows[:, t]] for t in range(TABLES)], axis=1)

    def pooled(self, docs):
        """Maxima of each filter over each text, and what the backward pass needs."""
        big = max(WIDTHS)
        size = np.array([n + 2 * big for n, _, _ in docs])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.concatenate([a + s + big for (_, a, _), s in zip(docs, start, strict=True)]).astype(np.int64)
        rows = np.concatenate([r for _, _, r in docs])
        vec = np.concatenate([np.zeros((1, TABLES * DIM), np.float32), self.vectors(rows)])
        index = np.zeros(int(size.sum()) + big, np.int64)
        index[at] = np.arange(1, len(at) + 1)
        maxima, trace = [], []
        for k, w in enumerate(WIDTHS):
            spots = np.unique(np.concatenate([start, *[at - j for j in range(w)]]))
            ids = np.stack([index[spots + j] for j in range(w)])
            conv = self.bias[k] + sum(vec[ids[j]] @ self.filters[k][j] for j in range(w))
            first = np.searchsorted(spots, start)
            top = np.maximum.reduceat(conv, first)
            lengths = np.diff(np.append(first, len(spots)))
            place = np.where(conv == np.repeat(top, lengths, axis=0), np.arange(len(spots))[:, None], len(spots))
            maxima.append(top)
            trace.append((ids, np.minimum.reduceat(place, first)))
        return np.maximum(np.concatenate(maxima, axis=1), 0), trace, vec, rows

    def logits(self, docs) -> np.ndarray:
        return self.pooled(docs)[0] @ self.out + self.base

    def gradients(self, docs, y: np.ndarray):
        """Of the mean log loss: by the logit, summed; by parameter; by the vectors of the texts' live words, with their rows."""
        pool, trace, vec, rows = self.pooled(docs)
        err = ((sigmoid(pool @ self.out + self.base) - y) / len(docs)).astype(np.float32)
        grads = {"out": pool.T @ err, "bias": np.zeros_like(self.bias)}
        back = np.outer(err, self.out) * (pool > 0)
        gvec = np.zeros_like(vec)
        for k, (ids, top) in enumerate(trace):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads["bias"][k] = g.sum(0)
            gf = np.zeros_like(self.filters[k])
            for j in range(WIDTHS[k]):
                who = ids[j][top]
                for f in range(FILTERS):
                    gf[j, :, f] = g[:, f] @ vec[who[:, f]]
                    np.add.at(gvec, who[:, f], np.outer(g[:, f], self.filters[k][j][:, f]))
            grads[f"f{k}"] = gf
        return float(err.sum()), grads, gvec[1:], rows

    def fit(self, docs, y, epochs=EPOCHS, rate=RATE, seed=5):
        rng = np.random.default_rng(seed)
        params = {"out": self.out, "bias": self.bias, **{f"f{k}": f for k, f in enumerate(self.filters)}}
        sums = {k: np.full_like(v, 1e-2) for k, v in params.items()} | {"emb": np.full((TABLES, SIZE), 1e-2, np.float32)}
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        base_sum = 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                err, grads, gvec, rows = self.gradients([docs[i] for i in part], y[part])
                grads["out"] += 1e-5 * self.out
                for k, p in params.items():
                    sums[k] += grads[k] ** 2
                    p -= rate * grads[k] / np.sqrt(sums[k])
                base_sum += err**2
                self.base -= rate * err / base_sum**0.5
                for t in range(TABLES):
                    g = gvec[:, t * DIM : (t + 1) * DIM]
                    r, inv = np.unique(rows[:, t], return_inverse=True)
                    total = np.zeros((len(r), DIM), np.float32)
                    np.add.at(total, inv, g)
                    total[~self.live[t, r]] = 0
                    sums["emb"][t, r] += (total**2).mean(1)
                    self.emb[t, r] -= rate * total / np.sqrt(sums["emb"][t, r])[:, None]


def seed_rows(net: Net, hs: list[np.ndarray], y: np.ndarray) -> None:
    """Mark the rows that go with the label, and start them by how strongly they do."""
    rng = np.random.default_rng(3)
    p = y.mean()
    for t in range(TABLES):
        seen, toxic = np.zeros(SIZE), np.zeros(SIZE)
        for h, label in zip(hs, y, strict=True):
            u = np.unique(((h >> np.uint64(20 * t)) & np.uint64(SIZE - 1)).astype(np.int64))
            seen[u] += 1
            if label:
                toxic[u] += 1
        z = (toxic - p * seen) / np.sqrt(p * (1 - p) * seen + 1)
        net.live[t] = (seen >= SEEN) & (np.abs(z) >= LEAST)
        net.emb[t, net.live[t]] = rng.normal(0, 0.05, (int(net.live[t].sum()), DIM))
        net.emb[t, :, 0] += np.where(net.live[t], np.tanh(z / 6), 0)


def train(hs: list[np.ndarray], y: np.ndarray, lang: list[str | None]) -> Net:
    net = Net()
    y = np.asarray(y, np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    held = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~held)
    if y[learn].min() == y[learn].max() or not held.any():
        learn, held = np.arange(len(y)), np.zeros(len(y), bool)
    for f in net.filters:
        f[:, ::DIM, :] = np.abs(f[:, ::DIM, :])
    seed_rows(net, [hs[i] for i in learn], y[learn])
    net.fit([net.sparse(hs[i]) for i in learn], y[learn])
    if held.any():
        rest = np.flatnonzero(held)
        x, t = net.logits([net.sparse(hs[i]) for i in rest]), y[rest]
        if t.min() < t.max():
            a, b = 1.0, 0.0
            for _ in range(50):  # Newton steps with a weak prior at a = 1, b = 0
                p = sigmoid(a * x + b)
                w = p * (1 - p) + 1e-9
                g = np.array([((p - t) * x).sum() + (a - 1), (p - t).sum() + b])
                hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
                a, b = np.array([a, b]) - np.linalg.solve(hess, g)
            net.scale, net.shift = max(float(a), 0.05), float(b)
            s = sigmoid(net.scale * x + net.shift)
            names = np.array([x or "" for x in lang], object)[rest]
            for name in set(names):
                own = names == name
                if t[own].sum() >= PER_LANG:
                    cuts = np.unique(np.round(s[own], 3))
                    f1 = [2 * (t[own] * (s[own] >= c)).sum() / max(1.0, t[own].sum() + (s[own] >= c).sum()) for c in cuts]
                    net.lang[name] = float(cuts[int(np.argmax(f1))])
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, held_out) -> DataFrame:
    """i, y, lang, text (as bytes) of the rows to learn from: those of at most `rows` labelled ids, the ones with the smallest hash.

    The ids are bounded by `rows`, so they are broadcast and the texts aren't shuffled.
    """
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = ids.orderBy(F.xxhash64("i"), "i").limit(rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("i"), lang.alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.join(F.broadcast(ids), "i").select("i", "y", "lang", "text")


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, out: int = 0, rows: int = ROWS) -> Net:
    """A net learnt from labelled rows whose crc32(doc_id as text) mod `mod` isn't `out`."""
    rows_ = sample(docs, labels, "toxic", rows, split_of("doc_id", mod) == out)
    sizes = rows_.groupBy("i").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"), F.min(F.xxhash64("i")).alias("h")).toArrow().to_pylist()
    total, chosen = 0, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["i"])):
        if total + r["n"] <= CHARS:
            total += r["n"]
            chosen.append((r["i"],))
    if len(chosen) < len(sizes):
        rows_ = rows_.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "i long")), "i", "left_semi").select("i", "y", "lang", "text")

    def run(batches):
        for b in batches:
            h = [hashes(t.as_py()).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(h, pa.binary())], ["i", "y", "lang", "h"])

    got = rows_.mapInArrow(tidied(run), "i long, y int, lang string, h binary").toArrow().to_pylist()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["i"]).encode()), r["i"], r["h"]))
    return train([np.frombuffer(r["h"], np.uint64) for r in got], np.array([r["y"] for r in got]), [r["lang"] for r in got])


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, lang, score (0 to 1), lang_threshold, flagged of every row; no shuffle. The net is a few MB, whatever the corpus."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches):
        net = held.value
        digest = xxhash.xxh64_intdigest
        rows = [np.zeros(TABLES, np.int64)]

        known: dict[bytes, int] = {}

        def learn(words):
            """Files new words: 0 for those without a live row, else the number of their rows."""
            new = [w for w in set(words) if w not in known]
            if not new:
                return
            if len(known) + len(new) > 400_000:
                known.clear()
                del rows[1:]
                new = list(set(words))
            known.update(dict.fromkeys(new, 0))
            _, at, r = net.sparse(np.fromiter((digest(w, 7) for w in new), np.uint64, len(new)))
            for k, row in zip(at, r, strict=True):
                known[new[k]] = len(rows)
                rows.append(row)

        for b in batches:
            scores = np.empty(b.num_rows)
            docs_, where = [], []

            def flush():
                if docs_:
                    scores[where] = sigmoid(net.scale * net.logits(docs_) + net.shift)
                    docs_.clear()
                    where.clear()

            for i, t in enumerate(b.column(2)):
                words = alnum_words(t.as_py())
                learn(words)
                ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                at = np.flatnonzero(ids)
                docs_.append((len(words), at, np.array([rows[k] for k in ids[at]], np.int64).reshape(-1, TABLES)))
                where.append(i)
                if len(docs_) == 128:
                    flush()
            flush()
            if net.constant is not None:
                scores[:] = net.constant
            names = b.column(1).to_pylist()
            cut = np.array([net.lang.get(x or "", 0.5) for x in names])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores), pa.array(cut), pa.array(scores >= cut)],
                ["doc_id", "lang", "score", "lang_threshold", "flagged"],
            )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    return src.mapInArrow(tidied(run), "doc_id long, lang string, score double, lang_threshold double, flagged boolean")
