"""Language-model scores by context-tree weighting (CTW) over bytes.

A text is read as its words, lower-cased, joined by single spaces and closed by a line feed, after `depth` line feeds of context. Each
byte is eight binary decisions; each decision (the bits of the byte so far) has a context tree over the bytes before. A node at depth d holds the
Krichevsky-Trofimov estimate of its zeros and ones; CTW mixes, at every node, that estimate with what the deeper nodes say, by the weights
that the training texts give: P = (KT block probability + product of the children's) / 2. The tree is counted over all training texts,
then frozen; a decision's probability is the mixture along the path of its context, a node without data at its end says 1/2. The
code length per byte is minus the base-2 logarithm of a text's probability over its bytes, the closing one included.

How it runs. One pass counts words and (depth + 1)-byte strings of the training rows, summed within tasks first, then by key over the cluster; what
is gathered grows with the corpus. Strings are dealt to units of about `UNIT` by the two bytes before the last, which all deeper nodes of a path
share, so that each unit's tree is built by itself, in a task. Only nodes of depth 0 and 1 lie in several units: at most 65,536 by their byte
and bits, their sums go to the driver and back. Two kinds of strings are priced in two ways, as are words:

* those with more than a 2**-22 share of the training bytes (words: a 2**-20 share of the tokens) can't be more than 2**22 (2**20); their
  prices are broadcast, and the one pass over the texts sums them up there;
* all others are packed by that pass, unit by unit, and sent to the unit's tree, which is streamed the packs of its strings and prices them.
  A unit that many packs ask for is built in several tasks, each with a share of the packs.

So the driver holds no tree, no table but the bounded ones, and each text is read once to count and once to score.

Defined results: null and empty texts have the end token only; a null doc_id counts as the empty text when rows are dealt; repeated rows each
get their row; without training rows every probability is 1/2 a bit, and base is log10(0.1 / 0.1). Columns of docs other than doc_id and text
(and those that `train` names) are neither read nor returned, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, space_words, split_of, tidied

DEPTH = 5
UNIT = 100_000
#: Shares of the training tokens and bytes above which a word or string is priced by broadcast.
HEAVY, HEAVY_STRINGS = 1 << 20, 1 << 22
#: Positions that a unit's task is sent, about; a unit with more is built in several tasks.
ASKED = 20_000_000
END = b"\n"  # can't be part of a word
PIECE = 2 << 20
HALF = np.log10(0.5)


def normal(text: bytes | None) -> tuple[list[bytes], bytes]:
    words = space_words(text)
    return words, b" ".join(words) + END


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """Codes of all (depth + 1)-byte strings, the last byte lowest."""
    n = len(data) - depth
    code = np.zeros(max(n, 0), np.uint64)
    for i in range(depth + 1):
        code <<= np.uint64(8)
        code |= data[i : n + i]
    return code


def joined(texts_: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts' strings, one text after the other, and each text's number of them."""
    code = grams(np.frombuffer(b"".join(END * depth + t for t in texts_), np.uint8), depth)
    size = np.array([len(t) for t in texts_])
    start = np.concatenate([[0], np.cumsum(size + depth)[:-1]])
    keep = np.ones(len(code), bool)
    for s in start[1:]:
        keep[s - depth : s] = False  # strings that end in a later text's padding
    return code[keep], size


def merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.concatenate(codes), np.concatenate(counts)
    o = np.argsort(c, kind="stable")
    c, n = c[o], n[o]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.array([], int)
    return c[first], np.add.reduceat(n, first) if len(c) else n


def count(docs: DataFrame, depth: int) -> DataFrame:
    """kind (0 a word, 1 a string), key, n over the rows of docs."""

    def run(batches):
        words: Counter = Counter()
        codes, counts, held, texts_, size = [], [], 0, [], 0

        def rows(kind, keys, ns):
            for lo in range(0, len(keys), 100_000):
                part = keys[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.binary()), pa.array(ns[lo : lo + 100_000], pa.int64())], ["kind", "key", "n"]
                )

        def strings():
            if codes:
                c, n = merge(codes, counts)
                raw = c.astype(">u8").tobytes()
                yield from rows(1, [raw[i : i + 8] for i in range(0, len(raw), 8)], n)
                codes.clear()
                counts.clear()

        def take():
            nonlocal size, held
            if texts_:
                c, n = np.unique(joined(texts_, depth)[0], return_counts=True)
                codes.append(c)
                counts.append(n)
                held += len(c)
                texts_.clear()
                size = 0

        for b in batches:
            for t in b.column(0):
                ws, text = normal(t.as_py())
                words.update(ws)
                words[END] += 1
                texts_.append(text)
                size += len(text)
                if size > PIECE:
                    take()
                    if held > 3_000_000:
                        merged = merge(codes, counts)
                        codes[:], counts[:] = [merged[0]], [merged[1]]
                        held = len(merged[0])
                        if held > 1_500_000:
                            yield from strings()
                            held = 0
                if len(words) > 300_000:
                    yield from rows(0, list(words), list(words.values()))
                    words.clear()
        take()
        yield from strings()
        yield from rows(0, list(words), list(words.values()))

    src = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    return src.mapInArrow(tidied(run), "kind int, key binary, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1/2."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    i = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - i * (1 / 360 - i / 1260)) / y


def kt(n0, n1):
    """Natural logarithm of the KT block probability."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """Nodes of one depth: sorted keys (context and bits so far, then the number of bits), zeros and ones."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        keys, zeros, ones = [], [], []
        for bit in range(8):
            p = (code >> np.uint64(8 - bit) << np.uint64(3)) | np.uint64(bit)
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            one = ((code >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            keys.append(p[first])
            zeros.append(np.add.reduceat(np.where(one, 0, n), first))
            ones.append(np.add.reduceat(np.where(one, n, 0), first))
        key = np.concatenate(keys)
        o = np.argsort(key, kind="stable")
        self.key, self.zeros, self.ones = key[o], np.concatenate(zeros)[o].astype(float), np.concatenate(ones)[o].astype(float)

    def at(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return i, self.key[i] == key


def parent(key: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the nodes above, at `depth`: the oldest byte of the context goes."""
    bit = key & np.uint64(7)
    mask = (np.uint64(1) << (np.uint64(8 * depth) + bit)) - np.uint64(1)
    return ((key >> np.uint64(3)) & mask) << np.uint64(3) | bit


def levels(code: np.ndarray, n: np.ndarray, depths) -> dict[int, Level]:
    out = {}
    for d in sorted(depths, reverse=True):
        code, n = merge([code & np.uint64((1 << 8 * (d + 1)) - 1)], [n])
        out[d] = Level(code, n)
    return out


class Tree:
    """All nodes of one part, with what a decision that ends at each has gathered: `s` for a one, `r` the weight left for deeper nodes.

    upper: nodes of depth 0 and 1 over all parts, as (keys, s, r); see `roots`.
    """

    def __init__(self, code, n, depth: int):
        self.depth, self.code = depth, code
        self.levels = levels(code, n, range(min(2, depth), depth + 1))
        self.low = min(self.levels)
        below = None
        for d in range(depth, self.low - 1, -1):
            below = self.weigh(self.levels[d], d, below)
        top = self.levels[self.low]
        self.up = None
        if self.low:  # summed by the node above, of which there are few
            key, log = parent(top.key, self.low - 1), top.log
            o = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[o]) != 0]))
            self.up = (key[o][first], np.add.reduceat(log[o], first))

    @classmethod
    def bare(cls, depth: int, upper: dict[int, Level]) -> Tree:
        """A tree of the shared nodes only."""
        tree = cls.__new__(cls)
        none = (np.array([np.iinfo(np.uint64).max], np.uint64), np.zeros(1, np.float32), np.zeros(1, np.float32))
        tree.depth, tree.nodes = depth, {d: none for d in range(depth + 1)} | {d: (v.key, v.s, v.r) for d, v in upper.items()}
        return tree

    @staticmethod
    def weigh(level: Level, d: int, below) -> tuple[np.ndarray, np.ndarray]:
        """Sets log (weighted block probability) and w (the own estimate's share) of the nodes; returns their parents and logs."""
        own = kt(level.zeros, level.ones)
        if below is None:
            level.log, level.w = own, np.ones_like(own)
        else:
            deep = np.bincount(level.at(below[0])[0], below[1], len(level.key))
            level.log = np.logaddexp(own, deep) - np.log(2)
            level.w = 1 / (1 + np.exp(np.clip(deep - own, -700, 700)))
        return (parent(level.key, d - 1) if d else None), level.log

    def spread(self, level: Level, d: int, above: Level | None) -> None:
        one = (level.ones + 0.5) / (level.zeros + level.ones + 1)
        if above is None:
            s, r = np.zeros(len(one)), np.ones(len(one))
        else:
            i = above.at(parent(level.key, d - 1))[0]
            s, r = above.s[i], above.r[i]
        level.s, level.r = (s + r * level.w * one).astype(np.float32), (r * (1 - level.w)).astype(np.float32)
        del level.zeros, level.ones, level.log, level.w

    def finish(self, upper: dict[int, Level]) -> None:
        """Probabilities down the tree; then log10 of each string's last byte."""
        self.levels |= upper
        for d in range(self.low, self.depth + 1):
            self.spread(self.levels[d], d, self.levels.get(d - 1))
        self.logs = self.price(self.code).astype(np.float32)
        keep = {}
        for d, x in self.levels.items():
            keep[d] = (x.key, x.s, x.r)
        self.nodes = keep
        del self.levels

    def nodes_of(self, d: int):
        if hasattr(self, "nodes"):
            return self.nodes[d]
        x = self.levels[d]
        return x.key, x.s, x.r

    def price(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte in the context of the others."""
        out = np.zeros(len(code))
        for bit in range(8):
            one = np.full(len(code), 0.5)
            todo = np.arange(len(code))
            for d in range(self.depth + 1):
                key, s, r = self.nodes_of(d)
                k = ((code[todo] & np.uint64((1 << 8 * (d + 1)) - 1)) >> np.uint64(8 - bit) << np.uint64(3)) | np.uint64(bit)
                i = np.minimum(np.searchsorted(key, k), len(key) - 1)
                seen = key[i] == k
                todo, i = todo[seen], i[seen]
                if not len(todo):
                    break
                one[todo] = s[i] if d == self.depth else s[i] + 0.5 * r[i]
            is_one = ((code >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            out += np.log10(np.where(is_one, one, 1 - one))
        return out


def roots(trees_up: list, code_counts: list, depth: int) -> dict[int, Level]:
    """Nodes of depth 0 and 1, which all parts share (at most 65,536 by 255): counts and block probabilities of all parts, summed."""
    low = min(2, depth)
    if low == 0:
        return {}
    code, n = merge([c for c, _ in code_counts], [n for _, n in code_counts])
    out = levels(code, n, range(low))
    below = (np.concatenate([k for k, _ in trees_up]), np.concatenate([x for _, x in trees_up]))
    for d in range(low - 1, -1, -1):
        below = Tree.weigh(out[d], d, below)
    return out


def unit_of(code, units: int):
    """The unit of strings: by the two bytes before the last, for numpy arrays."""
    return ((code >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) % np.uint64(65536) % np.uint64(units)


def raw(a: np.ndarray, kind: str) -> bytes:
    return a.astype(kind).tobytes()


class Model:
    """The counted strings by units, and the nodes that units share.

    units: table of unit, code, n (packed arrays), written to the shared folder; upper: nodes of depth 0 and 1; least: a string seen more
    often than that is priced by broadcast.
    """

    def __init__(self, strings: DataFrame, depth: int = DEPTH, unit: int = UNIT):
        self.depth = depth
        number = F.conv(F.hex("key"), 16, 10).cast("long").alias("code")
        rows = strings.select(number, "n")
        total, size = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.count, self.least = max(1, -(-total // unit)), size / HEAVY_STRINGS
        n_units, least = self.count, self.least
        by = (F.shiftright("code", 8).bitwiseAND(0xFFFF) * 40503 % 65536 % n_units).cast("int").alias("unit")

        def pack(t: pa.Table) -> pa.Table:
            code, n = merge([t.column("code").to_numpy().astype(np.uint64)], [t.column("n").to_numpy()])
            up = Tree(code, n.astype(float), depth).up
            key, log = up if up is not None else (np.array([], np.uint64), np.array([], float))
            asked = int(n[n <= least].sum())
            return pa.table(
                {
                    "unit": pa.array([t.column("unit")[0].as_py()], pa.int32()),
                    "code": pa.array([raw(code, "<u8")], pa.binary()),
                    "n": pa.array([raw(n, "<i8")], pa.binary()),
                    "key": pa.array([raw(key, "<u8")], pa.binary()),
                    "log": pa.array([raw(log, "<f8")], pa.binary()),
                    "asked": pa.array([asked], pa.int64()),
                }
            )

        packed = rows.select(by, "code", "n").groupBy("unit").applyInArrow(pack, "unit int, code binary, n binary, key binary, log binary, asked long")
        self.units = cut(packed)
        self.upper = self.shared(rows)

    def shared(self, rows: DataFrame) -> dict[int, Level]:
        """Nodes of depth 0 and 1, from the sums over units of what their children say."""
        low = min(2, self.depth)
        if not low:
            return {}

        def unpack(batches):
            for b in batches:
                for key, log in zip(b.column(0), b.column(1), strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.frombuffer(key.as_py(), "<i8"), pa.int64()), pa.array(np.frombuffer(log.as_py(), "<f8"), pa.float64())], ["key", "log"]
                    )

        ups = self.units.select("key", "log").mapInArrow(unpack, "key long, log double").groupBy("key").agg(F.sum("log").alias("log")).toArrow()
        ends = rows.groupBy(F.col("code").bitwiseAND((1 << 8 * low) - 1).alias("code")).agg(F.sum("n").alias("n")).toArrow()
        if not ends.num_rows:
            return {}
        up = (ups.column("key").to_numpy().astype(np.uint64), ups.column("log").to_numpy())
        upper = roots([up], [(ends.column("code").to_numpy().astype(np.uint64), ends.column("n").to_numpy().astype(float))], self.depth)
        for d in sorted(upper):
            Tree.spread(None, upper[d], d, upper.get(d - 1))
        return upper

    def tree(self, code: bytes, n: bytes, upper: dict[int, Level]) -> tuple[Tree, np.ndarray]:
        """A unit's finished tree, and how often each of its strings was counted."""
        n_ = np.frombuffer(n, "<i8").astype(float)
        tree = Tree(np.frombuffer(code, "<u8"), n_, self.depth)
        tree.finish(dict(upper))
        return tree, n_

    def heavy(self, shared) -> tuple[np.ndarray, np.ndarray]:
        """Codes and prices of the strings above the share; their number is bounded by HEAVY_STRINGS."""
        model, least = _Light(self.depth), self.least

        def run(batches):
            for b in batches:
                for code, n in zip(b.column(0), b.column(1), strict=True):
                    n_ = np.frombuffer(n.as_py(), "<i8")
                    often = n_ > least
                    if not often.any():
                        continue
                    tree = model.tree(code.as_py(), n.as_py(), shared.value)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([raw(tree.code[often], "<u8")], pa.binary()), pa.array([raw(tree.logs[often], "<f4")], pa.binary())], ["code", "log"])

        got = self.units.select("code", "n").repartition(self.count).mapInArrow(tidied(run), "code binary, log binary").toArrow()
        return np.frombuffer(b"".join(got.column("code").to_pylist()), "<u8"), np.frombuffer(b"".join(got.column("log").to_pylist()), "<f4")


class _Light(Model):
    """What tasks need of a model."""

    def __init__(self, depth: int):
        self.depth = depth


class Table:
    """Open-addressing lookup from codes to prices, probed for whole arrays at once."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(2 * len(code)).bit_length())
        size = 1 << self.bits
        self.key, self.value = np.full(size, np.iinfo(np.uint64).max, np.uint64), np.zeros(size, np.float32)
        at, todo = self.slot(code), np.arange(len(code))
        while len(todo):
            free = self.key[at] == np.iinfo(np.uint64).max
            put = todo[free]
            self.key[at[free]] = code[put]
            won = self.key[at] == code[todo]
            self.value[at[won]] = value[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (size - 1)

    def slot(self, code):
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the positions of codes that aren't there."""
        at = self.slot(code)
        found = self.key[at]
        out = self.value[at].astype(float)
        todo = np.flatnonzero(found != code)
        lost, size = [], len(self.key)
        while len(todo):
            empty = self.key[at[todo]] == np.iinfo(np.uint64).max
            lost.append(todo[empty])
            todo = todo[~empty]
            at[todo] = (at[todo] + 1) & (size - 1)
            hit = self.key[at[todo]] == code[todo]
            out[todo[hit]] = self.value[at[todo[hit]]]
            todo = todo[~hit]
        return out, np.concatenate(lost) if lost else np.array([], int)


def codes_of(body: bytes, depth: int):
    """Codes of a text's strings, in slices of bounded size."""
    data = END * depth + body
    for lo in range(0, len(body), PIECE):
        yield grams(np.frombuffer(data[lo : lo + PIECE + depth], np.uint8), depth)


LINES = "row long, doc_id long, n_tokens long, known long, base double, score double, n_bytes long, word binary, times long, unit int, slot int, codes binary, rows binary"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
NAMES = [f.split()[0] for f in LINES.split(", ")]


def lines(src: DataFrame, words, strings, slots, smooth: float, depth: int, units: int) -> DataFrame:
    """Three kinds of lines, with nulls elsewhere: one for each row, one for each of its words that isn't in words, packs of strings that aren't in strings.

    words, strings, slots: broadcast {word: n}, (codes, prices), tasks of each unit.
    """

    def run(batches):
        known, slots_ = words.value, slots.value
        table = Table(*strings.value)

        class Logs(dict):
            def __missing__(self, n):
                out = self[n] = float(np.log10((n + 0.1) / smooth))
                return out

        log10 = Logs()
        turn = 0

        def batch(cols):
            n = max(map(len, cols.values()))
            return pa.RecordBatch.from_arrays([pa.array(cols[x], t) if x in cols else pa.nulls(n, t) for x, t in zip(NAMES, KINDS, strict=True)], NAMES)

        def emit(ids, bodies, word_lists):
            nonlocal turn
            sums, size = np.zeros(len(ids)), [len(x) for x in bodies]
            codes, rows = [], []

            short = [k for k, n in enumerate(size) if n <= PIECE]
            if short:
                code, n = joined([bodies[k] for k in short], depth)
                value, lost = table.get(code)
                value[lost] = 0
                sums[short] = np.add.reduceat(value, np.concatenate([[0], np.cumsum(n)[:-1]]))
                codes.append(code[lost])
                rows.append(np.repeat(short, n)[lost])
            for k, n in enumerate(size):
                if n > PIECE:
                    for code in codes_of(bodies[k], depth):
                        value, lost = table.get(code)
                        value[lost] = 0
                        sums[k] += value.sum()
                        codes.append(code[lost])
                        rows.append(np.full(len(lost), k))
            tokens, known_n, base, tail = [], [], [], ([], [], [])
            for (row, _), ws in zip(ids, word_lists, strict=True):
                own = Counter(ws)
                own[END] += 1
                k, x = 0, 0.0
                for w, c in own.items():
                    n = known.get(w)
                    if n is None:
                        tail[0].append(row)
                        tail[1].append(w)
                        tail[2].append(c)
                    else:
                        k += c
                        x += c * log10[n]
                tokens.append(len(ws) + 1)
                known_n.append(k)
                base.append(x)
            number = np.array([r for r, _ in ids], np.int64)
            yield batch({"row": number, "doc_id": [d for _, d in ids], "n_tokens": tokens, "known": known_n, "base": base, "score": sums, "n_bytes": size})
            if tail[0]:
                yield batch({"row": tail[0], "word": tail[1], "times": tail[2]})
            code, row = np.concatenate(codes), number[np.concatenate(rows).astype(np.int64)]
            if len(code):
                unit = unit_of(code, units).astype(np.int64)
                o = np.lexsort((code, unit))
                code, row, unit = code[o], row[o], unit[o]
                first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
                ends = np.append(first[1:], len(unit))
                turn += 1
                yield batch(
                    {
                        "unit": unit[first],
                        "slot": [turn % slots_.get(int(u), 1) for u in unit[first]],
                        "codes": [raw(code[a:b], "<u8") for a, b in zip(first, ends, strict=True)],
                        "rows": [raw(row[a:b], "<i8") for a, b in zip(first, ends, strict=True)],
                    }
                )

        for b in batches:
            ids, bodies, lists, size = [], [], [], 0
            for row, doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ws, body = normal(t.as_py())
                ids.append((row, doc))
                bodies.append(body)
                lists.append(ws)
                size += len(body)
                if size > PIECE // 2:
                    yield from emit(ids, bodies, lists)
                    ids, bodies, lists, size = [], [], [], 0
            if ids:
                yield from emit(ids, bodies, lists)

    return src.mapInArrow(tidied(run), LINES)


def answers(model: Model, packs: DataFrame, slots: dict[int, int], shared) -> DataFrame:
    """row, score: sums of the prices of packed strings. In each task a unit's tree comes first, then the packs that ask for it, one after the other."""
    spark = packs.sparkSession
    light = _Light(model.depth)
    many = F.create_map(*[F.lit(x) for kv in slots.items() for x in kv])[F.col("unit")] if slots else F.lit(None).cast("int")
    trees = model.units.select("unit", F.explode(F.sequence(F.lit(0), F.coalesce(many, F.lit(1)) - 1)).alias("slot"), F.lit(0).alias("kind"), F.col("code").alias("a"), F.col("n").alias("b"))
    asked = packs.select("unit", "slot", F.lit(1).alias("kind"), F.col("codes").alias("a"), F.col("rows").alias("b"))

    def run(batches):
        at, tree, table = None, None, None
        for b in batches:
            for unit, slot, kind, x, y in zip(*(b.column(i) for i in range(5)), strict=True):
                here = (unit.as_py(), slot.as_py())
                if here != at:
                    at, tree, table = here, None, None
                if kind.as_py() == 0:
                    tree = light.tree(x.as_py(), y.as_py(), shared.value)[0]
                    table = Table(tree.code, tree.logs)
                    continue
                code, row = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<i8")
                if tree is None:  # a unit that no training string fell in: only the shared nodes say anything
                    tree, table = Tree.bare(light.depth, shared.value), Table(np.array([], np.uint64), np.array([], np.float32))
                value, lost = table.get(code)
                if len(lost):
                    u, back = np.unique(code[lost], return_inverse=True)
                    value[lost] = tree.price(u)[back]
                rows, back = np.unique(row, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.bincount(back, value), pa.float64())], ["row", "score"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), model.count)
    sent = trees.unionByName(asked).repartition(n, "unit", "slot").sortWithinPartitions("unit", "slot", "kind")
    return sent.mapInArrow(tidied(run), "row long, score double")


def score(docs: DataFrame, train, depth: int = DEPTH, unit: int = UNIT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row of docs, learning from rows where `train` holds."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    counts = cut(count(docs.filter(train), depth), "kind")
    words, strings = counts.filter("kind = 0").select("key", "n"), counts.filter("kind = 1").select("key", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = (F.col("n") > total / HEAVY) & (F.length("key") <= 64)
    heavy = {bytes(r["key"]): r["n"] for r in words.filter(often).toLocalIterator()}
    rest = words.filter(~often)
    smooth = total + 0.1 * (kinds + 1)
    model = Model(strings, depth, unit)
    shared = sc.broadcast(model.upper)
    slots = {r["unit"]: r["n"] for r in model.units.select("unit", F.ceil(F.col("asked") / ASKED).cast("int").alias("n")).filter("n > 1").collect()}
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    # Written once: all that follows joins by the row numbers that stand there.
    told = cut(lines(src, sc.broadcast(heavy), sc.broadcast(model.heavy(shared)), sc.broadcast(slots), smooth, depth, model.count))
    nothing = {"known": F.lit(0).cast("long"), "base": F.lit(0.0), "score": F.lit(0.0)}
    leads = told.filter("n_tokens IS NOT NULL").select("row", "doc_id", "n_tokens", "n_bytes", "known", "base", "score")
    new = F.coalesce(F.col("n"), F.lit(0))
    tail = told.filter("word IS NOT NULL").select("row", "word", "times").join(rest.select(F.col("key").alias("word"), "n"), "word", "left")
    tail = tail.select("row", F.when(new > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10((new + 0.1) / F.lit(smooth))).alias("base"))
    more = answers(model, told.filter("unit IS NOT NULL").select("unit", "slot", "codes", "rows"), slots, shared)
    parts = leads.unionByName(tail.withColumn("score", nothing["score"]), allowMissingColumns=True)
    parts = parts.unionByName(more.withColumn("known", nothing["known"]).withColumn("base", nothing["base"]), allowMissingColumns=True)
    out = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
        F.max("n_bytes").alias("n_bytes"),
    )
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")
    return out.drop("row").withColumn("bits_per_byte", bits)


def held_out(mod: int = 10, out: int = 0):
    return split_of("doc_id", mod) == out
