"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reads a text once. At each position its output links give every piece that ends there, longest first, and each
relaxes the best path to that position:

* unigram models: the best score at the piece's start plus the piece's score, as Viterbi does;
* BPE models: scores are merge ranks and don't add up, so the highest sum isn't what the merges give. There the path
  to a position is the one whose last two pieces stay apart when they are merged on their own. A sequence of pieces is the result of
  the merges exactly if each two neighbours are, so the single pass yields what merging yields, and the relaxation has one winner.

Pieces hold the space mark only in front, so a text falls apart before each run of marks; each part is encoded once
and held in a bounded cache. Characters in no piece become byte pieces where the model has them, else the unknown piece.

Only models with identity normalisation and no user-defined pieces are read; others raise ValueError. Defined results: null and empty
texts have no ids and decode to the empty text; a text that itself has U+2581 decodes with spaces in its place, as in the library. Every row,
repeated ones and those with a null id as well, gets a row; an empty table gives an empty one. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tidied, worker_cache

MARK = "▁"
#: Parts that are held, and the characters of the longest that is.
CACHE, SHORT = 250_000, 64


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message; a value is an int or bytes."""
    at, n = 0, len(data)

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < n:
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """A SentencePiece model read from its file's bytes."""

    def __init__(self, model: bytes):
        self.names, self.scores, self.kinds = [], [], []
        spec: dict = {}
        self.bpe = False
        for k, v in _fields(model):
            if k == 1:
                p = dict(_fields(v))
                self.names.append(p.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0)
                self.kinds.append(p.get(3, 1))
            elif k == 2:
                self.bpe = dict(_fields(v)).get(3, 1) == 2
            elif k == 3:
                spec = dict(_fields(v))
        if spec.get(2) or 4 in self.kinds:
            raise ValueError("only models with identity normalisation and without user-defined pieces are supported")
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.unk = self.kinds.index(2)
        self.bytes = {int(s[3:5], 16): i for i, (s, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == 6}
        self.id = {s: i for i, (s, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == 1}
        self.score = {s: self.scores[i] for s, i in self.id.items()}
        for s in self.id:
            if MARK in s.lstrip(MARK):
                raise ValueError("a piece has the space mark after another character")
        self.apart: dict[int, bool] = {}
        #: Of each piece that merging makes: the two parts of its last merge.
        self.halves: dict[str, tuple[str, str]] = {}
        self.auto = ahocorasick.Automaton()
        for s in self.id:
            if not self.bpe or self.merge(s) == [s]:
                self.auto.add_word(s, self.id[s] if self.bpe else s)
        #: Whether all characters of pieces are pieces: then no merge can take in a character that is none.
        self.closed = all(c in self.id for c in set("".join(self.id)))
        if self.bpe and not self.closed:
            raise ValueError("a character of a piece is no piece itself")
        self.length = [len(s) for s in self.names]
        #: Pieces whose parts have better scores than they, down to characters: their merges come in the order of scores.
        self.ordered: set[str] = set()
        for s in sorted(self.halves, key=len):
            if all(len(h) == 1 or h in self.ordered and self.score[h] > self.score[s] for h in self.halves[s]):
                self.ordered.add(s)
        self.auto.make_automaton()
        self.lone = min(self.score.values(), default=0.0) - 10
        back = [s.encode() for s in self.names]
        mark = MARK.encode()
        self.surface = [
            bytes([int(s[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else b.replace(mark, b" ")
            for s, k, b in zip(self.names, self.kinds, back, strict=True)
        ]
        pieces = self

        class Held(dict):
            def __missing__(self, part):
                out = array("i", (pieces.merged if pieces.bpe else pieces.best)(part)).tobytes()
                if len(part) <= SHORT:
                    if len(self) >= CACHE:
                        self.clear()
                    self[part] = out
                return out

        self.held = Held()

    def merge(self, text: str) -> list[str]:
        """Merging by definition: the pair of neighbours with the best score, the leftmost of equals, until none is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if len(parts) == 2:
                self.halves[text] = tuple(parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, i: int, j: int) -> bool:
        """Whether merging leaves the two pieces as they are."""
        a, b = self.names[i], self.names[j]
        if (len(a) == 1 or a in self.ordered) and (len(b) == 1 or b in self.ordered):
            out = self.undo(a, b)
        else:
            out = self.merge(a + b) == [a, b]
        if len(self.apart) >= CACHE:
            self.apart.clear()
        self.apart[i << 24 | j] = out
        return out

    def undo(self, a: str, b: str) -> bool:
        """stay_apart by undoing merges, the latest first: at no time may a merge over the border come before the next one beside it."""
        get, halves = self.score.get, self.halves
        if a + b in self.score:
            return False
        while len(a) > 1 or len(b) > 1:
            if len(b) == 1 or len(a) > 1 and get(a) < get(b):
                late, a = get(a), halves[a][1]
                over = get(a + b)
                if over is not None and over > late:
                    return False
            else:
                late, b = get(b), halves[b][0]
                over = get(a + b)
                if over is not None and over >= late:
                    return False
        return True

    def merged(self, part: str) -> list[int]:
        """Ids of a part under a BPE model."""
        n, length, stay, known = len(part), self.length, self.stay_apart, self.apart.get
        last, done = [-1] * n, -1
        for end, p in self.auto.iter(part):
            if end == done:
                continue
            start = end - length[p]
            if start >= 0 and (before := last[start]) >= 0:
                ok = known(before << 24 | p)
                if ok is None:
                    ok = stay(before, p)
                if not ok:
                    continue
            last[end], done = p, end
        out, at = [], n - 1
        while at >= 0:
            p = last[at]
            if p < 0:
                out += self.lone_ids(part[at])[::-1]
                at -= 1
            else:
                out.append(p)
                at -= length[p]
        out.reverse()
        return out if self.bytes else self.no_runs(out)

    def lone_ids(self, c: str) -> list[int]:
        """Ids of a character that is in no piece."""
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unk]

    def no_runs(self, ids: list[int]) -> list[int]:
        return [x for k, x in enumerate(ids) if x != self.unk or not k or ids[k - 1] != self.unk]

    def best(self, part: str) -> list[int]:
        """Ids of a part under a unigram model; of equal scores the longer last piece wins."""
        n, score = len(part), self.score
        best, last = [0.0] + [-1e300] * n, [""] * n
        at = 0

        def close(upto):
            """Characters that are no piece, up to a position."""
            for i in range(at, upto):
                if part[i] not in score and best[i] + self.lone > best[i + 1]:
                    best[i + 1], last[i] = best[i] + self.lone, part[i]

        for end, p in self.auto.iter(part):
            if end > at:
                close(end)
                at = end
            value = best[end + 1 - len(p)] + score[p]
            if value > best[end + 1]:
                best[end + 1], last[end] = value, p
        close(n)
        out, at = [], n
        while at:
            p = last[at - 1]
            out += [self.id[p]] if p in score else self.lone_ids(p)[::-1]
            at -= len(p)
        out.reverse()
        return out if self.bytes else self.no_runs(out)

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.prefix and text:
            text = " " + text
        parts = PARTS.findall(text.replace(" ", MARK))
        return np.frombuffer(b"".join(map(self.held.__getitem__, parts)), "<i4")

    def decode(self, ids) -> str:
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _pieces(held):
    model = held.value
    return worker_cache("pieces" + hashlib.sha256(model).hexdigest(), lambda: Pieces(model))


def encode(docs: DataFrame, model: bytes, with_ids: bool = True) -> DataFrame:
    """doc_id, n_chars, n_pieces, n_bytes (byte pieces), ids (unless left out), ids_sha256 (of little-endian int32), round_trip.

    The model (under 1 MB for 32,000 pieces) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        p = _pieces(held)
        is_byte = np.zeros(len(p.names), bool)
        is_byte[list(p.bytes.values())] = True
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            parts, offsets = [], [0]
            for t in b.column(1):
                t = (t.as_py() or b"").decode("utf-8", "replace")
                ids = p.encode(t)
                same = p.decode(ids.tolist()) == t.replace(MARK, " ")
                row = (len(t), len(ids), int(is_byte[ids].sum()), hashlib.sha256(ids.tobytes()).hexdigest(), same)
                for o, v in zip(out, row, strict=False):
                    o.append(v)
                if with_ids:
                    parts.append(ids)
                    offsets.append(offsets[-1] + len(ids))
            cols = [b.column(0), *(pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=False))]
            if with_ids:
                flat = np.concatenate(parts) if parts else np.array([], "<i4")
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_chars long, n_pieces long, n_bytes long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    names = [f.split()[0] for f in schema.split(", ")]
    return texts(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidied(run), schema)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """doc_id, text of rows of ids; null ids give the empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        p = _pieces(held)
        for b in batches:
            out = [p.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids)).mapInArrow(tidied(run), "doc_id long, text string")
