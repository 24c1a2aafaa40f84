"""License scans with a positional index of rare words.

The index holds, for each licence template, the positions of its rare words: those in few templates, so of high inverse document
frequency (IDF). Of a text, every word in the index is looked up, with all its positions, so what else the text holds can't crowd a notice out. A
posting at position p of a template and a text position t vote for the template standing at t - p; positions may slip by `SLACK` words, to
allow for changed names and years. Where a template gathers enough of its rare words (half of them, half of `RARE` at most), its mandatory key phrases
are looked for in the text between there and the template's end; only if all stand there, in order, does the template's label count. The score is the
share of the template's rare words found in place, the best over labels; it is 1 where a base phrase stands. Votes are counted and dropped every
`FLUSH` words, so that they stay few in long texts.

Defined results: null and empty texts have no words, no labels and score 0. Every row gives one row, repeated ones and those with a null id as well;
an empty table gives an empty one. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, texts, tidied

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
RARE, SLACK, SHARE, FLUSH = 24, 6, 0.5, 4096
#: label, notice, phrases that must stand in it (in order).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "sublicense and or sell")),
    ("mit", "Released under the MIT License", ("the mit license",)),
    ("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ("redistribution and use in source and binary forms", "must reproduce the above copyright notice")),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ("apache license version 2", "on an as is basis")),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2",)),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license as published by the free software foundation", "version 2")),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license as published by the free software foundation", "version 3")),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl-3", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ("mozilla public license v 2",)),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", ("eclipse public license 2",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights CC0 1.0 Universal", ("cc0 1 0 universal",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4",)),
)


class Index:
    """Positional postings of the rare words of licence templates."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        words = [(label, alnum_words(text.encode()), [alnum_words(p.encode()) for p in phrases]) for label, text, phrases in templates]
        within = Counter(w for _, ws, _ in words for w in set(ws))
        self.idf = {w: math.log(len(words) / n) for w, n in within.items()}
        self.postings: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        self.templates = []
        for t, (label, ws, phrases) in enumerate(words):
            # the rarest words of a template: its better half by IDF, three at least
            order = sorted(set(ws), key=lambda w: (-self.idf[w], w))
            rare = {w: 1 << k for k, w in enumerate(order[: max(3, len(order) // 2)])}
            for i, w in enumerate(ws):
                if w in rare:
                    self.postings[w].append((t, i, rare[w]))
            self.templates.append((label, len(ws), len(rare), [b" " + b" ".join(p) + b" " for p in phrases]))
        self.base = [(b" " + p.encode() + b" ", label) for p, label in base]

    def scan(self, text: bytes | None):
        """n_words, starts of base phrases, base labels, {label: score}."""
        words = alnum_words(text)
        if not words:
            return 0, [], set(), {}
        flat = b" " + b" ".join(words) + b" "
        starts, labels = [], set()
        for p, label in self.base:
            at, before, spaces = flat.find(p), 0, 0
            while at >= 0:
                spaces += flat.count(b" ", before, at)
                before = at
                starts.append(spaces)
                labels.add(label)
                at = flat.find(p, at + 1)
        out: dict[str, float] = {}
        if not self.postings.keys().isdisjoint(words):
            longest = max(length for _, length, _, _ in self.templates)
            # (template, cell): bits of the rare words seen there
            votes: dict[tuple[int, int], int] = {}
            for lo in range(0, len(words), FLUSH):
                for at, w in enumerate(words[lo : lo + FLUSH], lo):
                    for t, i, bit in self.postings.get(w, ()):
                        cell = (at - i) // SLACK
                        votes[t, cell] = votes.get((t, cell), 0) | bit
                        votes[t, cell + 1] = votes.get((t, cell + 1), 0) | bit
                # later words vote for cells from here on
                still = (lo + FLUSH - longest) // SLACK if lo + FLUSH < len(words) else math.inf
                self._judge(words, {k: v for k, v in votes.items() if k[1] < still}, out)
                votes = {k: v for k, v in votes.items() if k[1] >= still}
        for label in labels:
            out[label] = 1.0
        return len(words), sorted(starts), labels, out

    def _judge(self, words: list[bytes], votes: dict[tuple[int, int], int], out: dict[str, float]):
        """Adds to out the labels of templates that have enough votes in a cell, and their phrases there."""
        for (t, cell), bits in votes.items():
            label, length, rare, phrases = self.templates[t]
            seen = bits.bit_count()
            if seen >= max(1, SHARE * min(rare, RARE)) and out.get(label, 0.0) < seen / rare:
                lo = max(0, (cell - 1) * SLACK)
                part = b" " + b" ".join(words[lo : max(0, (cell + 1) * SLACK) + length + 2 * SLACK]) + b" "
                at = 0
                for p in phrases:
                    at = part.find(p, at)
                    if at < 0:
                        break
                else:
                    out[label] = seen / rare


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row; no shuffle."""

    def run(batches):
        index = Index(templates)
        for b in batches:
            rows = [index.scan(t.as_py()) for t in b.column(1)]
            cols = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([r[1][0] if r[1] else None for r in rows], pa.int64()),
                pa.array([r[1][-1] if r[1] else None for r in rows], pa.int64()),
                pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                pa.array([",".join(sorted(r[3])) for r in rows], pa.string()),
                pa.array([float(max(r[3].values(), default=0.0)) for r in rows], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [f.split()[0] for f in schema.split(", ")]
    return texts(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidied(run), schema)
