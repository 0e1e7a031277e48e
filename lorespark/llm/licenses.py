"""License scan: which license notices a text contains.

A template is a notice, as the set of its five-word shingles over n consecutive places. A text contains it if some n
consecutive shingles of the text have at least 0.8 of the set (containment). Words are runs of ASCII letters, ASCII
digits and characters beyond ASCII; A-Z count as a-z.

Windows over the text overlap: they have n + s - 1 shingles and start every s, with s about n / 8, so that each run of n
shingles lies wholly in one of them. A window around a contained notice is similar to the template by at least
0.8 m / (n + s - 1 + 0.2 m), where m is the size of the set; the number of MinHash bands follows from that, so that such
a window meets its template in a band with probability 1 - 1e-4 at least. Templates met in a band are verified exactly,
on words, over the whole document.

The templates go to every task; they are taken in blocks of at most `most_bytes`, one scan for each block. A document is
scanned in the task that reads it: nothing is shuffled, and copies or common lines gather nowhere.

Defined cases: a null text, and one without words, contains nothing; so does an empty table. Rows are judged
one by one, so repeated rows give repeated results; a null id stays null. A template of fewer than five words is one
shingle of all its words, one without words is never found. Of equally good places the first counts. A text may contain
several templates. Further input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorespark.llm.common import id_and_text, rolling, scanned, slices, texts

SHINGLE = 5
#: Shingles whose windows are signed at once.
BLOCK = 1 << 17
NONE = np.uint32(0xFFFFFFFF)
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
#: Upper case becomes lower case; what is no word becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in _PLAIN)

# Customary notices of public licenses.
NOTICES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Released under the Apache License 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    ),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    ("BSD", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal"),
)


def needed_bands(similarity: float, rows: int, miss: float) -> int:
    """Bands of `rows` values in one of which two sets of this similarity meet, but for a chance of `miss`."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(similarity, 1 - 1e-9) ** rows)))


class Templates:
    """Templates with their band keys. Those of one number of shingles share their windows."""

    def __init__(self, notices: list[tuple[int, str]], least: float = 0.8, rows: int = 2, miss: float = 1e-4, seed: int = 17, size: int = SHINGLE) -> None:
        self.least, self.rows, self.size = least, rows, size
        self.number, self.sets, self.places, self.hashes = [], [], [], []
        for number, text in notices:
            words = text.encode().translate(FOLD).split()
            grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
            self.number.append(number)
            self.sets.append({g: n for n, g in enumerate(dict.fromkeys(grams))})
            self.places.append(len(grams))
            self.hashes.append(np.unique(rolling(scanned([b" ".join(words)])[3], size)))
        rng = np.random.default_rng(seed)
        self.classes = []  # places, step, width, bands, members
        for n in sorted(set(self.places)):
            step = max(1, n // 8)
            members = [t for t, p in enumerate(self.places) if p == n]
            m = min(len(self.sets[t]) for t in members)
            shared = math.ceil(least * m - 1e-9)
            similarity = shared / (n + step - 1 + m - shared)
            self.classes.append((n, step, n + step - 1, needed_bands(similarity, rows, miss), members))
        most = max((c[3] for c in self.classes), default=0)
        self.factors = rng.integers(0, 1 << 31, most * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.salts = rng.integers(0, 1 << 32, most * rows, dtype=np.uint32)
        self.widest = max((c[2] for c in self.classes), default=0)
        self.keys = {}  # (class, band): sorted keys, their templates, and which upper halves of keys there are
        for c, (*_, bands, members) in enumerate(self.classes):
            for band in range(bands):
                least = [np.array([self.values(self.hashes[t], k).min() for t in members]) for k in self.functions(band)]
                key = reduce(self.joined, least, np.full(len(members), band, dtype=np.uint32))
                order = np.argsort(key, kind="stable")
                there = np.zeros(1 << 16, dtype=bool)
                there[key >> np.uint32(16)] = True
                self.keys[c, band] = key[order], np.array(members)[order], there

    def functions(self, band: int) -> range:
        return range(band * self.rows, (band + 1) * self.rows)

    def values(self, h: np.ndarray, k: int) -> np.ndarray:
        """The k-th hash function of shingle hashes."""
        return ((h >> np.uint64(32)).astype(np.uint32) ^ self.salts[k]) * self.factors[k]

    @staticmethod
    def joined(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        return keys * np.uint32(0x9E3779B1) ^ values

    def met(self, h: np.ndarray, none: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first shingle, width, template) of windows that meet a template in a band. none: where there is no shingle."""
        for low in range(0, len(h), BLOCK):
            part, gaps = h[low : low + BLOCK + self.widest], np.flatnonzero(none[low : low + BLOCK + self.widest])
            size = min(BLOCK, len(h) - low)
            for band in range(max((c[3] for c in self.classes), default=0)):
                used = [(c, x) for c, x in enumerate(self.classes) if band < x[3]]
                keys = {c: np.full(-(-size // x[1]), band, dtype=np.uint32) for c, x in used}
                for k in self.functions(band):
                    v = np.full(size + self.widest, NONE, dtype=np.uint32)
                    v[: len(part)] = self.values(part, k)
                    v[gaps] = NONE
                    wide = 1
                    for c, (_, step, width, *_) in used:
                        while wide * 2 <= width:  # minima over 1, 2, 4, ... shingles; widths only grow
                            v = np.minimum(v[:-wide], v[wide:])
                            wide *= 2
                        least = np.minimum(v[:size:step], v[width - wide : width - wide + size : step])
                        keys[c] = self.joined(keys[c], least)
                for c, (_, step, width, *_) in used:
                    known, members, there = self.keys[c, band]
                    hit = np.flatnonzero(there[keys[c] >> np.uint32(16)])
                    a, b = (np.searchsorted(known, keys[c][hit], side=s) for s in ("left", "right"))
                    for i in np.flatnonzero(b > a).tolist():
                        for t in members[a[i] : b[i]].tolist():
                            yield low + int(hit[i]) * step, width, t

    def best(self, t: int, words: list[bytes], h: np.ndarray) -> tuple[int, int]:
        """Most shingles of the template within its number of consecutive places, and where they first start."""
        at = np.flatnonzero(np.isin(h, self.hashes[t])).tolist()
        found = [(i, g) for i in at if (g := self.sets[t].get(b" ".join(words[i : i + self.size]))) is not None]
        counts, most, first, low = [0] * len(self.sets[t]), 0, -1, 0
        distinct = 0
        for i, g in found:
            distinct += not counts[g]
            counts[g] += 1
            while found[low][0] <= i - self.places[t]:
                counts[found[low][1]] -= 1
                distinct -= not counts[found[low][1]]
                low += 1
            if distinct > most:
                # the run starts at the first place from which on no shingle is needless
                most, first = distinct, found[low][0]
        return most, first


FIELDS = "doc_id long, template long, shared long, shingles long, containment double, first_word long"


def _scan(groups: list[Templates]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [x.translate(FOLD) for x in texts(batch)]
            whole, begin, end, words, row = scanned(raw)
            ids, out = batch.column("doc_id").to_pylist(), []
            for templates in groups:
                size = templates.size
                if len(words) < size:
                    continue
                h = rolling(words, size)
                none = row[: len(h)] != row[size - 1 :]
                candidates = {(r, t) for at, width, t in templates.met(h, none) for r in range(row[at], row[min(at + width, len(h)) - 1] + 1)}
                for r, t in sorted(candidates):
                    a, b = np.searchsorted(row, [r, r + 1])
                    own = [whole[x:y] for x, y in zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True)]
                    shared, first = templates.best(t, own, h[a : max(a, b - size + 1)])
                    m = len(templates.sets[t])
                    if shared >= templates.least * m - 1e-9:
                        out.append((ids[r], templates.number[t], shared, m, shared / m, first))
            if out:
                kinds = (*[pa.int64()] * 4, pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in FIELDS.split(", ")])

    return run


def _by_size(notices: list[tuple[int, str]], least: float) -> list[Templates]:
    """Notices of fewer than SHINGLE words are one shingle of all their words; those without words are none."""
    sizes: dict[int, list[tuple[int, str]]] = {}
    for number, text in notices:
        if n := len(text.encode().translate(FOLD).split()):
            sizes.setdefault(min(n, SHINGLE), []).append((number, text))
    return [Templates(x, least, size=n) for n, x in sorted(sizes.items())]


def scan(docs: DataFrame, notices: Iterable[tuple[str, str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, most_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, template (its number in notices), license, shared and shingles (of the template), containment and first_word (where the best run starts; words count from 0) of each template in each row."""
    notices = list(notices)
    blocks, size = [[]], 0
    for n, (_, text) in enumerate(notices):
        if blocks[-1] and size + len(text) > most_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((n, text))
        size += len(text)
    rows = id_and_text(docs, id_col, text_col)
    found = reduce(DataFrame.union, (rows.mapInArrow(_scan(_by_size(block, least)), FIELDS) for block in blocks))
    names = docs.sparkSession.createDataFrame([(n, name) for n, (name, _) in enumerate(notices)], "template long, license string")
    return found.join(names.hint("broadcast"), "template").select("doc_id", "template", "license", "shared", "shingles", "containment", "first_word")


def oracle(notices: Iterable[tuple[str, str]] = NOTICES) -> str:
    """The same rows by plain SQL over all shingles (documents with distinct ids, a containment of 0.8)."""
    quoted = [(n, *(x.replace("'", "''") for x in pair)) for n, pair in enumerate(notices)]
    values = ", ".join(f"({n}, '{name}', '{text}')" for n, name, text in quoted)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    grams = "list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))"
    return f"""
        with notice(template, license, text) as (values {values}),
        wanted as (select *, least(len(words), {SHINGLE}) as size from (select template, license, {words} as words from notice)),
        grams as (select template, license, len(words) - size + 1 as places, unnest(list_distinct({grams})) as gram from wanted where len(words) > 0),
        template as (select *, count(*) over (partition by template) as shingles from grams),
        own as (select doc_id, {words} as words from documents where text is not null),
        shingle as (select doc_id, unnest({grams}) as gram, unnest(range(0, len(words) - size + 1)) as place from own, (select distinct size from wanted) where len(words) >= size),
        hit as (select doc_id, template, license, places, shingles, gram, place from shingle join template using (gram)),
        run as (
            select a.doc_id, a.template, a.license, a.shingles, a.place, count(distinct b.gram) as shared
            from hit a join hit b on a.doc_id = b.doc_id and a.template = b.template and b.place between a.place and a.place + a.places - 1
            group by all
        ),
        best as (select *, row_number() over (partition by doc_id, template order by shared desc, place) as k from run)
        select doc_id, template::bigint as template, license, shared, shingles, shared / shingles::double as containment, place::bigint as first_word
        from best where k = 1 and shared * 5 >= shingles * 4
    """
