"""License scans: winnowed fingerprints find candidates, banded alignment reports coverage and spans.

Words are runs of letters and digits in lower case. Every run of ``GRAM`` words is hashed and of every
``WINDOW`` neighbouring hashes the least is a fingerprint, on both sides, so a template and a text that
share ``GRAM + WINDOW - 1`` words in a row share a fingerprint. That is too much to ask of templates under
``SHORT`` words: of these the first words of the longest deciding run are looked up at every place of a text
or, without deciding words, every run of ``GRAM`` words (two in templates of up to five), so that any place
of a score of 0.8 is found. The fingerprints form inverted indexes of fixed size. Hits of one template whose offsets lie within ``BAND`` words are one place;
there the whole template is aligned with the text (fewest edits, both ends of the text free) inside the
band. A finding holds the template words matched, their share, and the span in words and bytes.

A template's deciding words (name, version, kind) tell it from others: all of each run must be matched, with
nothing in between. A finding scores matched / (template words + words the text has in between); those of
``least`` and more are given out, and of findings that overlap only the best. Licenses without a template
have no findings. Defined cases: a null or empty text has no
findings; repeated rows have theirs each; ties go to the longer, then the first template in the list; an
empty table gives no rows; only doc_id and text are read; long texts are read whole.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.llm.hashing import hash_spans, window_starts, windows, word_spans
from flagstone.llm.substring_dedup import member
from flagstone.llm.words import chunks, gather_runs

GRAM, WINDOW, BAND = 3, 3, 12
SHORT = 2 * (GRAM + WINDOW)

#: Wordings of public licenses and of the notices that name them, with their runs of deciding words.
TEMPLATES = [
    ("mit", "Released under the MIT License.", ("MIT License",)),
    ("mit", "This project is licensed under the terms of the MIT license.", ("MIT license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ()),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("Apache License, Version 2.0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("Apache License, Version 2.0",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("GNU General Public License, version 3",)),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("GNU General Public License", "version 3 of")),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("GNU General Public License", "version 2 of")),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("GNU Lesser General Public License", "version 2.1 of")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("Mozilla Public License, v. 2.0",)),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ()),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ()),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", ("CC BY 4.0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("CC BY-SA 4.0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("CC BY-NC 4.0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("Creative Commons Attribution 4.0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.", ()),
    ("apache-2.0", "Licensed under the Apache License 2.0.", ("Apache License 2.0",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("GNU General Public License, version 2",)),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.", ("GNU Lesser General Public License, version 2.1",)),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("GNU Lesser General Public License, version 3",)),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("GNU Affero General Public License, version 3",)),
    ("lgpl-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("GNU Library General Public License", "version 2 of")),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("GNU Lesser General Public License", "version 3 of")),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("GNU Affero General Public License", "version 3 of")),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("used to endorse or promote products derived",)),
    ("bsd-4-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("advertising materials mentioning features", "used to endorse or promote products derived")),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0.", ("CC BY-ND 4.0",)),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0.", ("CC BY-NC-SA 4.0",)),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0.", ("CC BY-NC-ND 4.0",)),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("Creative Commons Attribution-ShareAlike 4.0",)),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("Creative Commons Attribution-NonCommercial 4.0",)),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ("Creative Commons Attribution-NoDerivatives 4.0",)),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0",)),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0",)),
    ("cc0-1.0", "Licensed under CC0 1.0.", ("CC0 1.0",)),
    ("cc0-1.0", "This work is marked with CC0 1.0 Universal.", ("CC0 1.0",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright and related or neighboring rights",)),
]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARKS = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, begins, ends, and where each text's words start."""
    data, first, end, offsets = word_spans(texts, _MARKS)
    return hash_spans(_LOWER[data], first, end), first, end, offsets


def fingerprints(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of the winnowed runs; runs and windows stay within a text."""
    at, starts = window_starts(offsets, GRAM)
    if not len(at):
        return np.empty(0, np.uint64), at
    hashes = windows(words, GRAM)[at]
    chosen = np.zeros(len(hashes), bool)
    inner, _ = window_starts(starts, WINDOW)
    if len(inner):
        several = np.stack([hashes[inner + k] for k in range(WINDOW)])
        # of equal least hashes the last one
        chosen[inner + WINDOW - 1 - several[::-1].argmin(0)] = True
    counts = np.diff(starts)
    for i in np.flatnonzero((counts > 0) & (counts < WINDOW)):
        run = slice(starts[i], starts[i + 1])
        chosen[starts[i] + counts[i] - 1 - hashes[run][::-1].argmin()] = True
    return hashes[chosen], at[chosen]


def run_in(words: np.ndarray, phrase: str) -> tuple[int, int]:
    """Where a phrase first stands in a template."""
    own = plain_words(pa.array([phrase.encode()], pa.binary()))[0]
    for a in range(len(words) - len(own) + 1):
        if len(own) and (words[a : a + len(own)] == own).all():
            return a, a + len(own)
    raise ValueError(f"not in its template: {phrase}")


def short_grams(n: int, deciding: list[tuple[int, int]]) -> tuple[int, range]:
    """The width of a short template's fingerprints and where they stand."""
    if deciding:
        a, b = max(deciding, key=lambda x: x[1] - x[0])
        return min(GRAM, b - a), range(a, a + 1)
    width = GRAM if n > 5 else min(2, n)
    return width, range(n - width + 1)


class Postings:
    """For each hash the templates and positions it stands at."""

    def __init__(self, hashes: np.ndarray, template: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.template, self.at = template[order], at[order]
        self.keys, self.first, self.counts = np.unique(hashes[order], return_index=True, return_counts=True)

    def look_up(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = member(self.keys, hashes)
        on = keys >= 0
        keys, at = keys[on], at[on]
        counts = self.counts[keys]
        entry = gather_runs(np.arange(len(self.at)), self.first[keys], counts)
        return np.repeat(at, counts), self.template[entry], self.at[entry]


class Index:
    """The templates' words and deciding runs, and for each fingerprint the templates and positions it stands at."""

    def __init__(self, templates: tuple[tuple, ...]) -> None:
        self.names = [name for name, *_ in templates]
        words, _, _, offsets = plain_words(pa.array([t[1].encode() for t in templates], pa.binary()))
        self.words = [words[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        self.deciding = [[run_in(own, x) for x in (t[2] if len(t) > 2 else ())] for own, t in zip(self.words, templates, strict=True)]
        hashes, at = fingerprints(words, offsets)
        template = np.searchsorted(offsets, at, "right") - 1
        long = np.diff(offsets)[template] >= SHORT
        self.winnowed = Postings(hashes[long], template[long], (at - offsets[template])[long])
        grams: dict[int, list[tuple[np.uint64, int, int]]] = {}
        for t, own in enumerate(self.words):
            if 0 < len(own) < SHORT:
                width, places = short_grams(len(own), self.deciding[t])
                grams.setdefault(width, []).extend((windows(own, width)[i], t, i) for i in places)
        self.short = {width: Postings(*(np.array(x) for x in zip(*own, strict=True))) for width, own in grams.items()}

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word positions of some texts, the templates that may stand there, and their positions."""
        found = [self.winnowed.look_up(*fingerprints(words, offsets))]
        for width, postings in self.short.items():
            at, _ = window_starts(offsets, width)
            found.append(postings.look_up(windows(words, width)[at] if len(at) else np.empty(0, np.uint64), at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@functools.lru_cache(maxsize=4)
def index_of(templates: tuple[tuple, ...]) -> Index:
    return Index(templates)


def align(template: np.ndarray, text: np.ndarray, start: int) -> tuple[int, int, int]:
    """Matched words and the span [first, last] of the best alignment of the whole template near an offset; -1 without a match."""
    return span(aligned(template, text, start))


def span(at: np.ndarray) -> tuple[int, int, int]:
    on = at[at >= 0]
    return (len(on), int(on[0]), int(on[-1])) if len(on) else (0, -1, -1)


def aligned(template: np.ndarray, text: np.ndarray, start: int) -> np.ndarray:
    """For each word of the template the word of the text that it matches in that alignment, or -1."""
    n, wide = len(template), 2 * BAND + 1
    if 0 <= start <= len(text) - n and (text[start : start + n] == template).all():
        return np.arange(start, start + n)  # nothing is cheaper than no edit
    cost = np.zeros((n + 1, wide))
    shift = np.arange(wide)
    place = start - BAND + shift
    for i in range(1, n + 1):
        here = place + i - 1
        inside = (here >= 0) & (here < len(text))
        same = inside & (text[np.clip(here, 0, len(text) - 1)] == template[i - 1])
        step = cost[i - 1] + np.where(same, 0.0, 1.0) + np.where(inside, 0.0, 1e6)
        step[:-1] = np.minimum(step[:-1], cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(step - shift) + shift
    b, i, at = int(cost[n].argmin()), n, np.full(n, -1)
    while i > 0:
        here = int(place[b]) + i - 1
        inside = 0 <= here < len(text)
        same = inside and text[here] == template[i - 1]
        if inside and cost[i, b] == cost[i - 1, b] + (0 if same else 1):
            if same:
                at[i - 1] = here
            i -= 1
        elif b + 1 < wide and cost[i, b] == cost[i - 1, b + 1] + 1:
            i, b = i - 1, b + 1
        elif b > 0:
            b -= 1
        else:
            break
    return at


def decided(at: np.ndarray, runs: list[tuple[int, int]]) -> bool:
    """Whether every deciding run is matched word by word."""
    return all(at[a] >= 0 and (at[a:b] == at[a] + np.arange(b - a)).all() for a, b in runs)


def findings(words: np.ndarray, templates: np.ndarray, starts: np.ndarray, index: Index, least: float) -> list[tuple[float, int, int, int, int]]:
    """(score, matched, template, first word, last word) of one text, best first, overlaps left out."""
    offsets: dict[int, set[int]] = {}
    for template, start in zip(templates.tolist(), starts.tolist(), strict=True):
        offsets.setdefault(template, set()).add(start)
    found = []
    for template, places in offsets.items():
        own, begin, previous = index.words[template], None, None
        for place in [*sorted(places), None]:
            if begin is None:
                begin = previous = place
            elif place is not None and place - begin <= BAND:
                previous = place
            else:
                middle = (begin + previous) // 2
                near = words[max(0, middle - BAND) : max(0, middle + len(own) + BAND + 1)]
                # no alignment matches more words than stand there at all
                at = aligned(own, words, middle) if np.isin(own, near).sum() / len(own) >= least else np.full(len(own), -1)
                matched, first, last = span(at)
                if matched and decided(at, index.deciding[template]):
                    score = matched / (len(own) + max(0, last - first + 1 - len(own)))
                    if score >= least:
                        found.append((score, matched, template, first, last))
                begin = previous = place
    kept: list[tuple[float, int, int, int, int]] = []
    taken = np.zeros(len(words), bool)
    for item in sorted(found, key=lambda x: (-x[1] * x[0], -x[0], x[2])):
        if not taken[item[3] : item[4] + 1].any():
            taken[item[3] : item[4] + 1] = True
            kept.append(item)
    return sorted(kept, key=lambda x: x[3])


SCHEMA = "doc_id long, license string, coverage double, matched int, start_word int, end_word int, start_byte long, end_byte long"


def scan_licenses(docs: DataFrame, least: float = 0.8, templates: list[tuple] | None = None) -> DataFrame:
    """A row per finding: ``doc_id``, ``license``, ``coverage``, ``matched`` words and the span (ends excluded).

    A template is a name, a wording and, if some words decide, a tuple of their runs."""
    fixed = tuple((name, text, *map(tuple, runs)) for name, text, *runs in templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(fixed)
        for batch in batches:
            for part in chunks(batch):
                words, first, end, offsets = plain_words(part.column(1))
                at, templates, places = index.hits(words, offsets)
                doc = np.searchsorted(offsets, at, "right") - 1
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
                begins = np.cumsum(sizes) - sizes
                out = []
                # hits of one text stand together
                order = np.argsort(doc, kind="stable")
                doc, templates, starts = doc[order], templates[order], (at - places)[order]
                cuts = [*np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)]).tolist(), len(doc)]
                for b, c in itertools.pairwise(cuts):
                    i = int(doc[b])
                    a = offsets[i]
                    for score, matched, template, x, y in findings(words[a : offsets[i + 1]], templates[b:c], starts[b:c] - a, index, least):
                        out.append((i, index.names[template], score, matched, x, y + 1, int(first[a + x] - begins[i]), int(end[a + y] - begins[i])))
                if out:
                    rows, *rest = zip(*out, strict=True)
                    kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.record_batch(
                        [part.column(0).take(pa.array(rows)), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))],
                        names=["doc_id", "license", "coverage", "matched", "start_word", "end_word", "start_byte", "end_byte"],
                    )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
