"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Text and templates are two-word shingles (lower case, punctuation parts words). For each template length a text is seen through windows
of twice that length, a quarter of it apart, so any passage as long as the template lies whole in one. Every band is one MinHash
value: with 24 bands a window that holds 80% of a template (Jaccard 0.36 at the least) is retrieved but once in 40,000 times.
A window that verifies holds 80% of a template's shingles, so MinHash values are computed only for windows that hold as many
shingles of templates of their length; this leaves out nothing.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import mix, pieces, shingles, word_hashes

WORDS, BANDS, CONTAINMENT = 2, 24, 0.8
MARKS = b".,;:!?()[]\"'"
#: Notices and opening sentences of public licenses.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "All rights reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (body)": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "Apache-2.0 (notice)": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0 (body)": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software",
    "GPL-2.0 (notice)": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (body)": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "GPL-3.0 (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1 (notice)": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT (full)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT (license)": "Licensed under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def _signature(values: np.ndarray) -> np.ndarray:
    return mix(values[None, :] ^ _SEEDS[:, None]).min(1)


def passages(values: np.ndarray, template: np.ndarray, wide: int) -> list[tuple[int, int, float]]:
    """(first, behind the last, containment) of a template's passages in a run of windows that verified; none overlap.

    A run of at most `wide` shingles that holds enough of the template scores one for each distinct shingle of it and loses one for
    each other or repeated place. Of all runs the best ones count, the earlier if tied, so back-to-back notices stay apart.
    """
    on = np.isin(values, template)
    _, same = np.unique(values, return_inverse=True)
    before = np.full(len(values), -1)
    order = np.argsort(same, kind="stable")
    again = same[order][1:] == same[order][:-1]
    before[order[1:][again]] = order[:-1][again]
    runs = []
    for i in np.flatnonzero(on):
        held = np.cumsum(on[i:i + wide] & (before[i:i + wide] < i))
        score = np.where(held >= CONTAINMENT * len(template) - 1e-9, 2 * held - np.arange(1, len(held) + 1), -wide)
        j = int(score.argmax())
        if score[j] > -wide:
            runs.append((-int(score[j]), int(i), int(i) + j + 1, int(held[j]) / len(template)))
    best: list[tuple[int, int, float]] = []
    for _, a, b, share in sorted(runs):
        at = bisect_left(best, (a, b))
        if (at == 0 or best[at - 1][1] <= a) and (at == len(best) or b <= best[at][0]):
            best.insert(at, (a, b, share))
    return best


@dataclass(frozen=True)
class Template:
    name: str
    values: np.ndarray  # distinct shingles, sorted
    words: int
    signature: np.ndarray


class Library:
    """Templates, the set of their shingles and the tables of their bands, by window length."""

    def __init__(self, templates: Mapping[str, str]):
        made = []
        for name, text in sorted(templates.items()):
            h, c = word_hashes(pa.array([text.lower()]), MARKS)
            if len(h):
                values = np.unique(shingles(h, c, WORDS)[0])
                made.append(Template(name, values, len(h), _signature(values)))
        self.low = np.zeros(1 << 16, bool)
        self.by_length: dict[int, list[Template]] = defaultdict(list)
        for t in made:
            self.by_length[t.words].append(t)
            self.low[(t.values & np.uint64(0xFFFF)).astype(int)] = True
        # For each length: all its templates' shingles, and how many of them a window that verifies holds at the least.
        self.needs = {n: (np.unique(np.concatenate([t.values for t in ts])), max(1, int(np.ceil(CONTAINMENT * min(len(t.values) for t in ts) - 1e-9))))
                      for n, ts in self.by_length.items()}
        self.bands = {n: [{v: [t for t in ts if t.signature[b] == v] for v in {t.signature[b] for t in ts}} for b in range(BANDS)] for n, ts in self.by_length.items()}

    def _runs(self, n: int, values: np.ndarray, places: np.ndarray, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of as many shingles as a match needs, near enough for one window and in one text."""
        wanted, need = self.needs[n]
        own = places[np.isin(values[places], wanted)]
        first, last = own[:max(0, len(own) - need + 1)], own[need - 1:]
        near = last - first < 2 * n
        if text is not None:
            near &= text[first] == text[last]
        return first[near], last[near]

    def candidates(self, values: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Texts with a window that may verify. values: shingles of texts one after another; text: the text of each."""
        places = np.flatnonzero(self.low[(values & np.uint64(0xFFFF)).astype(np.int64)])
        return np.unique(np.concatenate([text[self._runs(n, values, places, text)[0]] for n in self.by_length])) if len(places) else places

    def scan(self, values: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(template, first shingle, behind the last, containment) of every passage in one text's shingles; where passages of two
        templates overlap, only the better one counts."""
        places = np.arange(len(values))
        found = []
        for n, templates in self.by_length.items():
            wide, stride = 2 * n, max(1, n // 4)
            runs = list(zip(*self._runs(n, values, places)))
            if not runs:
                continue
            starts = np.unique(np.concatenate([np.arange(max(0, -(-(b - wide + 1) // stride)), a // stride + 1) for a, b in runs])) * stride
            verified: dict[str, list] = defaultdict(list)
            for s in starts:
                window = values[s:s + wide]
                signature = _signature(window)
                hit = {t.name: t for b in range(BANDS) for t in self.bands[n][b].get(signature[b], ())}
                for t in hit.values():
                    if len(np.unique(window[np.isin(window, t.values)])) / len(t.values) >= CONTAINMENT:
                        regions = verified[t.name]
                        if regions and s <= regions[-1][1]:
                            regions[-1] = (regions[-1][0], int(s) + wide)
                        else:
                            regions.append((int(s), int(s) + wide))
            for t in templates:
                for a, b in verified.get(t.name, ()):
                    found += [(t.name, a + i, a + j, share) for i, j, share in passages(values[a:b], t.values, wide)]
        found.sort(key=lambda m: m[1])
        starts, longest = [m[1] for m in found], max((m[2] - m[1] for m in found), default=0)

        def outdone(m: tuple[str, int, int, float]) -> bool:
            near = found[bisect_left(starts, m[1] - longest):bisect_left(starts, m[2])]
            return any(o[3] > m[3] and o[1] < m[2] and m[1] < o[2] for o in near)

        return sorted(m for m in found if not outdone(m))


def scan_licenses(df: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, matches, first_word, containment), one row for each row of df and template found in its whole text.

    matches: passages found; first_word: where the first begins, in words; containment: of the template's shingles in the best.
    Null and empty texts match nothing; repeated rows are reported each; a null id stays null; other columns are not looked at.
    A one-word template is its own shingle. Rows are scanned one by one in slices of some MB.
    """
    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lower(F.col(f"`{text_col}`")).alias("text"))
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(templates)
        for b in pieces(batches, "text"):
            values, text = shingles(*word_hashes(b.column(1), MARKS), WORDS)
            rows = []
            for doc in library.candidates(values, text):
                first, behind = np.searchsorted(text, [doc, doc + 1])
                by_name = defaultdict(list)
                for name, a, _, share in library.scan(values[first:behind]):
                    by_name[name].append((a, share))
                rows += [(b.column(0)[int(doc)].as_py(), name, len(m), min(x[0] for x in m), max(x[1] for x in m)) for name, m in by_name.items()]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["id", "license", "matches", "first_word", "containment"])

    return narrow.mapInArrow(run, "id long, license string, matches long, first_word long, containment double")
