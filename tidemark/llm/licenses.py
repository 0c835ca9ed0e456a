"""License scans: MinHash bands over overlapping windows find templates, shingle containment confirms them.

A template of ``s`` five-word shingles is looked up by windows of ``w`` shingles, the largest power of two
up to two thirds of ``s + 1``, at every second half window of a text. A verbatim copy therefore always
contains a text window whose shingles are a template window's: all bands collide. For altered copies the
number of bands follows from ``bands_for``: windows at ``ALIGNED`` similarity collide with at least
``1 - MISSED``. A candidate counts if at least ``containment`` of the template's shingles lie together in
the text, which is computed exactly. A match ends where the next copy begins, and of templates that overlap in a
text the one with the most shingles there is reported, so a notice is not mistaken for a relative's. Whole texts are scanned inside their rows; nothing is shuffled. The
templates are an argument and become a lookup table in the tasks; their number is bounded by ``MOST``.

Defined results: null, empty and short texts have no matches; repeated rows are scanned one by one; a
text can hold several licenses and one license several times. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.words import Words, chunks, inside_texts, rolled

SHINGLE, CONTAINMENT = 5, 0.8
ALIGNED, MISSED, MOST = 0.6, 1e-6, 10_000
MATCH = "doc_id long, license string, containment double, start_word long, n_words long, matched string"
MARKS = b".,;:!?()[]{}<>\"'`*#|_-/\\"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_TABLE_BITS = 20

# License notices as their publishers word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
        "License, or (at your option) any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version."
    ),
    "GPL-2.0-only": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License version 2 as published by the Free Software Foundation."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "LGPL-2.0-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Library General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version."
    ),
    "LGPL-3.0-or-later": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "GFDL-1.3-or-later": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
        "Documentation License, Version 1.3 or any later version published by the Free Software Foundation"
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions:"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
        "software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"
    ),
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-1.0": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of "
        "the Eclipse Public License v1.0 which accompanies this distribution"
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at"
    ),
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may "
        "not use this file except in compliance with the License."
    ),
    "CDDL-1.0": (
        "The contents of this file are subject to the terms of the Common Development and Distribution License "
        "(the \"License\"). You may not use this file except in compliance with the License."
    ),
    "WTFPL": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and "
        "changing it is allowed as long as the name is changed."
    ),
    "PostgreSQL": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, "
        "without fee, and without a written agreement is hereby granted, provided that the above copyright notice "
        "and this paragraph and the following two paragraphs appear in all copies."
    ),
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
        "to this work."
    ),
    "CC-BY-ND-4.0": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."
    ),
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    ),
    "CC-BY-NC-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International "
        "License."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
}


def bare_words(texts: list[bytes]) -> Words:
    """Words with A-Z in lower case and without marks."""
    return Words(texts, lower=True, skip=MARKS)


def bands_for(similarity: float = ALIGNED, missed: float = MISSED) -> int:
    """Bands of one row, so that windows of that similarity share one but for ``missed`` of all cases."""
    return math.ceil(math.log(missed) / math.log(1 - similarity))


def window_width(shingles: int) -> int:
    return 1 << (max(1, (shingles + 1) * 2 // 3).bit_length() - 1)


def _seeds(bands: int) -> np.ndarray:
    return np.random.default_rng(20240101).integers(1, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _narrow(row: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Minima of windows of 1, 2, 4, … shingles; windows overlap by half, so entry ``j`` starts at ``j * max(1, w / 2)``."""
    width, least = 1, row
    yield width, least
    while True:
        halves = least if width == 1 else least[::2]
        if len(halves) < 2:
            return
        least, width = np.minimum(halves[:-1], halves[1:]), width * 2
        yield width, least


class TemplateIndex:
    """Band keys of all template windows, per width and band."""

    def __init__(self, templates: dict[str, str], bands: int):
        if len(templates) > MOST:
            raise ValueError(f"more than {MOST} templates; scan them in blocks")
        self.names, self.shingles, self.places, self.seeds = [], [], [], _seeds(bands)
        keys: dict[tuple[int, int], dict[int, set[int]]] = {}
        for name, text in sorted(templates.items()):
            grams = rolled(bare_words([text.encode()]).flat, SHINGLE)
            if not len(grams):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            width = window_width(len(grams))
            for band, seed in enumerate(self.seeds[: 1 if width == 1 else None]):
                spread = grams * seed
                for at in range(len(grams) - width + 1):
                    own = keys.setdefault((width, band), {})
                    own.setdefault(int(spread[at : at + width].min()), set()).add(len(self.names))
            self.names.append(name)
            own, kinds = np.unique(grams, return_inverse=True)
            self.shingles.append(own)
            self.places.append([np.flatnonzero(kinds == k) for k in range(len(own))])
        self.keys = keys
        self.tables = {}
        for place, own in keys.items():
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[np.fromiter(own, np.uint64, len(own)) >> np.uint64(64 - _TABLE_BITS)] = True
            self.tables[place] = table
        self.widest = max(width for width, _ in keys)

    def candidates(self, grams: np.ndarray) -> set[tuple[int, int]]:
        """``(template, shingle position)`` of windows that share a band with a template window."""
        found: set[tuple[int, int]] = set()
        for band, seed in enumerate(self.seeds):
            for width, least in _narrow(grams * seed):
                if width > self.widest:
                    break
                if (width, band) not in self.tables:
                    continue
                own = self.keys[width, band]
                for j in np.flatnonzero(self.tables[width, band][least >> np.uint64(64 - _TABLE_BITS)]):
                    for template in own.get(int(least[j]), ()):
                        found.add((template, int(j) * max(1, width // 2)))
        return found

    def matches(
        self, grams: np.ndarray, starts: np.ndarray, containment: float
    ) -> list[tuple[int, int, float, int, int]]:
        """``(document, template, containment, first word, words)`` of confirmed places, words counted from 0.

        Of places that overlap in a text that with the most shingles of its template stays, then the one with
        the larger share of it.
        """
        near: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for template, at in sorted(self.candidates(grams)):
            doc, size = int(np.searchsorted(starts, at, "right")) - 1, len(self.shingles[template])
            low, high = max(int(starts[doc]), at - 2 * size), min(int(starts[doc + 1]), at + 3 * size)
            places = near.setdefault((doc, template), [])
            if places and low <= places[-1][1]:
                places[-1] = (places[-1][0], max(high, places[-1][1]))
            else:
                places.append((low, high))
        found: dict[int, list[tuple[int, float, int, int, int]]] = {}
        for (doc, template), places in near.items():
            own, spots = self.shingles[template], self.places[template]
            for low, high in places:
                hits = low + np.flatnonzero(np.isin(grams[low:high], own))
                for count, first, last in _copies(grams, hits, own, spots, containment):
                    found.setdefault(doc, []).append((count, count / len(own), first, last, template))
        rows = []
        for doc, places in found.items():
            kept: list[tuple[int, int]] = []
            for _, share, first, last, template in sorted(places, key=lambda p: (-p[0], -p[1], p[2:])):
                if all(last + SHINGLE <= a or b + SHINGLE <= first for a, b in kept):
                    kept.append((first, last))
                    rows.append((doc, template, share, int(first - starts[doc]), int(last - first) + SHINGLE))
        return sorted(rows, key=lambda r: (r[0], r[3], r[1]))


def _copies(
    grams: np.ndarray, hits: np.ndarray, own: np.ndarray, places: list[np.ndarray], containment: float
) -> Iterator[tuple[int, int, int]]:
    """Copies of a template among ``hits``: how many of its distinct shingles, and their first and last place.

    A hit says where its copy would begin: its place less that of the shingle in the template. The hits of one copy
    agree on that but for words put in or left out, those of the next copy differ by a whole template.
    """
    kinds = np.searchsorted(own, grams[hits])
    times = np.array([len(p) for p in places])[kinds]
    at, kind = np.repeat(hits, times), np.repeat(kinds, times)
    begin = at - np.concatenate([places[k] for k in kinds.tolist()]) if len(kinds) else at
    order = np.lexsort((at, begin))
    at, kind, begin = at[order], kind[order], begin[order]
    slack = max(3, sum(len(p) for p in places) // 4)
    edges = np.flatnonzero(np.diff(begin) > slack) + 1
    for group in np.split(np.arange(len(at)), edges):
        left = group.tolist()
        while len(left) >= containment * len(own):
            seen: dict[int, int] = {}
            low, best = 0, (0, 0, 0)
            for high, i in enumerate(left):
                seen[kind[i]] = seen.get(kind[i], 0) + 1
                while begin[i] - begin[left[low]] > slack:
                    k = kind[left[low]]
                    seen[k] -= 1
                    if not seen[k]:
                        del seen[k]
                    low += 1
                best = max(best, (len(seen), -low, high))
            if best[0] < containment * len(own):
                break
            taken = at[left[-best[1] : best[2] + 1]]
            first, last = int(taken.min()), int(taken.max())
            yield best[0], first, last
            left = [i for i in left if not first <= at[i] <= last]


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, bands: int | None = None
) -> DataFrame:
    """``MATCH`` rows: each license found in a document, where, and how much of it."""
    texts, count = templates or TEMPLATES, bands or bands_for()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(texts, count)
        for doc_ids, bodies in chunks(batches, ["doc_id", "text"]):
            words = bare_words(bodies)
            starts, grams = words.starts, rolled(words.flat, SHINGLE)
            grams[~inside_texts(starts, len(grams), SHINGLE)] = _NONE
            rows = []
            for doc, template, share, first, n in index.matches(grams, starts, containment):
                text = b" ".join(bodies[doc].split()[first : first + n]).decode()
                rows.append((doc_ids[doc], index.names[template], share, first, n, text))
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[f.split()[0] for f in MATCH.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, MATCH)
