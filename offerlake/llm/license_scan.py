"""License scans by patience alignment.

A template is laid over a text: words that both have exactly once are anchors, the longest
increasing run of anchors stays, and the gaps between them are aligned in the same way. Where a
gap has no anchor, equal words at its two ends are matched. Coverage is the share of the
template's words that are matched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

#: Share of a template that counts as found.
COVERAGE = 0.8
#: Short notices, and the openings or whole texts of standard licenses.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: Words that tell a notice from that of another license ("Licensed under CC BY-ND 4.0."); without them it isn't found.
NAMING = {
    "CC-BY-NC-4.0": "by-nc", "CC-BY-4.0": "by", "CC-BY-SA-4.0": "by-sa", "MIT": "mit", "LGPL-text": "lesser", "AGPL-text": "affero",
    "CC-BY-4.0-notice": "attribution", "CC-BY-SA-4.0-notice": "attribution-sharealike", "CC-BY-NC-4.0-notice": "attribution-noncommercial",
}
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c in b"0123456789abcdefghijklmnopqrstuvwxyz.-" or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of letters, digits, dots and hyphens, lower-cased, without dots at their ends."""
    return [w for x in (text or b"").translate(_WORD).split() if (w := x.strip(b".-"))]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (ordered by the first) in which the second increases too."""
    tops: list[int] = []
    piles: list[int] = []  # index of the pair on top of each pile
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [b], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), in order."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            gaps += [(x[0] + 1, y[0], x[1] + 1, y[1]) for x, y in zip(edges, edges[1:]) if y[0] - x[0] > 1 and y[1] - x[1] > 1]
    return sorted(out)


def _least(need: int, coverage: float) -> int:
    """Words of a template of need words that must be matched."""
    return max(1, ceil(coverage * need - 1e-9))


def _stretches(at: list[int], k: int, ends: list[int], need: int, n: int) -> Iterator[tuple[int, int]]:
    """Bounds of the text about the k-th of the places at of a word, the widest first.

    ends are the word's places in the template. Where notices stand close together the wide
    stretch holds several, and no word is there once. The narrower ones hold the word as often as
    the template does, or begin where the template would if nothing were put in or left out.
    """
    a, b = max(0, at[k] - 2 * need), min(n, at[k] + 2 * need)
    yield a, b
    m = len(ends)
    for first in range(k - m + 1, k + 1):
        low = at[first - 1] + 1 if first > 0 else 0
        high = at[first + m] if first + m < len(at) else n
        if first >= 0 and (low > a or high < b):
            yield max(a, low), min(b, high)
    for end in ends:
        yield max(0, at[k] - end), min(n, at[k] - end + need)


def occurrences(text: list[bytes], template: list[bytes], coverage: float = COVERAGE, naming: bytes | None = None) -> list[tuple[float, int, int]]:
    """(coverage, first word, last word) of places at which a template has the coverage or more; places may overlap.

    The template is laid over stretches about each place of its rarest words, so that a word
    which the rest of a long text also has does not hide a notice.
    """
    need, known = len(template), Counter(template)
    there: dict[bytes, list[int]] = {w: [] for w in known}
    for i, w in enumerate(text):
        if w in there:
            there[w].append(i)
    least = _least(need, coverage)
    if sum(min(n, len(there[w])) for w, n in known.items()) < least:
        return []  # no alignment can reach the coverage
    # An alignment that reaches the coverage lacks at most need - least words, so it has one of the rarest.
    rare = sorted(known, key=lambda w: (len(there[w]), w))[: need - least + 1]
    ends = {w: [j for j, x in enumerate(template) if x == w] for w in rare}
    found, done = [], -1
    for i, w, k in sorted((i, w, k) for w in rare for k, i in enumerate(there[w])):
        if i < done:
            continue
        for a, b in _stretches(there[w], k, ends[w], need, len(text)):
            pairs = align(text[a:b], template)
            if len(pairs) < least or naming and all(template[j] != naming for _, j in pairs):
                continue
            first, last = a + pairs[0][0], a + pairs[-1][0] + 1
            found.append((len(pairs) / need, first, last))
            if first <= i < last and last - first <= 2 * need - least:
                done = max(done, last)  # the other rare words of this copy
                if len(pairs) == need == last - first:
                    break
    return found


def _apart(found: list[tuple[float, int, int, str]]) -> list[tuple[str, float, int, int]]:
    """Places that don't overlap: the highest coverage first, then the longest template's words and the shortest stretch."""
    out: list[tuple[str, float, int, int]] = []
    firsts: list[int] = []  # of the chosen places, in order; none of these overlap, so only the two neighbours can
    for share, first, last, name in sorted(set(found), key=lambda x: (-x[0], x[2] - x[1], x[1], x[3])):
        k = bisect_left(firsts, first)
        if (k == 0 or out[k - 1][3] <= first) and (k == len(out) or last <= firsts[k]):
            firsts.insert(k, first)
            out.insert(k, (name, share, first, last))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, naming: dict[str, str] | None = None) -> DataFrame:
    """One row for each place of a license in a text: doc_id, license, coverage, first and last word.

    Places in one text do not overlap: where several fit, that of the highest coverage stays, then
    the shortest stretch, the first and the name. Null and empty texts have none, very long texts
    are read as a whole, repeated rows give repeated rows, an empty table gives none; other columns
    of any name are ignored. Each text is scanned by itself, so there is no shuffle.

    naming has, by template, the word that must be matched (NAMING where it is left out, whatever the
    templates are); it counts for templates that hold it.
    """
    must = NAMING if naming is None else naming
    known = [(k, words_of(t.encode())) for k, t in sorted((TEMPLATES if templates is None else templates).items())]
    known = [(k, w, must[k].encode() if k in must and must[k].encode() in w else None) for k, w in known if w]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(texts(batch)):
                words = words_of(text)
                have = set(words)
                found = []
                for name, template, naming in known:
                    # As many words as the distinct ones that the text lacks can't be matched.
                    if len(set(template) - have) <= len(template) - _least(len(template), coverage):
                        found += [(*place, name) for place in occurrences(words, template, coverage, naming)]
                apart = _apart(found)
                owner += [i] * len(apart)
                rows += apart
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["doc_id", "license", "coverage", "first", "last"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, first bigint, last bigint")
