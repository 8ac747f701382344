"""License scans: templates are ranked by what they save of a block's compressed size and confirmed by wording; sizes decide between passages."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices

# Words without which a passage is no license statement.
CUE = r"(?i)licen[sc]|copyright|copyleft|spdx|public domain|creative commons|\bcc[ -]by|\bcc0\b|redistribut|hereby granted|without warrant|mozilla|\bmpl\b|free to copy"
_CUE = re.compile(CUE)
_WORD = re.compile(r"[a-z0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_END = re.compile(r"[.!?;]*")
LEAST = 0.8
EXTRA = 3

# License, words that its statement must hold where the wording has them, and wordings: declarations and the standard notices.
_CC = "This work is licensed under a Creative Commons {} {} International License."
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "mit", (
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.",
    )),
    ("Apache-2.0", "2", (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    )),
    ("GPL-3.0", "3", (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3 license.",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    )),
    ("GPL-2.0", "2", (
        "This work is licensed under the GNU General Public License, version 2.", "Released under the GNU GPL v2 license.",
        "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    )),
    ("LGPL-3.0", "lesser 3", (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    )),
    ("LGPL-2.1", "lesser 2 1", (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    )),
    ("AGPL-3.0", "affero 3", (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    )),
    ("BSD-3-Clause", "bsd 3", (
        "Released under the BSD 3-Clause License.", "Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    )),
    ("BSD-2-Clause", "bsd 2", (
        "Released under the BSD 2-Clause License.", "Licensed under the 2-Clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    )),
    ("MPL-2.0", "mozilla 2", (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    )),
    ("ISC", "isc", (
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    )),
    ("Unlicense", "unlicense", (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.",
    )),
    ("CC0-1.0", "cc0", ("Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal.")),
    ("CC-BY-4.0", "by 4", ("Licensed under CC BY 4.0.", _CC.format("Attribution", "4.0"))),
    ("CC-BY-SA-4.0", "sa 4", ("Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike", "4.0"))),
    ("CC-BY-NC-4.0", "nc 4", ("Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial", "4.0"))),
    ("CC-BY-ND-4.0", "nd 4", ("Licensed under CC BY-ND 4.0.", _CC.format("Attribution-NoDerivatives", "4.0"))),
    ("CC-BY-NC-SA-4.0", "nc sa 4", ("Licensed under CC BY-NC-SA 4.0.", _CC.format("Attribution-NonCommercial-ShareAlike", "4.0"))),
    ("CC-BY-NC-ND-4.0", "nc nd 4", ("Licensed under CC BY-NC-ND 4.0.", _CC.format("Attribution-NonCommercial-NoDerivatives", "4.0"))),
)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str, reach: int) -> list[tuple[int, int]]:
    """Candidate blocks of a whole text, as places in code points: `reach` words on either side of each cue, whatever the line breaks.

    Blocks that meet are one.
    """
    cues = [(m.start(), m.end()) for m in _CUE.finditer(text)]
    if not cues:
        return []
    places = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    begins = [a for a, _ in places]
    out: list[tuple[int, int]] = []
    for a, b in cues:
        first, last = max(0, bisect_right(begins, a) - 1 - reach), min(len(places), bisect_right(begins, b) + reach) - 1
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        elif last >= first:
            out.append((first, last))
    return [(places[a][0], _END.match(text, places[b][1]).end()) for a, b in out]


@dataclass(frozen=True)
class Verdict:
    license: str
    start: int
    stop: int
    alone: int
    given: int
    missing: int
    extra: int


class Scanner:
    """The templates as dictionaries of raw content; one for each task, with the verdicts on blocks that came before."""

    def __init__(self, templates: Sequence[tuple[str, str, tuple[str, ...]]] = TEMPLATES, level: int = 9, cached: int = 20_000):
        import zstandard

        self.templates = [(name, t) for name, _, texts in templates for t in texts]
        self.required = {name: words(needed) for name, needed, _ in templates}
        options = {"level": level, "write_content_size": False}
        self.plain = zstandard.ZstdCompressor(**options)
        self.with_dictionary = lambda data: zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options)
        self.data = [t.lower().encode() for _, t in self.templates]
        self.given = [self.with_dictionary(t) for t in self.data]
        self.words = [words(t) for _, t in self.templates]
        self.counts = [Counter(w) for w in self.words]
        self.own = [set(self.required[name]).intersection(w) for (name, _), w in zip(self.templates, self.words, strict=True)]
        # Words that a passage has at most, and those it can begin with, if the share LEAST of the template is in it.
        self.most_extra = [max(EXTRA, (1 - LEAST) * len(w)) for w in self.words]
        self.longest = [int(len(w) + e) for w, e in zip(self.words, self.most_extra, strict=True)]
        self.first = [set(w[: len(w) - math.ceil(LEAST * len(w)) + 1]) for w in self.words]
        self.reach = max(self.longest, default=0)
        self.judge = lru_cache(cached)(self._judge)

    def ranked(self, block: str, among: Iterable[int] | None = None) -> list[tuple[int, int, int]]:
        """Templates by what they save of the compressed size: (size alone, size with the template, template), most first."""
        data = block.strip().lower().encode()
        alone = len(self.plain.compress(data))
        sizes = [(len(self.given[i].compress(data)), i) for i in (range(len(self.given)) if among is None else among)]
        return [(alone, given, i) for given, i in sorted(sizes)]

    def _possible(self, i: int, counts: Counter) -> bool:
        """Whether a block of these words can hold the wording of template i: the share LEAST of its words, and all of the license's own."""
        return all(counts[w] for w in self.own[i]) and sum(min(n, counts[w]) for w, n in self.counts[i].items()) >= LEAST * len(self.words[i])

    def _aligned(self, i: int, own: list[str]) -> tuple[int, int, int, int] | None:
        """The passage of `own` that has the wording of template i: first word, word after the last, words missing and words more.

        It has the template's words in order to the share LEAST at least, few words more between them, and all of the license's own words.
        """
        template = self.words[i]
        same = [m for m in SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks() if m.size]

        def passage(same: list) -> tuple[int, int, int, int] | None:
            matched = sum(m.size for m in same)
            if matched < LEAST * len(template):
                return None
            start, stop = same[0].b, same[-1].b + same[-1].size
            held = {w for m in same for w in template[m.a : m.a + m.size]}
            extra = stop - start - matched
            return (start, stop, len(template) - matched, extra) if extra <= self.most_extra[i] and self.own[i] <= held else None

        # Words before and after the passage aren't differences; words inside it are. Far words at its ends may be before or after it.
        tried = [passage(same)] if same else []
        while len(same) > 1 and same[1].b - same[0].b - same[0].size > same[0].size:
            same = same[1:]
            tried.append(passage(same))
        while len(same) > 1 and same[-1].b - same[-2].b - same[-2].size > same[-1].size:
            same = same[:-1]
            tried.append(passage(same))
        return min((x for x in tried if x), key=lambda x: x[2] + x[3], default=None)

    def _passages(self, i: int, own: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """Passages with the wording of template i, from left to right."""
        least = LEAST * len(self.words[i])
        at, reach, of = 0, self.longest[i], self.counts[i]
        for k, w in enumerate(own):
            if k < at or w not in self.first[i]:
                continue
            near = own[k : k + reach]
            if sum(min(n, of[x]) for x, n in Counter(near).items() if x in of) < least:
                continue
            found = self._aligned(i, near)
            if not found:
                continue
            begin = k
            # Words before the passage took some of the reach.
            while found[0] and (again := self._aligned(i, own[begin + found[0] : begin + found[0] + reach])):
                begin, found = begin + found[0], again
            start, stop, missing, extra = found
            at = begin + stop
            yield begin + start, begin + stop, missing, extra

    def _judge(self, block: str) -> tuple[Verdict, ...]:
        """The passages of the block that have the wording of a license; they don't overlap.

        Templates are ranked by what they save of the compressed block and confirmed by wording in that order. No saving is too small: long
        sentences hide short declarations, so only templates of whose words the block holds too few are left out. Of passages
        that overlap, the one counts whose template saves most of its compressed size, less what the passage leaves of the
        template's; of equal ones, that with fewer differences and then that whose template ranks higher in the block.
        """
        places = [(m.start(), m.end()) for m in _TOKEN.finditer(block)]
        own = [block[a:b].lower() for a, b in places]
        counts = Counter(own)
        found = []
        possible = [i for i in range(len(self.templates)) if self._possible(i, counts)]
        for rank, (_, _, i) in enumerate(self.ranked(block, possible) if possible else ()):
            for start, stop, missing, extra in self._passages(i, own):
                a, b = places[start][0], _END.match(block, places[stop - 1][1]).end()
                data = block[a:b].lower().encode()
                alone, given = len(self.plain.compress(data)), len(self.given[i].compress(data))
                rest = len(self.with_dictionary(data).compress(self.data[i]))
                found.append((given + rest - alone, missing + extra, rank, Verdict(self.templates[i][0], a, b, alone, given, missing, extra)))
        out: list[Verdict] = []
        for *_, v in sorted(found, key=lambda x: x[:3]):
            # What is taken is kept in order, so only the neighbours can overlap.
            at = bisect_right(out, v.start, key=lambda x: x.start)
            if (at == 0 or out[at - 1].stop <= v.start) and (at == len(out) or out[at].start >= v.stop):
                out.insert(at, v)
        return tuple(out)


_FOUND = T.StructType([
    T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
    T.StructField("size_alone", T.IntegerType()), T.StructField("size_given", T.IntegerType()),
    T.StructField("n_missing", T.IntegerType()), T.StructField("n_extra", T.IntegerType()),
])


def statements(scanner: Scanner, text: str) -> list[dict]:
    """The license statements of a whole text, in order: each passage that has a wording, with its own place."""
    return [
        {"license": v.license, "start": a + v.start, "stop": a + v.stop, "size_alone": v.alone, "size_given": v.given,
         "n_missing": v.missing, "n_extra": v.extra}
        for a, b in blocks(text, scanner.reach) for v in scanner.judge(text[a:b])
    ]


def scan(df: DataFrame, *, text: str = "text", templates: Sequence[tuple[str, str, tuple[str, ...]]] = TEMPLATES) -> DataFrame:
    """One row for each license statement of each row: the other columns of `df`, `license`, `start` and `stop` (code points), the compressed
    sizes of the passage alone and with the template, and the words that differ.

    Only texts with a cue leave the JVM. Null and empty texts have no statement; repeated rows have theirs each; equal blocks of a task
    are judged once. Columns of `df` with these names are replaced; the text itself isn't returned.
    """
    kept = [c for c in df.columns if c != text and c not in _FOUND.fieldNames()]

    @F.arrow_udf(T.ArrayType(_FOUND))
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(templates)
        kind = pa.list_(pa.struct([(f.name, pa.string() if f.name == "license" else pa.int32()) for f in _FOUND]))
        for array in batches:
            parts: Iterable[pa.RecordBatch] = slices([pa.record_batch([array], names=["t"])], "t")
            yield pa.array([statements(scanner, t or "") for p in parts for t in p.column(0).to_pylist()], kind)

    with_cue = df.filter(F.rlike(text, F.lit(CUE)))
    return with_cue.select(*kept, find(F.col(text)).alias("_found")).select(*kept, F.inline("_found"))
