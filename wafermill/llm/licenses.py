"""License scans by conditional compression.

A block of words that restates a license notice compresses better when the notice is given as a
dictionary. The words of a whole text are cut, whatever the line breaks, into overlapping blocks about as
long as the templates; blocks without a single telling word of a template cannot restate one. Every other
block is compressed alone and with each template of its length as zstandard raw dictionary. Templates are
ranked by the bytes this saves, relative to what the template saves on the least of its own wording that may
stand for it; those that save too little are out, the others are confirmed word by word: of n words d may
differ, so one of d + 1 parts stands unchanged and is aligned with the text around it. Of notices
confirmed for the same words the one wins whose template saves more bytes of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafermill.llm.bpe import Remembered
from wafermill.llm.common import slices

#: Notices of up to this many words must stand whole and uninterrupted; of longer ones a tenth may differ.
SHORT, MAY_DIFFER = 16, 0.1
#: A template is confirmed in a block where it saves this share of what it saves on its own wording.
LEAST_SAVING = 0.25
#: Below level 0 zstandard leaves letters without a match as they are, so what a match saves does not depend on the
#: other words of a block; matches have this many bytes or more. Confirmed notices are ranked at a level that finds all.
LEVEL, MATCH = -1, 5
RANKING_LEVEL = 19
#: Ends every block: a run that always compresses, or zstandard stores short blocks as they are and no saving shows.
ENDING = b"\0" * 32
#: Ends every dictionary: its last 8 bytes are not looked up.
DICT_END = b"\n" * 8
#: Words are compressed up to this length, which is beyond those of the templates.
LONGEST_WORD = 40

# Wording of public license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:"
    )),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    )),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    )),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    )),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."
    )),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    )),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    )),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *((f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.") for kind in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")),
    *(
        (f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.")
        for kind, name in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    ),
]
# Openings of a short notice that may be worded otherwise or be missing.
OPENING = frozenset("this work is are program software file code project released licensed distributed available under the a terms of".split())
WORDS = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def lowered(text: str) -> str:
    """The text in small letters, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Scanner:
    """Finds templates by what they save, confirms and ranks them."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = [(name, text, words(text)) for name, text in templates]
        texts = [self.block(template) for _, _, template in self.templates]
        self.quick = self._compressors(texts, LEVEL, min_match=MATCH)
        self.close = self._compressors(texts, RANKING_LEVEL)
        self.least = []
        #: Longest word of each part -> (template, place of the part in it, place of the word in the part, part).
        self.parts: dict[str, list[tuple[int, int, int, list[str]]]] = {}
        #: Half the words of a block -> its templates; a notice of one more word lies whole in a block.
        self.steps: dict[int, list[int]] = {}
        self.step: list[int] = []
        for k, (_, _, template) in enumerate(self.templates):
            cut = self._cut(template)
            must = cut[0][1] if len(cut) == 1 else template
            self.least.append(max(1, LEAST_SAVING * self.bytes_saved(self.block(must), k, self.quick)))
            longest = len(template) + (int(MAY_DIFFER * len(template)) if len(template) > SHORT else 0)
            step = 1 << max(2, (longest - 1).bit_length())
            self.step.append(step)
            self.steps.setdefault(step, []).append(k)
            for at, part in cut:
                longest = max(range(len(part)), key=lambda i: len(part[i]))
                self.parts.setdefault(part[longest], []).append((k, at, longest, part))
        self.keys = frozenset(self.parts)
        self.of_key = {word: frozenset(self.step[k] for k, *_ in parts) for word, parts in self.parts.items()}
        self.aligned = Remembered(lambda asked: self.differences(list(asked[1]), self.templates[asked[0]][2]), 2_000)
        self.ranked = Remembered(lambda asked: self.ranking(*asked), 10_000)
        self.saved = Remembered(lambda asked: (self.bytes_saved(*asked, self.close), self.saving(*asked)), 10_000)

    @staticmethod
    def _compressors(texts: list[bytes], level: int, **more) -> tuple[zstandard.ZstdCompressor, list[zstandard.ZstdCompressor]]:
        """A compressor without a dictionary, and one for each text given as dictionary."""
        # Nothing but the compressed bytes themselves: no magic number, sizes or checksums.
        bare = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=1024, window_log=18, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=False, write_content_size=False,
            write_dict_id=False, **more,
        )
        given = []
        for text in texts:
            wording = zstandard.ZstdCompressionDict(text + DICT_END, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            wording.precompute_compress(compression_params=bare)
            given.append(zstandard.ZstdCompressor(compression_params=bare, dict_data=wording))
        return zstandard.ZstdCompressor(compression_params=bare), given

    def _cut(self, template: list[str]) -> list[tuple[int, list[str]]]:
        """(place, words) of the parts of a template of which one at least stands unchanged."""
        if not template:
            return []
        if len(template) <= SHORT:
            # The opening may vary; the rest must stand as it is, without a word between.
            start = next((i for i, w in enumerate(template) if w not in OPENING), 0)
            return [(start, template[start:])]
        parts = int(MAY_DIFFER * len(template)) + 1
        cuts = [len(template) * i // parts for i in range(parts + 1)]
        return [(a, template[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def block(own: list[str]) -> bytes:
        """Words as the compressor sees them: single spaces between and around them."""
        return f" {' '.join([w[:LONGEST_WORD] for w in own])} ".encode("utf-8", "replace")

    @staticmethod
    def bytes_saved(block: bytes, k: int, compressors: tuple) -> int:
        """Bytes that a template saves of a compressed block."""
        alone, given = compressors
        raw = block + ENDING
        return len(alone.compress(raw)) - len(given[k].compress(raw))

    def saving(self, block: bytes, k: int) -> float:
        """Share of the compressed size of a notice that a template saves."""
        return self.bytes_saved(block, k, self.close) / len(self.close[0].compress(block + ENDING))

    def ranking(self, block: bytes, step: int) -> list[int]:
        """Templates of a length that save enough of a block, the best first."""
        alone, given = self.quick
        raw = block + ENDING
        size = len(alone.compress(raw))
        shares = [((size - len(given[k].compress(raw))) / self.least[k], k) for k in self.steps[step]]
        return [k for share, k in sorted(shares, key=lambda s: (-s[0], s[1])) if share >= 1]

    def differences(self, block: list[str], template: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """(first, end, missing, extra) of the alignment with the fewest differences: the words of the block
        it spans, words of the template that the block lacks, and words that the block puts between them."""
        cost = [[0] * (len(block) + 1)]
        for i, w in enumerate(template, 1):
            above, row = cost[-1], [i]
            for j, v in enumerate(block, 1):
                row.append(above[j - 1] if w == v else min(above[j], row[-1]) + 1)
            cost.append(row)
        i, j = len(template), min(range(len(block) + 1), key=cost[-1].__getitem__)
        missing, extra, met = [], [], []
        while i:
            if j and template[i - 1] == block[j - 1]:
                i, j = i - 1, j - 1
                met.append(j)
            elif j == 0 or cost[i][j] == cost[i - 1][j] + 1:
                i -= 1
                missing.append(template[i])
            else:
                j -= 1
                extra.append(block[j])
        return (met[-1], met[0] + 1, missing[::-1], extra[::-1]) if met else None

    def candidates(self, own: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(template, places of its telling words) for all blocks and the templates that save enough of them."""
        hits: dict[tuple[int, int], list[int]] = {}
        for at, word in enumerate(own):
            for step in self.of_key.get(word, ()):
                # Blocks overlap by half, so every word is in two of them.
                number = at // step
                hits.setdefault((step, number), []).append(at)
                if number:
                    hits.setdefault((step, number - 1), []).append(at)
        for (step, number), places in hits.items():
            for k in self.ranked[self.block(own[number * step : (number + 2) * step]), step]:
                yield k, places

    def confirmed(self, own: list[str], k: int, places: Iterable[int]) -> Iterator[tuple[int, int, int, list[str], list[str]]]:
        """(template, first word, end, missing, extra) where a template stands around some places of its words."""
        template, done = self.templates[k][2], 0
        most = int(MAY_DIFFER * len(template))
        for at in places:
            for other, offset, longest, part in self.parts[own[at]]:
                begin = at - longest
                if other != k or begin < done or own[begin : begin + len(part)] != part:
                    continue
                if len(template) <= SHORT:
                    n = 0
                    while n < min(offset, begin) and own[begin - 1 - n] == template[offset - 1 - n]:
                        n += 1
                    yield k, begin - n, begin + len(part), template[: offset - n], []
                    continue
                low = max(begin - offset - most, done, 0)
                found = self.aligned[k, tuple(own[low : begin - offset + len(template) + most])]
                if found is not None and len(found[2]) + len(found[3]) <= most:
                    done = low + found[1]
                    yield k, low + found[0], low + found[1], found[2], found[3]

    def notices(self, text: str) -> list[tuple]:
        """(license, template number, saving, missing words, extra words, start, end) of the notices in a
        text, in order; of templates that share most of their words the best one."""
        low = lowered(text)
        own = WORDS.findall(low)
        if self.keys.isdisjoint(own):
            return []
        # Blocks overlap, so most notices are met twice.
        found = {(k, a, b): (missing, extra) for t, places in self.candidates(own) for k, a, b, missing, extra in self.confirmed(own, t, places)}
        if not found:
            return []
        spans = [m.span() for m in WORDS.finditer(low)]
        ranked = []
        for (k, a, b), (missing, extra) in found.items():
            saved, share = self.saved[self.block(own[a:b]), k]
            ranked.append((-saved, k, a, b, share, missing, extra))
        taken = bytearray(len(own))
        out = []
        for _, k, a, b, share, missing, extra in sorted(ranked):
            if 2 * sum(taken[a:b]) > b - a:
                continue
            taken[a:b] = b"\1" * (b - a)
            out.append((self.templates[k][0], k, share, missing, extra, spans[a][0], spans[b - 1][1]))
        return sorted(out, key=lambda f: (f[5], f[1]))

    def scan(self, block: str) -> tuple | None:
        """(license, template number, saving, missing words, extra words) of the longest notice in a block."""
        found = self.notices(block)
        return max(found, key=lambda f: f[6] - f[5])[:5] if found else None


@lru_cache(maxsize=4)
def _scanner(templates: tuple) -> Scanner:
    return Scanner(list(templates))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License notices in the texts of ``docs``.

    One row per row of ``docs`` and notice found: id, ``line`` of its first word (from 0),
    ``license``, ``saving`` (share of the notice's compressed size that the template saves),
    ``missing`` (words of the template that the text lacks), ``extra`` (words between) and ``block``
    (the notice as it stands in the text, over as many lines as it takes). ``templates`` lists
    (license, wording); of templates that save as much of the same words the earlier one counts.
    Null and empty texts have none; null ids and repeated rows are kept; other columns are not
    read; an empty table gives an empty result. Whole texts, row by row, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = tuple(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(wanted)
        for whole in batches:
            for part in slices(whole, "_text"):
                rows, found = [], []
                for k, text in enumerate(part.column("_text").to_pylist()):
                    notices = scanner.notices(text)
                    breaks = [m.start() for m in re.finditer("\n", text)] if notices else []
                    for name, _, saving, missing, extra, start, end in notices:
                        rows.append(k)
                        found.append((bisect_right(breaks, start), name, saving, missing, extra, text[start:end]))
                line, name, saving, missing, extra, block = zip(*found, strict=True) if found else ([],) * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id").take(pa.array(rows, pa.int64())), pa.array(line, pa.int64()), pa.array(name, pa.string()), pa.array(saving, pa.float64()),
                        pa.array(missing, pa.list_(pa.string())), pa.array(extra, pa.list_(pa.string())), pa.array(block, pa.string()),
                    ],
                    names=["_id", "line", "license", "saving", "missing", "extra", "block"],
                )

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {kind}, line bigint, license string, saving double, missing array<string>, extra array<string>, block string"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
