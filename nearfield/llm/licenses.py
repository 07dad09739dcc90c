"""License scans by conditional compression and exact word differences.

A wording of n words may differ in a tenth of n: words of it that the text lacks, and words that the text has between them besides.
None of either may be a name or number that tells licenses apart. Cut into one part more than it may have differences, a wording leaves
one part at least untouched, so one automaton pass for all parts finds every place where a wording can stand. The stretch of text that the wording
can cover from there is a candidate; candidates that overlap are one block.

Each block is compressed by zstandard alone and with each wording as raw dictionary. The wordings, ranked by the bytes that they save, are confirmed in
that order by the least differences on both sides of a part; a confirmed span takes its words, and the ranks below are confirmed in what is left.
So the compression decides between wordings that overlap and none is given up by its rank. Words alone count: line breaks, blank lines, punctuation and what
stands around do not.

Defined cases. A null or empty text has no license. Spans go from the first to the last word that matches, with a full stop that ends
both, and never overlap. Ties in saving go to the wording listed first, places of one wording from left to right. Time and memory are linear in a
text's length, but for a block's words, which are few around each place. Rows are scanned one by one, so repeated rows get equal results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.runs import trimmed
from nearfield.session import ship

# Wordings of public licenses, short notices and standard headers.
WORDINGS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    # The first lines of texts that are too long to list here.
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
)
#: Words that tell licenses apart.
NAMES = {"mit", "apache", "gnu", "lesser", "affero", "mozilla", "cc", "by", "sa", "nc", "nd", "sharealike", "noncommercial", "bsd", "isc", "cc0", "clause", "eclipse", "boost"}
#: Share of a wording's words that may differ.
DIFFER = 0.1
#: Blocks whose ranks are kept, and words of the longest that are; the table is emptied when full.
TABLE, SHORT = 20_000, 400

_words = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


@dataclass(frozen=True)
class Match:
    """saving is the share of its block's compressed size that the wording spares."""

    license: str
    saving: float
    missing: tuple[str, ...]
    extra: tuple[str, ...]


@lru_cache(1)
def _tools():
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    own = []
    for _, wording in WORDINGS:
        d = zstandard.ZstdCompressionDict(" ".join(_words.findall(wording.lower())).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return plain, own


@lru_cache(1)
def _seeds():
    """(words of each wording, an automaton of their parts, words of which a text with any part has one)."""
    templates = [_words.findall(w.lower()) for _, w in WORDINGS]
    parts: dict[str, list[tuple[int, int, int]]] = {}
    cues: set[str] = set()
    for t, words in enumerate(templates):
        n = int(DIFFER * len(words)) + 1
        bounds = [k * len(words) // n for k in range(n + 1)]
        for a, z in zip(bounds, bounds[1:]):
            parts.setdefault(f" {' '.join(words[a:z])} ", []).append((t, a, z))
            if cues.isdisjoint(words[a:z]):
                cues.add(max(words[a:z], key=len))
    automaton = ahocorasick.Automaton()
    for part, places in parts.items():
        automaton.add_word(part, places)
    automaton.make_automaton()
    return templates, automaton, tuple(sorted(cues))


def _tells(word: str) -> bool:
    return word in NAMES or word[0].isdigit()


def _extend(text: list[str], template: list[str], most: int) -> tuple[int, list[str], list[str]] | None:
    """(words of text read, missing, extra) of the least differences, at most ``most``, of the whole template from the start of text on."""
    if text[: len(template)] == template:
        return len(template), [], []
    rows: list[dict[int, int]] = []
    for i in range(len(template) + 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(text), i + most) + 1):
            costs = [0] if i == j == 0 else []
            if i and j and template[i - 1] == text[j - 1]:
                costs.append(rows[-1].get(j - 1, most + 1))
            if i and not _tells(template[i - 1]):
                costs.append(rows[-1].get(j, most + 1) + 1)
            if j and not _tells(text[j - 1]):
                costs.append(row.get(j - 1, most + 1) + 1)
            if costs and min(costs) <= most:
                row[j] = min(costs)
        if not row:
            return None
        rows.append(row)
    least = min(rows[-1].values())
    i, j = len(template), max(j for j, c in rows[-1].items() if c == least)
    read, missing, extra = j, [], []
    while i or j:
        cost = rows[i][j]
        if i and j and template[i - 1] == text[j - 1] and rows[i - 1].get(j - 1) == cost:
            i, j = i - 1, j - 1
        elif i and not _tells(template[i - 1]) and rows[i - 1].get(j) == cost - 1:
            i -= 1
            missing.append(template[i])
        else:
            j -= 1
            extra.append(text[j])
    return read, missing[::-1], extra[::-1]


_known: dict[str, tuple[tuple[int, float], ...]] = {}


def ranked(words: list[str]) -> tuple[tuple[int, float], ...]:
    """(wording, share of the block's compressed size that it saves as raw dictionary) of all wordings, the largest saving first."""
    block = " ".join(words)
    if block in _known:
        return _known[block]
    plain, own = _tools()
    data = block.encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    saving = [1 - len(c.compress(data)) / alone for c in own]
    out = tuple(sorted(enumerate(saving), key=lambda x: (-x[1], x[0])))
    if len(words) <= SHORT:
        if len(_known) >= TABLE:
            _known.clear()
        _known[block] = out
    return out


@dataclass
class Block:
    """Words first to last, exclusive, and the places in them of parts of wordings: by wording (first word of the part, part's bounds in the wording)."""

    first: int
    last: int
    parts: dict[int, list[tuple[int, int, int]]]


def candidate_blocks(words: list[str]) -> Iterator[Block]:
    """Maximal stretches of words that wordings could cover, in order."""
    templates, automaton, _ = _seeds()
    ends = list(accumulate(len(w) + 1 for w in words))
    hits = []
    for end, places in automaton.iter(f" {' '.join(words)} "):
        after = bisect_left(ends, end) + 1
        for t, a, z in places:
            at, most = after - (z - a), int(DIFFER * len(templates[t]))
            hits.append((max(0, at - a - most), min(len(words), after + len(templates[t]) - z + most), t, at, a, z))
    block: Block | None = None
    for first, last, t, at, a, z in sorted(hits):
        if block is None or first >= block.last:
            if block is not None:
                yield block
            block = Block(first, last, {})
        block.last = max(block.last, last)
        block.parts.setdefault(t, []).append((at, a, z))
    if block is not None:
        yield block


def _confirmed(words: list[str], block: Block) -> Iterator[tuple[int, int, int, float, list[str], list[str]]]:
    """(first word, word after the last, wording, saving, missing, extra): wordings by rank, each confirmed where no one before it stands."""
    templates = _seeds()[0]
    taken: list[tuple[int, int]] = []
    for t, saving in ranked(words[block.first : block.last]):
        template, most = templates[t], int(DIFFER * len(templates[t]))
        for at, a, z in sorted(block.parts.get(t, ())):
            i = bisect_left(taken, (at + 1,))
            low, high = taken[i - 1][1] if i else 0, taken[i][0] if i < len(taken) else len(words)
            if at < low or at + z - a > high:
                continue  # the part lies in a span that is confirmed
            left = _extend(words[max(low, at - a - most) : at][::-1], template[:a][::-1], most)
            if left is None:
                continue
            after = at + z - a
            right = _extend(words[after : min(high, after + len(template) - z + most)], template[z:], most - len(left[1]) - len(left[2]))
            if right is None:
                continue
            span = at - left[0], after + right[0]
            insort(taken, span)
            yield *span, t, saving, left[1][::-1] + right[1], left[2][::-1] + right[2]


def scan_text(text: str | None) -> list[tuple[int, int, Match]]:
    """(start, end, match) of each license, in order."""
    if not text:
        return []
    low = text.lower()
    if not any(c in low for c in _seeds()[2]):
        return []
    if len(low) != len(text):  # a few characters grow when lower-cased
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    words = _words.findall(low)
    places = [x for b in candidate_blocks(words) for x in _confirmed(words, b)]
    if not places:
        return []
    at = [m.span() for m in _words.finditer(low)]
    out = []
    for a, z, t, saving, missing, extra in sorted(places, key=lambda x: x[:2]):
        start, end = at[a][0], at[z - 1][1]
        if text[end : end + 1] == "." == WORDINGS[t][1][-1]:
            end += 1
        out.append((start, end, Match(WORDINGS[t][0], saving, tuple(missing), tuple(extra))))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found), a row for each row of docs; found is an array of (start, end, license, saving, missing, extra)."""
    ship(docs.sparkSession)
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saving", pa.float64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                found = [[{"start": s, "end": e, "license": m.license, "saving": m.saving, "missing": list(m.missing), "extra": list(m.extra)} for s, e, m in scan_text(t)] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(item))], ["doc_id", "found"])

    schema = f"doc_id {id_type}, found array<struct<start: long, end: long, license: string, saving: double, missing: array<string>, extra: array<string>>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))
