"""Licence scans by sentence rules: known sentences become identifiers, licences are sequences of identifiers.

Sentences are compared in lower case as words of letters and digits alone. A sentence of a text may be wrapped over
lines: it begins after a line end, a sentence end or the start, and is known if its words are exactly those of a
known sentence up to a line end or sentence end. The identifiers found in a text, in order, are matched against
ordered rules; a rule may be interrupted by at most GAP_WORDS other words between two of its sentences. At a place
the rule with the most sentences wins, and its sentences are used up.

A reservation of all rights is found as `proprietary`, with or without a copyright line before it; after a copyright
notice it may also stand in the same sentence. Before a licence text of several sentences it is part of that text.

Each document is read once by its task, with no shuffle; the rules are a fixed small table.

Defined results: null and empty texts have no finding; a licence that is found twice gives two rows; a rule whose
first sentence stands alone gives no row unless a rule of that sentence alone exists; a null doc_id is passed on;
other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_WORDS = 12
RESERVED = "All rights reserved."

# Licence notices, sentence by sentence.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("Released under the MIT License.",)),
    ("MIT", ("Licensed under the MIT License.",)),
    ("MIT", ("This project is licensed under the MIT License.",)),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software.",
    )),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
        " on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    )),
    ("GPL-3.0-only", ("This work is licensed under the GNU General Public License, version 3.",)),
    ("GPL-3.0-or-later", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
    )),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0.",)),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0.",)),
    ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0.",)),
    ("BSD-3-Clause", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
    )),
    ("BSD-2-Clause", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution.",
    )),
    ("MPL-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    )),
]
RULES += [(name, (RESERVED, *sentences)) for name, sentences in RULES if len(sentences) > 1]
RULES.append(("proprietary", (RESERVED,)))
FINDING = "doc_id bigint, licence string, start bigint, end bigint, sentences array<int>"

_WORD = re.compile(r"[^\W_]+")
_EDGE = re.compile(r"[.!?;:][\"')\]]*(?=\s|$)|\n")
# A copyright notice from its line's start, up to COPYRIGHT_CHARS long, with no sentence end needed after it.
COPYRIGHT_CHARS = 200
_COPYRIGHT = re.compile(r"(?:^|\n)[\W_]*?(?:copyright(?![^\W_])|©|\(c\))[^\n]*$")


def words(sentence: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(sentence.lower()))


_RESERVED = words(RESERVED)


class Scanner:
    """Known sentences by identifier, and the rules over identifiers."""

    def __init__(self, rules: list[tuple[str, tuple[str, ...]]]):
        self.identifiers: dict[tuple[str, ...], int] = {}
        self.rules = [
            (name, tuple(self.identifiers.setdefault(words(s), len(self.identifiers)) for s in sentences))
            for name, sentences in rules]
        self.rules.sort(key=lambda rule: -len(rule[1]))
        self.by_opening: dict[str, list[tuple[str, ...]]] = {}
        for sentence in sorted(self.identifiers, key=len, reverse=True):
            self.by_opening.setdefault(" ".join(sentence[:2]), []).append(sentence)
        openings = "|".join(r"[\W_]+".join(map(re.escape, o.split())) for o in sorted(self.by_opening))
        self.opening = re.compile(rf"(?<![^\W_])(?:{openings})(?![^\W_])")

    def sentences(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, identifier) of the known sentences of a text, in order."""
        lowered = text.lower()
        if len(lowered) != len(text):
            # A few capitals change their length; they are no part of any known sentence.
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out, used = [], 0
        for hit in self.opening.finditer(lowered):
            if hit.start() < used:
                continue
            begins = self._begins(lowered, hit.start())
            for sentence in self.by_opening[" ".join(_WORD.findall(hit.group()))]:
                if not begins and not (sentence == _RESERVED and self._after_copyright(lowered, hit.start())):
                    continue
                end = self._match(lowered, hit.start(), sentence)
                if end is not None:
                    out.append((hit.start(), end, self.identifiers[sentence]))
                    used = end
                    break
        return out

    def _begins(self, text: str, at: int) -> bool:
        """Is there a line or sentence end, or the start, before this place, with no word between?"""
        back = at - 1
        while back >= 0 and not text[back].isalnum():
            if text[back] in "\n.!?;:":
                return True
            back -= 1
        return back < 0

    def _after_copyright(self, text: str, at: int) -> bool:
        """Does a copyright notice stand before this place in its line?"""
        return _COPYRIGHT.search(text[max(0, at - COPYRIGHT_CHARS):at]) is not None

    def _match(self, text: str, at: int, sentence: tuple[str, ...]) -> int | None:
        for word in sentence:
            found = _WORD.search(text, at)
            if found is None or found.group() != word:
                return None
            at = found.end()
        follows = _WORD.search(text, at)
        edge = _EDGE.search(text, at)
        if follows is None or (edge is not None and edge.start() < follows.start()):
            return at
        return None

    def scan(self, text: str) -> list[tuple[str, int, int, list[int]]]:
        """(licence, start, end, identifiers) of the rules matched in a text."""
        found = self.sentences(text)
        out, at = [], 0
        while at < len(found):
            for name, rule in self.rules:
                if self._follows(text, found, at, rule):
                    out.append((name, found[at][0], found[at + len(rule) - 1][1], list(rule)))
                    at += len(rule)
                    break
            else:
                at += 1
        return out

    def _follows(self, text: str, found: list[tuple[int, int, int]], at: int, rule: tuple[int, ...]) -> bool:
        part = found[at:at + len(rule)]
        if tuple(f[2] for f in part) != rule:
            return False
        return all(len(_WORD.findall(text, a[1], b[0])) <= GAP_WORDS for a, b in zip(part, part[1:]))


def licences(docs: DataFrame, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """doc_id, licence, start and end (characters) and sentence identifiers of every licence found."""
    scanner = Scanner(RULES if rules is None else rules)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [
                (i, *hit) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"))
                for hit in scanner.scan(text.as_py() or "")]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = zip(*hits) if hits else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names="doc_id licence start end sentences".split())

    return rows.mapInArrow(scan, FINDING)
