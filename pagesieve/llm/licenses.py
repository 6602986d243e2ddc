"""License notices in texts by conditional compression.

Around each word that speaks of licensing a region of words is taken, across line breaks. A region
is as wide as the longest match to both sides, so every match around a sign lies whole in one.

1. Blocks of a region (twice as long as the longest match, overlapping by half) are compressed alone and with each
   template as a raw dictionary for zstandard. All templates are ranked by the most bytes that they save in a block.
2. In that order each template is confirmed by its exact difference in words, also one that saves nothing: what its wording needs
   to become part of the text must be at most ``MOST_MISSING`` of its words, and words that set licenses apart (versions,
   names) must be among those that agree. Words between those of the template are counted: at most as many as the
   template has in one gap, and ``MOST_OTHER`` times as many in all. A number counts only for the name and the version it stands
   with. Of overlapping places of a template the best one counts.
3. A confirmed place claims the template's words in it. A place of which all such words are claimed by templates
   of higher rank is closed.

What a template saves of its confirmed place, as a share of the size without it, is reported.

Candidates are chosen by an expression in Spark; the comparison runs in tasks, on the regions, whole texts
being read. Nothing is shuffled.

Defined cases: a null or empty text has no license; a license that occurs in several places of a text
is reported at the one with the fewest missing words, then fewest other words, then the first; templates that save
equally are ranked by their number of words, then by name; equal rows are reported alike; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wordings of short notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights-reserved": "All rights reserved",
}
#: Texts without any of these are no candidates; every template has one of them.
SIGNS = r"(?i)licen[sc]|rights\s+reserved|permission|redistribut|public\s+domain|unencumbered"
#: Words that tell licenses apart, besides those with a digit; those of a template must all be found.
TELLING = {"by", "by-nc", "by-nd", "by-sa", "cc", "mit", "gnu", "apache", "mozilla", "affero", "lesser"}
_WORD = re.compile(r"[\w./-]*\w")
MOST_MISSING = 0.2
#: Other words inside a match, as a multiple of the template's words; the FSF's notice has 21 for 12.
MOST_OTHER = 2
#: Words that may stand between two numbers of which both are meant, as in "version 2 or (at your option) version 3".
LINKS = {"or", "and", "and/or", "version", "versions", "v", "license", "the", "of", "either", "at", "your", "option", "any", "later"}
#: Words that make another license of the name before them.
QUALIFIERS = {"affero", "lesser", "library"}
#: Words of a region that are compared at once, besides the overlap.
REGION = 4096
_NUMBER = re.compile(r"\d")
_LEVEL = 3

Word = tuple[str, int, int]


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Template:
    """A wording, and its places in lists of words."""

    def __init__(self, words: list[str]):
        self.words, n = words, len(words)
        self.telling = [w in TELLING or bool(re.search(r"\d", w)) for w in words]
        self.needed = {w for w, t in zip(words, self.telling) if t}
        self.counts = Counter(words)
        self.missing, self.other = int(MOST_MISSING * n), MOST_OTHER * n
        told = [i for i, t in enumerate(self.telling) if t]
        self._first, self._last = (told[0], told[-1]) if told else (n, -1)
        self._at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            self._at.setdefault(w, []).append(i)

    def span(self) -> int:
        """The most words from the first to the last of a match."""
        return len(self.words) + self.other

    def _enough(self, have: Counter) -> bool:
        """Whether words of these numbers can hold the wording in any order; what fails has no place."""
        return self.needed <= have.keys() and sum(min(n, have[w]) for w, n in self.counts.items()) >= len(self.words) - self.missing

    def places(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(missing, other, first word, word behind the last) of matches that don't overlap, best first."""
        n, found = len(self.words), []
        if not self._enough(Counter(words)):
            return []
        marks = _Marks(words)
        recent: deque = deque()  # (place, word of the template, fewest other words by missing words)
        for j, w in enumerate(words):
            if w not in self._at:
                continue
            while recent and j - recent[0][0] - 1 > n:
                recent.popleft()
            new = []
            for i in self._at[w]:
                costs = {i: 0} if i <= self.missing and i <= self._first else {}
                for before, k, old in recent:
                    if k < i and i - k - 1 <= self.missing and before < j and not any(self.telling[k + 1 : i]) and self._may_follow(k, before, i, j, marks):
                        for missing, other in old.items():
                            missing, other = missing + i - k - 1, other + j - before - 1
                            if missing <= self.missing and other <= min(self.other, costs.get(missing, self.other)):
                                costs[missing] = other
                if costs:
                    new.append((j, i, costs))
                    if i >= self._last:
                        found += [
                            (m + n - 1 - i, other, j + m - i - other, j + 1) for m, other in costs.items() if m + n - 1 - i <= self.missing
                        ]
            recent.extend(new)
        best: list[tuple[int, int, int, int]] = []
        for x in sorted(found):
            if not any(x[2] < z and a < x[3] for _, _, a, z in best):
                best.append(x)
        return best

    def _may_follow(self, k: int, before: int, i: int, j: int, marks: _Marks) -> bool:
        """Whether what lies between places ``before`` and ``j`` may part words ``k`` and ``i`` of the template."""
        if j == before + 1 or not self._first <= k or i > self._last:
            return True
        if self.telling[k] and marks.qualifiers[j] > marks.qualifiers[before + 1]:
            return False
        number = marks.next_number[before + 1]
        if number < j and marks.last_plain[j] > number:
            return False  # another number, and not in one list with this one
        return not _NUMBER.match(self.words[i]) or marks.plain[j] - marks.plain[before + 1] <= i - k - 1


class _Marks:
    """Of a list of words: how many before each place are plain (no number, no link) or qualifiers, and where the nearest ones are."""

    def __init__(self, words: list[str]):
        n = len(words)
        numbers = [bool(_NUMBER.match(w)) for w in words]
        self.plain, self.qualifiers, self.last_plain, self.next_number = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1), [n] * (n + 1)
        for j, w in enumerate(words):
            is_plain = not numbers[j] and w not in LINKS
            self.plain[j + 1] = self.plain[j] + is_plain
            self.qualifiers[j + 1] = self.qualifiers[j] + (w in QUALIFIERS)
            self.last_plain[j + 1] = j if is_plain else self.last_plain[j]
        for j in range(n - 1, -1, -1):
            self.next_number[j] = j if numbers[j] else self.next_number[j + 1]


class Scanner:
    """Finds the templates' wordings in lists of words."""

    def __init__(self, templates: dict[str, str]):
        import zstandard

        self._plain = zstandard.ZstdCompressor(level=_LEVEL, write_content_size=False)
        self._templates = {n: Template(wording(templates[n])) for n in sorted(templates)}
        self.radius = max(t.span() for t in self._templates.values())
        self._with = {}
        for n, t in self._templates.items():
            data = zstandard.ZstdCompressionDict(" ".join(t.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self._with[n] = zstandard.ZstdCompressor(level=_LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)

    def saving(self, name: str, words: list[str]) -> float:
        """A template's share of the compressed size of words that it saves."""
        data = " ".join(words).encode()
        return 1 - len(self._with[name].compress(data)) / len(self._plain.compress(data))

    def ranked(self, words: list[str]) -> list[str]:
        """All templates by the most bytes of compressed size that they save in a block of the words, largest first."""
        saved: dict[str, int] = {}
        for i in range(0, max(1, len(words) - self.radius), self.radius):
            data = " ".join(words[i : i + 2 * self.radius]).encode()
            alone = len(self._plain.compress(data))
            for name, tool in self._with.items():
                here = alone - len(tool.compress(data))
                saved[name] = max(saved.get(name, here), here)
        return sorted(saved, key=lambda n: (-saved[n], -len(self._templates[n].words), n))

    def region(self, words: list[str]) -> list[tuple[str, float, int, int, int, int]]:
        """(template, saving, missing words, other words, first word, word behind the last) of the wordings in a region, by rank."""
        rows, claimed = [], set()
        for name in self.ranked(words):
            template = self._templates[name]
            for missing, other, first, last in template.places(words):
                own = {i for i in range(first, last) if words[i] in template.counts}
                if not own <= claimed:
                    claimed |= own
                    rows.append((name, round(self.saving(name, words[first:last]), 6), missing, other, first, last))
        return rows


def regions(text: str, radius: int) -> Iterator[list[Word]]:
    """(word, begin, end) of the words around each sign of licensing; regions that overlap are one, long ones are cut with an overlap."""
    signs = (m.start() for m in re.finditer(SIGNS, text))
    sign = next(signs, None)
    if sign is None:
        return
    before: deque[Word] = deque(maxlen=radius)
    region, left = [], 0
    for m in _WORD.finditer(text):
        word = (m.group().lower(), m.start(), m.end())
        while sign is not None and sign < m.end():
            region, left, sign = region or list(before), radius, next(signs, None)
        if not left and sign is None:
            return
        before.append(word)
        if left or region:
            region.append(word)
            left -= 1
            if left <= 0:
                yield region
                region, left = [], 0
            elif len(region) >= REGION + 2 * radius:
                yield region
                region = region[-2 * radius :]
    if region:
        yield region


def find(text: str, scanner: Scanner) -> list[tuple[str, float, int, int, int, int]]:
    """(template, saving, missing, other, begin, end) of each license of a text, by name."""
    best: dict[str, tuple] = {}
    for region in regions(text, scanner.radius):
        for name, saving, missing, other, first, last in scanner.region([w[0] for w in region]):
            begin, end = region[first][1], region[last - 1][2]
            rank = (missing, other, begin)
            if name not in best or rank < best[name][0]:
                best[name] = (rank, (name, saving, missing, other, begin, end))
    return [best[n][1] for n in sorted(best)]


def licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, saving, missing_words, other_words, begin, end) of each license in each document."""
    known = dict(templates or TEMPLATES)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("saving", T.DoubleType()),
        *(T.StructField(c, T.LongType()) for c in ("missing_words", "other_words", "begin", "end")),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for batch in batches:
            rows, of = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = find(text, scanner)
                rows += found
                of += [i] * len(found)
            if rows:
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], schema.names)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), text.alias("text")).filter(F.col("text").rlike(SIGNS)).mapInArrow(run, schema)
