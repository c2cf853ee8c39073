"""License scans: fuzzy search for short notices (operator 12).

Whole texts are lower-cased in A-Z and cut into words; joined by one space they are searched once.
Base phrases count wherever their words stand one after the other. The method adds ``NOTICES``,
each with a number of edits that it may differ by, one for every ``CHARS_PER_EDIT`` characters.
A notice with k edits is split into k + 1 seeds: in every place within k edits one of the seeds
is left whole, as k edits cannot touch k + 1 of them (pigeonhole). An Aho-Corasick automaton over
the seeds of all notices finds their places in one pass. Around each place the starts and ends
of words that the notice can have there are verified by the ``regex`` library with its bounded
number of edits, which also tells how many there are; strings whose letters alone, in any order, need
more edits are not asked about. A notice must keep its names whole (``mit``, ``version 3``), as one
edit makes another license of them. Of the places of a notice that overlap the one with the fewest
edits stays (then the earliest, then the shortest).

Texts are searched where they are: nothing is shuffled, and a task holds one batch of texts.
Verdicts on equal strings are kept by each worker, up to ``KEPT_VERDICTS``.

Defined results: a null or empty text has no words, no places, labels '' and score 0; repeated rows
are each scanned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.llm._common import map_batches, read_table

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

CHARS_PER_EDIT = 9
KEPT_VERDICTS = 50_000


class Notice(NamedTuple):
    label: str
    text: str
    names: tuple[str, ...]
    """Words in a row that a place must keep."""

    @property
    def edits(self) -> int:
        return len(self.text) // CHARS_PER_EDIT


#: Short notices as licenses and their users word them.
NOTICES = (
    Notice("mit", "released under the mit license", ("mit",)),
    Notice("mit", "licensed under the mit license", ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ()),
    Notice("apache-2", "licensed under the apache license version 2 0", ("apache", "2 0")),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Notice("cc-by-nc", "creative commons attribution noncommercial 4 0", ("attribution", "4 0")),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Notice("cc-by-sa", "creative commons attribution sharealike 4 0", ("attribution", "4 0")),
    Notice("gpl-3", "licensed under the gnu general public license version 3", ("gnu general", "3")),
    Notice("gpl-2", "licensed under the gnu general public license version 2", ("gnu general", "2")),
    Notice("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser",)),
    Notice("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero", "3")),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ()),
    Notice("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla", "2 0")),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", ()),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ()),
    Notice("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse", "2 0")),
    Notice("boost-1", "distributed under the boost software license version 1 0", ("boost", "1 0")),
)


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """(place, piece) of the ``edits`` + 1 pieces of a notice; in any place within its edits one is left whole."""
    cuts = [round(i * len(notice.text) / (notice.edits + 1)) for i in range(notice.edits + 2)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_edits(a: Counter, b: Counter) -> int:
    """Edits that two strings with these letters need at least, wherever the letters stand."""
    return max((a - b).total(), (b - a).total())


def has_words(span: str, names: tuple[str, ...]) -> bool:
    return all(f" {n} " in f" {span} " for n in names)


class Place(NamedTuple):
    notice: int
    first_word: int
    last_word: int
    edits: int


class Scanner:
    """Finds base phrases and notices in words joined by one space."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        import ahocorasick
        import regex

        self.notices = notices
        at: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for place, piece in seeds(notice):
                at.setdefault(piece, []).append((k, place))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        letters = [Counter(n.text) for n in notices]
        patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}") for n in notices]

        @lru_cache(KEPT_VERDICTS)
        def edits(k: int, span: str) -> int | None:
            """How many edits make the notice into ``span``; None: more than it may have, or a name is lost."""
            if not has_words(span, notices[k].names) or least_edits(letters[k], Counter(span)) > notices[k].edits:
                return None
            found = patterns[k].fullmatch(span)
            return sum(found.fuzzy_counts) if found else None

        self.edits = edits

    def places(self, text: str, starts: list[int], ends: list[int]) -> list[Place]:
        """The places of notices in ``text``, whose words begin at ``starts`` and end at ``ends``."""
        windows: dict[int, set[int]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for k, place in found:
                begin, reach = end + 1 - size - place, self.notices[k].edits
                low, high = bisect_left(starts, begin - reach), bisect_right(starts, begin + reach)
                windows.setdefault(k, set()).update(range(low, high))
        out = []
        for k, firsts in windows.items():
            size, reach = len(self.notices[k].text), self.notices[k].edits
            hits = []
            for first in sorted(firsts):
                for last in range(bisect_left(ends, starts[first] + size - reach), bisect_right(ends, starts[first] + size + reach)):
                    edits = self.edits(k, text[starts[first] : ends[last]])
                    if edits is not None:
                        hits.append(Place(k, first, last, edits))
            out += best_apart(hits)
        return sorted(out, key=lambda p: (p.first_word, p.last_word, p.notice))


def best_apart(hits: list[Place]) -> list[Place]:
    """Of places that overlap, the one with the fewest edits, then the earliest, then the shortest."""
    kept: list[Place] = []
    for hit in sorted(hits, key=lambda p: (p.edits, p.first_word, p.last_word)):
        at = bisect_left(kept, hit.first_word, key=lambda p: p.first_word)
        if (at == 0 or kept[at - 1].last_word < hit.first_word) and (at == len(kept) or kept[at].first_word > hit.last_word):
            kept.insert(at, hit)
    return kept


def base_places(text: str) -> list[tuple[int, str]]:
    """(first word, label) of every base phrase in words joined by one space."""
    found = []
    padded = f" {text} "
    for phrase, label in BASE_PHRASES.items():
        at = padded.find(f" {phrase} ")
        word, counted = 0, 0
        while at >= 0:
            word += padded.count(" ", counted, at)
            counted = at
            found.append((word, label))
            at = padded.find(f" {phrase} ", at + 1)
    return found


_SPANS = "array<struct<label:string,first_char:int,last_char:int,first_word:int,last_word:int,edits:int,text:string>>"
_SCAN = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    f" score double, spans {_SPANS}"
)


def scan_text(scanner: Scanner, text: str) -> tuple:
    """The columns after doc_id for one whole text."""
    lowered = text.encode().lower().decode()
    words = _WORD.findall(lowered)
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    joined = " ".join(words)
    base = base_places(joined)
    places: list[Place] = []
    if next(scanner.automaton.iter(joined), None) is not None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        places = scanner.places(joined, starts, ends.tolist())
    spans = []
    if places:
        at = [m.span() for m in _WORD.finditer(lowered)]
        for p in places:
            notice, begin, end = scanner.notices[p.notice], at[p.first_word][0], at[p.last_word][1]
            spans.append((notice.label, begin, end, p.first_word, p.last_word, p.edits, text[begin:end]))
    base_labels = {label for _, label in base}
    score = max([1.0 - p.edits / len(scanner.notices[p.notice].text) for p in places] + [1.0] * bool(base), default=0.0)
    firsts = [w for w, _ in base]
    return (
        len(words),
        len(base),
        min(firsts, default=None),
        max(firsts, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {s[0] for s in spans})),
        score,
        spans,
    )


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """For every row its words, base places and labels, and ``spans`` of notices within their edits.

    ``first_char`` and ``last_char`` (excluded) are code points of the text, ``text`` is what stands there.
    """
    schema = docs.sparkSession.createDataFrame([], _SCAN).schema
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    fields = ("label", "first_char", "last_char", "first_word", "last_word", "edits", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            rows = [
                (i, *scan_text(scanner, t or "")) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in arrow]
            columns[-1] = [[dict(zip(fields, s, strict=True)) for s in spans] for spans in columns[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents")).drop("spans")
