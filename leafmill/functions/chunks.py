"""Splitters of long texts: by characters, by tokens along separators, and by searched token length.

All find the places of their cuts first, by bisection over ascending candidate places, and slice then.
A token count must not fall when a text gets longer.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators in order of preference.
CHAR_SEPARATORS = ("。", "！", "？", "；", ".", "!", "?", ";", "，", "、", ",", "\n\n", "\n", " ", "")
TOKEN_SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ".", "!", "?", ";", "，", ",", " ", "")
_TOKEN = re.compile(r"[一-鿿]|[^\W一-鿿]+")


def count_tokens(text: str) -> int:
    """Substitute token count, equal to ``functions.text.token_count``: Han characters plus words."""
    return len(_TOKEN.findall(text))


def _between(text: str, count: Callable[[str], int]) -> Callable[[int, int], int]:
    """``count(text[a:b])`` for any a and b. The text is read once for ``count_tokens``, as a part of a token is one too."""
    if count is not count_tokens:
        return lambda a, b: count(text[a:b])
    spans = [m.span() for m in _TOKEN.finditer(text)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    return lambda a, b: bisect_left(starts, b) - bisect_right(ends, a) if a < b else 0


def _runs(widths: Sequence[int], glue: int, size: int) -> Iterator[slice]:
    """The longest runs of fields that are at most ``size`` wide when glued; a wider field is a run of its own."""
    ends = list(accumulate(w + glue for w in widths))
    start = 0
    while start < len(ends):
        room = size + glue + (ends[start - 1] if start else 0)
        stop = max(start + 1, bisect_right(ends, room, start))
        yield slice(start, stop)
        start = stop


def split_chars(text: str | None, size: int = 4000, overlap: int = 0) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the most preferred separator that helps.

    Chunks are stripped; the separator at a cut and blank fields are dropped. A field that is
    too long is split by the separators that follow. With ``overlap``, a chunk starts with the
    last characters of the one before it if that is longer (and may then exceed ``size``); this
    holds for the chunks of a long field and again for all chunks of the text that has it.
    """
    if not text:
        return []
    return [text] if len(text) <= size else _char_chunks(text, CHAR_SEPARATORS, size, overlap)


def _char_chunks(text: str, separators: Sequence[str], size: int, overlap: int) -> list[str]:
    fields, level = [], 0
    for level, separator in enumerate(separators):
        fields = [x for x in text.split(separator) if x.strip()] if separator else list(text)
        if len(fields) > 1:
            break
    found: list[str] = []
    for run in _runs([len(x) for x in fields], len(separators[level]), size):
        joined = separators[level].join(fields[run])
        found += [joined.strip()] if len(joined) <= size else _char_chunks(joined, separators[level + 1 :], size, overlap)
    tails = ["", *(x[-overlap:] if 0 < overlap < len(x) else "" for x in found)]
    return [chunk for chunk in map("".join, zip(tails, found, strict=False)) if chunk]


def split_tokens(text: str | None, size: int = 500, overlap: int = 0, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Chunks of at most ``size`` tokens that keep every separator; ``overlap`` characters may exceed the size.

    A character of more than ``size`` tokens is a chunk of its own.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    text = text or ""
    places = [0, *_token_places(text, 0, len(text), 0, size, _between(text, count))]
    chunks = [text[a:b] for a, b in zip(places, places[1:], strict=False)]
    tails = ["", *(x[-overlap:] if overlap else "" for x in chunks)]
    return list(map("".join, zip(tails, chunks, strict=False)))


def _token_places(text: str, start: int, stop: int, level: int, size: int, count: Callable[[int, int], int]) -> Iterator[int]:
    """Where the chunks of ``text[start:stop]`` end, cut behind separators of ``level`` or, in fields that are too long, later ones."""
    if start == stop:
        return
    if level == len(TOKEN_SEPARATORS) or count(start, stop) <= size:
        yield stop
        return
    separator = TOKEN_SEPARATORS[level]
    ends: Sequence[int] = range(start + 1, stop + 1)
    if separator:
        ends = [m.end() for m in re.finditer(re.escape(separator), text[start:stop])]
        ends = [start + e for e in ends]
        if not ends or ends[-1] != stop:
            ends.append(stop)
    at, tried = start, 0
    while at < stop:
        width = 1  # doubled until too wide, so that counting takes time in proportion to a chunk
        while tried + width < len(ends) and count(at, ends[tried + width]) <= size:
            width *= 2
        fit = bisect_right(ends, size, tried, min(len(ends), tried + width + 1), key=lambda e: count(at, e))  # noqa: B023
        if fit > tried:
            yield ends[fit - 1]
        else:
            fit = tried + 1
            yield from _token_places(text, at, ends[tried], level + 1, size, count)
        at, tried = ends[fit - 1], fit


def split_fast(text: str | None, size: int = 500, overlap: int = 0, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Chunks of at most ``size`` tokens found by bisection and snapped to a separator near the cut.

    How far a chunk can reach is estimated from the text's first 1000 characters. The snapped
    cut is measured from the chunk's own start. Chunks are stripped. ``overlap`` characters are
    shortened until the chunk fits again.
    """
    if not text:
        return []
    between = _between(text, count)
    if between(0, len(text)) <= size:
        return [text]
    few = min(1000, len(text))
    reach = max(1, int(size * few / max(1, between(0, few)) * 1.2))
    places = [0]
    while places[-1] < len(text):
        places.append(_fast_place(text, places[-1], reach, size, between))
    chunks = [x for x in (text[a:b].strip() for a, b in zip(places, places[1:], strict=False)) if x]
    if not overlap:
        return chunks
    out = chunks[:1]
    for before, chunk in zip(chunks, chunks[1:], strict=False):
        tail = before[-overlap:]
        joined = _between(tail + chunk, count)
        width = bisect_right(range(1, len(tail) + 1), size, key=lambda n: joined(len(tail) - n, len(tail) + len(chunk)))  # noqa: B023
        out.append(before[len(before) - width :] + chunk)
    return out


def _fast_place(text: str, at: int, reach: int, size: int, count: Callable[[int, int], int]) -> int:
    """Where the chunk that begins at ``at`` ends."""

    def furthest(low: int, high: int) -> int:
        return low + bisect_right(range(low + 1, high + 1), size, key=lambda p: count(at, p))

    end = max(at + 1, furthest(at, min(at + reach, len(text))))
    if end == len(text):
        return end
    near = min(200, reach // 4)
    low, high = max(at, end - near), min(len(text), end + near)
    last = furthest(end, high)
    for separator in TOKEN_SEPARATORS[:-1]:
        behind = (low + m.end() for m in re.finditer(re.escape(separator), text[low:high]))
        if fitting := [p for p in behind if at < p <= last]:
            return min(fitting, key=lambda p: abs(p - end))
    return end


#: Texts, and characters of them, whose results are held at once.
FEW_TEXTS, FEW_CHARACTERS = 256, 1 << 20


def few_at_once(*columns: pd.Series) -> Iterator[pd.Series]:
    """Neighbours of a batch by the number and the length of the first column's texts; tuples where there are more columns.

    What Python holds of their results does not grow with the batch.
    """
    a = characters = 0
    for b, text in enumerate(columns[0]):
        if b > a and (b - a == FEW_TEXTS or characters + len(text or "") > FEW_CHARACTERS):
            yield tuple(c.iloc[a:b] for c in columns) if len(columns) > 1 else columns[0].iloc[a:b]
            a, characters = b, 0
        characters += len(text or "")
    if a < len(columns[0]):
        yield tuple(c.iloc[a:] for c in columns) if len(columns) > 1 else columns[0].iloc[a:]


def chunked(text: Column, kind: str = "chars", size: int = 4000, overlap: int = 0) -> Column:
    """The chunks of a text as an array; kinds 'chars', 'tokens' and 'fast'."""
    split = {"chars": split_chars, "tokens": split_tokens, "fast": split_fast}[kind]

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for part in few_at_once(texts):
                yield part.map(lambda t: split(t, size, overlap))

    return run(text)
