"""JSON found inside text: scanners as Arrow functions, parsing as VARIANT in the JVM."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of one kind of bracket in JSON that is read; bounds the work on hostile texts.
MAX_NESTING = 200
_FENCE = re.compile(r"```json\s*([\s\S]*?)\s*```")


def _valid(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def _fenced(text: str) -> str | None:
    found = _FENCE.search(text)
    body = found[1].strip() if found else ""
    return body if found and _valid(body) else None


def _balanced(text: str, pair: str) -> list[tuple[int, int, int]]:
    """(start, end, quotes) of what stands between matching brackets of ``pair``, by start; one pass.

    A quote behind a backslash does not count. Brackets match among those with as many quotes
    before them, odd or even, so what stands in a string, seen from a bracket, is left out. What
    has more than ``MAX_NESTING`` levels is no JSON that is read.
    """
    waiting: tuple[list[list[int]], list[list[int]]] = [], []  # of open brackets: the place, and the levels inside so far
    odd, found = 0, []
    for mark in re.finditer(rf'(?<!\\)"|[{re.escape(pair)}]', text):
        stack = waiting[odd]
        if mark[0] == '"':
            odd = 1 - odd
        elif mark[0] == pair[0]:
            stack.append([mark.start(), 0])
        elif stack:
            start, levels = stack.pop()
            if stack:
                stack[-1][1] = max(stack[-1][1], levels + 1)
            if levels < MAX_NESTING:
                found.append((start, mark.end(), odd))
    return sorted(found)


def _first_valid(text: str, pair: str) -> str | None:
    return next((text[a:b] for a, b, _ in _balanced(text, pair) if _valid(text[a:b])), None)


def _top_objects(text: str) -> str | None:
    """All valid objects outside strings and outside other balanced braces, as one array."""
    found, over = [], 0
    for a, b, odd in _balanced(text, "{}"):
        if not odd and a >= over:
            over = b
            if _valid(text[a:b]):
                found.append(text[a:b])
    return f"[{','.join(found)}]" if found else None


def find_json_array(text: str | None, mode: str = "auto") -> str | None:
    """The first JSON array of a text.

    Modes: 'jsonblock' a fenced block; 'array' the first balanced valid array; 'objects' all
    top-level objects as an array; 'auto' the first of these that finds something.
    """
    steps = {"jsonblock": _fenced, "array": lambda t: _first_valid(t, "[]"), "objects": _top_objects}
    for name in steps if mode == "auto" else (mode,):
        found = steps[name](text or "")
        if found is not None:
            return found
    return None


def find_json_object(text: str | None) -> str | None:
    """The first JSON object of a text: a fenced block, else the first balanced valid object."""
    found = _fenced(text or "")
    return found if found is not None else _first_valid(text or "", "{}")


def json_array(text: Column, mode: str = "auto") -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_json_array(t, mode))

    return run(text)


def json_object(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(find_json_object)

    return run(text)


def parsed_or(text: Column, default: str) -> Column:
    """The text as VARIANT, the default where it is no JSON."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit(default)))


def only_objects(variants: Column) -> Column:
    """The elements of an array of VARIANT that are objects."""
    return F.filter(variants, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
