"""Scores read from a judge's free text, strictly."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The axes of a score and its range.
AXES = ("groundedness", "correctness", "tone")
LOWEST, HIGHEST = 1, 5
SCORES = ", ".join(f"{a} int" for a in AXES) + ", parse_ok boolean"

#: A quoted string, closed or running off the end, or a brace outside of strings.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}]', re.S)


def unfenced(text: str) -> str:
    """The text without a code fence around it."""
    text = text.strip()
    if not text.startswith("```"):
        return text
    body = text.partition("\n")[2]
    return (body.rpartition("```")[0] if "```" in body else body).strip()


def first_object(text: str) -> str | None:
    """The first balanced {...}; braces in quoted strings don't count, from the start of the text on."""
    begin, depth = 0, 0
    for token in _TOKEN.finditer(text):
        if token[0] == "{":
            begin = begin if depth else token.start()
            depth += 1
        elif token[0] == "}" and depth:
            depth -= 1
            if not depth:
                return text[begin : token.end()]
    return None


def as_score(value) -> int | None:
    """A whole number from LOWEST to HIGHEST, also as 4.0 or "4"; nothing is rounded or clamped."""
    if isinstance(value, str) and re.fullmatch(r"\s*-?\d+\s*", value):
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value not in range(LOWEST, HIGHEST + 1):
        return None
    return int(value)


def read_scores(raw: str | None) -> dict:
    """The scores of all axes, or none of them where an axis is missing, another key is there, or a value is no score."""
    found = None
    text = unfenced(raw or "")
    for candidate in (text, first_object(text)):
        try:
            found = json.loads(candidate) if candidate is not None else None
            break
        except ValueError:
            continue
    scores = {a: as_score(found[a]) for a in AXES} if isinstance(found, dict) and set(found) == set(AXES) else {}
    ok = bool(scores) and None not in scores.values()
    return {**(scores if ok else dict.fromkeys(AXES)), "parse_ok": ok}


def parse_scores(raw: Column) -> Column:
    """struct of the axes and parse_ok; a null text doesn't parse."""

    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([read_scores(x) for x in batch], columns=[*AXES, "parse_ok"])
            yield rows.astype({a: "Int32" for a in AXES})

    return F.pandas_udf(parsed, SCORES)(raw)
