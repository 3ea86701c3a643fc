"""Extracts of texts around the query terms. Lengths are code points."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH, REACH = 240, 40
_WORD = re.compile(r"[^\W_]+")


def densest(found: list[tuple[int, int, str]], size: int, budget: int) -> tuple[int, int]:
    """Of the stretches of ``budget`` characters that have a quarter before one of the matches, the earliest that holds most
    different terms. Matches are in order and do not overlap, so those within a stretch are a slice of them."""
    starts, ends, terms = zip(*found)
    begins = [max(0, s - budget // 4) for s in starts]
    shown = lambda a: len(set(terms[bisect_left(starts, a) : bisect_right(ends, min(a + budget, size))]))
    best = max(begins, key=shown)
    return best, min(best + budget, size)


def widened(text: str, start: int, end: int) -> tuple[int, int]:
    """Both ends moved outwards to a blank, if one is within reach."""
    if start > 0:
        for i in range(start, max(0, start - REACH) - 1, -1):
            if i == 0 or text[i - 1].isspace():
                start = i
                break
    if end < len(text):
        for i in range(end, min(len(text), end + REACH) + 1):
            if i == len(text) or text[i].isspace():
                end = i
                break
    return start, end


def snippet(text: str | None, terms: list[str], allowed: bool = True, most: int | None = None, length: int = LENGTH) -> tuple[str, list[tuple[int, int]]]:
    """(extract, highlights); both empty where extracts are forbidden or the text is blank."""
    if not allowed or most == 0 or not text or not text.strip():
        return "", []
    budget = length if most is None else min(length, most)
    wanted = set(terms)
    found = [(m.start(), m.end(), t) for m in _WORD.finditer(text) if (t := m.group().lower()) in wanted]
    start, end = densest(found, len(text), budget) if found else (0, min(budget, len(text)))
    start, end = widened(text, start, end)
    part = text[start:end]
    lead = "…" if start > 0 else ""
    cut = len(part) - len(part.lstrip())
    out = lead + part.strip() + ("…" if end < len(text) else "")
    marks = [(s - start - cut + len(lead), e - start - cut + len(lead)) for s, e, _ in found if s >= start and e <= end]
    return out, [(a, z) for a, z in marks if a >= len(lead) and z <= len(out)]


_RANGE = T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])
SNIPPET = T.StructType([T.StructField("text", T.StringType()), T.StructField("highlights", T.ArrayType(_RANGE))])


@F.pandas_udf(SNIPPET)
def snippets(texts: pd.Series, terms: pd.Series, allowed: pd.Series, most: pd.Series) -> pd.DataFrame:
    """For the few rows that a search returns."""
    rows = [snippet(t, list(q), a is None or bool(a), None if m is None or m != m else int(m)) for t, q, a, m in zip(texts, terms, allowed, most)]
    return pd.DataFrame({"text": [r[0] for r in rows], "highlights": [[{"from": a, "to": z} for a, z in r[1]] for r in rows]})
