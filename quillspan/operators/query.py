"""The query language: terms (AND), "phrases", -exclusions, -"phrases" and site:host."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAX_TERM_BYTES, MAX_NUMBER = 40, 12


def words(text: str) -> list[str]:
    """The surviving terms of a text. Dropped terms leave no gap in a query."""
    found, now = [], []
    for c in text:
        if c.isalpha() or c.isnumeric():
            now.append(c)
        elif now:
            found.append("".join(now))
            now = []
    if now:
        found.append("".join(now))
    terms = ("".join(c.lower() for c in w) for w in found)
    return [t for t in terms if len(t.encode()) <= MAX_TERM_BYTES and not re.fullmatch(r"[0-9]{%d,}" % (MAX_NUMBER + 1), t)]


@dataclass
class Query:
    required: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    excluded_phrases: list[list[str]] = field(default_factory=list)
    site: str | None = None

    @property
    def empty(self) -> bool:
        """Exclusions and a site alone ask for nothing."""
        return not self.required

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(self.required))


def chunks(raw: str) -> list[tuple[str, bool, bool]]:
    """(text, negated, quoted): blanks part chunks outside quotes; a minus negates only where a chunk begins;
    a quote inside a word joins what it holds to it; an open quote runs to the end; empty chunks vanish."""
    out: list[tuple[str, bool, bool]] = []
    text, negated, quoted, inside, begun = "", False, False, False, False
    for c in raw + " ":
        if inside:
            if c == '"':
                inside = False
            else:
                text += c
        elif c == '"':
            inside = quoted = begun = True
        elif c.isspace():
            if text.strip():
                out.append((text, negated, quoted))
            text, negated, quoted, begun = "", False, False, False
        elif c == "-" and not begun:
            negated = begun = True
        else:
            begun = True
            text += c
    if inside and text.strip():
        out.append((text.rstrip() if text.endswith(" ") else text, negated, quoted))
    return out


def parse(raw: str) -> Query:
    q = Query()
    for text, negated, quoted in chunks(raw):
        if text.startswith("site:") and not negated and not quoted:
            host = text[5:].strip().lower()
            while host.startswith("www."):
                host = host[4:]
            if host:
                q.site = host
            continue
        terms = words(text)
        if not terms:
            continue
        if negated:
            if len(terms) == 1:
                q.excluded.append(terms[0])
            else:
                q.excluded_phrases.append(terms)
        else:
            q.required += terms
            if len(terms) > 1:
                q.phrases.append(terms)
    return q


PARTS_SCHEMA = "query_id bigint, kind string, part int, place int, term string"


def parts_of(query_id: int, q: Query) -> list[tuple]:
    """A query as rows: kind is term, phrase, not_term, not_phrase or site."""
    rows = [(query_id, "term", i, 0, t) for i, t in enumerate(q.terms)]
    rows += [(query_id, "phrase", i, j, t) for i, p in enumerate(q.phrases) for j, t in enumerate(p)]
    rows += [(query_id, "not_term", i, 0, t) for i, t in enumerate(dict.fromkeys(q.excluded))]
    rows += [(query_id, "not_phrase", i, j, t) for i, p in enumerate(q.excluded_phrases) for j, t in enumerate(p)]
    return rows + ([(query_id, "site", 0, 0, q.site)] if q.site else [])


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, text) -> the parts of all queries, parsed in Arrow batches."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = [r for i, t in zip(f["query_id"], f["text"]) if t is not None for r in parts_of(int(i), parse(t))]
            yield pd.DataFrame(rows, columns=["query_id", "kind", "part", "place", "term"])

    return queries.where("query_id is not null").select("query_id", "text").mapInPandas(run, PARTS_SCHEMA)


def literal(spark: SparkSession, texts: dict[int, str]) -> DataFrame:
    """The parts of queries given as they are; a local table of the plan."""
    rows = [r for i, t in texts.items() for r in parts_of(i, parse(t))]
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
    columns = [c.split()[0] for c in PARTS_SCHEMA.split(", ")]
    return spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(columns, types))}))
