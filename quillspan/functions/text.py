"""Token and text expressions. All are built-in functions, so they stay inside the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TERM_BYTES, MAX_NUMBER_BYTES, FIELD_GAP = 40, 12, 1000
FIELDS = ["body", "title", "heading", "url", "anchor"]
#: Letters with combining vowel signs, and numbers of every kind.
WORD = r"[\p{IsAlphabetic}\p{N}]+"


def raw_words(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased one by one, dropped tokens included."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def useful(term: Column) -> Column:
    """Neither too long nor an over-long number."""
    size = F.octet_length(term)
    # Most terms are short, and a short one needs no pattern.
    return (size <= MAX_NUMBER_BYTES) | ((size <= MAX_TERM_BYTES) & ~term.rlike(r"^[0-9]{%d,}$" % (MAX_NUMBER_BYTES + 1)))


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"^[^:/?#]*://", "")


def not_blank(text: Column) -> Column:
    return text.isNotNull() & text.rlike(r"[^\s\p{Z}]")


def field_tokens(docs: DataFrame, fields: dict[str, Column], key: str = "crawl_doc") -> DataFrame:
    """(key, field, position, term): the surviving tokens of each field. Dropped tokens keep their position."""
    parts = F.array(*(F.struct(F.lit(i).alias("field"), raw_words(c).alias("words")) for i, c in enumerate(fields.values())))
    each = docs.select(key, F.explode(parts).alias("f")).select(key, "f.field", F.posexplode("f.words").alias("position", "term"))
    return each.where(useful(F.col("term")))


def field_lengths(tokens: DataFrame, fields: list[str], key: str = "crawl_doc") -> DataFrame:
    """(key, len_<field> ...): the last surviving position + 1 of each field."""
    return tokens.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("field") == i, F.col("position") + 1)), F.lit(0)).alias(f"len_{f}") for i, f in enumerate(fields)))


# Text rather than columns: both stand in higher-order functions of a search, whose plan is faster to parse than to build.
#: Inverse document frequency of a term of t.df documents, among stats.n_docs.
IDF = "ln(1 + (stats.n_docs - least(t.df, stats.n_docs) + 0.5d) / (least(t.df, stats.n_docs) + 0.5d))"
#: The factor of a page's quality, between 0 and 1.
QUALITY = "least(greatest(least(greatest(text_ratio, 0.0d), 0.5d) / 0.5d * (1 - least(greatest(link_density, 0.0d), 1.0d)) / (1 + scripts / 15.0d), 0.0d), 1.0d)"


def thousandths(x: Column) -> Column:
    """Single precision, cut to thousandths, between 0 and 1."""
    y = F.least(F.greatest(F.coalesce(x, F.lit(0.0)).cast("float") * F.lit(1000.0).cast("float"), F.lit(0.0).cast("float")), F.lit(1000.0).cast("float"))
    return F.floor(y) / 1000.0


def damped(v: Column, most: Column) -> Column:
    return F.when(most > 0, F.least(F.greatest(F.log1p(v) / F.log1p(most), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def tidy(anchor: Column) -> Column:
    """Anchor wording: blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(anchor, F.lit("")), r"[\s\p{Z}]+", " ")))


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TiB"
