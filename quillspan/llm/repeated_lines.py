"""Lines repeated across one site's documents.

The wording of a line is its letters: lower-cased, every run of other characters one
blank, outer blanks dropped. For each wording of a source the records that hold it
inside and outside the source are compared by Dunning's log-likelihood ratio; the
tests of the whole collection are controlled by the Benjamini-Hochberg step-up rule.

A line is *repeated* if it holds the floors on records and share and either

* its excess over the other sources is significant, which decides for all lines that
  few sources have, or
* it is *widespread*: it stands in at least ``WIDESPREAD`` of all records. Such a line can
  fill every source alike, so that no source exceeds the rest, and is boilerplate still.

Cleaning anti-joins the repeated wordings against the lines of each source and puts the
lines that are left together again by their position.

Defined results: null and blank texts count for nothing and hold no lines; a null
source is a source of its own; rows that repeat an id count once, of different texts
under one id the least is cleaned; a text of which all lines are removed becomes empty;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

MIN_RECORDS, MIN_SHARE, MIN_LETTERS, FALSE_DISCOVERY = 5, 0.2, 8, 0.01
#: Share of all records from which a line is widespread. A line of the floors that is rarer than this has a
#: log-likelihood ratio of 15 or more, far beyond what the control of false discoveries asks for.
WIDESPREAD = 0.02


def wording(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\P{L}+", " "))


def lines(df: DataFrame, id_col: str, source: Column, text_col: str, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(id, source, line_no, h1, h2): every line, written once for all that follows. The wording of a line of
    enough letters goes on as two 64-bit hashes, so shuffles carry 16 bytes instead of a line; others have nulls."""
    texts = df.select(F.col(id_col).alias("id"), source.alias("source"), F.split(text_col, "\n").alias("lines")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    each = texts.select("id", "source", F.posexplode("lines").alias("line_no", "line")).select("id", "source", (F.col("line_no") + 1).cast("int").alias("line_no"), wording(F.col("line")).alias("wording"))
    long = F.length(F.replace("wording", F.lit(" "), F.lit(""))) >= min_letters
    return materialise(each.select("id", "source", "line_no", F.when(long, F.xxhash64("wording")).alias("h1"), F.when(long, F.xxhash64(F.concat(F.lit("second"), F.col("wording")))).alias("h2")), "lines")


def _x_log_x(n: Column) -> Column:
    return F.when(n > 0, n * F.log(n)).otherwise(F.lit(0.0))


def log_likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """2 log(likelihood ratio) of two binomial samples k1 of n1 and k2 of n2; negative where the first is the rarer."""
    both = lambda k, n: _x_log_x(k) + _x_log_x(n - k) - _x_log_x(n)
    llr = F.greatest(F.lit(0.0), F.lit(2.0) * (both(k1, n1) + both(k2, n2) - both(k1 + k2, n1 + n2)))
    return F.when(k1 * n2 >= k2 * n1, llr).otherwise(-llr)


def _tail(llr: Column) -> Column:
    """log10 of the upper tail of chi-square with one degree of freedom, one-sided:
    erfc(x)/2 with x = sqrt(llr/2), by its continued fraction beyond 1 (Abramowitz and Stegun 7.1.14 and 7.1.26)."""
    x = F.sqrt(F.greatest(llr, F.lit(0.0)) / 2)
    t = F.lit(1.0) / (1 + 0.3275911 * x)
    near = (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    far = F.lit(0.5641895835477563) / (x + 0.5 / (x + 1.0 / (x + 1.5 / (x + 2.0 / (x + 0.5)))))
    log_p = (F.log(F.when(x < 2.5, near).otherwise(far) / 2) - x * x) / F.log(F.lit(10.0))
    return F.when(llr > 0, log_p).otherwise(F.log10(F.lit(0.5)))


def tested_lines(df: DataFrame, id_col: str, source: Column, text_col: str, min_records: int = MIN_RECORDS, false_discovery: float = FALSE_DISCOVERY, own_lines: DataFrame | None = None) -> DataFrame:
    """(source, h1, h2, n_in, records_in, n_out, records_out, llr, log10_p, significant) of every wording in at least min_records of a source."""
    own = lines(df, id_col, source, text_col) if own_lines is None else own_lines
    held = own.where("h1 is not null").select("source", "h1", "h2", "id").distinct()
    n_in = materialise(held.groupBy("source", "h1", "h2").agg(F.count(F.lit(1)).alias("n_in")), "counts")
    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).where(~F.col(text_col).rlike(r"^[\s\p{Z}]*$"))
    per_source = texts.select(source.alias("source"), F.col(id_col).alias("id")).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("records_in"))
    all_records = per_source.agg(F.sum("records_in").alias("records"))
    sums = n_in.groupBy("h1", "h2").agg(F.sum("n_in").alias("n_all"), F.max("n_in").alias("most")).where(F.col("most") >= min_records).drop("most")
    frequent = n_in.where(F.col("n_in") >= min_records).join(sums, ["h1", "h2"])
    joined = frequent.join(per_source, frequent.source.eqNullSafe(per_source.source)).drop(per_source.source)
    tests = joined.select("source", "h1", "h2", "n_in", "records_in", (F.col("n_all") - F.col("n_in")).alias("n_out"), (all_records.scalar() - F.col("records_in")).alias("records_out"))
    tests = tests.withColumn("llr", log_likelihood(F.col("n_in").cast("double"), F.col("records_in").cast("double"), F.col("n_out").cast("double"), F.col("records_out").cast("double")))
    # Few rows, and the step-up rule reads them twice.
    return benjamini_hochberg(materialise(tests.withColumn("log10_p", _tail(F.col("llr"))), "tests"), "log10_p", false_discovery)


def benjamini_hochberg(tests: DataFrame, log10_p: str, rate: float) -> DataFrame:
    """Adds ``significant``. The step-up rule compares p(i) with rate * i / m; ranks come from a
    histogram of log10 p in steps of 1/100 down to -400, so no global sort is needed: a test is ranked by the
    number of tests in its own step or a more significant one. The window runs over at most 40,000 steps."""
    step = F.floor(F.greatest(F.col(log10_p), F.lit(-400.0)) * 100)
    stepped = tests.withColumn("step", step)
    counts = stepped.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.max(log10_p).alias("p"))
    ranked = counts.selectExpr("step", "p", "sum(n) over (order by step) as i", "sum(n) over () as m")
    limit = ranked.where(F.col("p") <= F.log10(F.lit(rate) * F.col("i") / F.col("m"))).agg(F.max("step").alias("limit"))
    return stepped.withColumn("significant", F.coalesce(F.col("step") <= limit.scalar(), F.lit(False))).drop("step")


def chosen_wordings(tests: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, h1, h2, path): the repeated wordings of each source, found by 'excess' or as 'widespread'."""
    floors = (F.col("n_in") >= min_records) & (F.col("n_in") / F.col("records_in") >= min_share)
    widespread = (F.col("n_in") + F.col("n_out")) / (F.col("records_in") + F.col("records_out")) >= WIDESPREAD
    path = F.when(F.col("significant"), "excess").when(widespread, "widespread")
    return tests.withColumn("path", path).where(floors & F.col("path").isNotNull()).select("source", "h1", "h2", "path")


def _met(own: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    return own.join(chosen, own.source.eqNullSafe(chosen.source) & (own.h1 == chosen.h1) & (own.h2 == chosen.h2), how)


def repeated_lines(df: DataFrame, id_col: str, source: Column, text_col: str, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, line_no): every line whose wording its source repeats."""
    own = lines(df, id_col, source, text_col)
    chosen = chosen_wordings(tested_lines(df, id_col, source, text_col, min_records, own_lines=own), min_records, min_share)
    return _met(own.where("h1 is not null"), chosen, "left_semi").select("id", F.col("line_no").cast("bigint").alias("line_no")).distinct()


def clean_texts(df: DataFrame, id_col: str, source: Column, text_col: str, extra: list[str] = ()) -> DataFrame:
    """(id, text, extra ...): the texts of df without the lines that df repeats in their source, one row per id.
    Extra columns come along from the row of the text."""
    own = lines(df, id_col, source, text_col)
    chosen = chosen_wordings(tested_lines(df, id_col, source, text_col, own_lines=own))
    left = _met(own, chosen, "left_anti").groupBy("id").agg(F.collect_set("line_no").alias("kept"))
    row = F.struct(F.col(text_col).alias("text"), *extra)
    texts = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(row).alias("row")).select("id", "row.*")
    parts = F.split("text", "\n")
    # Positions of one id are few; those of another text under the same id fall out where it is shorter.
    placed = F.transform(F.filter(F.array_sort(F.coalesce("kept", F.array().cast("array<int>"))), lambda i: i <= F.size(parts)), lambda i: F.element_at(parts, i))
    whole = F.col("text").isNull() | (F.size("kept") == F.size(parts))
    return texts.join(left, "id", "left").select("id", F.when(whole, F.col("text")).otherwise(F.array_join(placed, "\n")).alias("text"), *extra)


def without_lines(df: DataFrame, id_col: str, text_col: str, chosen: DataFrame) -> DataFrame:
    """(id, text): the texts without the chosen (id, line_no), one row per id, of its least text."""
    texts = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
    each = texts.select("id", F.posexplode_outer(F.split("text", "\n")).alias("at", "line")).withColumn("line_no", F.col("at").cast("bigint") + 1)
    left = each.join(chosen, ["id", "line_no"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    text = F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).otherwise(F.lit(""))
    return texts.join(left, "id", "left").select("id", F.when(F.col("text").isNotNull(), F.coalesce(text, F.lit(""))).alias("text"))
