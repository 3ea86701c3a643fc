"""The positional inverted index as four tables: postings, dictionary, doc_table, stats.

A segment is a partition of whole documents in crawl order; merging segments is a
union, so answers never depend on how documents were cut into segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hosts import plain_host
from ..functions.text import FIELD_GAP, FIELDS, MAX_NUMBER_BYTES, MAX_TERM_BYTES, not_blank, raw_words, thousandths, useful, without_scheme
from ..functions.urls import host_raw
from ..session import materialise, table
from .anchors import anchor_texts

FORMAT_VERSION = 1
DOCS_PER_SEGMENT = 50_000


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    dictionary: DataFrame
    doc_table: DataFrame
    stats: DataFrame

    def stored(self) -> Index:
        """The index written to the shared folder, postings in the order of their terms, so that a
        filter on terms reads only the row groups that hold them."""
        by_term = materialise(in_order(self.postings), "postings")
        return Index(by_term, materialise(dictionary(by_term), "dictionary"), self.doc_table, materialise(self.stats, "stats"))


def in_order(postings_: DataFrame) -> DataFrame:
    """Postings in the order of terms within each part. A term's documents are spread over the parts by ranges of ids, so
    one in a third of all documents makes no part larger than others. This is the one shuffle of an index build's postings."""
    return postings_.repartition(F.col("term"), F.floor(F.col("crawl_doc") / 65536)).sortWithinPartitions("term", "crawl_doc")


def crawl_docs(records: DataFrame) -> DataFrame:
    """One row per crawl_doc, late and repeated rows merged; blank texts stay in (link sources) until indexing."""
    return records.where("crawl_doc is not null").dropDuplicates(["crawl_doc"])


def indexable(docs: DataFrame) -> DataFrame:
    return docs.where(not_blank(F.col("text")))


def fields_of(anchor: bool) -> dict:
    columns = {"body": F.col("text"), "title": F.col("title"), "heading": F.array_join("headings", " "), "url": without_scheme(F.col("url"))}
    return columns | {"anchor": F.col("anchor") if anchor else F.lit("")}


def segments(docs: DataFrame, per_segment: int = DOCS_PER_SEGMENT) -> DataFrame:
    """(crawl_doc, segment): crawl order cut every per_segment documents. Ranks come from counts of id ranges,
    so no task sorts the whole crawl."""
    part = docs.select("crawl_doc", F.floor(F.col("crawl_doc") / 65536).alias("part"))
    before = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    ranked = part.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("crawl_doc")))
    return ranked.join(before, "part").select("crawl_doc", F.floor((F.col("before") + F.col("r") - 1) / per_segment).cast("int").alias("segment"))


def worded(kept: DataFrame, columns: dict) -> DataFrame:
    """Adds len_<field>, base_<field>, the words of all fields one after another, their number in each field and the place
    where each begins. Fields share one space of positions, with a gap between; a field's length ends with its last
    surviving word. All of it is worked out within the row."""
    slow = lambda words: F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(useful(w), i + 1))), F.lit(0))
    last = lambda words: F.when(F.size(words) == 0, F.lit(0)).when(useful(F.element_at(words, -1)), F.size(words)).otherwise(slow(words))
    out = kept.withColumns({f"w_{f}": raw_words(c) for f, c in columns.items()})
    out = out.withColumns({f"len_{f}": last(F.col(f"w_{f}")) for f in columns})
    sizes, starts = F.array(*(F.size(f"w_{f}") for f in columns)), F.array(*(F.col(f"base_{f}") for f in columns))
    return bases(out).withColumns({"words": F.concat(*(f"w_{f}" for f in columns)), "sizes": sizes, "bases": starts}).drop(*(f"w_{f}" for f in columns))


def build(records: DataFrame, anchors: bool = True, per_segment: int = DOCS_PER_SEGMENT) -> Index:
    # Repeats are merged once; what follows reads whole documents from the copy, in many tasks.
    docs = materialise(crawl_docs(records.select("crawl_doc", "url", "final_url", "title", "text", "headings", "links", "quality")), "docs")
    kept = indexable(docs).select("crawl_doc", "url", "title", "text", "headings", "quality")
    if anchors:
        kept = kept.join(materialise(anchor_texts(docs), "anchors"), "crawl_doc", "left")
    kept = worded(kept, fields_of(anchors))
    own = kept.select("crawl_doc", F.lower(host_raw(F.col("url"))).alias("host"), thousandths(F.col("quality.text_ratio")).alias("text_ratio"), thousandths(F.col("quality.link_density")).alias("link_density"), F.coalesce("quality.scripts", F.lit(0)).alias("scripts"), *(f"len_{f}" for f in FIELDS))
    doc_table = materialise(own.join(segments(indexable(docs), per_segment), "crawl_doc").withColumn("site_key", plain_host(F.col("host"))), "doc_table")
    made = postings(kept)
    return Index(made, dictionary(made), doc_table, stats(doc_table))


def bases(lengths: DataFrame) -> DataFrame:
    """Adds base_<field>: where each field begins in the position space of its document."""
    at = F.lit(0)
    for f in FIELDS:
        lengths = lengths.withColumn(f"base_{f}", at)
        at = F.col(f"base_{f}") + F.col(f"len_{f}") + FIELD_GAP
    return lengths


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (crawl_doc, words, sizes, bases) -> the postings of each document, from the words of all documents of a batch at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words, ids = batch.column(1).flatten(), batch.column(0).to_numpy()
        sizes, starts = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
        cell = np.repeat(np.arange(len(sizes)), sizes)
        position = starts[cell] + np.arange(len(cell)) - (np.cumsum(sizes) - sizes)[cell]
        length = pc.binary_length(words).to_numpy()
        kept = np.flatnonzero(length <= MAX_TERM_BYTES)
        long = kept[length[kept] > MAX_NUMBER_BYTES]
        numbers = long[pc.match_substring_regex(words.take(pa.array(long)), "^[0-9]+$").to_numpy(zero_copy_only=False)]
        kept = np.setdiff1d(kept, numbers, assume_unique=True)
        coded = words.take(pa.array(kept)).dictionary_encode()
        code, cell, position = coded.indices.to_numpy().astype(np.int64), cell[kept], position[kept]
        doc, field = cell // len(FIELDS), cell % len(FIELDS)
        key = doc * max(len(coded.dictionary), 1) + code
        # Positions rise through a document, and a stable sort keeps them in order.
        order = np.argsort(key, kind="stable")
        if not len(order):
            continue
        head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        counts = [pa.array(np.add.reduceat(field[order] == i, head, dtype=np.int32)) for i in range(len(FIELDS))]
        places = pa.ListArray.from_arrays(pa.array(np.r_[head, len(order)].astype(np.int32)), pa.array(position[order].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[order][head])), pa.array(ids[doc[order][head]]), *counts, places], names=["term", "crawl_doc", *(f"c_{f}" for f in FIELDS), "positions"])


def postings(docs: DataFrame) -> DataFrame:
    """(term, crawl_doc, c_<field> ..., positions): counts by field and sorted positions. A document's words all
    come from its own row, so this needs no shuffle of tokens."""
    schema = f"term string, crawl_doc bigint, {', '.join(f'c_{f} int' for f in FIELDS)}, positions array<int>"
    return docs.select(F.col("crawl_doc").cast("bigint"), "words", "sizes", "bases").mapInArrow(_gathered, schema)


def dictionary(postings_: DataFrame) -> DataFrame:
    """(term, df): documents that hold a term in any field."""
    return postings_.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def stats(doc_table: DataFrame) -> DataFrame:
    """One row: n_docs and the average length of each field."""
    return doc_table.agg(F.count(F.lit(1)).alias("n_docs"), *(F.coalesce(F.avg(f"len_{f}"), F.lit(0.0)).alias(f"avg_{f}") for f in FIELDS))


def merged(one: Index, other: Index, per_segment: int = 1_000_000) -> Index:
    """Both indexes as one; documents keep their order, statistics are those of all documents."""
    docs = one.doc_table.unionByName(other.doc_table).drop("segment")
    docs = docs.join(segments(docs, per_segment), "crawl_doc")
    terms = one.dictionary.unionByName(other.dictionary).groupBy("term").agg(F.sum("df").alias("df"))
    return Index(one.postings.unionByName(other.postings), terms, docs, stats(docs))


def write(index: Index, path: str) -> None:
    for name in ("postings", "dictionary", "doc_table", "stats"):
        df = getattr(index, name)
        if name == "postings":
            df = in_order(df)
        if name == "stats":
            df = df.withColumn("format_version", F.lit(FORMAT_VERSION))
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> Index:
    stats_ = spark.read.parquet(f"{path}/stats")
    versions = [r[0] for r in stats_.select("format_version").distinct().limit(2).collect()]
    if versions != [FORMAT_VERSION]:
        raise ValueError(f"index format {versions}, expected {FORMAT_VERSION}")
    return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "dictionary", "doc_table")), stats_.drop("format_version"))


def totals(index: Index) -> DataFrame:
    """One row for reports: documents, terms, postings, positions."""
    p = index.postings.agg(F.count(F.lit(1)).alias("postings"), F.sum(F.size("positions")).cast("bigint").alias("positions"))
    return index.doc_table.agg(F.count(F.lit(1)).alias("documents")).withColumns({"terms": index.dictionary.agg(F.count(F.lit(1))).scalar(), "postings": p.select("postings").scalar(), "positions": p.select("positions").scalar()})


_built: dict[tuple[str, str], Index] = {}


def of_tables(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder's records, built once per session and then read, as an engine serves its index."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = build(table(spark, sf_dir, "records")).stored()
    return replace(_built[key])
