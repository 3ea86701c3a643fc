"""Continuous ingest with Structured Streaming: segments appended per batch, keys seen once, polite hosts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.urls import dedupe_key, host_node
from ..operators import index as ix
from ..sources.store import RECORD_SCHEMA


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def seen_once(records: DataFrame, delay: str = "7 days") -> DataFrame:
    """Records whose address key was not seen within the delay; older keys leave the state with the watermark."""
    keyed = records.withColumn("key", dedupe_key(F.col("url"))).withColumn("at", F.timestamp_seconds("fetched_at"))
    return keyed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["key"])


def append_segments(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch becomes an immutable segment; a batch that runs again replaces its own segment only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        index = ix.build(batch, anchors=False)
        for name in ("postings", "doc_table"):
            df = getattr(index, name)
            if name == "doc_table":
                df = df.drop("segment")
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}/segment={batch_id}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_segments(spark: SparkSession, out: str) -> ix.Index:
    """All segments as one index; statistics are those of all documents."""
    postings = spark.read.parquet(f"{out}/postings").drop("segment")
    docs = spark.read.parquet(f"{out}/doc_table")
    terms = postings.select("term", "crawl_doc").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return ix.Index(postings, terms, docs, ix.stats(docs))


def _turns(delay: float):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ready = state.get[0] if state.exists else 0.0
        for f in frames:
            f = f.sort_values(["fetched_at", "url"])
            at = []
            for t in f["fetched_at"]:
                ready = max(ready, float(t))
                at.append(ready)
                ready += delay
            yield pd.DataFrame({"host": key[0], "url": f["url"].values, "ready": at})
        state.update((ready,))

    return run


def polite(records: DataFrame, delay: float = 3.0) -> DataFrame:
    """(host, url, ready): when each address may be fetched; a host's next turn is kept as state across batches."""
    named = records.select(host_node(F.col("url")).alias("host"), "url", F.coalesce("fetched_at", F.lit(0)).cast("double").alias("fetched_at"))
    return named.groupBy("host").applyInPandasWithState(_turns(delay), "host string, url string, ready double", "ready double", "append", GroupStateTimeout.NoTimeout)


def events_per_window(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events per window and type; events later than the watermark are dropped."""
    w = F.window("ts", length)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
