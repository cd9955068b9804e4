"""The per-document readers over a stream of arriving files.

The readers are maps, so they run unchanged on a stream; counts over arriving
documents use an event-time window with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import clean_subtitles, token_count
from docweave.sources.markdown import markdown_blocks

DOCUMENT = "doc_id long, text string, source string, fetched_at timestamp"


def stream_documents(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """Documents from parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def stream_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of arriving Markdown documents."""
    return markdown_blocks(documents.select("doc_id", "text"))


def stream_transcripts(documents: DataFrame) -> DataFrame:
    """Spoken text of arriving subtitle documents."""
    return documents.where("text like '%-->%'").select("doc_id", clean_subtitles("text").alias("body"))


def arrivals(documents: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Documents and tokens per source and window; documents later than ``late`` are not counted."""
    timed = documents.where(F.col("fetched_at").isNotNull()).withWatermark("fetched_at", late)
    return timed.groupBy(F.window("fetched_at", window).alias("w"), "source").agg(F.count(F.lit(1)).alias("n"), F.sum(token_count("text")).alias("tokens")).select(F.col("w.start").alias("start"), "source", "n", "tokens")
