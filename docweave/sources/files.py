"""Readers and writers of files: notes, subtitle folders, manifests, ordered text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import clean_subtitles, natural_key, strip
from docweave.sources.markdown import html_markdown


def read_documents(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Whole files below ``path`` as ``path, text``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_subtitles(spark: SparkSession, path: str, html: bool = False) -> DataFrame:
    """Paths of subtitle files below ``path`` with their natural sort key; contents are not read."""
    kinds = r"(?i)\.(srt|vtt|html)$" if html else r"(?i)\.(srt|vtt)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where(F.col("path").rlike(kinds))
    return files.withColumn("sort_key", natural_key("path"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a manifest with their place in it, blank lines dropped: ``place, path``.

    Lines are numbered by file and offset order; a manifest is one or a few
    files whose names sort.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"), strip("value").alias("path")).where("path <> ''")
    return lines.select(F.struct("_file", "_at").alias("place"), "path")


def write_manifest(files: DataFrame, path: str, mirror: str | None = None) -> None:
    """One path per line, in order; the parts of the output sort by name.  ``mirror`` gets the same lines."""
    ordered = files.repartitionByRange("sort_key").sortWithinPartitions("sort_key").select("path")
    for target in (path, mirror):
        if target:
            ordered.write.mode("overwrite").text(target)


def read_subtitles(spark: SparkSession, path: str, html: bool = False, manifest: str | None = None) -> DataFrame:
    """Subtitle files below ``path`` with their spoken text, with ``html`` also pages as Markdown: ``path, sort_key, body``.

    With a ``manifest`` only the files it lists, in its order; listed files
    that do not exist are left out.
    """
    kinds = r"(?i)\.(srt|vtt|html)$" if html else r"(?i)\.(srt|vtt)$"
    files = read_documents(spark, path, "*").where(F.col("path").rlike(kinds)).withColumn("sort_key", natural_key("path"))
    if manifest:
        plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
        listed = read_manifest(spark, manifest).select(plain(F.col("path")).alias("_path"), F.concat(F.col("place._file"), F.lit("\x01"), F.lpad(F.col("place._at").cast("string"), 20, "0")).alias("_place"))
        files = files.withColumn("_path", plain(F.col("path"))).join(listed, "_path").withColumn("sort_key", F.col("_place")).drop("_path", "_place")
    spoken = files.where(~F.col("path").rlike(r"(?i)\.html$")).select("path", "sort_key", clean_subtitles("text").alias("body"))
    if not html:
        return spoken
    pages = files.where(F.col("path").rlike(r"(?i)\.html$"))
    # The place of a page goes through the reader inside its key.
    read = html_markdown(pages.select(F.struct("path", "sort_key").alias("key"), "text"), "key")
    return spoken.unionByName(read.select("key.path", "key.sort_key", F.col("markdown").alias("body")))


def write_lines(lines: DataFrame, path: str, order: list[str], line: str = "line", by: str | None = None, folders: bool = False) -> None:
    """Ordered lines as text files whose parts sort by name.

    With ``by`` the lines of many documents are written as sorted ranges of
    JSON lines that name their document, however many there are; ``folders``
    makes a folder of plain text per document instead, for a few.
    """
    keys = ([by] if by else []) + order
    sorted_ = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    value = F.col(line).alias("value")
    if by and folders:
        sorted_.select(by, value).write.mode("overwrite").partitionBy(by).text(path)
    elif by:
        sorted_.select(by, value).write.mode("overwrite").json(path)
    else:
        sorted_.select(value).write.mode("overwrite").text(path)


def write_pages(pages: DataFrame, path: str, tree: str = "map_id", folders: bool = False) -> None:
    """Node pages in order, as sorted ranges of JSON lines that name tree and page, or with ``folders`` a folder per tree and page.

    Of pages with one name the last in preorder stays readable beside the others.
    """
    keys = [tree, "page", "node_id", "ord"]
    if folders:
        sorted_ = pages.select(*keys, "part").repartition(tree, "page").sortWithinPartitions(*keys)
        sorted_.select(tree, "page", F.col("part").alias("value")).write.mode("overwrite").partitionBy(tree, "page").text(path)
    else:
        pages.select(*keys, "part").repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)
