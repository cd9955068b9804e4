"""Stable ids and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import normalize_for_id, slug, strip


def hash8(c: Column) -> Column:
    """First eight hex digits of SHA-1."""
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 8)


def _filled(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def block_content(kind: Column, text: Column, markdown: Column, src: Column, alt: Column, path: Column) -> Column:
    """What identifies a block: of images the source, else the alternative text, else the place; of others the first content that is not empty."""
    image = F.coalesce(_filled(strip(src)), _filled(strip(alt)), _filled(F.array_join(path, " / ")))
    other = F.coalesce(_filled(text), _filled(markdown), _filled(alt), _filled(src))
    return F.coalesce(F.when(kind == "image", image).otherwise(other), F.lit(""))


def element_id(prefix: Column, content: Column, path: Column | None = None) -> Column:
    """``prefix_slug8_hash8`` of the content; with ``path`` the hash also covers the place."""
    norm = normalize_for_id(F.coalesce(content, F.lit("")))
    payload = norm
    if path is not None:
        payload = F.when(F.size(path) > 0, F.concat(norm, F.lit(" || "), normalize_for_id(F.array_join(path, " / ")))).otherwise(norm)
    base = F.when(norm == "", prefix).otherwise(norm)
    # The start of a text mostly decides; the whole text is folded only if its start is too poor in letters.
    start = slug(F.substring(base, 1, 48))
    short = F.substring(F.when(F.length(start) > 8, start).otherwise(slug(base)), 1, 8)
    return F.concat_ws("_", prefix, F.when(short == "", F.lit("item")).otherwise(short), hash8(payload))


def node_id(path: Column, depth: Column, sibling: Column) -> Column:
    """Slug of the path of titles and a hash of path, depth and place among siblings."""
    text = F.array_join(F.transform(path, lambda t: F.when(F.coalesce(t, F.lit("")) == "", F.lit("untitled")).otherwise(t)), " / ")
    seed = F.concat(text, F.lit("|depth="), depth.cast("string"), F.lit("|sib="), sibling.cast("string"))
    readable = F.when(slug(text) == "", F.lit("untitled")).otherwise(slug(text))
    return F.concat(readable, F.lit("_"), F.substring(F.md5(F.encode(seed, "UTF-8")), 1, 8))


def content_hash(c: Column) -> Column:
    """``sha256:<hex>``."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def fingerprint(title: Column, ancestors: Column, first_markdown: Column) -> Column:
    """Hash of title, ancestors and first content of a tree node."""
    first = F.sha1(F.encode(F.coalesce(first_markdown, F.lit("")), "UTF-8"))
    return hash8(F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit("|"), F.array_join(ancestors, " / ", ""), F.lit("|"), first))
