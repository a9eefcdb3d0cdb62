"""Slugs, titles, base names and content ids as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F


def slug(c):
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def titled(slug_col):
    return F.initcap(F.regexp_replace(slug_col, "-", " "))


def base_name(c):
    """Lower-cased, without a parenthesis and a trailing number."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s*\([^)]*\)", ""), r"[\s#-]+[0-9]+$", ""))


def content_id(*cols):
    """sha256 of fields framed by their lengths, so that no two field lists read alike."""
    framed = [F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")) for c in cols]
    return F.sha2(F.concat_ws("|", *framed), 256)


def locus(c):
    """book, chapter, verse of 'BK.5.12'."""
    p = F.split(c, r"\.")
    return F.struct(F.get(p, F.lit(0)).alias("book"), F.get(p, F.lit(1)).cast("int").alias("chapter"), F.get(p, F.lit(2)).cast("int").alias("verse"))
