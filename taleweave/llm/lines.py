"""Site-relative line dedup, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.llm.scratch import stored

#: A line on more than this part of its host's pages, and on so many pages at least, is boilerplate.
RATIO, LEAST_PAGES = 0.08, 5
_EDGES = " \t\n\x0b\f\r"


def _hashes(text: Column) -> Column:
    """The distinct 64-bit hashes of a text's lines that have a word."""
    solid = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _EDGES, "")) > 0)
    return F.array_distinct(F.transform(solid, lambda x: F.xxhash64(x)))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``docs(text, host)`` -> ``(host, hashes array<long>)``: each host's boilerplate lines by hash.

    A host has at most (lines of a mean page / ratio) of them. Lines are counted once a page,
    added up map-side, so a host with most pages or a line on most pages is no hot key.
    """
    pages = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col("text").cast("string").alias("text"))
    counts = pages.select("host", F.explode(_hashes(F.col("text"))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    often = counts.where(F.col("n") >= least).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return stored(often.groupBy("host").agg(F.collect_list("line").alias("hashes")), "boilerplate")


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``docs(doc_id, text, host, ...)`` -> ``(row, text, n_lines, n_dropped)``; ``row`` is the whole input row.

    Text is cut at \\n; each line that has a word and is boilerplate of the row's host is
    dropped, wherever it stands, blank lines stay. Null text gives empty text and no lines. A
    null host has no boilerplate. Every row counts as a page, repeated ones too. No rows: none.
    """
    lines = boilerplate(docs, host, ratio, least)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the optimizer knows the stored table's size: it is broadcast only when small
    joined = rows.join(lines, "host", "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.when(F.col("hashes").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("hashes", F.xxhash64(x))))
    joined = joined.withColumn("kept", kept)
    return joined.select(
        "row", F.array_join("kept", "\n").alias("text"),
        F.when(F.col("text") == "", 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def dropped(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` with the same columns, their text without boilerplate lines (null text: null)."""
    rows = without_boilerplate(docs, host)
    text = F.when(F.col("row.text").isNotNull(), F.col("text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
