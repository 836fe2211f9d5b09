"""Story time: sums of stated spans before any position, and the clock with its epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_story_sums(statements: DataFrame, spans: DataFrame) -> DataFrame:
    """``statements(book, chapter, pos, ...)``, ``spans(book, chapter, pos, years)`` -> statements with span sums.

    Adds for the spans strictly before the statement's position (``_lt``) and up to it
    (``_le``): their years, how many have none, and how many there are. The sums are taken
    inside each chapter and completed by the earlier chapters' totals, so the unit of work is a
    chapter, not a book.
    """
    spans = spans.select("book", "chapter", "pos", F.coalesce("years", F.lit(0.0)).alias("y"), F.col("years").isNull().cast("long").alias("z"), F.lit(1).cast("long").alias("c"))
    totals = spans.groupBy("book", "chapter").agg(*[F.sum(x).alias(f"{x}_all") for x in "yzc"])
    chapters = statements.select("book", "chapter").union(spans.select("book", "chapter")).distinct().join(totals, ["book", "chapter"], "left")
    earlier = Window.partitionBy("book").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    bases = chapters.select("book", "chapter", *[F.coalesce(F.sum(f"{x}_all").over(earlier), F.lit(0)).alias(f"{x}_base") for x in "yzc"])
    none = [F.lit(None).cast(t).alias(x) for x, t in (("y", "double"), ("z", "bigint"), ("c", "bigint"))]
    rows = statements.select("book", "chapter", "pos", F.struct(*statements.columns).alias("row"), *none)
    rows = rows.unionByName(spans.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)).select(rows.columns))
    inside = Window.partitionBy("book", "chapter").orderBy("pos")
    lt, le = inside.rangeBetween(Window.unboundedPreceding, -1), inside.rangeBetween(Window.unboundedPreceding, 0)
    summed = rows.select("book", "chapter", "row", *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(f"{x}_{s}") for x in "yzc" for s, w in (("lt", lt), ("le", le))])
    summed = summed.where("row is not null").join(bases, ["book", "chapter"])
    names = {"y": "years", "z": "unknown", "c": "spans"}
    return summed.select("row.*", *[(F.col(f"{x}_base") + F.col(f"{x}_{s}")).alias(f"{names[x]}_{s}") for x in "yzc" for s in ("lt", "le")])


def gap(a: str, b: str) -> Column:
    """Years from statement struct ``a`` to ``b``; null if a span between them has none."""
    years = F.col(f"{b}.years_lt") - F.col(f"{a}.years_le") - F.col(f"{b}.offset") + F.col(f"{a}.offset")
    return F.when(F.col(f"{b}.unknown_lt") - F.col(f"{a}.unknown_le") > 0, F.lit(None)).otherwise(years)


def clock(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points(book, chapter, pos, ...)`` -> with ``epoch`` and ``story_time`` just before each.

    A span without years begins an epoch and sets the time to 0; others add their years.
    Spans at the point's own position do not count yet.
    """
    summed = with_story_sums(points, spans)
    # what the spans had summed up to when the present epoch began
    marks = with_story_sums(spans.where("years is null").select("book", "chapter", "pos"), spans)
    starts = marks.groupBy("book", F.col("unknown_le").alias("unknown_lt")).agg(F.max("years_le").alias("begun"))
    return summed.join(starts, ["book", "unknown_lt"], "left").withColumn("epoch", F.col("unknown_lt")).withColumn("story_time", F.col("years_lt") - F.coalesce("begun", F.lit(0.0)))
