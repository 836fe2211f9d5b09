"""Seeded samples: quotas in proportion to strata, books drawn whole. Sampling is the feature here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave.scratch import stored

#: A stratum's rows are first ranked in so many parts, so a hot one isn't sorted by one task.
PARTS = 64


def drawn(seed: int, *key: str) -> Column:
    """A row's lot: the hash of the seed and its key, alike wherever it runs."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def quotas(rows: DataFrame, stratum: str, n: int) -> DataFrame:
    """``(stratum, size, quota)``: shares of ``n`` in proportion to size, by largest remainder.

    Whole shares are rounded down; what is left goes one each to the largest remainders, ties to the
    smaller stratum; nothing exceeds a stratum's size. Only counts, never rows, meet in one place.
    """
    sizes = stored(rows.groupBy(stratum).agg(F.count("*").alias("size")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = min(n, total)
    share = sizes.withColumn("whole", F.floor(F.col("size") * n / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("long")).withColumn("rest", F.col("size") * n - F.col("whole") * total)
    left = n - share.agg(F.coalesce(F.sum("whole"), F.lit(0))).first()[0]
    more = share.where("rest > 0").orderBy(F.desc("rest"), F.asc_nulls_first(stratum)).limit(left).select(F.struct(stratum).alias("lucky"), F.lit(1).alias("one"))
    joined = share.join(more, F.struct(stratum).eqNullSafe(F.col("lucky")), "left")
    return joined.select(stratum, "size", (F.col("whole") + F.coalesce("one", F.lit(0))).cast("long").alias("quota"))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """The columns of ``rows`` and ``chosen``: whether a row is among its stratum's quota of the sample of ``n``.

    A stratum's rows are chosen by lot, ties by ``key``, which tells rows apart. A null stratum is one too. No rows: none.
    """
    share = quotas(rows, stratum, n).select(F.col(stratum).alias("__stratum"), F.col("quota").alias("__quota"))
    lots = rows.select(stratum, key, drawn(seed, key).alias("__lot")).join(share, F.col(stratum).eqNullSafe(F.col("__stratum"))).drop("__stratum")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("__lot", key))
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    few = lots.withColumn("__part", part).withColumn("__rank", rank(stratum, "__part")).where("__rank <= __quota")
    best = few.withColumn("__rank", rank(stratum)).where("__rank <= __quota").select(F.col(key).alias("__key"), F.lit(True).alias("chosen"))
    return rows.join(best, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def to_review(items: DataFrame, n: int, seed: int) -> DataFrame:
    """``(id, type, verdict)`` -> ``(id, type, part)``: what a person reads of the judged issues.

    All that weren't dismissed as false alarms are ``kept``; of those dismissed a sample of ``n``, spread over
    the types in proportion, is ``sampled``; the others are ``rest``. No verdict counts as kept.
    """
    dismissed = F.coalesce(F.col("verdict") == "false_alarm", F.lit(False))
    kept = items.where(~dismissed).select("id", "type", F.lit("kept").alias("part"))
    sample = stratified(items.where(dismissed).select("id", "type"), "type", "id", n, seed)
    return kept.unionByName(sample.select("id", "type", F.when(F.col("chosen"), "sampled").otherwise("rest").alias("part")))


def probed(chapters: DataFrame, books: int, first: int, seed: int) -> DataFrame:
    """``(book, number, ...)`` -> the chapters of ``books`` books drawn by lot, and the ``first`` ones of every other book."""
    lots = chapters.select("book").distinct().withColumn("__lot", drawn(seed, "book")).orderBy("__lot", "book").limit(books)
    whole = lots.select(F.col("book").alias("__book"), F.lit(True).alias("__whole"))
    named = chapters.join(whole, F.col("book") == F.col("__book"), "left")
    return named.where(F.coalesce("__whole", F.lit(False)) | (F.col("number") <= first)).drop("__book", "__whole")
