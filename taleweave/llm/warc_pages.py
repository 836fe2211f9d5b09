"""Pages as WARC records with equal payloads stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm.scratch import new_folder, stored
from taleweave.llm.warc import read_archives, write_archives

#: Payloads below this many bytes are always stored.
LEAST_BYTES = 100


def page_records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> the rows that ``write_archives`` takes.

    Of equal payloads of ``LEAST_BYTES`` or more, that with the smallest page_id is the
    response and the others revisit it. Null html: empty. Rows that repeat the smallest
    page_id are responses too; so is a null page_id. Other columns are not read.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.length("payload") >= LEAST_BYTES).select("page_id", F.col("digest").alias("same"))
    # only digests that occur more than once: the join's other side stays as small as that
    firsts = stored(long.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    joined = rows.join(firsts, F.col("digest") == F.col("same"), "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    later = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))
    return joined.select(name("page_id").alias("record_id"), "uri", F.when(later, "revisit").otherwise("response").alias("kind"), "payload", "digest", F.when(later, name("first")).alias("refers_to"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder and returns what they hold, a row per page."""
    spark = pages.sparkSession
    files = write_archives(page_records(pages), new_folder(spark, "warc"))
    rows = read_archives(spark, files).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    stored_here = F.col("record_type") == "response"
    return rows.select(
        number("record_id").alias("page_id"),
        F.when(stored_here, F.length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.when(stored_here, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
