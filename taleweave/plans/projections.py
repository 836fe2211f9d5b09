"""The model's tables drawn from the supplied ones by fixed projections.

Each projection is a list of SQL expressions that Spark and DuckDB read alike, so a query and
its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Narrative position as one number: chapter, then offset (both non-negative).
POSITION = "cast(chapter as bigint) * 4294967296 + char_start"

_K = "cast(regexp_extract(props, '[0-9]+', 0) as int)"
#: events -> statements about characters and story time.
STATEMENTS = [
    "cast(user_id % 5 as int) as book", "cast(user_id as bigint) as character", "cast(extract(day from ts) as int) as chapter",
    "cast(event_id as bigint) as char_start", "cast(event_id + 10 as bigint) as char_end", "event_type", f"{_K} as k",
    "cast(cast(floor(value) as bigint) % 80 as double) as age_value",
    f"{_K} % 9 = 0 as is_flashback", f"{_K} % 11 = 0 as is_speculative",
    f"case when {_K} % 9 = 0 and {_K} % 2 = 0 then cast({_K} % 5 as double) end as years_before",
]
#: What each kind of statement is drawn from.
IS_AGE = "event_type = 'purchase'"
IS_STAGE = "event_type = 'view'"
IS_SPAN = "event_type = 'click' and k % 25 = 0"
SPAN_YEARS = "case when k % 50 <> 0 then cast(k % 4 as double) end"
IS_DEATH = "event_type = 'signup' and k % 20 = 0"
IS_PRESENCE = "event_type = 'signup' and k % 20 <> 0"
IS_TRAIT = "event_type = 'error'"

#: life stage -> its number in order and its ages (fixed values).
STAGES = [("infant", 0.0, 3.0), ("child", 2.0, 13.0), ("teen", 10.0, 20.0), ("young_adult", 16.0, 35.0), ("middle_aged", 30.0, 60.0), ("elderly", 50.0, None)]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(*STATEMENTS)
    return rows.selectExpr("*", f"{POSITION} as pos")


STATEMENTS_SQL = f"statements as (select *, {POSITION} as pos from (select {', '.join(STATEMENTS)} from events))"

#: documents and labels -> chapters of books (a book is a source).
CHAPTERS_SQL = """chapters as (
  select source as book, row_number() over (partition by source order by d.doc_id) as number, d.doc_id, text as content,
         case l.quality when 1 then 'extracted' when 0 then 'failed' else 'pending' end as status
  from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l on l.doc_id = d.doc_id)"""


def chapter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, book, number)``, without texts."""
    from pyspark.sql import functions as F

    from taleweave.operators.records import numbered

    return numbered(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book")), ["book"], ["doc_id"])


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    status = F.when(F.col("quality") == 1, "extracted").when(F.col("quality") == 0, "failed").otherwise("pending")
    # numbers are given on the narrow columns; the text is shuffled once, to join them
    found = chapter_numbers(spark, sf_dir).join(labels, "doc_id", "left").withColumn("status", status)
    return found.select("doc_id", "book", "number", "status").join(docs, "doc_id").select("book", "number", "doc_id", "content", "status")
