"""The corpus pipeline: quality rules, line dedup, near-dedup, suffix dedup, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and
returns the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave.llm.keyed import filtered
from taleweave.llm.lines import dropped
from taleweave.llm.minhash import near_duplicates
from taleweave.llm.quality import passing
from taleweave.llm.queries import packed_documents
from taleweave.llm.scratch import new_folder, stored
from taleweave.llm.suffix import without_repeats

#: Word shingles and similarity of the near-dedup stage; bytes of a repeated passage.
SHINGLE_WORDS, SIMILAR_PERCENT, PASSAGE_BYTES = 5, 80, 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their source's boilerplate lines."""
    return _counted(dropped(docs, "source"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id; a null one comes last.

    A node is what has one doc_id and text; rows that only share a doc_id, or have none, are told
    apart, and of rows with both equal one (the least) stays. Nodes are numbered by a 64-bit hash;
    where different rows have one number, a second hash gives them others. Texts without a word
    are linked with nothing and all stay. What goes is decided on numbers alone.
    """
    text = F.col("text").cast("string")
    solid = F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))  # stops at the first word
    keyed = docs.select(F.xxhash64("doc_id", text).alias("node"), F.xxhash64(F.lit("second"), "doc_id", text).alias("second"), F.struct(*docs.columns).alias("row"), solid.alias("solid"))
    solids = keyed.where("solid").drop("solid")
    again = stored(solids.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "again")
    single = solids.join(again, "node", "left_semi").groupBy("node", "second").agg(F.min("row").alias("row"))
    clash = F.count("*").over(Window.partitionBy("node")) > 1
    single = stored(single.select(F.when(clash, F.xxhash64("node", "second")).otherwise(F.col("node")).alias("node"), "row"), "single")
    rows = filtered(solids.select("node", "row"), again, "node", "left_anti").union(single)
    near = near_duplicates(rows.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text")), SHINGLE_WORDS, SIMILAR_PERCENT)
    others = stored(near.where("not kept").select(F.col("doc_id").alias("node"), "component_id"), "others")
    members = stored(others.union(others.select(F.col("component_id").alias("node"), "component_id").distinct()), "members")
    ranked = filtered(rows.select("node", F.struct(F.col("row.doc_id").isNull().alias("none"), "row.doc_id", "node").alias("rank")), members, "node", "left_semi").join(members, "node")
    ranked = stored(ranked.select("node", "component_id", "rank"), "ranked")
    best = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.node")
    gone = stored(ranked.select("node").join(best, "node", "left_anti"), "gone")
    return filtered(rows, gone, "node", "left_anti").select("row.*").union(keyed.where("not solid").select("row.*"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that occur more than once; cut characters go as a whole."""
    rows = without_repeats(docs, PASSAGE_BYTES, as_text=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    return _counted(rows.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    return packed_documents(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now is, where the documents have that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("suffix dedup", suffix_dedup), ("packing", packing)]

#: Similarity groups and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
