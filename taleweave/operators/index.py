"""A kept keyword index: which passages have a word, brought up to date by what changed, searched by bounds.

``passages(passage, source_key, tokens, n)`` holds each passage's distinct words and ``postings(token,
passage, n)`` the same by word, kept as lists of passages, sorted by word. A version of the index is
a folder written once; a new one is written beside it and becomes current by its last file, so a
reader never sees half of one, and a failed update leaves the old one current.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave import scratch
from taleweave.functions.text import by_size
from taleweave.operators.retrieval import CANDIDATES, tokens

#: Postings of a query's rarest words that are scored first, to learn what its best passages reach.
PROBED = 4 * CANDIDATES
#: Bytes of words that a task gathers into lists at once.
LIST_BYTES = 32 << 20


@dataclass
class Index:
    """``lists(token, passages, ns)`` has a word's passages, some at a time, and their numbers of words; an index that isn't kept has none."""

    passages: DataFrame
    lists: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        if self.lists is None:
            # an outer one: of explode() the optimizer makes a filter on the sizes, which would cut each text once more
            return self.passages.select(F.explode_outer("tokens").alias("token"), "passage", "n").where("token is not null")
        return self.lists.select("token", F.inline(F.arrays_zip("passages", "ns")).alias("passage", "n"))


def source_key(text: Column, *settings: object) -> Column:
    """What a passage's index rows were made from: its text and the settings that cut it."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(len(settings))), *[F.lit(str(s)) for s in settings], F.coalesce(text.cast("string"), F.lit(""))), 256)


def _cut(rows: DataFrame, names: list[str]) -> DataFrame:
    found = tokens(F.coalesce("text", F.lit("")), names)
    return rows.select("passage", "source_key", found.alias("tokens")).withColumn("n", F.size("tokens"))


def _listed(cut: DataFrame) -> DataFrame:
    """The lists of ``cut``: what a task holds at once is gathered by word there, so that words are shuffled, not postings."""
    kind = dict(cut.dtypes)["passage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in by_size(batch, LIST_BYTES)):
            words = part.column("tokens").flatten().dictionary_encode()
            code = words.indices.to_numpy()
            of = pc.list_parent_indices(part.column("tokens")).take(pa.array(np.argsort(code, kind="stable")))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(words.dictionary)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, part.column(c).take(of)) for c in ("passage", "n")]
            yield pa.RecordBatch.from_arrays([words.dictionary, *lists], names=["token", "passages", "ns"])

    return cut.select("passage", "tokens", "n").mapInArrow(run, f"token string, passages array<{kind}>, ns array<int>")


def built(passages: DataFrame, names: list[str]) -> Index:
    """The index of ``passages(passage, source_key, text)`` from nothing, cut whenever it is read: ``save`` keeps it. Null text has no words; a repeated passage is an error of the caller."""
    return Index(_cut(passages, names))


def _of(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return rows.join(ids.select(F.col("passage").alias("__id")), F.col("passage").eqNullSafe(F.col("__id")), how)


def refreshed(index: Index, passages: DataFrame, names: list[str]) -> tuple[Index, dict[str, int]]:
    """The index of ``passages`` as they are now, with how many were ``kept``, ``rebuilt`` and ``dropped``.

    A passage whose source key is unchanged keeps its rows; only others' texts are cut. What
    changed is told by the keys alone, so neither texts nor words are shuffled for a few changes.
    """
    key = ["passage", "source_key"]
    now = scratch.stored(passages.select(*key), "index-keys")
    changed = scratch.stored(now.join(index.passages.select(*key), key, "left_anti").select("passage"), "index-changed")
    gone = scratch.stored(index.passages.select(*key).join(now, key, "left_anti").select("passage"), "index-gone")
    counts = {"rebuilt": changed.count(), "dropped": gone.join(now, "passage", "left_anti").count()}
    counts["kept"] = index.passages.count() - gone.count()
    return Index(_of(index.passages, gone, "left_anti").unionByName(_cut(_of(passages, changed, "left_semi"), names))), counts


def recut(index: Index, texts: DataFrame, new_names: list[str], names: list[str]) -> tuple[Index, DataFrame]:
    """The index once ``new_names`` are words too, and the ``passages(passage, tokens, before)`` whose words changed.

    ``texts(passage, text)``; ``names`` are all names, the new ones included. Only texts that
    contain a new name of two characters or more are cut again.
    """
    wanted = sorted({n.strip().lower() for n in new_names if len(n.strip()) >= 2})
    holds = F.lit(False)
    for n in wanted:
        holds = holds | F.contains(F.lower("text"), F.lit(n))
    again = texts.where(holds).select("passage", tokens(F.col("text"), names).alias("now"))
    # null-safe: of != the optimizer makes filters for nulls on both sides, which would cut each text once more
    changed = index.passages.join(again, "passage").where(~F.sort_array("tokens").eqNullSafe(F.sort_array("now")))
    changed = scratch.stored(changed.select("passage", "source_key", F.col("now").alias("tokens"), F.size("now").alias("n"), F.col("tokens").alias("before")), "index-recut")
    ids, fresh = changed.select("passage"), changed.drop("before")
    passages = index.passages.join(ids, "passage", "left_anti").unionByName(fresh)
    return Index(passages), changed.select("passage", "tokens", "before")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The finished versions in a folder, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("v")]
    return sorted(int(f.getName()[1:]) for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "ready/_SUCCESS")))


def save(index: Index, folder: str) -> int:
    """Writes the index as the folder's next version, which becomes current when all of it is there."""
    spark = index.passages.sparkSession
    version = (_versions(spark, folder) or [0])[-1] + 1
    base = f"{folder}/v{version}"
    index.passages.write.mode("overwrite").parquet(f"{base}/passages")
    cut = spark.read.schema(index.passages.schema).parquet(f"{base}/passages")  # what was written: no text is cut twice
    lists = scratch.stored(_listed(cut), "index-lists")  # the ranges are drawn from it before it is dealt out
    order = ["token", F.col("passages")[0]]
    lists.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{base}/postings")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{base}/ready")
    return version


def load(spark: SparkSession, folder: str, version: int | None = None) -> Index:
    """The current version of the index, or a stated one; LookupError if it isn't there."""
    found = _versions(spark, folder)
    if not found or (version is not None and version not in found):
        raise LookupError(folder)
    base = f"{folder}/v{version or found[-1]}"
    return Index(spark.read.parquet(f"{base}/passages"), spark.read.parquet(f"{base}/postings"))


def ranked(queries: DataFrame, postings: DataFrame, k: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """``queries(query, tokens)`` -> (``query, passage, hits, place``: the ``k`` passages with most query words, ties by passage; the pairs scored).

    A passage with s of a query's m words has j of its m - s + j rarest, for each j to s. So the
    passages of the rarest words are scored first; their k-th best, s, is what a passage must
    reach, and only those with half of s among the words that this leaves are scored besides.
    The most frequent words are not looked up for that; a passage of fewer words than s is skipped.
    Asked words have numbers, so that sets of words meet as sets of numbers.
    """
    asked = scratch.stored(queries.select("query", F.explode(F.array_distinct("tokens")).alias("token")), "asked")
    numbers = scratch.stored(asked.select("token").distinct().withColumn("word", F.monotonically_increasing_id()), "asked-words")
    asked = asked.join(numbers, "token").select("query", "word")
    own = scratch.stored(postings.join(numbers, "token").select("word", "passage", "n"), "asked-postings")
    often = own.groupBy("word").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("query").orderBy("df", "word")
    words = asked.join(often, "word").select("query", "word", "df", F.row_number().over(rarest).alias("place"), F.sum("df").over(rarest).alias("reach"))
    words = scratch.stored(words.withColumn("m", F.count("*").over(Window.partitionBy("query"))), "words")
    sets = scratch.stored(own.groupBy("passage").agg(F.collect_set("word").alias("has")), "asked-sets")
    wanted = words.groupBy("query").agg(F.collect_set("word").alias("wanted"), F.max("m").alias("m"))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sets, "passage").join(wanted.select("query", "wanted"), "query")
        return met.select("query", "passage", F.size(F.array_intersect("wanted", "has")).cast("bigint").alias("hits"))

    first = scratch.stored(scored(own.join(words.where((F.col("reach") - F.col("df") < k) | (F.col("reach") <= PROBED)).select("query", "word"), "word").select("query", "passage").distinct()), "scored")
    best = Window.partitionBy("query").orderBy(F.desc("hits"), "passage")
    kth = first.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query", F.col("hits").alias("least"))
    needed = words.join(kth, "query", "left").withColumn("least", F.coalesce("least", F.lit(1))).withColumn("several", F.ceil(F.col("least") / 2).cast("int"))
    needed = needed.where(F.col("place") <= F.col("m") - F.col("least") + F.col("several"))
    met = own.join(needed.select("query", "word", "least", "several"), "word").where(F.col("n") >= F.col("least"))
    more = met.groupBy("query", "passage", "several").agg(F.count("*").alias("c")).where("c >= several").select("query", "passage")
    more = scratch.stored(scored(more.join(first.select("query", "passage"), ["query", "passage"], "left_anti")), "scored")
    pairs = first.unionByName(more)
    return pairs.withColumn("place", F.row_number().over(best).cast("bigint")).where(F.col("place") <= k), pairs
