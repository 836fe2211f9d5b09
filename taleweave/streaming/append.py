"""Chapters that arrive over time, in any order: the same states as in batch, kept by Structured Streaming.

A table that a stream keeps is a folder of versions. Each micro-batch writes a version of its own
number and then marks it as whole, so a reader always finds the last whole one, and a batch that is
run again after a failure writes the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from taleweave.operators import snapshots


def arriving(spark: SparkSession, folder: str, pattern: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def last_known(statements: DataFrame) -> DataFrame:
    """Streaming statements -> each character's last known age and look, whatever order they arrive in.

    The greatest position wins, so a chapter inserted later doesn't undo what follows it; the state
    is one row per character, kept in the JVM's state store.
    """
    said = statements.where("not is_flashback and not is_speculative")
    at = lambda cond: F.when(cond, F.struct("pos", "age_value", "k"))
    found = said.groupBy("book", "character").agg(F.max(at(F.col("event_type") == "purchase")).alias("age"), F.max(at(F.col("event_type") == "error")).alias("look"), F.count("*").alias("n"))
    return found.select("book", "character", F.col("age.age_value").alias("age"), (F.col("look.k") % 3).alias("look"), "n")


def whole_versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers of the versions that were written to their end, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("batch=")]
    return sorted(int(f.getName()[6:]) for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "whole/_SUCCESS")))


def write_version(tables: dict[str, DataFrame], target: str, number: int) -> None:
    """Writes tables as one version, and the mark that it is whole after them."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}/{name}")
    next(iter(tables.values())).sparkSession.range(1).coalesce(1).write.mode("overwrite").parquet(f"{target}/batch={number}/whole")


def read_version(spark: SparkSession, target: str, name: str, before: int | None = None) -> DataFrame | None:
    """A table of the last whole version (before a number), or None without one."""
    found = [v for v in whole_versions(spark, target) if before is None or v < before]
    return spark.read.parquet(f"{target}/batch={found[-1]}/{name}") if found else None


class Progress(StreamingQueryListener):
    """What the triggers of a session's streams did: ``rows`` of (batch, input rows, milliseconds)."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((p.batchId, p.numInputRows, int(p.durationMs.get("triggerExecution", 0))))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_table(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Runs a complete-mode stream over what is there now; every trigger writes a new version under ``target``."""
    _run(stream, lambda batch, number: write_version({"rows": batch}, target, number), checkpoint, "complete")
    return read_version(stream.sparkSession, target, "rows")


def run_core(facts: DataFrame, target: str, checkpoint: str, every: int = snapshots.EVERY) -> snapshots.Runs:
    """Keeps the runs of books while ``facts`` arrive, chapters late or early; returns them as they are then.

    ``facts`` are as for ``core.fold``, and spans among them: rows with ``is_span`` true, of whose
    columns ``book, chapter, pos, years`` count. A trigger adds its rows to the store of facts, a
    folder for each batch, and summarises only the runs that its chapters are in, from the store.
    """
    spark = facts.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/facts/batch={number}")
        store = spark.read.option("basePath", f"{target}/facts").parquet(*[f"{target}/facts/batch={n}" for n in range(number + 1)]).drop("batch")
        own, spans = store.where("not is_span").drop("is_span", "years"), store.where("is_span").select("book", "chapter", "pos", "years")
        before = [read_version(spark, f"{target}/runs", name, number) for name in ("states", "clocks")]
        if before[0] is None:
            runs = snapshots.summarised(own, spans, every)
        else:
            changed = spark.read.parquet(f"{target}/facts/batch={number}").select("book", "chapter")
            runs, _ = snapshots.rebuilt(snapshots.Runs(*before, every), changed, own, spans)
        write_version({"states": runs.states, "clocks": runs.clocks}, f"{target}/runs", number)

    _run(facts, step, checkpoint, "append")
    return snapshots.Runs(read_version(spark, f"{target}/runs", "states"), read_version(spark, f"{target}/runs", "clocks"), every)
