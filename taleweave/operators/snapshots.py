"""Kept states of books: summaries of runs of chapters, from which the state after any chapter is put together.

A run is ``every`` chapters. Its summary is the fold of its own facts, with the clock started anew, so
it depends on no other run: a changed or late chapter touches one run. The state after chapter n
is the runs before it in order, and the fold of the last run's chapters up to n: ages of a run
take the clock's epoch and time at its start, later values stand over earlier ones. A stated life
stage has a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave import scratch
from taleweave.operators import core

#: Chapters of a run.
EVERY = 8


@dataclass
class Runs:
    """``states(book, run, character, ...)`` as ``core.fold`` gives them, ``clocks(book, run, epoch, story_time)``."""

    states: DataFrame
    clocks: DataFrame
    every: int = EVERY


def _of_run(rows: DataFrame, run) -> DataFrame:
    """Rows with (book, run) in the place of the book."""
    return rows.withColumn("book", F.struct("book", run.cast("long").alias("run")))


def _apart(rows: DataFrame) -> DataFrame:
    return rows.select("book.book", "book.run", *[c for c in rows.columns if c != "book"])


def summarised(facts: DataFrame, spans: DataFrame, every: int = EVERY) -> Runs:
    """The runs of ``facts`` and ``spans`` as for ``core.fold``. Chapters are not negative."""
    run = F.floor(F.col("chapter") / every)
    own = _of_run(spans, run)
    return Runs(scratch.stored(_apart(core.fold(_of_run(facts, run), own)), "runs"), scratch.stored(_apart(core.book_clock(own)), "run-clocks"), every)


def touched(chapters: DataFrame, every: int = EVERY) -> DataFrame:
    """``chapters(book, chapter)`` -> the runs ``(book, run)`` that they are in."""
    return chapters.select("book", F.floor(F.col("chapter") / every).cast("long").alias("run")).distinct()


def rebuilt(runs: Runs, changed: DataFrame, facts: DataFrame, spans: DataFrame) -> tuple[Runs, int]:
    """The runs once the ``changed(book, chapter)`` are as ``facts`` and ``spans`` have them now, and how many facts were read again."""
    again = scratch.stored(touched(changed, runs.every), "touched")
    run = F.floor(F.col("chapter") / runs.every).cast("long")
    of = lambda rows: rows.withColumn("run", run).join(again, ["book", "run"], "left_semi").drop("run")
    read = scratch.stored(of(facts), "facts-again")
    fresh = summarised(read, of(spans), runs.every)
    merged = lambda old, new: scratch.stored(old.join(again, ["book", "run"], "left_anti").unionByName(new), "runs")
    return Runs(merged(runs.states, fresh.states), merged(runs.clocks, fresh.clocks), runs.every), read.count()


def restored(runs: Runs, cuts: DataFrame) -> tuple[Runs, DataFrame]:
    """The runs that lie wholly before each book's ``cuts(book, chapter)``, and ``(book, chapter)``: where reading starts again.

    Books without a cut are kept whole.
    """
    first = cuts.groupBy("book").agg(F.min("chapter").alias("cut"))
    kept = lambda rows: rows.join(first, "book", "left").where(F.col("cut").isNull() | ((F.col("run") + 1) * runs.every <= F.col("cut"))).drop("cut")
    return Runs(kept(runs.states), kept(runs.clocks), runs.every), first.select("book", (F.floor(F.col("cut") / runs.every) * runs.every).alias("chapter"))


def state_after(runs: Runs, facts: DataFrame, spans: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(book, n)`` -> ``(book, n, character, ...)``: each character's state after chapter n, as ``core.fold`` of the chapters to n.

    Of ``facts`` and ``spans`` only the chapters of the run that n lies in are read.
    """
    every = runs.every
    want = asked.select("book", F.col("n").cast("long").alias("n")).distinct().withColumn("whole", F.floor((F.col("n") + 1) / every).cast("long"))
    tail = lambda rows: rows.join(want, "book").where((F.col("chapter") >= F.col("whole") * every) & (F.col("chapter") <= F.col("n"))).withColumn("book", F.struct("book", "n", "whole")).drop("n", "whole")
    last = core.fold(tail(facts), tail(spans))
    columns = [c for c in last.columns if c != "book"]
    pieces = runs.states.join(want, "book").where(F.col("run") < F.col("whole")).select("book", "n", "run", *columns)
    pieces = pieces.unionByName(last.select("book.book", "book.n", F.col("book.whole").alias("run"), *columns))
    return _put_together(pieces, _starts(runs.clocks, pieces.select("book", "run").distinct()))


def state_now(runs: Runs) -> DataFrame:
    """``(book, character, ...)``: the state after the last chapter, from the runs alone."""
    pieces = runs.states.withColumn("n", F.lit(0))
    return _put_together(pieces, _starts(runs.clocks, pieces.select("book", "run").distinct())).drop("n")


def clock_after(runs: Runs, spans: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(book, n)`` -> ``(book, n, epoch, story_time)``: each book's clock after chapter n; only the run that n lies in is read."""
    want = asked.select("book", F.col("n").cast("long").alias("n")).distinct().withColumn("run", F.floor((F.col("n") + 1) / runs.every).cast("long"))
    tail = spans.join(want, "book").where((F.col("chapter") >= F.col("run") * runs.every) & (F.col("chapter") <= F.col("n"))).withColumn("book", F.struct("book", "n"))
    own = core.book_clock(tail).select("book.book", "book.n", "epoch", "story_time")
    rows = want.join(_starts(runs.clocks, want.select("book", "run").distinct()), ["book", "run"]).join(own, ["book", "n"], "left").fillna({"epoch": 0, "story_time": 0.0})
    time = F.when(F.col("epoch") > 0, F.col("story_time")).otherwise(F.col("time_before") + F.col("story_time"))
    return rows.select("book", "n", (F.col("epoch_before") + F.col("epoch")).alias("epoch"), time.alias("story_time"))


def ages_after(runs: Runs, facts: DataFrame, spans: DataFrame, asked: DataFrame) -> DataFrame:
    """``state_after`` with ``low_now`` and ``high_now``: the age after chapter n, where the story's time since it was stated is known."""
    states = state_after(runs, facts, spans, asked).join(clock_after(runs, spans, asked), ["book", "n"])
    now = lambda c: F.when(F.col("age_epoch") == F.col("epoch"), F.col(c) + F.col("story_time") - F.col("age_time"))
    return states.withColumns({"low_now": now("age_low"), "high_now": now("age_high")}).drop("epoch", "story_time")


def _starts(clocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(book, run, epoch_before, time_before)``: the clock at the start of each wanted run."""
    rows = clocks.select("book", "run", "epoch", "story_time").join(wanted, ["book", "run"], "full_outer").fillna({"epoch": 0, "story_time": 0.0})
    earlier = Window.partitionBy("book").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"passed": F.coalesce(F.sum("story_time").over(earlier), F.lit(0.0)), "epoch_before": F.coalesce(F.sum("epoch").over(earlier), F.lit(0))})
    # the time stands still where an epoch begins; what a run with one adds counts from there
    begun = F.last(F.when(F.col("epoch") > 0, F.col("passed")), ignorenulls=True).over(earlier)
    return rows.select("book", "run", "epoch_before", (F.col("passed") - F.coalesce(begun, F.lit(0.0))).alias("time_before"))


def _put_together(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    rows = pieces.join(starts, ["book", "run"])
    time = F.when(F.col("age_epoch") > 0, F.col("age_time")).otherwise(F.col("time_before") + F.col("age_time"))
    age = F.struct("age_low", "age_high", "age_chapter", (F.col("epoch_before") + F.col("age_epoch")).alias("age_epoch"), time.alias("age_time"))
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("run"))).alias(c)
    found = rows.groupBy("book", "n", "character").agg(F.max_by(age, F.when(F.col("age_low").isNotNull(), F.col("run"))).alias("age"), *map(given, ["life_stage", "eye_color", "hair_color"]), F.min("died_chapter").alias("died_chapter"))
    return found.select("book", "n", "character", "age.*", "life_stage", "eye_color", "hair_color", "died_chapter")
