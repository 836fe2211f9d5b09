"""A book's state: the clock, each character's last known facts, and the state as of a chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave import scratch
from taleweave.operators import records
from taleweave.operators.timeline import clock


def fold(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """``facts(book, character, chapter, pos, category, attribute, num, num_max, text, own_look, is_flashback,
    is_speculative)`` -> one row per character.

    The last age, life stage and look stated stand, the first death does; flashbacks and
    guesses don't count. The age keeps the clock's epoch and time where it was stated. An upper
    age of 0 counts as not given. Everything is one partial aggregation by position.
    """
    said = facts.where(~F.col("is_flashback") & ~F.col("is_speculative"))
    ages = clock(said.where("attribute = 'absolute_age' and num is not null"), spans)
    high = F.greatest(F.col("num"), F.coalesce(F.nullif(F.col("num_max"), F.lit(0.0)), F.col("num")))
    last_age = ages.groupBy("book", "character").agg(F.max_by(F.struct(F.col("num").alias("age_low"), high.alias("age_high"), F.col("chapter").alias("age_chapter"), F.col("epoch").alias("age_epoch"), F.col("story_time").alias("age_time")), "pos").alias("age"))
    is_trait = (F.col("category") == "appearance") & F.coalesce("own_look", F.lit(True)) & F.col("text").isNotNull()
    at = lambda cond: F.when(cond, F.col("pos"))
    rest = said.groupBy("book", "character").agg(
        F.max_by("text", at(F.col("attribute") == "life_stage")).alias("life_stage"),
        F.max_by("text", at(is_trait & (F.col("attribute") == "eye_color"))).alias("eye_color"),
        F.max_by("text", at(is_trait & (F.col("attribute") == "hair_color"))).alias("hair_color"),
        F.min_by("chapter", at(F.col("attribute") == "died")).alias("died_chapter"),
    )
    return rest.join(last_age, ["book", "character"], "left").select("book", "character", "age.*", "life_stage", "eye_color", "hair_color", "died_chapter")


def book_clock(spans: DataFrame) -> DataFrame:
    """``spans(book, pos, years)`` -> each book's epoch and story time after its last span."""
    begun = spans.groupBy("book").agg(F.count_if(F.col("years").isNull()).alias("epoch"), F.max(F.when(F.col("years").isNull(), F.col("pos"))).alias("begun"))
    since = spans.join(begun, "book").where("years is not null and (begun is null or pos > begun)").groupBy("book").agg(F.sum("years").alias("story_time"))
    return begun.join(since, "book", "left").select("book", "epoch", F.coalesce("story_time", F.lit(0.0)).alias("story_time"))


def projected_ages(states: DataFrame, clocks: DataFrame) -> DataFrame:
    """Ages now, for characters whose age was stated in the book's present epoch."""
    rows = states.where("age_low is not null").join(clocks, "book").where("age_epoch = epoch")
    passed = F.col("story_time") - F.col("age_time")
    return rows.select("book", "character", (F.col("age_low") + passed).alias("low_now"), (F.col("age_high") + passed).alias("high_now"))


def as_of(snapshots: DataFrame, asked: DataFrame, before: bool = False) -> DataFrame:
    """``snapshots(book, chapter, ...)``, ``asked(book, n)`` -> the latest snapshot of chapter <= n (or < n)."""
    values = F.struct("chapter", *[c for c in snapshots.columns if c not in ("book", "chapter")])
    # asked chapters take the last snapshot in one pass; of one chapter the asked row goes first if it isn't to count
    stated = snapshots.select("book", F.col("chapter").alias("__at"), F.lit(1).alias("__turn"), F.lit(None).cast("bigint").alias("n"), values.alias("s"))
    wanted = asked.select("book", F.col("n").alias("__at"), F.lit(0 if before else 2).alias("__turn"), F.col("n").cast("bigint").alias("n"), F.lit(None).cast(stated.schema["s"].dataType).alias("s"))
    last = F.last("s", ignorenulls=True).over(Window.partitionBy("book").orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, 0))
    rows = stated.unionByName(wanted).withColumn("s", last).where("n is not null and s is not null")
    return rows.select("book", F.col("n").cast(asked.schema["n"].dataType).alias("n"), "s.*")


def last_before(statements: DataFrame, keys: list[str], value: str, order) -> DataFrame:
    """The last statement of each key: its ``pos`` and value, by ``order``."""
    return statements.groupBy(*keys).agg(F.max("pos").alias("pos"), F.max_by(value, order).alias(value))


def numbered(stored: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New events of each book with the numbers that follow the stored ones, given in ranges."""
    last = stored.groupBy("book").agg(F.max("seq").alias("last"))
    return records.numbered(new, ["book"], order, "n").join(last, "book", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("n")).drop("n", "last")


def merged_into(merges: DataFrame) -> DataFrame:
    """``merges(book, character, into)``, one a character -> ``(book, character, root)``: where chains of merges end.

    The pointers are followed by doubling, so the rounds grow with the logarithm of the longest
    chain. Chains don't run in circles: a merged character is gone and can't be merged into.
    """
    step = scratch.stored(merges.select("book", "character", F.col("into").alias("root")), "merges")
    while True:
        up = step.select("book", F.col("character").alias("root"), F.col("root").alias("next"))
        jumped = step.join(up, ["book", "root"], "left").select("book", "character", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = scratch.stored(jumped, "merges")
        step = jumped.select("book", "character", "root")
        if jumped.where("moved").isEmpty():
            return step


def replay(events: DataFrame, upto: int | None = None, kinds: bool = False) -> DataFrame:
    """Characters as the event log ``(book, seq, kind, character, name, into, chapter, source)`` leaves them.

    Undoing from a chapter on is replaying what remains: events of the author's, and extracted
    ones of earlier chapters. A character exists if created and not merged away; its name is that
    of its last create or rename. With ``kinds`` there is a column ``kind``: that of its last
    ``promote`` (whose ``name`` is the new kind), else "minor". Who was merged away leaves its names and aliases to the character that
    the merge, or the chain of merges, ends at.
    """
    kept = scratch.stored(events if upto is None else events.where((F.col("source") == "user") | (F.col("chapter") < upto)), "log")
    named = F.when(F.col("kind").isin("create", "rename"), F.col("seq"))
    state = kept.groupBy("book", "character").agg(
        F.max_by("name", named).alias("name"), F.bool_or(F.col("kind") == "create").alias("made"),
        F.max_by("into", F.when(F.col("kind") == "merge", F.col("seq"))).alias("into"),
        F.coalesce(F.max_by("name", F.when(F.col("kind") == "promote", F.col("seq"))), F.lit("minor")).alias("kind"),
    )
    state = scratch.stored(state, "states")
    roots = merged_into(state.where("into is not null").select("book", "character", "into"))
    given = kept.where("kind in ('create', 'rename', 'alias')").select("book", "character", "name", "kind")
    given = given.join(roots, ["book", "character"], "left").where("kind = 'alias' or root is not null")
    given = given.select("book", F.coalesce("root", "character").alias("character"), "name").distinct()
    aliases = given.groupBy("book", "character").agg(F.sort_array(F.collect_list("name")).alias("aliases"))
    own = state.where("made and into is null").join(aliases, ["book", "character"], "left")
    none = F.array().cast("array<string>")
    return own.select("book", "character", "name", F.array_except(F.coalesce("aliases", none), F.array("name")).alias("aliases"), *["kind"] * kinds)


def reset_from(facts: DataFrame, spans: DataFrame, events: DataFrame, chapter: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What remains of facts, spans and log before reading again from ``chapter`` on: the author's events stay."""
    before = F.col("chapter") < chapter
    return facts.where(before), spans.where(before), events.where(before | (F.col("source") == "user"))
