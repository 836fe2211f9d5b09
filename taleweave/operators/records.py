"""Listings, lookups and overviews of a book's records; issue lists and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave import scratch
from taleweave.functions.text import normalize_newlines

#: Order of certainty in reports (fixed values).
CONFIDENCE_ORDER = {"confirmed": 0, "suspected_review": 1, "insufficient_info": 2}


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their place, from 1, among those of their group in the given order.

    Rows go to ranges of (group, order); a row's place is that in its range and the counts of
    the group's earlier ranges, so no task sees more than a range, however large a group is.
    """
    ranges = scratch.stored(rows.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(*group, "__range").agg(F.count("*").alias("__n"))  # a row for each group in a range
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order))
    placed = ranges.withColumn("__own", own).join(bases, [*group, "__range"])
    return placed.select(*rows.columns, (F.col("__base") + F.col("__own")).cast("bigint").alias(name))


def of_book(rows: DataFrame, user: str, book: str) -> DataFrame:
    """The tenant filter that every read starts with; both columns prune partitions."""
    return rows.where((F.col("user_id") == user) & (F.col("book_id") == book))


def require(rows: DataFrame, what: str) -> DataFrame:
    """``rows`` if there are any, else LookupError: the existence guard of the public reads."""
    if rows.isEmpty():
        raise LookupError(what)
    return rows


def in_chapters(column: Column, first: int | None = None, last: int | None = None) -> Column:
    """Inclusive chapter range with open ends."""
    return column.between(first or 1, last or 100_000)


def chapter_range(text: str) -> tuple[int, int]:
    """"5" or "3-9" as a range."""
    first, _, last = text.partition("-")
    return int(first), int(last or first)


def list_facts(facts: DataFrame, characters: DataFrame, category: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Facts with their character's name in narrative order; the filters reach the scan."""
    if category:
        facts = facts.where(F.col("category") == category)
    return facts.where(in_chapters(F.col("chapter"), first, last)).join(characters, "character").orderBy("chapter", "char_start")


def find_character(characters: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """The character with this canonical name or alias; of several the smallest id."""
    name = name.strip()
    by_alias = aliases.where(F.col("alias") == name).select("character")
    mine = characters.where(F.col("name") == name).select("character").union(by_alias)
    return characters.join(mine.distinct(), "character", "left_semi").orderBy("character").limit(1)


def by_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """The one row whose id starts so; LookupError if none or several do."""
    found = rows.where(F.col(column).startswith(prefix))
    n = len(found.select(column).distinct().limit(2).collect())
    if n != 1:
        raise LookupError(f"{prefix}: {'several' if n else 'none'}")
    return found


def mentions(passages: DataFrame, names: list[str]) -> DataFrame:
    """Passages that contain any of the names."""
    found = F.lit(False)
    for n in names:
        found = found | F.contains(F.col("text"), F.lit(n))
    return passages.where(found)


def first_lacking(readings: DataFrame, kinds: list[str]) -> DataFrame:
    """``readings(book, chapter, kind)`` -> each book's first chapter that has some kinds but not all."""
    have = readings.groupBy("book", "chapter").agg(F.collect_set("kind").alias("kinds"))
    lacking = have.where(F.size(F.array_except(F.array(*map(F.lit, kinds)), "kinds")) > 0)
    return lacking.groupBy("book").agg(F.min("chapter").alias("chapter"))


def overview(books: DataFrame, chapters: DataFrame, characters: DataFrame) -> DataFrame:
    """Books with counts of chapters by status and of characters; counts first, then left joins."""
    c = chapters.groupBy("book").agg(F.count("*").alias("chapters"), F.count_if(F.col("status") == "extracted").alias("extracted"), F.count_if(F.col("status") == "failed").alias("failed"))
    n = characters.groupBy("book").agg(F.count("*").alias("characters"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return books.join(c, "book", "left").join(n, "book", "left").select(*books.columns, *map(zero, ("chapters", "extracted", "failed", "characters")))


def report(issues: DataFrame, verdicts: DataFrame, show_all: bool = False) -> DataFrame:
    """Issues in report order with their valid verdict; false alarms and closed ones hidden unless asked for.

    A verdict is valid while its key is the issue's; the latest counts. Most certain first,
    then the earliest chapter quoted, then the fingerprint.
    """
    latest = verdicts.groupBy("fingerprint", "key").agg(F.max_by(F.struct("verdict", "reason"), "created").alias("v"))
    rows = issues.join(latest, ["fingerprint", "key"], "left").withColumn("verdict", F.col("v.verdict"))
    if not show_all:
        rows = rows.where("status = 'open' and coalesce(verdict, '') <> 'false_alarm'")
    rank = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in CONFIDENCE_ORDER.items()])
    return rows.withColumns({"rank": rank, "first_chapter": F.array_min("chapters")}).orderBy("rank", "first_chapter", "fingerprint").select("fingerprint", "confidence", "status", "verdict", "rank", "first_chapter")


def changes(before: DataFrame, after: DataFrame, key: str = "fingerprint") -> DataFrame:
    """What an edit added and removed: both differences by key."""
    added = after.join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    removed = before.join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def placed_facts(evidence: DataFrame, facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Each evidence with the fact at its place, the issue's subject's first, else the span there.

    A place's facts are first reduced to the least of each character and the least of all, so that
    evidence never meets all facts of a crowded place; it meets one row on each side.
    """
    at = ["chapter", "char_start", "char_end"]
    least = facts.groupBy(*at, F.col("character").alias("subject")).agg(F.min("fact_id").alias("own"), F.lit(True).alias("is_own"))
    any_one = least.groupBy(*at).agg(F.min("own").alias("least"))
    one = spans.groupBy(*at).agg(F.min("span_id").alias("span_id"))
    met = evidence.join(least, [*at, "subject"], "left").join(any_one, at, "left").join(one, at, "left")
    is_own = F.coalesce("is_own", F.lit(False))
    met = met.select("issue", "n", is_own.alias("is_own"), F.when(is_own, F.col("own")).otherwise(F.col("least")).alias("fact_id"), "span_id")
    w = Window.partitionBy("issue", "n").orderBy(F.col("is_own").desc(), F.col("fact_id").asc_nulls_last(), F.col("span_id").asc_nulls_last())
    first = met.withColumn("place", F.row_number().over(w)).where("place = 1")
    return first.select("issue", "n", "fact_id", F.when(F.col("fact_id").isNull(), F.col("span_id")).alias("span_id"))


def patched(chapters: DataFrame, book: str, number: int, old: str, new: str) -> DataFrame:
    """``chapters`` with the one occurrence of ``old`` in a chapter replaced; ValueError if it isn't one."""
    here = (F.col("book") == book) & (F.col("number") == number)
    times = chapters.where(here).select(((F.length("content") - F.length(F.replace("content", F.lit(old)))) / F.lit(len(old))).cast("int")).first()
    if times is None or times[0] != 1:
        raise ValueError(f"the text occurs {times[0] if times else 0} times")
    return chapters.withColumn("content", F.when(here, F.replace("content", F.lit(old), F.lit(new))).otherwise(F.col("content")))


def appended(chapters: DataFrame, new: DataFrame) -> DataFrame:
    """``chapters(book, number, content)`` and ``new(book, content)``, one a book, as its last chapter; blank ones are refused."""
    last = chapters.groupBy("book").agg(F.max("number").alias("last"))
    rows = new.join(last, "book", "left").select("book", (F.coalesce("last", F.lit(0)) + 1).alias("number"), _checked(F.col("content")).alias("content"))
    return chapters.select("book", "number", "content").unionByName(rows)


def replaced(chapters: DataFrame, new: DataFrame) -> DataFrame:
    """``chapters`` with the contents of ``new(book, number, content)``; blank ones are refused, others stay."""
    given = new.select("book", "number", _checked(F.col("content")).alias("__new"), F.lit(True).alias("__given"))
    rows = chapters.join(given, ["book", "number"], "left")
    return rows.withColumn("content", F.when(F.col("__given"), F.col("__new")).otherwise(F.col("content"))).select(*chapters.columns)


def _checked(content: Column) -> Column:
    plain = normalize_newlines(content)
    return F.when(F.length(F.trim(F.regexp_replace(plain, "(?U)\\s", ""))) > 0, plain).otherwise(F.raise_error(F.lit("a chapter can't be blank")))


def without_chapter(chapters: DataFrame, number: int) -> DataFrame:
    """Each book without the chapter ``number``; later ones move up."""
    return chapters.where(F.col("number") != number).withColumn("number", F.col("number") - (F.col("number") > number).cast("int"))


def merged_chapters(chapters: DataFrame, every: int = 3) -> DataFrame:
    """``(book, number, content, ...)`` -> each chapter's merged chapter and where it begins in it.

    Every ``every`` chapters make one; a remainder joins the last. A line break stands between.
    """
    last = chapters.groupBy("book").agg(F.count("*").alias("n"))
    group = F.least(F.floor((F.col("number") - 1) / every), F.greatest(F.floor(F.col("n") / every) - 1, F.lit(0)))
    w = Window.partitionBy("book", "merged").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = chapters.select("book", "number", F.length("content").alias("size")).join(last, "book").withColumn("merged", group.cast("bigint"))
    return rows.select("book", "number", "merged", F.coalesce(F.sum(F.col("size") + 1).over(w), F.lit(0)).alias("begin"))


def other_side(statements: DataFrame, names: DataFrame) -> DataFrame:
    """``statements(book, other_name, other_mention, ...)``, ``names(book, name, character, canonical)`` -> with ``other``.

    The character meant by the name, else by the mention; a canonical name goes before an alias,
    of several the smallest id.
    """
    of = names.groupBy("book", "name").agg(F.min_by("character", F.struct(~F.col("canonical"), "character")).alias("who"))
    by = lambda column, out: of.select("book", F.col("name").alias(column), F.col("who").alias(out))
    rows = statements.join(by("other_name", "__a"), ["book", "other_name"], "left").join(by("other_mention", "__b"), ["book", "other_mention"], "left")
    return rows.select(*statements.columns, F.coalesce("__a", "__b").alias("other"))


def shifted_readings(readings: DataFrame, chapters: DataFrame, version: str) -> DataFrame:
    """Stored readings that still hold, with their places moved to where the chapter's text now begins.

    ``readings(book, number, content_hash, version, begin, statements)``, where ``statements`` is JSON
    of ``[{quote, start, end}]`` in coordinates of the book; ``chapters(book, number, content, begin)``.
    A reading holds if text and version are the same and each quote stands at its place in the
    chapter. Chapters without one are to be read again: ``statements`` is null.
    """
    kind = "array<struct<quote:string,start:bigint,end:bigint>>"
    r = readings.where(F.col("version") == version).select("book", "number", "content_hash", F.col("begin").alias("old"), F.from_json("statements", kind).alias("s"))
    c = chapters.select("book", "number", "content", "begin", F.sha2("content", 256).alias("content_hash"))
    met = c.join(r, ["book", "number", "content_hash"], "left")
    here = F.forall("s", lambda x: F.substring(F.col("content"), (x["start"] - F.col("old") + 1).cast("int"), (x["end"] - x["start"]).cast("int")) == x["quote"])
    moved = F.transform("s", lambda x: F.struct(x["quote"].alias("quote"), (x["start"] - F.col("old") + F.col("begin")).alias("start"), (x["end"] - F.col("old") + F.col("begin")).alias("end")))
    return met.select("book", "number", F.when(F.col("s").isNotNull() & here, F.to_json(moved)).alias("statements"))


def recompute_from(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(book, number, story)`` both -> each book's first chapter whose story text, without notes, has changed."""
    hashed = lambda d, n: d.select("book", "number", F.sha2("story", 256).alias(n))
    met = hashed(before, "a").join(hashed(after, "b"), ["book", "number"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return met.groupBy("book").agg(F.min("number").alias("number"))


def dense_first(chapters: DataFrame, k: int = 2, first: int = 4) -> DataFrame:
    """``(book, number, mentions)`` -> the ``k`` chapters of each book with most mentions, from the ``first`` on, ties to the earlier."""
    place = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("mentions"), "number"))
    return chapters.where(F.col("number") >= first).withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def rules_of(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """``facts(category, attribute, ...)`` with the ``rule`` of ``rules(category, attribute, rule)``; an unknown pair is an error."""
    unknown = F.raise_error(F.concat(F.lit("no rule for "), F.coalesce("category", F.lit("null")), F.lit("/"), F.coalesce("attribute", F.lit("null"))))
    rows = facts.join(F.broadcast(rules.withColumnRenamed("rule", "__rule")), ["category", "attribute"], "left")
    return rows.withColumn("rule", F.coalesce(F.col("__rule"), unknown)).drop("__rule")


def capped_reads(reads: DataFrame, order: list[str], notes: list[tuple[int, int]], span: int = 2000, total: int = 3000) -> DataFrame:
    """``reads(run, start, end, ...)`` with ``stop``, ``cut`` and ``notes``: what each read of a run may show.

    A read has at most ``span`` characters, a run's reads in their order ``total`` in all; ``notes``
    are the ranges of author's notes that what is shown touches.
    """
    size = F.least(F.col("end") - F.col("start"), F.lit(span))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = reads.withColumn("stop", F.col("start") + F.greatest(F.least(size, F.lit(total) - before), F.lit(0)))
    ranges = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in notes])
    inside = F.filter(ranges, lambda n: (n[0] < F.col("stop")) & (F.col("start") < n[1]))
    return rows.withColumns({"cut": F.col("end") - F.col("start") > span, "notes": inside})


def clue_questions(questions: DataFrame) -> DataFrame:
    """``(q, clues, reasons)`` -> a row for each clue that has a place (not -1), with the reason of the same number."""
    rows = questions.select("q", F.posexplode(F.arrays_zip("clues", "reasons")).alias("n", "z"))
    return rows.select("q", "n", F.col("z.clues").alias("clue"), F.col("z.reasons").alias("reason")).where("clue <> -1")


def reusable(chapters: DataFrame, readings: DataFrame, version: str) -> DataFrame:
    """Chapters with the stored reading of their very text and this version, or none."""
    r = readings.where(F.col("version") == version).select("book", "number", "content_hash", F.lit(True).alias("hit"))
    rows = chapters.select("book", "number", F.sha2("content", 256).alias("content_hash"))
    return rows.join(r, ["book", "number", "content_hash"], "left").select("book", "number", F.coalesce("hit", F.lit(False)).alias("reused"))
