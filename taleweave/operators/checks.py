"""Consistency checks over statements: ages, life stages, looks, kinship, revival.

Each check compares neighbours in narrative order, so it is a window over one character (or
pair) and its cost is linear. Positions are single numbers (chapter, then offset); ties are
ordered by ``char_start`` and the row's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave.operators.timeline import gap, with_story_sums

#: Ages are often rounded, and a birthday may lie between two statements.
TOLERANCE_YEARS = 1.0


def comparable(is_flashback: Column, years_before: Column) -> Column:
    """How far before the present a statement is set: 0, or a flashback's known offset; else null."""
    return F.when(~is_flashback, F.lit(0.0)).otherwise(years_before)


def range_distance(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """0 where the ranges overlap, otherwise how far they are apart. A null end is open."""
    return F.greatest(F.lit(0.0), lo2 - hi1, F.coalesce(lo1 - hi2, F.lit(0.0)))


def _per_character() -> Window:
    return Window.partitionBy("book", "character").orderBy("pos", "char_start")


def _said(statements: DataFrame, spans: DataFrame) -> DataFrame:
    """Certain, comparable statements with their story sums."""
    rows = statements.withColumn("offset", comparable(F.col("is_flashback"), F.col("years_before")))
    return with_story_sums(rows.where(~F.col("is_speculative") & F.col("offset").isNotNull()), spans)


_SUMS = ["years_lt", "years_le", "unknown_lt", "unknown_le", "spans_lt", "spans_le"]


def age_verdict(gap: Column) -> tuple[Column, Column]:
    """(mismatch in years, confidence or null) of two statements ``a`` and ``b`` with ``gap`` years between."""
    present = ~F.col("a.is_flashback") & ~F.col("b.is_flashback")
    mismatch = F.when(gap.isNotNull(), range_distance(F.col("a.low") + gap, F.col("a.high") + gap, F.col("b.low"), F.col("b.high")))
    return mismatch, F.when(present & (F.col("b.high") < F.col("a.low")), "confirmed").when(mismatch > TOLERANCE_YEARS, "suspected_review")


def age_pairs(ages: DataFrame, spans: DataFrame) -> DataFrame:
    """Neighbouring stated ages of a character that disagree.

    ``ages(book, character, chapter, char_start, pos, low, high, is_flashback, is_speculative,
    years_before)``, ``spans`` the advances of the present. A present age that goes down is
    confirmed, whatever time passed; otherwise an age that differs by more than the tolerance
    from what the story's time makes of the earlier one is suspected; unknown time: nothing.
    """
    said = _said(ages, spans)
    own = F.struct("pos", "char_start", "chapter", "low", "high", "is_flashback", "offset", *_SUMS)
    pairs = said.select("book", "character", F.lag(own).over(_per_character()).alias("a"), own.alias("b")).where("a is not null")
    pairs = pairs.withColumn("gap", gap("a", "b"))
    mismatch, confidence = age_verdict(F.col("gap"))
    found = pairs.withColumns({"mismatch": mismatch, "confidence": confidence}).where("confidence is not null")
    return found.select(
        "book", "character", F.col("a.pos").alias("a_pos"), F.col("b.pos").alias("b_pos"), F.col("a.chapter").alias("a_chapter"), F.col("b.chapter").alias("b_chapter"),
        F.col("a.low").alias("a_low"), F.col("a.high").alias("a_high"), F.col("b.low").alias("b_low"), F.col("b.high").alias("b_high"),
        "gap", "mismatch", "confidence", (F.col("b.spans_lt") - F.col("a.spans_le")).alias("spans_between"),
    )


def life_stages(stages: DataFrame, ages: DataFrame, spans: DataFrame) -> DataFrame:
    """Life stages that the character's nearest earlier stated age (else the first) rules out.

    ``stages(..., stage, stage_low, stage_high)``; a null ``stage_high`` has no end.
    """
    columns = ["book", "character", "chapter", "pos", "char_start", "is_flashback", "is_speculative", "years_before"]
    none = {"low": "double", "high": "double", "stage": "string", "stage_low": "double", "stage_high": "double"}
    both = [d.select(*columns, *[F.col(c) if c in d.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]) for d in (ages, stages)]
    said = _said(both[0].unionByName(both[1]), spans)
    age = F.when(F.col("low").isNotNull(), F.struct("pos", "low", "high", "offset", *_SUMS))
    w = Window.partitionBy("book", "character").orderBy("pos")
    earlier = F.last(age, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1))
    first = F.first(age, ignorenulls=True).over(Window.partitionBy("book", "character").orderBy("pos", "char_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = said.withColumn("ref", F.coalesce(earlier, first)).where("stage is not null and ref is not null")
    rows = rows.withColumn("me", F.struct("pos", "offset", *_SUMS)).withColumn("before", F.col("ref.pos") <= F.col("pos"))
    shift = F.when(F.col("before"), gap("ref", "me")).otherwise(-gap("me", "ref"))
    rows = rows.withColumn("shift", shift).where("shift is not null")
    rows = rows.withColumns({"expected_low": F.col("ref.low") + F.col("shift"), "expected_high": F.col("ref.high") + F.col("shift")})
    apart = range_distance(F.col("expected_low"), F.col("expected_high"), F.col("stage_low"), F.col("stage_high"))
    return rows.where(apart > TOLERANCE_YEARS).select("book", "character", "pos", "stage", F.col("ref.pos").alias("ref_pos"), "expected_low", "expected_high")


def stage_regressions(stages: DataFrame, ages: DataFrame) -> DataFrame:
    """Clear steps back between neighbouring life stages of characters without any comparable age.

    ``stages`` needs ``stage_order`` too. Flashbacks are not compared.
    """
    offset = comparable(F.col("is_flashback"), F.col("years_before"))
    said = stages.where(~F.col("is_speculative") & offset.isNotNull())
    aged = ages.where(~F.col("is_speculative") & offset.isNotNull()).select("book", "character").distinct()
    said = said.join(aged, ["book", "character"], "left_anti")
    own = F.struct("pos", "stage", "stage_order", "stage_low", "is_flashback")
    pairs = said.withColumn("a", F.lag(own).over(_per_character())).where("a is not null and not a.is_flashback and not is_flashback")
    back = (F.col("stage_high") < F.col("a.stage_low")) & (F.col("stage_order") < F.col("a.stage_order"))
    return pairs.where(back).select("book", "character", F.col("a.pos").alias("a_pos"), F.col("pos").alias("b_pos"), F.col("a.stage").alias("a_stage"), F.col("stage").alias("b_stage"))


def content_keys(facts: DataFrame, order: list[str]) -> DataFrame:
    """``facts(book, chapter_key, quote, ...)`` with ``key``: chapter, quote and which use of the quote it is.

    All facts count, certain or not, so a key outlives a new reading of the chapter.
    """
    n = F.row_number().over(Window.partitionBy("book", "chapter_key", "quote").orderBy(*order)) - 1
    return facts.withColumn("key", F.concat_ws("|", "chapter_key", "quote", n.cast("string")))


def fingerprint(checker: Column, *keys: Column) -> Column:
    """A stable id of the same problem, whatever order its facts are given in."""
    return F.substring(F.sha2(F.concat_ws("|", checker, F.array_sort(F.array(*keys))), 256), 1, 32)


def appearance(traits: DataFrame) -> DataFrame:
    """Neighbouring statements of one look (or of one kind of mark on one part) that differ.

    ``traits(book, character, group, value, pos, char_start, is_flashback, is_speculative,
    disguised, temporary)``; ``group`` names the attribute, for marks with part and kind, and
    ``value`` what is compared, for marks the side. Guesses, flashbacks and passing looks are out.
    """
    own_look = ~F.coalesce(F.col("disguised"), F.lit(False)) & ~F.coalesce(F.col("temporary"), F.lit(False))
    said = traits.where(~F.col("is_flashback") & ~F.col("is_speculative") & own_look & (F.coalesce("value", F.lit("")) != ""))
    w = Window.partitionBy("book", "character", "group").orderBy("pos", "char_start")
    pairs = said.withColumns({"a_value": F.lag("value").over(w), "a_pos": F.lag("pos").over(w)})
    return pairs.where("a_value <> value").select("book", "character", "group", "a_pos", F.col("pos").alias("b_pos"), "a_value", F.col("value").alias("b_value"))


def marks(values: DataFrame, column: str = "value") -> DataFrame:
    """``value`` "where·what" -> ``side``, ``part``, ``kind``; all null without a side written."""
    parts = F.split(F.col(column), "·", 2)
    where, what = F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))
    sides = F.expr(f"case when contains(split({column}, '·', 2)[0], '左') then '左' when contains(split({column}, '·', 2)[0], '右') then '右' end")
    side = F.when(F.contains(F.col(column), F.lit("·")), sides)
    part = F.replace(F.replace(F.replace(F.replace(where, side, F.lit("")), F.lit("半边"), F.lit("")), F.lit("边"), F.lit("")), F.lit("侧"), F.lit(""))
    return values.withColumns({"side": side, "part": F.when(side.isNotNull(), part), "kind": F.when(side.isNotNull(), what)})


def kin_conflict(a: str, b: str) -> Column:
    """Why two descriptions of the same ordered pair can't both hold, or null.

    Only what both tell is compared: generation, link, side, the sexes, who is older.
    """
    differ = lambda f: F.col(f"{a}.{f}") != F.col(f"{b}.{f}")  # noqa: E731  null if either doesn't tell
    return (
        F.when(differ("generations"), "generation").when(differ("link"), "link")
        .when(differ("side"), F.when(F.col(f"{a}.link") == "cousin", "cousin_kind").otherwise("side"))
        .when(differ("sex_a"), "sex").when(differ("sex_b"), "sex").when(differ("a_older"), "age_order")
    )


def kin_described(statements: DataFrame) -> DataFrame:
    """Statements joined with their relation's columns, turned to one direction: ``first`` is the smaller id as text.

    Adds ``first``, ``second``, ``kin`` (what is said of the pair in that direction) and ``is_compared``.
    """
    swapped = F.col("person").cast("string") > F.col("other").cast("string")
    turn = lambda x, y: F.when(swapped, y).otherwise(x)
    kin = F.struct(
        turn(F.col("generations"), -F.col("generations")).alias("generations"), "link", "side", turn(F.col("sex_a"), F.col("sex_b")).alias("sex_a"),
        turn(F.col("sex_b"), F.col("sex_a")).alias("sex_b"), turn(F.col("a_older"), ~F.col("a_older")).alias("a_older"), "pos", "relation", "address",
    )
    compared = ~F.col("is_speculative") & F.col("other").isNotNull() & (F.col("person") != F.col("other"))
    return statements.withColumns({"first": turn(F.col("person"), F.col("other")), "second": turn(F.col("other"), F.col("person")), "kin": kin, "is_compared": compared})


def kin_issue(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` of neighbouring descriptions -> those that contradict each other, with ``reason``.

    Forms of address may blur sibling, cousin and the kind of cousin.
    """
    pairs = pairs.withColumn("reason", kin_conflict("a", "b"))
    loose = (F.coalesce("a.address", F.lit(False)) | F.coalesce("b.address", F.lit(False))) & ((F.col("reason") == "cousin_kind") | ((F.col("reason") == "link") & (F.col("a.generations") == 0)))
    return pairs.where(F.col("reason").isNotNull() & ~loose)


def kinship(statements: DataFrame, relations: DataFrame) -> DataFrame:
    """Neighbouring kinship statements about a pair that contradict each other.

    ``statements(book, person, other, relation, pos, tie, is_speculative, address)``: person is
    the relation of other; ``relations`` describes each relation. Flashbacks count.
    """
    rows = kin_described(statements.join(F.broadcast(relations), "relation")).where("is_compared")  # the relation table is a fixed one
    before = F.lag("kin").over(Window.partitionBy("book", "first", "second").orderBy("pos", "tie"))
    pairs = rows.select("book", "first", "second", F.col("kin").alias("b"), before.alias("a")).where("a is not null")
    return kin_issue(pairs).select("book", "first", "second", F.col("a.pos").alias("a_pos"), F.col("b.pos").alias("b_pos"), F.col("a.relation").alias("a_relation"), F.col("b.relation").alias("b_relation"), "reason")


def revivals(deaths: DataFrame, presences: DataFrame) -> DataFrame:
    """The first appearance in person in a chapter after the character's first certain death.

    ``deaths`` and ``presences`` ``(book, character, chapter, pos)``, deaths with
    ``is_speculative``. Presences count whatever their flags.
    """
    died = deaths.where(~F.col("is_speculative")).groupBy("book", "character").agg(F.min("pos").alias("death_pos"), F.min_by("chapter", "pos").alias("death_chapter"))
    later = presences.join(died, ["book", "character"]).where("chapter > death_chapter")
    return later.groupBy("book", "character", "death_pos").agg(F.min("pos").alias("seen_pos"))


def sync(stored: DataFrame, found: DataFrame, unextracted: DataFrame, ran: list[str]) -> DataFrame:
    """The issue table after a run of the checkers ``ran``.

    ``stored(book, fingerprint, checker, status, resolved_from, confidence, chapters array)``,
    ``found(book, fingerprint, checker, confidence, chapters)``, ``unextracted(book, chapter)``.
    New issues are open. Those found again keep their status; a resolved one becomes what it
    was resolved from, or open. Open and acknowledged ones no longer found are resolved,
    unless they quote a chapter that isn't extracted. Intentional ones and other checkers'
    rows are left alone. An issue found twice counts once.
    """
    found = found.where(F.col("checker").isin(ran)).groupBy("book", "fingerprint").agg(*[F.min_by(c, "confidence").alias(f"new_{c}") for c in ("checker", "confidence", "chapters")])
    missing = unextracted.groupBy("book").agg(F.collect_set("chapter").alias("missing"))
    rows = stored.join(found, ["book", "fingerprint"], "full_outer").join(missing, "book", "left")
    mine = F.col("checker").isin(ran)
    again, new = F.col("status").isNotNull() & F.col("new_checker").isNotNull(), F.col("status").isNull()
    gone = F.col("new_checker").isNull() & mine & F.col("status").isin("open", "acknowledged")
    kept = F.coalesce(F.arrays_overlap("chapters", "missing"), F.lit(False))
    back = again & (F.col("status") == "resolved")
    status = F.when(new, "open").when(back, F.coalesce("resolved_from", F.lit("open"))).when(gone & ~kept, "resolved").otherwise(F.col("status"))
    before = F.when(back, None).when(gone & ~kept, F.col("status")).otherwise(F.col("resolved_from"))
    action = F.when(new, "new").when(back, "reopened").when(again, "again").when(gone & kept, "kept").when(gone, "resolved").otherwise("untouched")
    return rows.select(
        "book", "fingerprint", F.coalesce("new_checker", "checker").alias("checker"), status.alias("status"), before.alias("resolved_from"),
        F.coalesce("new_confidence", "confidence").alias("confidence"), action.alias("action"),
    )
