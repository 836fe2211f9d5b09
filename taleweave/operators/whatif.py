"""What a check would say if a statement were different: issues that an edit adds or removes.

Each case edits one row, and is judged as if its book had been copied with that row changed. Only
what an edit can reach is recomputed. A statement has two neighbours in its sequence, so a case
makes at most six pairs. A changed span moves all story time after it; instead of copying the book's
sums, the pairs with the span between them are found by cells of chapters and judged with the
difference. Nothing is done per book, and the work grows with rows, edits, and pairs reached.

A case's result is ``(case, checker, a, b, change)``: the ids of the issue's two statements, and
``added`` or ``removed``. An issue that stays between the same statements is neither.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave import scratch
from taleweave.operators import checks
from taleweave.operators.timeline import gap, with_story_sums


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``rows(id, ...)``, ``edits(case, id, changes map<string, string>)`` -> ``(case, old, new)``, structs of the row.

    ``changes`` holds the new values of columns as text, null included; columns it lacks keep
    theirs. An edit of an id that no row has is dropped; an edit doesn't move its row.
    """
    new = F.struct(*[F.when(F.map_contains_key("changes", f.name), F.element_at("changes", f.name).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in rows.schema.fields])
    return edits.select("case", "id", "changes").join(rows, "id").select("case", F.struct(*[F.col(c) for c in rows.columns]).alias("old"), new.alias("new"))


def _difference(found: DataFrame, checker: str) -> DataFrame:
    """``found(case, a, b, is_new)``, the issues of both worlds -> those of one only."""
    seen = found.groupBy("case", "a", "b").agg(F.bool_or("is_new").alias("now"), F.bool_or(~F.col("is_new")).alias("was")).where("now <> was")
    return seen.select("case", F.lit(checker).alias("checker"), "a", "b", F.when(F.col("now"), "added").otherwise("removed").alias("change"))


def neighbour_pairs(rows: DataFrame, versions: DataFrame, keys: list[str], order: list[str], counts: Callable[[str], Column], own: Callable[[str], Column]) -> DataFrame:
    """The pairs of neighbours that each case takes away or brings: ``(case, a, b, is_new)``.

    ``rows`` and the structs ``old`` and ``new`` of ``versions`` have the same columns. A row takes
    part where ``counts(prefix)`` is true, in the sequence of its ``keys``, by ``order`` (which tells
    rows apart), and is carried as ``own(prefix)``.
    """
    base = rows.where(counts("")).select(*keys, *order, F.lit(1).alias("is_row"), own("").alias("own"), F.lit(None).cast(versions.schema["case"].dataType).alias("case"), F.lit(None).cast("boolean").alias("is_new"), F.lit(None).cast("boolean").alias("stays"))
    same = reduce(lambda x, y: x & y, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]) & counts("old.") & counts("new.")
    sides = []
    for side in ("old", "new"):
        where = versions.where(counts(f"{side}."))
        sides.append(where.select(*[F.col(f"{side}.{c}").alias(c) for c in (*keys, *order)], F.lit(0).alias("is_row"), own(f"{side}.").alias("own"), "case", F.lit(side == "new").alias("is_new"), same.alias("stays")))
    both = base.unionByName(sides[0]).unionByName(sides[1])
    carried = F.when(F.col("is_row") == 1, F.col("own"))

    def nearest(*by: Column) -> Column:
        # a probe comes before the row it stands for, so it never meets it
        return F.last(carried, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*by, "is_row").rowsBetween(Window.unboundedPreceding, -1))

    probes = both.withColumns({"before": nearest(*[F.col(c).asc() for c in order]), "after": nearest(*[F.col(c).desc() for c in order])}).where("is_row = 0")
    pair = lambda a, b, is_new: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), is_new.alias("is_new"))
    # where the row leaves a sequence or enters one, its neighbours meet or part
    closing = F.when(~F.col("stays"), pair("before", "after", ~F.col("is_new")))
    pairs = probes.select("case", F.explode(F.array(pair("before", "own", F.col("is_new")), pair("own", "after", F.col("is_new")), closing)).alias("p"))
    return pairs.where("p.a is not null and p.b is not null").select("case", "p.*")


_SAID = "not {0}is_speculative and (not {0}is_flashback or {0}years_before is not null)"


def _age(prefix: str) -> Column:
    offset = checks.comparable(F.col(f"{prefix}is_flashback"), F.col(f"{prefix}years_before"))
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("id", "pos", "low", "high", "is_flashback", *checks._SUMS)], offset.alias("offset"))


def age_changes(ages: DataFrame, spans: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of stated ages. ``ages`` as for ``checks.age_pairs`` with a unique ``id``; ``spans`` are the present's advances."""
    summed = with_story_sums(ages, spans)
    pairs = neighbour_pairs(summed, edited(summed, edits), ["book", "character"], ["pos", "id"], lambda p: F.expr(_SAID.format(p)), _age)
    _, confidence = checks.age_verdict(gap("a", "b"))
    found = pairs.where(confidence.isNotNull()).select("case", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "is_new")
    return _difference(found, "age_arithmetic")


def _cells(first: Column, last: Column, levels: int) -> Column:
    """The chapters from ``first`` to ``last`` as few cells ``(level, cell)`` of 2**level chapters each; none if the range is empty."""

    found = []
    for k in range(levels + 1):
        low, high = F.ceil(first / 2**k).cast("long"), F.floor((last + 1) / 2**k).cast("long") - 1  # cells wholly inside
        cell = lambda c, k=k: F.struct(F.lit(k).alias("level"), c.alias("cell"))
        found += [F.when((low <= high) & (F.pmod(low, F.lit(2)) == 1), cell(low)), F.when((low <= high) & (F.pmod(high, F.lit(2)) == 0), cell(high))]
    return F.array_compact(F.array(*found))


def between_spans(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """``pairs(book, a, b, ...)`` joined with the ``points(book, chapter, pos, ...)`` that lie strictly between ``a.pos`` and ``b.pos``.

    ``a`` and ``b`` have ``chapter`` and ``pos``. A pair meets points of its end chapters by chapter,
    those of the chapters between by cells, so a pair over n chapters is copied 2 log n times, not n times.
    """
    reach = pairs.agg(F.max(F.col("b.chapter") - F.col("a.chapter"))).first()[0]
    levels = max(0, int(reach or 0)).bit_length()
    ends = F.array_distinct(F.array(*[F.struct(F.lit(-1).alias("level"), F.col(f"{x}.chapter").cast("long").alias("cell")) for x in "ab"]))
    inner = _cells(F.col("a.chapter").cast("long") + 1, F.col("b.chapter").cast("long") - 1, levels)
    left = pairs.withColumn("at", F.explode(F.concat(ends, inner)))
    places = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col("chapter").cast("long"), max(k, 0)).alias("cell")) for k in range(-1, levels + 1)])
    right = points.withColumn("at", F.explode(places))
    on = [F.col("l.book") == F.col("r.book"), F.col("l.at.level") == F.col("r.at.level"), F.col("l.at.cell") == F.col("r.at.cell"), F.col("l.a.pos") < F.col("r.pos"), F.col("r.pos") < F.col("l.b.pos")]
    names = [c for c in points.columns if c != "book"]
    return left.alias("l").join(right.alias("r"), on).select(*[F.col(f"l.{c}") for c in pairs.columns], *[F.col(f"r.{c}") for c in names])


def span_changes(ages: DataFrame, spans: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of spans of time. ``spans(id, book, chapter, pos, years, kind, is_flashback)``: advances of the present count.

    A span that begins or ceases to count changes the years, or the number of unknown ones,
    between all statements around it, in its book.
    """
    counts = lambda p: (F.col(f"{p}kind") == "advance") & ~F.col(f"{p}is_flashback")
    years = lambda p: F.when(counts(p), F.coalesce(F.col(f"{p}years"), F.lit(0.0))).otherwise(0.0)
    unknown = lambda p: (counts(p) & F.col(f"{p}years").isNull()).cast("long")
    changed = edited(spans, edits).select("case", "old.book", "old.chapter", "old.pos", (years("new.") - years("old.")).alias("more"), (unknown("new.") - unknown("old.")).alias("more_unknown"))
    changed = changed.where("more <> 0 or more_unknown <> 0")
    said = with_story_sums(ages.where(_SAID.format("")).withColumn("offset", checks.comparable(F.col("is_flashback"), F.col("years_before"))), spans.where(counts("")))
    own = F.struct("id", "chapter", "pos", "low", "high", "is_flashback", "offset", *checks._SUMS)
    before = F.lag(own).over(Window.partitionBy("book", "character").orderBy("pos", "id"))
    unknowns = F.col("b.unknown_lt") - F.col("a.unknown_le")
    pairs = scratch.stored(said.select("book", before.alias("a"), own.alias("b")).where("a is not null").where(unknowns <= 1), "span-pairs")
    # with a span of unknown length between them in both worlds, a pair is judged alike whatever the others' years
    met = between_spans(pairs.where(unknowns <= 0), changed).unionByName(between_spans(pairs.where(unknowns == 1), changed.where("more_unknown < 0")))
    years_between = F.col("b.years_lt") - F.col("a.years_le") - F.col("b.offset") + F.col("a.offset")
    judged = {}
    for side, more, others in (("was", F.lit(0.0), F.lit(0)), ("now", F.col("more"), F.col("more_unknown"))):
        _, confidence = checks.age_verdict(F.when(unknowns + others <= 0, years_between + more))
        judged[side] = confidence.isNotNull()
    other = met.withColumns(judged).where("was <> now")  # a pair meets a case once, so its two verdicts stand in one row
    return _difference(other.select("case", F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("now").alias("is_new")), "age_arithmetic")


def appearance_changes(traits: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of looks. ``traits`` as for ``checks.appearance`` with a unique ``id``."""
    counts = lambda p: F.expr(f"not {p}is_flashback and not {p}is_speculative and not coalesce({p}disguised, false) and not coalesce({p}temporary, false) and coalesce({p}value, '') <> ''")
    own = lambda p: F.struct(F.col(f"{p}id").alias("id"), F.col(f"{p}value").alias("value"))
    pairs = neighbour_pairs(traits, edited(traits, edits), ["book", "character", "group"], ["pos", "id"], counts, own)
    return _difference(pairs.where("a.value <> b.value").select("case", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "is_new"), "appearance")


def kinship_changes(statements: DataFrame, relations: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of kinship statements. ``statements`` as for ``checks.kinship`` with a unique ``id``."""
    kinds = F.broadcast(relations)  # a fixed table
    turned = lambda rows: checks.kin_described(rows.join(kinds, "relation"))
    versions = edited(statements, edits)
    old, new = (turned(versions.select("case", f"{side}.*")) for side in ("old", "new"))
    columns = turned(statements).columns
    paired = [d.select("case", F.struct(*columns).alias(side)) for d, side in ((old, "old"), (new, "new"))]
    both = paired[0].join(paired[1], "case", "full_outer")  # a relation that isn't in the table is not compared
    counts = lambda p: F.coalesce(F.col(f"{p}is_compared"), F.lit(False))
    own = lambda p: F.struct(F.col(f"{p}id").alias("id"), F.col(f"{p}kin").alias("kin"))
    pairs = neighbour_pairs(turned(statements), both, ["book", "first", "second"], ["pos", "tie", "id"], counts, own)
    conflict = checks.kin_issue(pairs.select("case", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "is_new", F.col("a.kin").alias("a"), F.col("b.kin").alias("b")))
    return _difference(conflict.select("case", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "is_new"), "kinship")


def revival_changes(deaths: DataFrame, presences: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of deaths. ``deaths(id, book, character, chapter, pos, is_speculative)``, ``presences`` the same but for the last.

    A character's first certain death without the edited one is the first or the second of all.
    """
    death = lambda p: F.struct(F.col(f"{p}pos").alias("pos"), F.col(f"{p}id").alias("id"), F.col(f"{p}chapter").alias("chapter"))
    ranked = deaths.where("not is_speculative").select("book", "character", death("").alias("d"), F.row_number().over(Window.partitionBy("book", "character").orderBy("pos", "id")).alias("place")).where("place <= 2")
    firsts = ranked.groupBy("book", "character").agg(F.max(F.when(F.col("place") == 1, F.col("d"))).alias("one"), F.max(F.when(F.col("place") == 2, F.col("d"))).alias("two"))
    versions = edited(deaths, edits)
    sides = []
    for side, other in (("old", "new"), ("new", "old")):
        # each character that the edited death belonged to or comes to belong to, with what it is there after the edit
        there = (F.col("new.book") == F.col(f"{side}.book")) & (F.col("new.character") == F.col(f"{side}.character")) & ~F.col("new.is_speculative")
        sides.append(versions.select("case", f"{side}.book", f"{side}.character", F.col("old.id").alias("edited"), F.when(there, death("new.")).alias("here")))
    touched = sides[0].unionByName(sides[1]).distinct().join(firsts, ["book", "character"], "left")
    rest = F.when(F.col("one.id") == F.col("edited"), F.col("two")).otherwise(F.col("one"))
    worlds = touched.select("case", "book", "character", F.explode(F.array(F.struct(F.lit(False).alias("is_new"), F.col("one").alias("d")), F.struct(F.lit(True).alias("is_new"), F.least(rest, F.col("here")).alias("d")))).alias("w"))
    probes = worlds.where("w.d is not null").select("case", "book", "character", "w.is_new", F.col("w.d.chapter").alias("chapter"), F.col("w.d.id").alias("a"), F.lit(None).cast("struct<pos:bigint,id:bigint>").alias("seen"))
    seen = F.struct(F.col("pos").cast("long").alias("pos"), F.col("id").cast("long").alias("id"))
    rows = presences.select(F.lit(None).cast(probes.schema["case"].dataType).alias("case"), "book", "character", F.lit(None).cast("boolean").alias("is_new"), "chapter", F.lit(None).cast(probes.schema["a"].dataType).alias("a"), seen.alias("seen"))
    later = Window.partitionBy("book", "character").orderBy("chapter").rangeBetween(1, Window.unboundedFollowing)
    found = probes.unionByName(rows).withColumn("first", F.min("seen").over(later)).where("a is not null and first is not null")
    return _difference(found.select("case", "a", F.col("first.id").alias("b"), "is_new"), "revival")


#: Types of corruption (fixed values): table, the rows that can have it, and the new values by column.
#: ``other`` is another character, ``contrary`` a value that can't hold beside the row's; null where there is none.
CORRUPTIONS = [
    ("flashback", "ages", "is_flashback and not is_speculative", {"is_flashback": "'false'"}),
    ("speculative", "ages", "is_speculative and not is_flashback", {"is_speculative": "'false'"}),
    ("value", "ages", "not is_flashback and not is_speculative and low <= 120 and low = high", {"low": "cast(low + 12 as string)", "high": "cast(low + 12 as string)"}),
    ("misattributed", "ages", "not is_flashback and not is_speculative and low <= 120 and other is not null", {"character": "cast(other as string)"}),
    ("time_span", "spans", "kind in ('retrospective', 'future') and years >= 1 and not is_flashback", {"kind": "'advance'"}),
    ("fact_value", "traits", "comparable and often and contrary is not null", {"value": "contrary"}),
    ("fact_speculative", "deaths", "is_speculative and seen_later", {"is_speculative": "'false'"}),
    ("fact_misattributed", "deaths", "not is_speculative and other is not null", {"character": "cast(other as string)"}),
    ("fact_relation", "kin", "not is_speculative and often and contrary is not null", {"relation": "contrary"}),
]


def with_other(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """``rows(book, character, ...)`` with ``other``: the smallest of the book's ``candidates(book, character)`` that is another, or null."""
    one = candidates.groupBy("book").agg(F.min("character").alias("one"))
    two = candidates.join(one, "book").where("character <> one").groupBy("book").agg(F.min("character").alias("two"))
    joined = rows.join(one, "book", "left").join(two, "book", "left")
    return joined.withColumn("other", F.when(F.col("character") == F.col("one"), F.col("two")).otherwise(F.col("one"))).drop("one", "two")


def with_later(deaths: DataFrame, presences: DataFrame) -> DataFrame:
    """``deaths`` with ``seen_later``, and ``other``: the smallest other character of the book seen in a later chapter."""
    last = presences.groupBy("book", "character").agg(F.max("chapter").alias("last"))
    # the two smallest characters that are seen at ``last`` or later: a second one is the least of the greater of each and the smallest before it
    down = Window.partitionBy("book").orderBy(F.desc("last"), "character").rowsBetween(Window.unboundedPreceding, 0)
    one = last.withColumn("one", F.min("character").over(down))
    before = F.lag("one").over(Window.partitionBy("book").orderBy(F.desc("last"), "character"))
    pushed = one.withColumn("pushed", F.when(before.isNotNull(), F.greatest("character", before)))
    steps = pushed.withColumn("two", F.min("pushed").over(down)).groupBy("book", "last").agg(F.min("one").alias("one"), F.min("two").alias("two"))
    # the step just above each death's chapter
    probes = deaths.select("book", F.col("chapter").alias("last"), F.struct(*deaths.columns).alias("row"), F.lit(None).cast("struct<one:bigint,two:bigint>").alias("step"))
    rows = steps.select("book", "last", F.lit(None).cast(probes.schema["row"].dataType).alias("row"), F.struct(F.col("one").cast("long").alias("one"), F.col("two").cast("long").alias("two")).alias("step"))
    above = Window.partitionBy("book").orderBy("last").rangeBetween(1, Window.unboundedFollowing)
    met = probes.unionByName(rows).withColumn("next", F.first("step", ignorenulls=True).over(above)).where("row is not null").select("row.*", "next")
    met = met.join(last, ["book", "character"], "left")
    other = F.when(F.col("next.one") == F.col("character"), F.col("next.two")).otherwise(F.col("next.one"))
    return met.withColumns({"seen_later": F.coalesce(F.col("last") > F.col("chapter"), F.lit(False)), "other": other}).drop("last", "next")


def planned_edits(tables: dict[str, DataFrame]) -> DataFrame:
    """``(case, type, table, id, changes)``: every edit of the nine types that the tables allow.

    Each table has a unique ``id`` and the columns that ``CORRUPTIONS`` names. A case is its type and row.
    """
    out = None
    for kind, name, where, values in CORRUPTIONS:
        changes = F.create_map(*[x for c, v in values.items() for x in (F.lit(c), F.expr(v))])
        one = tables[name].where(where).select(F.concat_ws(":", F.lit(kind), F.col("id").cast("string")).alias("case"), F.lit(kind).alias("type"), F.lit(name).alias("table"), "id", changes.alias("changes"))
        out = one if out is None else out.unionByName(one)
    return out


def what_if(tables: dict[str, DataFrame], relations: DataFrame, edits: DataFrame) -> DataFrame:
    """All checkers' changes by all ``edits(case, table, id, changes)``: ``(case, checker, a, b, change)``.

    ``tables`` are ``ages``, ``spans``, ``traits``, ``deaths``, ``presences`` and ``kin``.
    """
    of = lambda name: edits.where(F.col("table") == name)
    advances = tables["spans"].where("kind = 'advance' and not is_flashback")
    return (
        age_changes(tables["ages"], advances, of("ages")).unionByName(span_changes(tables["ages"], tables["spans"], of("spans")))
        .unionByName(appearance_changes(tables["traits"], of("traits"))).unionByName(kinship_changes(tables["kin"], relations, of("kin")))
        .unionByName(revival_changes(tables["deaths"], tables["presences"], of("deaths")))
    )
