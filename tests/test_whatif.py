"""Edits judged by what they can reach, against copying the whole table for each case and checking it anew."""

import random

import pytest
from pyspark.sql import functions as F

from taleweave.functions.kin import CONTRARY, RELATIONS
from taleweave.operators import checks, whatif
from taleweave.plans.checking import relation_table


def copied(rows, versions):
    """``rows`` once for each case, with the case as book and its row changed."""
    cases = versions.select("case", F.col("old.id").alias("edited"), "new")
    both = rows.crossJoin(cases)  # a handful of cases: this is the brute force
    new = [F.when(F.col("id") == F.col("edited"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in rows.columns]
    return both.select(F.concat_ws("/", "case", "book").alias("__book"), *new).drop("book").withColumnRenamed("__book", "book"), both.select(F.concat_ws("/", "case", "book").alias("__book"), *rows.columns).drop("book").withColumnRenamed("__book", "book")


def found(df, a, b):
    return {(r.book, r[a], r[b]) for r in df.collect()}


def expect(now, was):
    return {(book.rpartition("/")[0], a, b, change) for rows, other, change in ((now, was, "added"), (was, now, "removed")) for book, a, b in rows - other}


def got(df):
    rows = df.collect()
    out = {(r.case, r.a, r.b, r.change) for r in rows}
    assert len(out) == len(rows)
    return out


def age_rows(spark, rng, n=60):
    rows = []
    for i in range(n):
        chapter, flash = rng.randrange(1, 9), rng.random() < 0.2
        low = float(rng.randrange(5, 40))
        rows.append((i, rng.choice("xy"), rng.randrange(4), chapter, i, chapter * 1000 + i, low, low + rng.choice([0, 0, 2]), flash, rng.random() < 0.15, float(rng.randrange(5)) if flash and rng.random() < 0.6 else None))
    return spark.createDataFrame(rows, "id long, book string, character long, chapter int, char_start long, pos long, low double, high double, is_flashback boolean, is_speculative boolean, years_before double")


def span_rows(spark, rng, n=25):
    rows = []
    for i in range(100, 100 + n):
        chapter = rng.randrange(1, 9)
        rows.append((i, rng.choice("xy"), chapter, chapter * 1000 + rng.randrange(60) * 1, rng.choice([None, 0.0, 3.0, 7.0]), rng.choice(["advance", "advance", "retrospective"]), rng.random() < 0.1))
    return spark.createDataFrame(rows, "id long, book string, chapter int, pos long, years double, kind string, is_flashback boolean")


def edits(spark, cases):
    return spark.createDataFrame([(f"c{i}", row, changes) for i, (row, changes) in enumerate(cases)], "case string, id long, changes map<string,string>")


@pytest.mark.parametrize("seed", range(2))
def test_edits_of_ages_and_spans(spark, seed):
    rng = random.Random(seed)
    ages, spans = age_rows(spark, rng).cache(), span_rows(spark, rng).cache()
    advances = spans.where("kind = 'advance' and not is_flashback")
    changes = [{"is_flashback": "true"}, {"is_flashback": "false"}, {"is_speculative": "true"}, {"is_speculative": "false"}, {"low": "80", "high": "81"}, {"character": "2"}, {"character": "99"}, {"years_before": None}, {"is_flashback": "true", "years_before": "4"}, {}, {"character": None}]
    own = edits(spark, [(rng.randrange(62), rng.choice(changes)) for _ in range(60)])
    after, before = copied(ages, whatif.edited(ages, own))
    books = before.select("book").distinct()
    every = books.join(advances.withColumnRenamed("book", "of"), F.substring_index("book", "/", -1) == F.col("of")).drop("of")
    key = ["a_pos", "b_pos"]
    ids = {r.pos: r.id for r in ages.collect()}
    now, was = (found(checks.age_pairs(d, every), *key) for d in (after, before))
    want = {(c, ids[a], ids[b], change) for c, a, b, change in expect(now, was)}
    assert got(whatif.age_changes(ages, advances, own)) == want and len(want) > 10

    changes = [{"kind": "advance"}, {"kind": "future"}, {"years": "9"}, {"years": None}, {"is_flashback": "true"}, {"is_flashback": "false", "kind": "advance", "years": "2"}]
    own = edits(spark, [(100 + rng.randrange(26), rng.choice(changes)) for _ in range(60)])
    after, before = copied(spans, whatif.edited(spans, own))
    books = before.select("book").distinct()
    every = books.join(ages.withColumnRenamed("book", "of"), F.substring_index("book", "/", -1) == F.col("of")).drop("of")
    counted = lambda d: d.where("kind = 'advance' and not is_flashback")
    now, was = (found(checks.age_pairs(every, counted(d)), *key) for d in (after, before))
    want = {(c, ids[a], ids[b], change) for c, a, b, change in expect(now, was)}
    assert got(whatif.span_changes(ages, spans, own)) == want and len(want) > 10


def test_edits_of_looks_and_kinship(spark):
    rng = random.Random(3)
    looks = [(i, rng.choice("xy"), rng.randrange(3), rng.choice("ab"), rng.choice(["c1", "c2", "", None]), i, i, rng.random() < 0.1, rng.random() < 0.1, rng.choice([None, True, False]), None) for i in range(60)]
    looks = spark.createDataFrame(looks, "id long, book string, character long, group string, value string, pos long, char_start long, is_flashback boolean, is_speculative boolean, disguised boolean, temporary boolean")
    own = edits(spark, [(rng.randrange(60), rng.choice([{"value": "c3"}, {"value": None}, {"group": "a"}, {"character": "1"}, {"disguised": None}, {"is_speculative": "true"}])) for _ in range(50)])
    after, before = copied(looks, whatif.edited(looks, own))
    now, was = (found(checks.appearance(d), "a_pos", "b_pos") for d in (after, before))
    assert got(whatif.appearance_changes(looks, own)) == expect(now, was) and now != was

    names = [r[0] for r in RELATIONS]
    kin = [(i, rng.choice("xy"), rng.randrange(3), rng.choice([0, 1, 2, None]), rng.choice(names), i, i, rng.random() < 0.2, rng.random() < 0.1) for i in range(80)]
    kin = spark.createDataFrame(kin, "id long, book string, person long, other long, relation string, pos long, tie long, address boolean, is_speculative boolean")
    own = edits(spark, [(rng.randrange(80), rng.choice([{"relation": rng.choice(names)}, {"relation": "nobody"}, {"is_speculative": "true"}, {"is_speculative": "false"}, {"other": "1"}, {"person": "0"}])) for _ in range(60)])
    after, before = copied(kin, whatif.edited(kin, own))
    now, was = (found(checks.kinship(d, relation_table(spark)), "a_pos", "b_pos") for d in (after, before))
    assert got(whatif.kinship_changes(kin, relation_table(spark), own)) == expect(now, was) and now != was


def test_edits_of_deaths(spark):
    rng = random.Random(5)
    lives = [(i, rng.choice("xy"), rng.randrange(4), chapter, chapter * 1000 + i, rng.random() < 0.3) for i in range(60) for chapter in [rng.randrange(1, 8)]]
    schema = "id long, book string, character long, chapter int, pos long, is_speculative boolean"
    deaths, presences = spark.createDataFrame(lives[:20], schema), spark.createDataFrame(lives[20:], schema)
    own = edits(spark, [(rng.randrange(21), rng.choice([{"is_speculative": "false"}, {"is_speculative": "true"}, {"character": "1"}, {"character": "77"}, {"character": "2", "is_speculative": "false"}])) for _ in range(60)])
    after, before = copied(deaths, whatif.edited(deaths, own))
    every = before.select("book").distinct().join(presences.withColumnRenamed("book", "of"), F.substring_index("book", "/", -1) == F.col("of")).drop("of")
    ids = {r[4]: r[0] for r in lives}
    now, was = (found(checks.revivals(d, every), "death_pos", "seen_pos") for d in (after, before))
    want = {(c, ids[a], ids[b], change) for c, a, b, change in expect(now, was)}
    assert got(whatif.revival_changes(deaths, presences, own)) == want and len(want) > 10


def test_points_between_pairs_by_cells(spark):
    rng = random.Random(1)
    pairs = [("b", i, *sorted(rng.sample(range(3000), 2))) for i in range(200)]
    points = [("b", p // 10, p, i) for i, p in enumerate(rng.sample(range(3000), 150))]
    place = lambda c: F.struct((F.col(c) / 10).cast("int").alias("chapter"), F.col(c).alias("pos"))
    left = spark.createDataFrame(pairs, "book string, pair long, x long, y long").select("book", "pair", place("x").alias("a"), place("y").alias("b"))
    met = whatif.between_spans(left, spark.createDataFrame(points, "book string, chapter int, pos long, point long"))
    rows = [(r.pair, r.point) for r in met.collect()]
    assert sorted(rows) == sorted((i, j) for _, i, x, y in pairs for _, _, p, j in points if x < p < y)
    assert "NestedLoop" not in met._jdf.queryExecution().toString()
    assert whatif.between_spans(left.limit(0), spark.createDataFrame(points, "book string, chapter int, pos long, point long")).count() == 0


def test_contrary_relations_are_contradictions(spark):
    kinds = {r.relation: r for r in relation_table(spark).collect()}
    pairs = spark.createDataFrame([(a, b) for a, b in CONTRARY.items()], "x string, y string")
    for side, name in (("x", "a"), ("y", "b")):
        pairs = pairs.join(relation_table(spark).select(F.col("relation").alias(side), F.struct(F.lit(False).alias("address"), *[F.col(c) for c in relation_table(spark).columns]).alias(name)), side)
    assert checks.kin_issue(pairs).count() == len(CONTRARY) and set(CONTRARY) <= set(kinds)
