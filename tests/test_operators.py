from pyspark.sql import functions as F

from taleweave.operators import checks, core, evaluation, records
from taleweave.operators.timeline import clock
from taleweave.sources import books

AGE = "book int, character int, chapter int, char_start long, pos long, low double, high double, is_flashback boolean, is_speculative boolean, years_before double"


def ages(spark, *rows):
    full = [(1, c, p // 10, p, p, float(lo), float(hi), flash, guess, before) for c, p, lo, hi, flash, guess, before in rows]
    return spark.createDataFrame(full, AGE)


def spans(spark, *rows):
    return spark.createDataFrame([(1, p // 10, p, y) for p, y in rows], "book int, chapter int, pos long, years double")


def test_age_pairs(spark):
    a = ages(spark, (1, 10, 18, 18, False, False, None), (1, 30, 21, 21, False, False, None), (1, 50, 16, 16, False, False, None), (2, 10, 20, 20, False, False, None), (2, 60, 40, 42, False, False, None),
             (3, 10, 30, 30, False, False, None), (3, 20, 10, 10, True, False, 20.0), (3, 22, 5, 5, True, False, None), (3, 24, 99, 99, False, True, None))
    got = {(r.character, r.a_pos, r.confidence, r.gap) for r in checks.age_pairs(a, spans(spark, (20, 3.0))).collect()}
    assert got == {(1, 30, "confirmed", 0.0), (2, 10, "suspected_review", 3.0)}
    unknown = checks.age_pairs(a, spans(spark, (20, 3.0), (40, None))).collect()
    assert {(r.character, r.a_pos, r.confidence) for r in unknown} == {(1, 30, "confirmed")}
    assert checks.age_pairs(a.limit(0), spans(spark, (20, 3.0))).count() == 0


def test_clock_matches_a_loop(spark):
    import random

    random.seed(9)
    places = random.sample(range(10, 400), 60)
    s = [(p, random.choice([None, 1.0, 2.5, 0.5])) for p in places[:25]]
    points = spark.createDataFrame([(1, p // 10, p) for p in places[25:]], "book int, chapter int, pos long")
    for r in clock(points, spans(spark, *s)).collect():
        epoch, time = 0, 0.0
        for p, y in sorted(s, key=lambda x: x[0]):
            if p < r.pos:
                epoch, time = (epoch + 1, 0.0) if y is None else (epoch, time + y)
        assert (r.epoch, r.story_time) == (epoch, time)


def test_fingerprint_ignores_order(spark):
    r = spark.range(1).select(checks.fingerprint(F.lit("c"), F.lit("a"), F.lit("b")).alias("x"), checks.fingerprint(F.lit("c"), F.lit("b"), F.lit("a")).alias("y")).first()
    assert r.x == r.y and len(r.x) == 32


def test_replay_stops_before_a_chapter(spark):
    log = spark.createDataFrame([(1, 1, "create", 7, "A", None, 1, "extracted"), (1, 2, "alias", 7, "B", None, 2, "extracted"), (1, 3, "rename", 7, "C", None, 3, "extracted"), (1, 4, "alias", 7, "D", None, 5, "user"), (1, 5, "create", 8, "E", None, 4, "extracted")],
                                "book int, seq int, kind string, character int, name string, into int, chapter int, source string")
    assert [tuple(r) for r in core.replay(log, 3).collect()] == [(1, 7, "A", ["B", "D"])]
    assert {r.name for r in core.replay(log).collect()} == {"C", "E"}


def test_matching_on_a_grid_finds_each_pair_once(spark):
    import random

    random.seed(3)
    side = lambda n: [(i, 1, 1, s, s + random.randrange(1, 300)) for i in range(n) for s in [random.randrange(0, 3000)]]
    a, b = side(60), side(60)
    kind = "id int, book int, chapter int, start int, end int"
    got = sorted(tuple(r) for r in evaluation.matched(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 100).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[3] < y[4] and y[3] < x[4])


def test_edits(spark):
    c = spark.createDataFrame([("b", 1, "one two"), ("b", 2, "x x"), ("b", 3, "z")], "book string, number int, content string")
    assert records.patched(c, "b", 1, "two", "2").where("number = 1").first().content == "one 2"
    for old in ("x", "none"):
        try:
            records.patched(c, "b", 2, old, "y")
            raise AssertionError("accepted")
        except ValueError:
            pass
    assert [(r.number, r.content) for r in records.without_chapter(c, 1).orderBy("number").collect()] == [(1, "x x"), (2, "z")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("第一章 甲".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes("﻿第二章".encode())
    assert {r.text for r in books.read_books(spark, f"file://{tmp_path}/*.txt").collect()} == {"第一章 甲", "第二章"}
    (tmp_path / "c.json").write_text('[{"novel": "n", "chapters": ["x", "y"]}]')
    assert [tuple(r) for r in books.read_corpus(spark, f"file://{tmp_path}/c.json").collect()] == [("n", 1, "x"), ("n", 2, "y")]
    (tmp_path / "d.num").write_text("[3]abc\nno\n[12]d[1]\n")
    assert [(r.number, r.text) for r in books.read_numbered(spark, f"file://{tmp_path}/d.num").collect()] == [(3, "abc"), (12, "d[1]")]
    assert "&lt;b&gt;" in books.review_page(spark.createDataFrame([("<b>",)], "t string"), "r")


def test_plans_have_no_nested_loops(spark):
    from taleweave import catalog, plans  # noqa: F401

    for name in ("age_pairs", "age_life_stage", "appearance_check", "kinship_check", "issue_sync", "core_fold", "usage_ledger", "span_matches", "keyword_ranking"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scratch_tables_are_cleared(spark):
    from taleweave import scratch

    scratch.clear(spark)
    assert scratch.stored(spark.range(5).toDF("id"), "five").count() == 5
    assert scratch.clear(spark) == 1 and scratch.clear(spark) == 0
