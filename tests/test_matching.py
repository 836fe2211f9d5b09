import random
from collections import Counter

from taleweave import catalog, plans  # noqa: F401
from taleweave.operators import evaluation, matching, sampling

PAIR = "part int, expected int, observed int, turn int, place int"
SPAN = "id int, book int, chapter int, start int, end int"


def walked(pairs):
    taken = set()
    for part, expected in sorted({(r[0], r[1]) for r in pairs}, key=lambda k: (k[0], next(r[3] for r in pairs if r[:2] == k))):
        for r in sorted((r for r in pairs if r[:2] == (part, expected)), key=lambda r: r[4]):
            if (part, r[2]) not in {(a, c) for a, _, c in taken}:
                taken.add(r[:3])
                break
    return taken


def test_rounds_take_what_a_walk_takes(spark):
    rng = random.Random(3)
    pairs = []
    for part in range(30):
        turns, places = rng.sample(range(99), 8), rng.sample(range(99), 8)
        pairs += [(part, e, o, turns[e], places[o]) for e in range(8) for o in range(8) if rng.random() < rng.choice([0.1, 0.4, 0.9])]
    pairs += [(99, e, o, e, o) for e in range(6) for o in (max(e - 1, 0), e)]  # each displaces the next
    got = [tuple(r) for r in matching.taken_in_order(spark.createDataFrame(pairs + pairs[:9], PAIR)).collect()]
    assert set(got) == walked(pairs) and len(got) == len(set(got))
    assert matching.taken_in_order(spark.createDataFrame([], PAIR)).count() == 0


def test_spans_in_rounds_as_the_walk_of_chapters(spark):
    rng = random.Random(8)
    side = lambda: spark.createDataFrame([(i, rng.randrange(2), rng.randrange(3), s := rng.randrange(400), s + rng.randrange(1, 60)) for i in range(150)], SPAN)
    a, b = side(), side()
    a, b = a.union(a.limit(9)), b.union(b.limit(9))
    assert sorted(map(tuple, matching.spans_taken(a, b, 50).collect())) == sorted(map(tuple, evaluation.one_to_one(a, b).collect()))


def test_scoring_of_issues(spark):
    spec = "story int, id int, type string, character string, confidence string, ends array<struct<first:int,last:int>>"
    specs = [(1, 1, "age", "A", "sure", [(1, 3)]), (1, 2, "age", "A", None, [(1, 3), (2, 3)]), (1, 3, "age", "B", None, [(1, 3)]), (1, 4, "kin", "A", None, []), (2, 1, "age", "A", None, [(1, 3)])]
    allowed = [(1, 9, "age", "A", None, [(5, 5)])]
    issues = [
        (1, 11, "age", [7, 7], 1, 3, "likely"), (1, 12, "age", [8], 2, 3, "sure"), (1, 13, "age", [8, 7], 5, 5, "sure"), (1, 14, "age", [6], 1, 3, "insufficient"),
        (1, 15, "age", None, 1, 3, "sure"), (1, 16, "age", [7], None, None, None), (1, 17, "kin", [7], 1, 3, "sure"),
    ]
    names = [(1, 7, "A"), (1, 7, "A"), (1, 8, "A"), (1, 8, "C")]
    rows = matching.issues_scored(spark.createDataFrame(specs, spec), spark.createDataFrame(allowed, spec), spark.createDataFrame(issues, "story int, id int, type string, subjects array<int>, first int, last int, confidence string"), spark.createDataFrame(names, "story int, model int, name string")).collect()
    assert {(r.story, r.side, r.id): (r.outcome, r.partner) for r in rows} == {
        (1, "spec", 1): ("wrong_confidence", 11), (1, "spec", 2): ("right", 12), (1, "spec", 3): ("missed", None), (1, "spec", 4): ("missed", None), (2, "spec", 1): ("missed", None),
        (1, "issue", 11): ("matched", 1), (1, "issue", 12): ("matched", 2), (1, "issue", 13): ("allowed", None), (1, "issue", 14): ("insufficient", None),
        (1, "issue", 15): ("false_positive", None), (1, "issue", 16): ("false_positive", None), (1, "issue", 17): ("false_positive", None),
    }
    assert len(rows) == 12


def test_quotas_by_largest_remainder(spark):
    rows = spark.createDataFrame([(i, "a" if i < 70 else "b" if i < 95 else None if i < 99 else "c") for i in range(100)], "id int, type string")
    for n, want in [(0, (0, 0, 0, 0)), (1, (1, 0, 0, 0)), (10, (7, 3, 0, 0)), (50, (35, 13, 2, 0)), (100, (70, 25, 4, 1)), (999, (70, 25, 4, 1))]:
        got = {r.type: r.quota for r in sampling.quotas(rows, "type", n).collect()}
        assert (got["a"], got["b"], got[None], got["c"]) == want, n
    chosen = sampling.stratified(rows, "type", "id", 50, 7).where("chosen").collect()
    assert Counter(r.type for r in chosen) == {"a": 35, "b": 13, None: 2}
    assert sampling.stratified(rows.repartition(9), "type", "id", 50, 7).where("chosen").exceptAll(spark.createDataFrame(chosen, "id int, type string, chosen boolean")).count() == 0
    assert sampling.stratified(rows, "type", "id", 50, 8).where("chosen").count() == 50
    assert sampling.stratified(rows.limit(0), "type", "id", 50, 7).count() == 0


def test_no_nested_loops(spark):
    for name in ("issues_scored", "spans_taken", "review_sample", "probed_chapters"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_one_id_in_several_stories(spark, tmp_path):
    import duckdb

    from tests.comparing import assert_same

    con = duckdb.connect()
    con.sql(f"copy (select * replace (l_orderkey % 60 as l_orderkey, (round(l_extendedprice) % 40)::double as l_extendedprice, l_suppkey % 20 as l_suppkey) from '/root/testdata/sf0.001/lineitem.parquet' limit 3000) to '{tmp_path}/lineitem.parquet'")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert_same(catalog.QUERIES["issues_scored"](spark, str(tmp_path)), con, catalog.ORACLES["issues_scored"])
