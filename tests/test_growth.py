"""Work that must grow no faster than the rows: crowded places, few keys, long texts."""

from pyspark.sql import functions as F

from taleweave import catalog, plans  # noqa: F401
from taleweave.operators import records, whatif
from tests.growth import rows_out


def test_facts_of_a_crowded_place(spark):
    e = spark.range(900).selectExpr("id as issue", "1 as n", "1 as chapter", "2 as char_start", "7 as char_end", "id % 3 as subject")
    f = spark.range(800).selectExpr("id + 5 as fact_id", "1 as chapter", "2 as char_start", "7 as char_end", "id % 2 as character")
    s = spark.createDataFrame([(9, 1, 2, 7), (8, 3, 2, 7)], "span_id long, chapter int, char_start int, char_end int")
    lone = spark.createDataFrame([(1000, 1, 3, 2, 7, 0), (1001, 1, 4, 2, 7, 0), (1002, 1, None, 2, 7, 0)], "issue long, n int, chapter int, char_start int, char_end int, subject long")
    found = records.placed_facts(e.union(lone), f, s)
    assert rows_out(spark, found, "Join") <= 2000
    got = {r.issue: (r.fact_id, r.span_id) for r in found.collect()}
    assert len(got) == 903 and all(got[i] == ([5, 6, 5][i % 3], None) for i in range(900))
    assert (got[1000], got[1001], got[1002]) == ((None, 8), (None, None), (None, None))


def test_a_fact_without_an_id_is_the_subjects_all_the_same(spark):
    e = spark.createDataFrame([(1, 1, 1, 2, 7, 4)], "issue long, n int, chapter int, char_start int, char_end int, subject int")
    f = spark.createDataFrame([(None, 1, 2, 7, 4), (3, 1, 2, 7, 5)], "fact_id long, chapter int, char_start int, char_end int, character int")
    s = spark.createDataFrame([(8, 1, 2, 7)], "span_id long, chapter int, char_start int, char_end int")
    assert [tuple(r) for r in records.placed_facts(e, f, s).collect()] == [(1, 1, None, 8)]


def test_pairs_across_unknown_time_meet_no_edits(spark):
    ages = spark.range(600).selectExpr("id", "1 as book", "cast(id % 300 as int) as character", "if(id < 300, 1, 9) as chapter", "(if(id < 300, 1L, 9L)) * 4294967296 + id as pos", "id as char_start", "20D as low", "20D as high", "false as is_flashback", "false as is_speculative", "cast(null as double) as years_before")
    spans = spark.range(200).selectExpr("id", "1 as book", "5 as chapter", "5L * 4294967296 + id as pos", "if(id % 100 < 2, null, 4D) as years", "if(id % 100 < 2, 'advance', 'future') as kind", "false as is_flashback")
    change = lambda where, to: spans.where(where).selectExpr("concat('c', id) as case", "id", f"map({to}) as changes")
    edits = change("kind = 'future'", "'kind', 'advance'").union(change("id = 0", "'kind', 'future'"))
    found = whatif.span_changes(ages, spans, edits)
    assert rows_out(spark, found, "Join") < 5000 and found.count() == 0
    one = spans.where("id <> 1 and id < 100")  # one unknown span: taking it away, or years where there is none, tells
    found = whatif.span_changes(ages, one, edits.where("id = 0"))
    assert found.count() == 0 and whatif.span_changes(ages.withColumn("low", F.expr("low + if(chapter = 9, 5, 0)")).withColumn("high", F.col("low")), one, edits.where("id = 0")).where("change = 'added'").count() == 300
    assert whatif.span_changes(ages, one.where("id > 0"), edits.where("id = 9")).where("change = 'added'").count() == 300


def test_few_keys_gather_no_rows(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("call_costs", "last_relation"):
            plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_sentence_far_into_a_text(spark):
    import time

    from taleweave.functions import text

    rows = spark.range(8).select(F.concat(F.repeat(F.lit("word "), 20000), F.lit("end!tail of it! More")).alias("text"))
    began = time.time()
    got = rows.select(text.sentence_at(F.col("text"), F.lit(100009), F.lit(100011)).alias("s"), text.sentence_at(F.lit("a\nb。"), F.lit(2), F.lit(3)).alias("short")).collect()
    assert {tuple(r) for r in got} == {("tail of it", "b")} and time.time() - began < 10


def test_a_task_takes_texts_a_few_at_a_time(spark):
    import pyarrow as pa

    from taleweave.functions import text

    parts = list(text.by_size(pa.array(["x" * 500_000] * 90)))
    assert sum(map(len, parts)) == 90 and max(map(len, parts)) <= 8 and list(text.by_size(pa.array([], pa.string()))) == []
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "一句。" * 100_000) for i in range(40)], "id int, text string").coalesce(1)

    def cut(t):
        return [(0, len(t)), (1, 2)] if t else []

    got = text.with_spans(rows, ["id"], "text", cut).groupBy().agg(F.count("*"), F.countDistinct("id"), F.sum("end")).first()
    assert tuple(got) == (64, 32, 32 * 300_002)
    read = text.read_passages(rows.where("text is not null").withColumns({"start": F.lit(4), "end": F.lit(5)}))
    assert read.select("begin", "focus_start", "focus_end").distinct().count() == 1 and read.columns == ["id", "text", "start", "end", "begin", "stop", "focus_start", "focus_end"]


def test_one_chapter_of_very_many_spans(spark):
    import time

    from taleweave.operators import evaluation

    side = lambda more: spark.range(150_000).selectExpr("id", "1 as book", "1 as chapter", "id * 10 as start", f"id * 10 + if(id = 0, 900, {more}) as end")
    began = time.time()
    got = evaluation.one_to_one(side(5), side(12)).where("expected = observed").count()
    assert got == 150_000 and time.time() - began < 15


def test_texts_are_embedded_a_few_at_a_time(spark):
    import inspect

    from taleweave.operators import retrieval

    assert "by_size" in inspect.getsource(retrieval.embedded) and "mapInPandas" not in inspect.getsource(retrieval._products)
    rows = spark.createDataFrame([(1, "ab"), (2, "a"), (3, None), (4, "")], "id int, text string")
    assert {r["id"]: sum(r["vector"]) for r in retrieval.embedded(rows, "id").collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_kin_words_are_looked_up_in_a_hashed_set(spark):
    from taleweave.functions import kin

    rows = spark.createDataFrame([("父亲", "他的父亲来了"), ("三叔大人", "三叔大人走了"), ("母亲的哥哥们", "母亲的哥哥们走了"), ("大儿", "大儿"), ("哥哥", "爸爸的大哥哥"), ("父母", "父母"), (None, "x"), ("　姐姐 ", "姐姐")], "term string, quote string")
    found = rows.select("quote", kin.term_relation(F.col("term")).alias("t"), kin.stated_relation(F.col("term"), F.col("quote"), F.lit(False)).alias("s"))
    assert "INSET" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.quote: (r.t, r.s) for r in found.collect()}
    assert got["他的父亲来了"] == ("father",) * 2 and got["三叔大人走了"] == ("paternal_uncle",) * 2 and got["母亲的哥哥们走了"] == ("maternal_uncle",) * 2
    assert got["大儿"] == (None, None) and got["爸爸的大哥哥"] == ("elder_brother", None) and got["父母"] == got["x"] == (None, None) and got["姐姐"][0] == "elder_sister"
