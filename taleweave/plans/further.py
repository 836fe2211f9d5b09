"""Queries: merges, anchors, contexts, caps and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.catalog import query
from taleweave.functions import text
from taleweave.operators import core, evaluation, records
from taleweave.plans import projections as p
from taleweave.plans.checking import BASE_SQL, ages, spans
from taleweave.plans.projections import table
from taleweave.plans.state import _FOLD, facts


@query(f"""with {p.STATEMENTS_SQL}, m as (select user_id as from_id, min(user_id % 40) as into_id from events where event_type = 'signup' and event_id % 3 = 0 group by 1)
select s.pos, s.book, coalesce(m.into_id, s.character) as character from statements s left join m on m.from_id = s.character""")
def merged_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts moved to the character that theirs was merged into."""
    s = p.statements(spark, sf_dir)
    m = s.where("event_type = 'signup' and char_start % 3 = 0").groupBy(F.col("character").alias("from_id")).agg(F.min(F.col("character") % 40).alias("into_id"))
    return s.join(m, F.col("from_id") == F.col("character"), "left").select("pos", "book", F.coalesce("into_id", "character").alias("character"))


@query(f"with {p.CHAPTERS_SQL} select d.doc_id as passage, c.number as chapter from documents d left join (select doc_id, number from chapters where number > 3) c using (doc_id)")
def passages_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with their chapters' present numbers."""
    numbers = p.chapter_numbers(spark, sf_dir).where("number > 3").select("doc_id", "number")
    return table(spark, sf_dir, "documents").select("doc_id").join(numbers, "doc_id", "left").select(F.col("doc_id").alias("passage"), F.col("number").alias("chapter"))


@query("""with q as (select unnest([1, 2, 3]) as n), f as (select doc_id, n, string_split(text, 'the ') as parts from documents, q where text is not null)
select doc_id, n, case when len(parts) > n then length(array_to_string(list_slice(parts, 1, n), 'the ')) when len(parts) > 1 then length(parts[1]) end as at_start from f""")
def quote_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each further use of one quote, from the start again when there are no more."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n"))
    place = lambda n: F.length(F.expr(f"substring_index(text, 'the ', {n})"))
    times = F.size(F.split("text", "the ", -1)) - 1
    return d.select("doc_id", "n", F.when(times >= F.col("n"), place("n")).when(times > 0, place("1")).cast("bigint").alias("at_start"))


@query("""with k as (select l_returnflag as book, l_suppkey % 30 as a, l_partkey % 30 as b, l_orderkey as pos, l_linenumber % 7 as relation, l_partkey * 1000000 + l_suppkey as tie from lineitem)
select book, a, b, max(pos) as pos, arg_max(relation, pos * 100000000000 + tie % 100000000000) as relation from k join (select book as b2, max(pos) as last from k group by 1) m on m.b2 = k.book where pos < last group by book, a, b""")
def last_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last statement about each pair before a point."""
    k = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as book", "l_suppkey % 30 as a", "l_partkey % 30 as b", "l_orderkey as pos", "l_linenumber % 7 as relation", "l_partkey * 1000000 + l_suppkey as tie")
    last = k.groupBy("book").agg(F.max("pos").alias("last"))
    return core.last_before(k.join(F.broadcast(last), "book").where("pos < last"), ["book", "a", "b"], "relation", F.expr("pos * 100000000000 + tie % 100000000000"))


@query(f"""with {p.STATEMENTS_SQL}, d as (select book, character, min(pos) as died from statements where {p.IS_DEATH} and not is_speculative group by all)
select s.book, s.character, count(*) as alive from statements s left join d on d.book = s.book and d.character = s.character where died is null or s.pos < died group by all""")
def alive_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places before each character's first certain death."""
    s = p.statements(spark, sf_dir)
    d = s.where(p.IS_DEATH).where("not is_speculative").groupBy("book", "character").agg(F.min("pos").alias("died"))
    return s.join(d, ["book", "character"], "left").where("died is null or pos < died").groupBy("book", "character").agg(F.count("*").alias("alive"))


@query(f"""with {BASE_SQL}, exact as (select * from ages where low = high and low between 1 and 60 and not is_flashback and not is_speculative),
nxt as (select book, character, pos, lead(pos) over (partition by book, character order by pos) as other from ages where not is_flashback and not is_speculative)
select e.book, e.character, e.pos, e.low from exact e where not exists (select 1 from nxt n join ages b on b.pos = n.other and b.book = n.book where n.book = e.book and n.pos = e.pos and b.high < e.low)""")
def usable_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact present ages that don't begin a step back."""
    from pyspark.sql.window import Window

    a = ages(spark, sf_dir).where("not is_flashback and not is_speculative")
    back = a.withColumn("next_high", F.lead("high").over(Window.partitionBy("book", "character").orderBy("pos"))).where("next_high < low").select("book", "pos")
    return a.where("low = high and low between 1 and 60").join(back, ["book", "pos"], "left_anti").select("book", "character", "pos", "low")


@query("select c_nationkey as book, count(*) as items, count(*) > 40 as too_many from customer group by 1")
def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that a tool refuses as too long."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("book")).agg(F.count("*").alias("items"), (F.count("*") > 40).alias("too_many"))


@query("select doc_id, case when length(text) > 4000 then substr(text, 1, 4000) || '…(' || length(text) || ')' else text end as shown from documents")
def cut_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results cut with a note of their length (O9); the limit is the feature."""
    long = F.concat(F.substring("text", 1, 4000), F.lit("…("), F.length("text").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") > 4000, long).otherwise(F.col("text")).alias("shown"))


#: category, attribute -> how a fact may change (fixed values).
CHANGE_RULES = [("age", "absolute_age", "temporal"), ("age", "life_stage", "temporal"), ("appearance", "eye_color", "fixed"), ("appearance", "hair_color", "fixed"), ("appearance", "mark", "fixed"), ("kinship", "father", "fixed"), ("life", "died", "monotonic"), ("life", "present", "mutable")]


@query(f"with {p.STATEMENTS_SQL} select case when {p.IS_AGE} then 'temporal' when {p.IS_STAGE} then 'temporal' when {p.IS_TRAIT} then 'fixed' when {p.IS_DEATH} then 'monotonic' end as rule, count(*) as n from statements where ({p.IS_AGE}) or ({p.IS_STAGE}) or ({p.IS_TRAIT}) or ({p.IS_DEATH}) group by 1")
def change_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by the rule of their category and attribute; an unknown pair is an error."""
    rules = spark.createDataFrame(CHANGE_RULES, "category string, attribute string, rule string")
    category = "case when attribute in ('absolute_age', 'life_stage') then 'age' when attribute = 'died' then 'life' else category end as category"
    rows = facts(spark, sf_dir).where("attribute is not null").selectExpr(category, "attribute")
    return records.rules_of(rows, rules).groupBy("rule").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, l_partkey, abs(l_discount - l_tax) <= 0.01 + 1e-9 and (l_returnflag is not distinct from case when l_linestatus = 'F' then 'A' end) as same from lineitem")
def tolerant_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values alike within a hundredth, flags alike with nulls."""
    same = (F.abs(F.col("l_discount") - F.col("l_tax")) <= 0.01 + 1e-9) & F.col("l_returnflag").eqNullSafe(F.when(F.col("l_linestatus") == "F", "A"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", same.alias("same"))

@query("with e as (select d.doc_id, text, greatest(0, doc_id % 700 - 220) as a, least(length(text), doc_id % 700 + 240) as b from documents d) select doc_id, substr(text, (a + 1)::bigint, greatest(b - a, 0)::bigint) as context from e")
def review_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around a place, for reading a report."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "cast(greatest(0, doc_id % 700 - 220) as int) as a", "cast(least(length(text), doc_id % 700 + 240) as int) as b")
    return d.select("doc_id", F.expr("substring(text, a + 1, greatest(b - a, 0))").alias("context"))


@query("with " + _FOLD.replace("said as (select * from statements where", "said as (select * from statements where chapter <= 3 and") + " select book, character, age_low, life_stage, eye_color, hair_color, died_chapter from folded")
def character_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters as known at the end of a chapter."""
    upto = facts(spark, sf_dir).where("chapter <= 3")
    return core.fold(upto, spans(spark, sf_dir)).select("book", "character", "age_low", "life_stage", "eye_color", "hair_color", "died_chapter")


@query(f"with {p.STATEMENTS_SQL} select pos, '第 ' || chapter || ' 章：' || case when age_value = floor(age_value) then cast(cast(age_value as bigint) as varchar) else cast(age_value as varchar) end || ' 岁' as phrase from statements where {p.IS_AGE}")
def described_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages as phrases."""
    a = p.statements(spark, sf_dir).where(p.IS_AGE)
    return a.select("pos", F.concat(F.lit("第 "), F.col("chapter").cast("string"), F.lit(" 章："), text.years_text(F.col("age_value")), F.lit(" 岁")).alias("phrase"))


@query("""with e as (select l_suppkey % 7 as "group", l_orderkey as "case", l_partkey % 500 as start, l_partkey % 500 + 20 as "end" from lineitem where l_linenumber = 1), o as (select l_orderkey as "case", l_partkey % 500 - l_linenumber + 2 as a, l_partkey % 500 + 20 + l_suppkey % 3 as b from lineitem where l_linenumber in (1, 2)),
x as (select "group", e."case", start, "end", max((a < "end" and start < b)::int) as touched, max((a <= start and "end" <= b)::int) as found, max((a = start and "end" = b)::int) as exact from e left join o on o."case" = e."case" group by all)
select "group", count(*) as notes, sum(coalesce(found, 0))::bigint as found, sum(coalesce(exact, 0))::bigint as exact, sum(coalesce(touched, 0))::bigint as touched from x group by 1""")
def note_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written notes found, exact and touched, by group."""
    rows = table(spark, sf_dir, "lineitem")
    e = rows.where("l_linenumber = 1").selectExpr("l_suppkey % 7 as group", "l_orderkey as case", "l_partkey % 500 as start", "l_partkey % 500 + 20 as `end`")
    o = rows.where("l_linenumber in (1, 2)").selectExpr("l_orderkey as case", "l_partkey % 500 - l_linenumber + 2 as start", "l_partkey % 500 + 20 + l_suppkey % 3 as `end`")
    return evaluation.note_scores(e, o)


@query(f"""with {p.CHAPTERS_SQL}, r as (select doc_id, unnest([0, 30]) as a, unnest([12, 45]) as b from documents)
select c.book, c.number, r.a as start, substr(content, (r.a + 1)::bigint, (r.b - r.a)::bigint) as note from chapters c join r using (doc_id) where length(content) > 50""")
def note_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author's notes with their text, from each chapter's ranges."""
    ranges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 12), (30, 45))])
    notes = table(spark, sf_dir, "documents").select("doc_id", F.explode(ranges).alias("r")).select("doc_id", "r.*")
    rows = p.chapters(spark, sf_dir).where("length(content) > 50").join(notes, "doc_id")
    return rows.select("book", "number", F.col("a").alias("start"), F.expr("substring(content, a + 1, b - a)").alias("note"))


@query("""with t as (select l_suppkey as who, l_partkey % 6 as trait, max(l_orderkey) as v from lineitem where l_linenumber = 1 group by all), s as (select l_suppkey as who, l_partkey % 6 as trait, max(l_orderkey) as v from lineitem where l_linenumber = 2 group by all)
select coalesce(t.who, s.who) as who, coalesce(t.trait, s.trait) as trait, coalesce(t.v, s.v) as v from t full join s on s.who = t.who and s.trait = t.trait""")
def merged_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trait maps of a merged pair of characters, the target's values first (U8)."""
    rows = table(spark, sf_dir, "lineitem")
    side = lambda w, n: rows.where(w).groupBy(F.col("l_suppkey").alias("who"), (F.col("l_partkey") % 6).alias("trait")).agg(F.max("l_orderkey").alias(n))
    both = side("l_linenumber = 1", "t").join(side("l_linenumber = 2", "s"), ["who", "trait"], "full_outer")
    return both.select("who", "trait", F.coalesce("t", "s").alias("v"))


@query("select doc_id, len(list_filter(string_split(text, ' '), lambda w: w in ('thereon', 'the'))) as uses from documents where contains(text, 'thereon') or contains(text, 'ation the ')")
def retokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only passages that contain a new name have their tokens cut again."""
    touched = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("thereon")) | F.contains("text", F.lit("ation the ")))
    return touched.select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: w.isin("thereon", "the"))).cast("bigint").alias("uses"))


@query("select l_orderkey as issue, count(*) as verdicts, arg_max(l_returnflag, l_linenumber * 100000000000 + l_partkey * 10000 + l_suppkey) as latest from lineitem group by 1")
def verdict_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts are only appended; the latest of each issue counts."""
    order = F.col("l_linenumber") * 100000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("issue")).agg(F.count("*").alias("verdicts"), F.max_by("l_returnflag", order).alias("latest"))


@query("""with i as (select o_orderkey as id, [o_custkey % 20, o_custkey % 13] as subjects from orders), c as (select 'golden' as source, id, subjects from i where id % 3 = 0 union all select 'injected', id, subjects from i where id % 7 = 0)
select source, id, list_has_any(subjects, [3::bigint, 5, 7]) as ours from c""")
def verdict_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of several sources, and whether they name our characters."""
    i = table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "array(o_custkey % 20, o_custkey % 13) as subjects")
    cases = i.where("id % 3 = 0").withColumn("source", F.lit("golden")).unionByName(i.where("id % 7 = 0").withColumn("source", F.lit("injected")))
    return cases.select("source", "id", F.arrays_overlap("subjects", F.array(*[F.lit(x).cast("bigint") for x in (3, 5, 7)])).alias("ours"))
