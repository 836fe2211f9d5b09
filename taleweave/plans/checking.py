"""Queries: the consistency checks over the supplied events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.catalog import query
from taleweave.functions.kin import RELATIONS
from taleweave.operators import checks
from taleweave.plans import projections as p


def stage_table(spark: SparkSession) -> DataFrame:
    rows = [(i, name, low, high) for i, (name, low, high) in enumerate(p.STAGES)]
    return spark.createDataFrame(rows, "stage_order int, stage string, stage_low double, stage_high double")


STAGES_SQL = "stages as (select * from (values " + ", ".join(f"({i}, '{n}', {lo}, {'null' if hi is None else hi})" for i, (n, lo, hi) in enumerate(p.STAGES)) + ") t(stage_order, stage, stage_low, stage_high))"


def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.statements(spark, sf_dir).where(p.IS_AGE).withColumns({"low": F.col("age_value"), "high": F.when(F.col("k") % 7 == 0, F.col("age_value") + 2).otherwise(F.col("age_value"))})


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.statements(spark, sf_dir).where(p.IS_SPAN).where("not is_flashback").selectExpr("book", "chapter", "pos", f"{p.SPAN_YEARS} as years")


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p.statements(spark, sf_dir).where(p.IS_STAGE).withColumn("stage_order", (F.col("k") % 6).cast("int"))
    return rows.join(F.broadcast(stage_table(spark)), "stage_order")


BASE_SQL = f"""{p.STATEMENTS_SQL},
spans as (select book, pos, {p.SPAN_YEARS} as years from statements where {p.IS_SPAN} and not is_flashback),
ages as (select *, age_value as low, case when k % 7 = 0 then age_value + 2 else age_value end as high from statements where {p.IS_AGE}),
{STAGES_SQL},
staged as (select s.*, t.* from statements s join stages t on t.stage_order = s.k % 6 where {p.IS_STAGE})"""
#: A statement's offset and, by plain scalar subqueries, what spans lie before it.
_SAID = """select *, case when not is_flashback then 0.0 else years_before end as off,
  (select coalesce(sum(coalesce(years, 0)), 0) from spans s where s.book = x.book and s.pos < x.pos) as y_lt,
  (select coalesce(sum(coalesce(years, 0)), 0) from spans s where s.book = x.book and s.pos <= x.pos) as y_le,
  (select count(*) from spans s where s.book = x.book and s.pos < x.pos and years is null) as z_lt,
  (select count(*) from spans s where s.book = x.book and s.pos <= x.pos and years is null) as z_le,
  (select count(*) from spans s where s.book = x.book and s.pos < x.pos) as c_lt,
  (select count(*) from spans s where s.book = x.book and s.pos <= x.pos) as c_le
  from {source} x where not is_speculative and (not is_flashback or years_before is not null)"""
_PAIRS = f"""pairs as (select *, lag(pos) over w as a_pos, lag(chapter) over w as a_chapter, lag(low) over w as a_low, lag(high) over w as a_high,
  lag(is_flashback) over w as a_flash, lag(off) over w as a_off, lag(y_le) over w as a_y, lag(z_le) over w as a_z, lag(c_le) over w as a_c
  from ({_SAID.format(source="ages")}) window w as (partition by book, character order by pos, char_start)),
gaps as (select *, case when z_lt - a_z > 0 then null else y_lt - a_y - off + a_off end as gap from pairs where a_pos is not null),
judged as (select *, case when gap is not null then greatest(0.0, low - (a_high + gap), (a_low + gap) - high) end as mismatch from gaps),
issues as (select book, character, a_pos, pos as b_pos, a_chapter, chapter as b_chapter, a_low, a_high, low as b_low, high as b_high, gap, mismatch,
  case when not a_flash and not is_flashback and high < a_low then 'confirmed' when mismatch > 1.0 then 'suspected_review' end as confidence, c_lt - a_c as spans_between from judged)"""


@query(f"with {BASE_SQL}, {_PAIRS} select * from issues where confidence is not null")
def age_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring stated ages that the story's time doesn't explain."""
    return checks.age_pairs(ages(spark, sf_dir), spans(spark, sf_dir))


@query(f"""with {BASE_SQL}, said_age as ({_SAID.format(source="ages")}), said_stage as ({_SAID.format(source="staged")}),
early as (select s.book, s.character, s.pos, max(a.pos) as ref_pos from said_stage s join said_age a on a.book = s.book and a.character = s.character and a.pos < s.pos group by all),
firsts as (select book, character, min(pos) as first_pos from said_age group by all),
refs as (select s.*, coalesce(e.ref_pos, f.first_pos) as rp from said_stage s join firsts f using (book, character) left join early e using (book, character, pos)),
shifted as (select r.book, r.character, r.pos, r.stage, r.stage_low, r.stage_high, a.pos as ref_pos, a.low, a.high,
  case when a.pos <= r.pos then case when r.z_lt - a.z_le > 0 then null else r.y_lt - a.y_le - r.off + a.off end
       else -(case when a.z_lt - r.z_le > 0 then null else a.y_lt - r.y_le - a.off + r.off end) end as shift
  from refs r join said_age a on a.book = r.book and a.character = r.character and a.pos = r.rp)
select book, character, pos, stage, ref_pos, low + shift as expected_low, high + shift as expected_high from shifted
where shift is not null and greatest(0.0, stage_low - (high + shift), coalesce((low + shift) - stage_high, 0.0)) > 1.0""")
def age_life_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life stages against the nearest earlier stated age, else the first."""
    return checks.life_stages(stages(spark, sf_dir), ages(spark, sf_dir), spans(spark, sf_dir))


_FEW = "character % 7 <> 0"


@query(f"""with {BASE_SQL}, ok as (select * from staged where not is_speculative and (not is_flashback or years_before is not null)),
aged as (select distinct book, character from ages where {_FEW} and not is_speculative and (not is_flashback or years_before is not null)),
pairs as (select *, lag(pos) over w as a_pos, lag(stage) over w as a_stage, lag(stage_order) over w as a_order, lag(stage_low) over w as a_stage_low, lag(is_flashback) over w as a_flash
  from ok where (book, character) not in (select (book, character) from aged) window w as (partition by book, character order by pos, char_start))
select book, character, a_pos, pos as b_pos, a_stage, stage as b_stage from pairs where a_pos is not null and not a_flash and not is_flashback and stage_high < a_stage_low and stage_order < a_order""")
def age_stage_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps back in life stage of characters without a stated age."""
    return checks.stage_regressions(stages(spark, sf_dir), ages(spark, sf_dir).where(_FEW))


_KEYED = ["pos", "char_end", "event_type", "age_order", "character"]
_QUOTE = "event_type || ' ' || cast(k % 10 as string)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = p.statements(spark, sf_dir).where(f"{p.IS_AGE} or {p.IS_STAGE}")
    facts = facts.selectExpr("*", f"{_QUOTE} as quote", "'#' || cast(chapter as string) as chapter_key", "case when age_value = 0 then -1.0 else age_value end as age_order")
    return checks.content_keys(facts, _KEYED)


_KEYED_SQL = f"""keyed as (select *, chapter_key || '|' || quote || '|' || cast(row_number() over (partition by book, chapter_key, quote order by pos, char_end, event_type, age_order, character) - 1 as varchar) as key
from (select *, {_QUOTE.replace("as string", "as varchar")} as quote, '#' || cast(chapter as varchar) as chapter_key, case when age_value = 0 then -1.0 else age_value end as age_order
from statements where ({p.IS_AGE}) or ({p.IS_STAGE})))"""


@query(f"with {p.STATEMENTS_SQL}, {_KEYED_SQL} select book, pos, key from keyed")
def fact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content keys: chapter, quote and which use of it."""
    return keyed(spark, sf_dir).select("book", "pos", "key")


@query(f"""with {BASE_SQL}, {_PAIRS}, {_KEYED_SQL}
select i.book, i.character, i.confidence, substr(sha256('age_arithmetic|' || least(a.key, b.key) || '|' || greatest(a.key, b.key)), 1, 32) as fingerprint,
  (select count(*) + 2 from spans s where s.book = i.book and s.pos > i.a_pos and s.pos < i.b_pos) as n_evidence,
  '第 ' || cast(i.a_chapter as varchar) || ' 章为 ' || cast(cast(i.a_low as bigint) as varchar) || ' 岁，第 ' || cast(i.b_chapter as varchar) || ' 章为 ' || cast(cast(i.b_low as bigint) as varchar) || ' 岁' as description
from issues i join keyed a on a.book = i.book and a.pos = i.a_pos join keyed b on b.book = i.book and b.pos = i.b_pos where confidence is not null""")
def age_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age check's issues with fingerprint, evidence and description (W7, X25, 4.3)."""
    keys = keyed(spark, sf_dir).select("book", "pos", "key")
    found = checks.age_pairs(ages(spark, sf_dir), spans(spark, sf_dir))
    for side in "ab":
        found = found.join(keys.select("book", F.col("pos").alias(f"{side}_pos"), F.col("key").alias(f"{side}_key")), ["book", f"{side}_pos"])
    rows = found
    where = lambda x: F.concat(F.lit("第 "), F.col(f"{x}_chapter").cast("string"), F.lit(" 章为 "), F.col(f"{x}_low").cast("bigint").cast("string"), F.lit(" 岁"))
    return rows.select(
        "book", "character", "confidence", checks.fingerprint(F.lit("age_arithmetic"), F.col("a_key"), F.col("b_key")).alias("fingerprint"),
        (F.col("spans_between") + 2).alias("n_evidence"), F.concat(where("a"), F.lit("，"), where("b")).alias("description"),
    )


@query(f"""with {p.STATEMENTS_SQL}, said as (select *, case when k % 2 = 0 then 'eye_color' else 'hair_color' end as "group", 'c' || cast(k % 3 as varchar) as value from statements
where {p.IS_TRAIT} and not is_flashback and not is_speculative and k % 13 <> 0 and k % 17 <> 0),
pairs as (select *, lag(value) over w as a_value, lag(pos) over w as a_pos from said window w as (partition by book, character, "group" order by pos, char_start))
select book, character, "group", a_pos, pos as b_pos, a_value, value as b_value from pairs where a_value <> value""")
def appearance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks that change between neighbouring statements."""
    traits = p.statements(spark, sf_dir).where(p.IS_TRAIT).selectExpr("*", "case when k % 2 = 0 then 'eye_color' else 'hair_color' end as `group`", "'c' || cast(k % 3 as string) as value", "k % 13 = 0 as disguised", "if(k % 17 = 0, true, null) as temporary")
    return checks.appearance(traits)


_KIN_LIST = ["father", "son", "elder_brother", "brother", "paternal_uncle", "tang_cousin", "biao_cousin"]
_KIN_CASE = "case l_linenumber % 7 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(_KIN_LIST)) + " end"
_KIN = ["l_returnflag as book", "l_suppkey % 30 as person", "l_partkey % 30 as other", f"{_KIN_CASE} as relation", "l_orderkey * 8 + l_linenumber as pos", "l_partkey * 1000000 + l_suppkey as tie", "l_linenumber = 3 as address", "l_partkey % 11 = 0 as is_speculative"]


def relation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "relation string, label string, generations int, link string, side string, sex_a string, sex_b string, a_older boolean")


_sql = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
RELATIONS_SQL = "relations as (select * from (values " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in RELATIONS) + ") t(relation, label, generations, link, side, sex_a, sex_b, a_older))"


@query(f"""with {RELATIONS_SQL}, said as (select {', '.join(_KIN)} from lineitem),
turned as (select book, pos, tie, address, s.relation, link, side, cast(person as varchar) > cast(other as varchar) as sw, person, other, generations, sex_a, sex_b, a_older
  from said s join relations r on r.relation = s.relation where not is_speculative and person <> other),
one as (select book, pos, tie, address, relation, link, side, case when sw then other else person end as first, case when sw then person else other end as second,
  case when sw then -generations else generations end as g, case when sw then sex_b else sex_a end as xa, case when sw then sex_a else sex_b end as xb, case when sw then not a_older else a_older end as o from turned),
pairs as (select *, lag(pos) over w as a_pos, lag(relation) over w as a_relation, lag(address) over w as aa, lag(g) over w as ag, lag(link) over w as al, lag(side) over w as aside, lag(xa) over w as axa, lag(xb) over w as axb, lag(o) over w as ao
  from one window w as (partition by book, first, second order by pos, tie)),
why as (select *, case when ag <> g then 'generation' when al <> link then 'link' when aside <> side then case when al = 'cousin' then 'cousin_kind' else 'side' end
  when axa <> xa then 'sex' when axb <> xb then 'sex' when ao <> o then 'age_order' end as reason from pairs where a_pos is not null)
select book, first, second, a_pos, pos as b_pos, a_relation, relation as b_relation, reason from why
where reason is not null and not ((aa or address) and (reason = 'cousin_kind' or (reason = 'link' and ag = 0)))""")
def kinship_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinship statements about a pair that contradict the one before."""
    return checks.kinship(p.table(spark, sf_dir, "lineitem").selectExpr(*_KIN), relation_table(spark))


@query(f"""with {p.STATEMENTS_SQL}, died as (select book, character, min(pos) as death_pos, arg_min(chapter, pos) as death_chapter from statements where {p.IS_DEATH} and not is_speculative group by all)
select d.book, d.character, death_pos, min(s.pos) as seen_pos from died d join statements s on s.book = d.book and s.character = d.character and {p.IS_PRESENCE} and s.chapter > d.death_chapter group by all""")
def revival_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters who appear in a chapter after their death."""
    s = p.statements(spark, sf_dir)
    return checks.revivals(s.where(p.IS_DEATH), s.where(p.IS_PRESENCE))


_STORED = "l_orderkey % 5 <> 4"


@query("""with base as (select l_returnflag as book, md5(cast(l_orderkey as varchar)) as fingerprint, l_orderkey, case when l_orderkey % 2 = 0 then 'age_arithmetic' else 'character_facts' end as checker,
  min(l_linenumber) as c1, max(l_partkey % 40) as c2 from lineitem group by all),
stored as (select *, case l_orderkey % 4 when 0 then 'open' when 1 then 'acknowledged' when 2 then 'intentional' else 'resolved' end as status, case when l_orderkey % 4 = 3 and l_orderkey % 3 = 0 then 'acknowledged' end as resolved_from from base where l_orderkey % 5 <> 4),
found as (select *, case when l_orderkey % 7 = 0 then 'confirmed' else 'suspected_review' end as conf from base where l_orderkey % 3 <> 1 and checker = 'age_arithmetic'),
j as (select coalesce(s.book, f.book) as book, coalesce(s.fingerprint, f.fingerprint) as fingerprint, coalesce(f.checker, s.checker) as checker, s.status as st, s.resolved_from as rf, f.checker is not null as hit, f.conf, s.checker = 'age_arithmetic' as mine,
  s.c1 in (3) or s.c2 in (3) as kept from stored s full join found f on f.book = s.book and f.fingerprint = s.fingerprint)
select book, fingerprint, checker,
  case when st is null then 'open' when hit and st = 'resolved' then coalesce(rf, 'open') when not hit and mine and st in ('open', 'acknowledged') and not kept then 'resolved' else st end as status,
  case when st is null then null when hit and st = 'resolved' then null when not hit and mine and st in ('open', 'acknowledged') and not kept then st else rf end as resolved_from,
  coalesce(conf, 'suspected_review') as confidence,
  case when st is null then 'new' when hit and st = 'resolved' then 'reopened' when hit then 'again' when mine and st in ('open', 'acknowledged') then case when kept then 'kept' else 'resolved' end else 'untouched' end as action
from j""")
def issue_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issue table merged with a run's findings."""
    base = p.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as book", "l_orderkey", "l_linenumber", "l_partkey % 40 as part")
    base = base.groupBy("book", "l_orderkey").agg(F.min("l_linenumber").alias("c1"), F.max("part").alias("c2"))
    base = base.selectExpr("book", "l_orderkey", "md5(cast(l_orderkey as string)) as fingerprint", "if(l_orderkey % 2 = 0, 'age_arithmetic', 'character_facts') as checker", "array(cast(c1 as bigint), c2) as chapters")
    stored = base.where(_STORED).selectExpr("*", "element_at(array('open', 'acknowledged', 'intentional', 'resolved'), cast(l_orderkey % 4 + 1 as int)) as status", "if(l_orderkey % 4 = 3 and l_orderkey % 3 = 0, 'acknowledged', null) as resolved_from", "'suspected_review' as confidence").drop("l_orderkey")
    found = base.where("l_orderkey % 3 <> 1").selectExpr("*", "if(l_orderkey % 7 = 0, 'confirmed', 'suspected_review') as confidence").drop("l_orderkey")
    missing = spark.createDataFrame([(b, 3) for b in "ANR"], "book string, chapter bigint")
    return checks.sync(stored, found, missing, ["age_arithmetic"])
