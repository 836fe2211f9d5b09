"""Queries: clocks, character states, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave import scratch
from taleweave.catalog import query
from taleweave.operators import core, snapshots
from taleweave.operators.timeline import clock
from taleweave.plans import projections as p
from taleweave.plans.checking import BASE_SQL, spans, stage_table
from taleweave.streaming import append

_AT = """select x.*, (select count(*) from spans s where s.book = x.book and s.pos < x.pos and s.years is null) as epoch,
  (select coalesce(sum(s.years), 0.0) from spans s where s.book = x.book and s.pos < x.pos
    and s.pos > coalesce((select max(z.pos) from spans z where z.book = x.book and z.pos < x.pos and z.years is null), -1)) as story_time from {source} x"""


@query(f"with {BASE_SQL} select book, pos, epoch, story_time from ({_AT.format(source='ages')})")
def core_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch and story time just before each stated age."""
    return clock(p.statements(spark, sf_dir).where(p.IS_AGE), spans(spark, sf_dir)).select("book", "pos", "epoch", "story_time")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p.statements(spark, sf_dir).selectExpr(
        "book", "character", "chapter", "pos", "is_flashback", "is_speculative", "k % 6 as stage_order", "case when event_type = 'error' then 'appearance' else 'other' end as category",
        f"case when {p.IS_AGE} then 'absolute_age' when {p.IS_STAGE} then 'life_stage' when {p.IS_DEATH} then 'died' when {p.IS_TRAIT} then if(k % 2 = 0, 'eye_color', 'hair_color') end as attribute",
        f"case when {p.IS_AGE} then age_value end as num", f"case when {p.IS_AGE} then if(k % 3 = 0, 0.0D, age_value + k % 4) end as num_max",
        f"case when {p.IS_TRAIT} then 'c' || cast(k % 3 as string) end as trait", "k % 13 <> 0 as own_look",
    )
    rows = rows.join(F.broadcast(stage_table(spark).select("stage_order", "stage")), "stage_order")
    return rows.withColumn("text", F.coalesce("trait", F.when(F.col("attribute") == "life_stage", F.col("stage"))))


_FOLD = f"""{BASE_SQL}, said as (select * from statements where not is_flashback and not is_speculative),
aged as ({_AT.format(source=f"(select * from said where {p.IS_AGE})")}),
last_age as (select book, character, arg_max(age_value, pos) as age_low, arg_max(greatest(age_value, case when k % 3 = 0 then age_value else age_value + k % 4 end), pos) as age_high,
  arg_max(chapter, pos) as age_chapter, arg_max(epoch, pos) as age_epoch, arg_max(story_time, pos) as age_time from aged group by all),
who as (select book, character, arg_max(st.stage, pos) filter (where {p.IS_STAGE}) as life_stage,
  arg_max('c' || cast(k % 3 as varchar), pos) filter (where {p.IS_TRAIT} and k % 2 = 0 and k % 13 <> 0) as eye_color,
  arg_max('c' || cast(k % 3 as varchar), pos) filter (where {p.IS_TRAIT} and k % 2 = 1 and k % 13 <> 0) as hair_color,
  arg_min(chapter, pos) filter (where {p.IS_DEATH}) as died_chapter from said join stages st on st.stage_order = k % 6 group by all),
folded as (select who.book, who.character, age_low, age_high, age_chapter, age_epoch, age_time, life_stage, eye_color, hair_color, died_chapter from who left join last_age l on l.book = who.book and l.character = who.character)"""


@query(f"with {_FOLD} select * from folded")
def core_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each character's state after the last chapter."""
    return core.fold(facts(spark, sf_dir), spans(spark, sf_dir))


_CLOCK = """clocks as (select b.book, b.epoch, coalesce((select sum(years) from spans s where s.book = b.book and years is not null and pos > coalesce(b.begun, -1)), 0.0) as story_time
from (select book, count(*) filter (where years is null) as epoch, max(pos) filter (where years is null) as begun from spans group by book) b)"""


@query(f"with {_FOLD}, {_CLOCK} select f.book, character, age_low + story_time - age_time as low_now, age_high + story_time - age_time as high_now from folded f join clocks c on c.book = f.book and c.epoch = f.age_epoch where age_low is not null")
def projected_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages at the book's present, where its epoch allows."""
    return core.projected_ages(core_fold(spark, sf_dir), core.book_clock(spans(spark, sf_dir)))


@query(f"""with {p.STATEMENTS_SQL}, snaps as (select book, chapter, count(*) as n_facts, max(pos) as last_pos from statements where chapter % 3 <> 0 group by all),
asked as (select distinct book, chapter as n from statements)
select a.book, a.n, arg_max(s.chapter, s.chapter) as chapter, arg_max(n_facts, s.chapter) as n_facts, arg_max(last_pos, s.chapter) as last_pos from asked a join snaps s on s.book = a.book and s.chapter < a.n group by all""")
def core_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot before each chapter."""
    s = p.statements(spark, sf_dir)
    snaps = s.where("chapter % 3 <> 0").groupBy("book", "chapter").agg(F.count("*").alias("n_facts"), F.max("pos").alias("last_pos"))
    return core.as_of(snaps, s.select("book", F.col("chapter").alias("n")).distinct(), before=True)


@query(f"""with {p.STATEMENTS_SQL}, old as (select book, row_number() over (partition by book order by pos) as seq from statements where event_type = 'signup')
select s.book, s.pos, coalesce((select max(seq) from old o where o.book = s.book), 0) + row_number() over (partition by s.book order by pos) as seq from statements s where event_type = 'error'""")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of new log entries after the stored ones."""
    s = p.statements(spark, sf_dir)
    none = s.where("event_type = 'signup'").select("book", "pos")
    stored = core.numbered(none.select("book").withColumn("seq", F.lit(0)).limit(0), none, ["pos"])
    return core.numbered(stored, s.where("event_type = 'error'").select("book", "pos"), ["pos"])


_LOG = [
    "book", "pos as seq", "case when event_type = 'signup' and k % 16 <> 3 then 'create' when k % 5 = 0 then 'promote' when k % 4 = 1 then 'rename' when k % 4 = 2 then 'alias' when k % 16 = 3 and character >= 15 then 'merge' else 'alias' end as kind",
    "character", "case when event_type <> 'signup' and k % 5 = 0 then 'k' || cast(k % 3 as varchar(9)) else 'n' || cast(k % 30 as varchar(9)) end as name",
    "character - 5 * (1 + k % 3) as into", "chapter", "case when k % 10 = 0 then 'user' else 'extracted' end as source",
]


@query(f"""with recursive {p.STATEMENTS_SQL}, log as (select {', '.join(_LOG)} from statements where event_type in ('signup', 'error')),
kept as (select * from log where source = 'user' or chapter < 4),
state as (select book, character, arg_max(name, seq) filter (where kind in ('create', 'rename')) as name, bool_or(kind = 'create') as made, arg_max("into", seq) filter (where kind = 'merge') as target,
  coalesce(arg_max(name, seq) filter (where kind = 'promote'), 'minor') as kind from kept group by all),
walk as (select book, character, target as at from state where target is not null union all select w.book, w.character, s.target from walk w join state s on s.book = w.book and s.character = w.at where s.target is not null),
roots as (select w.* from walk w join state s on s.book = w.book and s.character = w.at where s.target is null union all select w.* from walk w where not exists (select 1 from state s where s.book = w.book and s.character = w.at)),
given as (select distinct k.book, coalesce(r.at, k.character) as character, k.name from kept k left join roots r on r.book = k.book and r.character = k.character where k.kind = 'alias' or (k.kind in ('create', 'rename') and r.at is not null))
select s.book, s.character, s.name, coalesce((select list_sort(list(g.name)) from given g where g.book = s.book and g.character = s.character and g.name <> s.name), []) as aliases, s.kind from state s where made and target is null""")
def replayed_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters after undoing the log from chapter 4 on; merged ones leave their names."""
    log = p.statements(spark, sf_dir).where("event_type in ('signup', 'error')").selectExpr(*_LOG)
    return core.replay(log, 4, kinds=True)


@query(f"""with {p.STATEMENTS_SQL} select 'facts' as kept, count(*) as n from statements where {p.IS_AGE} and chapter < 4 union all select 'spans', count(*) from statements where {p.IS_SPAN} and chapter < 4
union all select 'events', count(*) from statements where event_type in ('signup', 'error') and (chapter < 4 or k % 10 = 0)""")
def state_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when a book is read again from chapter 4 on."""
    s = p.statements(spark, sf_dir)
    left = core.reset_from(s.where(p.IS_AGE), s.where(p.IS_SPAN), s.where("event_type in ('signup', 'error')").selectExpr(*_LOG), 4)
    out = None
    for name, rows in zip(("facts", "spans", "events"), left):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_ASKED = "chapter % 5 = 2"


def _fold_to(n: str) -> str:
    """The fold's SQL over the chapters to each asked one, with (book, n) in the place of the book."""
    return _FOLD.replace("select * from statements", "select * from asked_statements").replace(f"{BASE_SQL}, said", f"""{BASE_SQL},
asked as (select distinct book, chapter as n from statements where {_ASKED}),
asked_statements as (select s.* replace (s.book * 1000 + a.n as book) from statements s join asked a on a.book = s.book and s.chapter <= a.n), said""").replace("from spans s", "from asked_spans s").replace("from spans z", "from asked_spans z").replace("asked_statements as (", "asked_spans as (select s.* replace (s.book * 1000 + a.n as book) from spans s join asked a on a.book = s.book),\nasked_statements as (")


@query(f"""with {_fold_to('n')}, marks as (select book, max(pos) as begun, count(*) as epoch from (select a.* from asked_spans a join asked k on k.book * 1000 + k.n = a.book where a.years is null and floor(a.pos / 4294967296) <= k.n) group by book),
now as (select k.book * 1000 + k.n as book, coalesce(any_value(m.epoch), 0) as epoch, coalesce(sum(s.years) filter (where s.pos > coalesce(m.begun, -1)), 0.0) as story_time from asked k left join marks m on m.book = k.book * 1000 + k.n
  left join asked_spans s on s.book = k.book * 1000 + k.n and floor(s.pos / 4294967296) <= k.n group by k.book, k.n)
select f.book // 1000 as book, f.book % 1000 as n, f.* exclude (book), case when age_epoch = epoch then age_low + story_time - age_time end as low_now, case when age_epoch = epoch then age_high + story_time - age_time end as high_now from folded f join now using (book)""")
def core_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each character's state and age after every fifth chapter, from kept runs and the last run's chapters."""
    own, years = scratch.stored(facts(spark, sf_dir), "facts"), spans(spark, sf_dir)
    asked = p.statements(spark, sf_dir).where(_ASKED).select("book", F.col("chapter").alias("n")).distinct()
    return snapshots.ages_after(snapshots.summarised(own, years), own, years, asked)


@query(f"with {_FOLD} select * from folded")
def streamed_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold kept by a stream whose chapters come in no order (2.11, D5)."""
    folder = scratch.new_folder(spark, "chapters")
    own = facts(spark, sf_dir).select("book", "character", "chapter", "pos", "is_flashback", "is_speculative", "category", "attribute", "num", "num_max", "text", "own_look", F.lit(False).alias("is_span"), F.lit(None).cast("double").alias("years"))
    rows = own.unionByName(spans(spark, sf_dir).withColumn("is_span", F.lit(True)), allowMissingColumns=True)
    rows.repartition(6, F.xxhash64("book", "chapter")).write.parquet(f"{folder}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    runs = append.run_core(append.arriving(spark, f"{folder}/in", "*.parquet", schema, 2), f"{folder}/core", f"{folder}/checkpoint")
    return snapshots.state_now(runs)
