"""Queries: ledgers, agent runs and evaluation over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.catalog import query
from taleweave.operators import evaluation as ev
from taleweave.operators import ledger
from taleweave.plans import projections as p
from taleweave.plans.projections import table

#: USD per million tokens (fixed values): model, input, cached input, output.
PRICES = [("deepseek-flash", 0.30, 0.006, 1.20), ("deepseek-v4-pro", 1.32, 0.044, 3.96)]
_CALLS = ["l_returnflag as purpose", "l_linestatus as model", "l_linenumber = 1 as cache_hit", "cast(l_quantity as bigint) as tokens_in", "l_linenumber as tokens_out", "cast(l_extendedprice as decimal(18,6)) as cost"]
_SUMS = "count(*) as calls, count(*) filter (where l_linenumber = 1) as cache_hits, sum(cast(l_quantity as bigint))::bigint as tokens_in, sum(l_linenumber)::bigint as tokens_out, sum(cast(l_extendedprice as decimal(18,6)))::decimal(20,6) as cost"


@query(f"select l_returnflag as purpose, l_linestatus as model, {_SUMS} from lineitem group by 1, 2 union all select null, null, {_SUMS} from lineitem")
def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost by purpose and model, and in all (A1)."""
    return ledger.usage(table(spark, sf_dir, "lineitem").selectExpr(*_CALLS))


@query("""with c as (select l_orderkey, l_linenumber, l_suppkey, case l_partkey % 3 when 0 then 'deepseek-flash' when 1 then 'deepseek-v4-pro' else 'other' end as model, l_partkey as tokens_in, l_partkey % 100 as tokens_cached, l_suppkey as tokens_out from lineitem),
p as (select * from (values ('deepseek-flash', 0.30::double, 0.006::double, 1.20::double), ('deepseek-v4-pro', 1.32::double, 0.044::double, 3.96::double)) t(model, i, h, o))
select model, count(*) as calls, round(sum(round((tokens_in - tokens_cached) * coalesce(i, 0) / 1e6 + tokens_cached * coalesce(h, 0) / 1e6 + tokens_out * coalesce(o, 0) / 1e6, 6)), 4) as cost from c left join p using (model) group by model""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of calls by the price table, unknown models 0."""
    c = table(spark, sf_dir, "lineitem").selectExpr("case l_partkey % 3 when 0 then 'deepseek-flash' when 1 then 'deepseek-v4-pro' else 'other' end as model", "l_partkey as tokens_in", "l_partkey % 100 as tokens_cached", "l_suppkey as tokens_out")
    prices = spark.createDataFrame(PRICES, "model string, price_in double, price_cached double, price_out double")
    return ledger.costs(c, prices).groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


_STEPS = ["conv_id as run", "turn as seq", "if(role = 'user', 'tool', role) as role", "length(text) as size"]
_STEPS_SQL = "steps as (select conv_id as run, turn as seq, case role when 'user' then 'tool' else role end as role, length(text) as size from conversations)"


@query(f"with {_STEPS_SQL} select run, seq, role = 'tool' and size > 200 and (select count(*) from steps t where t.run = s.run and t.seq > s.seq and t.role = 'assistant') >= 2 as folded from steps s")
def folded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results that an agent's next call leaves out."""
    return ledger.folded(table(spark, sf_dir, "conversations").selectExpr(*_STEPS)).select("run", "seq", "folded")


@query("""with s as (select l_suppkey as run, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber as seq, cast(l_quantity * 1300 as bigint) as tokens_in, l_linenumber * 0.001::double as cost from lineitem),
r as (select *, row_number() over w as turn, sum(cost) over w as spent from s window w as (partition by run order by seq)),
o as (select run, seq, case when turn >= 10 then 'turns' when tokens_in >= 60000 then 'tokens' when spent >= 0.0505 then 'cost' end as reason from r)
select run, min(seq) as seq, arg_min(reason, seq) as reason from o where reason is not null group by run""")
def budget_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run went over its budget."""
    s = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as run", "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber as seq", "cast(l_quantity * 1300 as bigint) as tokens_in", "l_linenumber * 0.001D as cost")
    return ledger.budget_stops(s, cost=0.0505)  # between sums, so that rounding doesn't decide


@query(f"with {_STEPS_SQL} select run, count(*) as steps, count(*) filter (where role = 'assistant') as turns, count(*) filter (where role = 'tool') as tool_calls, sum(size)::bigint as chars from steps group by run")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agent run's steps."""
    return ledger.run_summary(table(spark, sf_dir, "conversations").selectExpr(*_STEPS))


@query("select l_partkey as hash, arg_min(l_orderkey * 10 + l_linenumber, l_orderkey * 100000 + l_suppkey * 10 + l_linenumber) as reply from lineitem where l_returnflag <> 'A' group by 1")
def cached_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored reply of each request: the first good one."""
    return ledger.cached(table(spark, sf_dir, "lineitem").selectExpr("l_partkey as hash", "l_returnflag <> 'A' as ok", "l_orderkey * 100000 + l_suppkey * 10 + l_linenumber as created", "l_orderkey * 10 + l_linenumber as reply"))


@query("""with r as (select o_custkey as request, o_orderkey as reply, row_number() over (partition by o_custkey order by o_orderkey) - 1 as place, count(*) over (partition by o_custkey) as n from orders)
select request, s.sample, reply from r join (select unnest([0, 1, 2, 3, 4]) as sample) s on s.sample % n = place""")
def replayed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded replies handed out to five samples."""
    return ledger.replayed(table(spark, sf_dir, "orders").selectExpr("o_custkey as request", "o_orderkey as created", "o_orderkey as reply"), list(range(5)))


@query("""with v as (select o_orderkey as run, case o_orderkey % 3 when 0 then 'genuine' when 1 then 'false_alarm' else 'needs_author' end as verdict, case when o_custkey % 2 = 0 then 'contradiction' else 'explained' end as reason, o_orderstatus <> 'F' as read from orders),
q as (select l_orderkey as run, count(*) as n, count(*) filter (where l_partkey % 10 = 0) as lost from lineitem where l_linenumber > 2 group by 1),
p as (select v.run, case when (verdict = 'genuine') <> (reason = 'contradiction') then 'reason' when verdict = 'false_alarm' and not read then 'unread' when coalesce(n, 0) = 0 then 'no_quote' when lost > 0 then 'quote_lost' end as problem from v left join q on q.run = v.run)
select * from p where problem is not null""")
def verdict_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that the guard refuses."""
    v = table(spark, sf_dir, "orders").selectExpr("o_orderkey as run", "element_at(array('genuine', 'false_alarm', 'needs_author'), cast(o_orderkey % 3 + 1 as int)) as verdict", "if(o_custkey % 2 = 0, 'contradiction', 'explained') as reason", "o_orderstatus <> 'F' as read")
    return ledger.verdict_problems(v, table(spark, sf_dir, "lineitem").where("l_linenumber > 2").selectExpr("l_orderkey as run", "l_partkey % 10 <> 0 as located"))


_SPAN = ["l_orderkey * 10 + l_linenumber as id", "l_returnflag as book", "l_suppkey as chapter", "l_partkey as start", "l_partkey + cast(l_quantity as bigint) as {end}"]
_SPANS = f"select {', '.join(_SPAN)} from lineitem where".replace("{end}", '"end"')


def _span_sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = table(spark, sf_dir, "lineitem")
    return [rows.where(w).selectExpr(*[x.replace("{end}", "`end`") for x in _SPAN]) for w in ("l_linenumber = 1", "l_linenumber = 2")]


@query(f"""with e as ({_SPANS} l_linenumber = 1), o as ({_SPANS} l_linenumber = 2)
select distinct e.id as expected, o.id as observed from e join o on o.book = e.book and o.chapter = e.chapter and e.start < o."end" and o.start < e."end" """)
def span_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and observed spans that overlap."""
    return ev.matched(*_span_sides(spark, sf_dir), 200).distinct()


@query(f"""with recursive e as (select *, row_number() over (partition by book, chapter order by start, "end", id) as n from ({_SPANS} l_linenumber = 1)), o as (select *, row_number() over (partition by book, chapter order by start, "end", id) as n from ({_SPANS} l_linenumber = 2)),
step as (select distinct book, chapter, 0::bigint as i, []::bigint[] as used, null::bigint as expected, null::bigint as pick from e
  union all select s.book, s.chapter, s.i + 1, case when x.pick is null then s.used else list_append(s.used, x.pick) end, x.id, x.pick from step s join lateral (
    select e.id, (select min(o.n) from o where o.book = e.book and o.chapter = e.chapter and o.start < e."end" and e.start < o."end" and not list_contains(s.used, o.n)) as pick from e where e.book = s.book and e.chapter = s.chapter and e.n = s.i + 1) x on true)
select s.expected, o.id as observed from step s join o on o.book = s.book and o.chapter = s.chapter and o.n = s.pick""")
def one_to_one_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps taken greedily in order, so that each side is used once."""
    return ev.one_to_one(*_span_sides(spark, sf_dir))


_R = "round(sum(quality)::double / nullif(count(*), 0), 4)"
_LABELLED = "l as (select d.lang, d.source, quality, toxic, d.doc_id from labels join documents d on d.doc_id = labels.doc_id)"


@query(f"with {_LABELLED} select lang, null as source, {_R} as ratio, count(*) as n from l group by lang union all select null, source, {_R}, count(*) from l group by source union all select null, null, {_R}, count(*) from l")
def ratio_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios over all, by group and by book in one pass."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return ev.grouped_ratios(table(spark, sf_dir, "labels").join(d, "doc_id"), ["lang", "source"], F.col("quality"), F.lit(1))


_STORY = [
    "l_suppkey as story", "element_at(array('absolute_age', 'life_stage', 'appearance', 'life'), cast(l_partkey % 4 + 1 as int)) as attribute", "l_partkey % 7 <> 0 as expected", "l_orderkey % 9 <> 0 as observed",
    "l_orderkey % 5 <> 0 as value_right", "l_orderkey % 11 <> 0 as character_right", "l_linenumber <> 3 as flashback_right", "l_linenumber <> 5 as speculative_right", "l_partkey % 7 = 0 and l_partkey % 2 = 0 as trap",
]
_STORY_SQL = f"select {', '.join(_STORY)} from lineitem".replace("element_at(array('absolute_age', 'life_stage', 'appearance', 'life'), cast(l_partkey % 4 + 1 as int))", "(['absolute_age', 'life_stage', 'appearance', 'life'])[l_partkey % 4 + 1]")
_FOUND = ["l_suppkey as story", "concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))) as fingerprint", "l_partkey % 3 <> 0 as expected", "l_orderkey % 4 <> 0 as observed", "l_discount > 0.02 as confidence_right"]


def _story_ratios() -> str:
    r = lambda a, b, name: f"round(count(*) filter (where {a})::double / nullif(count(*) filter (where {b}), 0), 4) as {name}"
    both = "expected and observed"
    parts = [r(both, "expected", "recall"), r(both, "observed", '"precision"'), r("trap and not observed", "trap", "traps_passed")]
    for kind in ("absolute_age", "life_stage", "appearance", "life"):
        here = f" and attribute = '{kind}'"
        parts += [r(both + here, "expected" + here, f"{kind}_recall"), r(both + here, "observed" + here, f"{kind}_precision")]
    parts += [r(f"{both} and {x}_right", both, f"{x}_right") for x in ("value", "character", "flashback", "speculative")]
    parts += ["count(*) filter (where expected and not observed) as missed", "count(*) filter (where observed and not expected and not trap) as extra", "count(*) filter (where trap and observed) as trapped"]
    return ", ".join(parts)


@query(f"""with f as ({_STORY_SQL}), i as (select {', '.join(_FOUND)} from lineitem), w as (select story, {_story_ratios()} from f group by story),
x as (select story, round(count(*) filter (where expected and observed)::double / nullif(count(*) filter (where expected), 0), 4) as issue_recall, round(count(*) filter (where expected and observed)::double / nullif(count(*) filter (where observed), 0), 4) as issue_precision,
round(count(*) filter (where expected and observed and confidence_right)::double / nullif(count(*) filter (where expected and observed), 0), 4) as confidence_right, count(*) filter (where observed and not expected) as false_issues,
list_sort(list(fingerprint || ':' || observed::varchar) filter (where expected)) as hits from i group by story) select w.*, x.* exclude (story) from w left join x using (story)""")
def story_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row of all of a story's ratios, counters and hits (A5)."""
    rows = table(spark, sf_dir, "lineitem")
    return ev.story_metrics(rows.selectExpr(*_STORY), rows.selectExpr(*_FOUND))


@query("""with v as (select l_partkey as "case", l_linenumber % 3 as sample, l_returnflag as verdict from lineitem where l_linenumber <= 3)
select "case", count(*) as samples, count(distinct verdict) = 1 as stable from v group by 1""")
def verdict_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that all samples judge alike."""
    return ev.stability(table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").selectExpr("l_partkey as case", "l_linenumber % 3 as sample", "l_returnflag as verdict"))


@query("with h as (select l_partkey as issue, count(*) filter (where l_returnflag = 'R') as k from lineitem group by 1) select k, count(*) as issues from h group by k")
def found_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many issues are found in k samples."""
    return ev.found_in(table(spark, sf_dir, "lineitem").selectExpr("l_partkey as issue", "l_linenumber as sample", "l_returnflag = 'R' as hit"))


@query("""with k as (select l_suppkey as "group", l_linenumber % 3 as sample, l_partkey % 5 as key from lineitem), n as (select "group", count(distinct sample) as samples from k group by 1), p as (select "group", key, count(distinct sample) as c from k group by all)
select p."group", round(count(*) filter (where c = samples)::double / count(*), 4) as consistency from p join n on n."group" = p."group" group by 1""")
def set_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples' common keys over all their keys."""
    return ev.set_consistency(table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as group", "l_linenumber % 3 as sample", "l_partkey % 5 as key"))


_CASES = [
    "concat('k', cast(l_suppkey % 5 as varchar(9))) as kind", "l_linenumber <= 5 as expected", "l_partkey % 3 <> 0 as detected", "l_discount > 0.02 as level_right", "l_tax > 0.06 as false_alarm", "l_orderkey % 4 as collateral",
    "case when l_orderkey % 3 = 0 then 'unread' when l_orderkey % 3 = 1 then 'unlinked' else 'tolerated' end as missed_by", "l_partkey % 40 as gap",
]


@query(f"""with c as (select {', '.join(_CASES)} from lineitem), w as (select kind, count(*) as cases, count(*) filter (where expected) as contradictions, round(count(*) filter (where expected and detected)::double / nullif(count(*) filter (where expected), 0), 4) as detected,
round(count(*) filter (where expected and detected and level_right)::double / nullif(count(*) filter (where expected and detected), 0), 4) as level_right, round(count(*) filter (where not expected and false_alarm)::double / nullif(count(*) filter (where not expected), 0), 4) as false_alarm,
sum(collateral)::bigint as collateral, round(count(*) filter (where expected and detected and gap < 5)::double / nullif(count(*) filter (where expected and gap < 5), 0), 4) as recall_near,
round(count(*) filter (where expected and detected and gap between 5 and 19)::double / nullif(count(*) filter (where expected and gap between 5 and 19), 0), 4) as recall_middle, round(count(*) filter (where expected and detected and gap >= 20)::double / nullif(count(*) filter (where expected and gap >= 20), 0), 4) as recall_far from c group by kind),
m as (select kind, missed_by || ':' || count(*)::varchar as x from c where expected and not detected group by kind, missed_by) select w.*, coalesce((select list_sort(list(x)) from m where m.kind = w.kind), []) as misses from w""")
def injection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected contradictions and controls by kind: found, level, false alarms, misses, recall by distance (A10)."""
    return ev.injection_metrics(table(spark, sf_dir, "lineitem").selectExpr(*_CASES))


_PLACE = "struct({c} as chapter, {s} as start, {s} + 60 as `end`)"
_PLACE_SQL = "{{'chapter': {c}, 'start': {s}, 'end': {s} + 60}}"
_AT = [("l_partkey % 6", "l_suppkey % 900"), ("l_linenumber % 6", "l_orderkey % 900")]
_BEFORE, _AFTER = "l_partkey % 4 <> 1", "l_suppkey % 5 <> 2"
_INJECTED = ["o_orderkey as injection", "o_orderkey % 6 as chapter", "o_orderkey % 900 as start", "o_orderkey % 900 + 200 as {end}", "o_custkey % 6 as ref_chapter", "o_custkey % 700 as ref_start", "o_custkey % 700 + 400 as ref_end"]


@query(f"""with i as (select l_orderkey as injection, concat(l_partkey::varchar, '-', l_suppkey::varchar, '-', l_linenumber::varchar) as fingerprint, l_returnflag as confidence, [{', '.join(_PLACE_SQL.format(c=c, s=s) for c, s in _AT)}] as evidence, {_BEFORE} as was, {_AFTER} as now_ from lineitem),
j as (select {', '.join(_INJECTED).replace('{end}', '"end"')} from orders), a as (select i.*, j.* exclude (injection) from i join j using (injection) where now_ and not was)
select injection, fingerprint, confidence, case when evidence[1].chapter = ref_chapter and evidence[1].start < ref_end and ref_start < evidence[1]."end" and evidence[-1].chapter = chapter and evidence[-1].start < "end" and start < evidence[-1]."end" then 'detected'
 when len(list_filter(evidence, lambda e: e.chapter = chapter and e.start < "end" and start < e."end")) > 0 then 'involving' else 'collateral' end as outcome from a
union all select injection, fingerprint, confidence, 'removed' from i where was and not now_""")
def injection_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that an injection added or removed, classified by where their evidence lies."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as injection", "concat(l_partkey, '-', l_suppkey, '-', l_linenumber) as fingerprint", "l_returnflag as confidence", f"array({', '.join(_PLACE.format(c=c, s=s) for c, s in _AT)}) as evidence", f"{_BEFORE} as was", f"{_AFTER} as now_")
    issues = lambda w: rows.where(w).drop("was", "now_")
    return ev.injection_outcomes(table(spark, sf_dir, "orders").selectExpr(*[x.replace("{end}", "`end`") for x in _INJECTED]), issues("was"), issues("now_"))


@query("""with p as (select distinct l_suppkey as model, l_partkey as golden from lineitem)
select model as id, count(distinct golden) as n, 'merge' as what from p group by 1 having n > 1 union all select golden, count(distinct model) as n, 'split' from p group by 1 having n > 1""")
def merges_and_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters taken for one, or for several."""
    return ev.merges_and_splits(table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as model", "l_partkey as golden").distinct())


@query("""with c as (select c_custkey as id, c_mktsegment as kind, c_nationkey as book, md5('7-' || cast(c_custkey as varchar)) as draw from customer), t as (select *, row_number() over (partition by kind, book order by draw, id) as turn from c),
p as (select *, row_number() over (partition by kind order by turn, draw, id) as place from t where turn <= 3) select id, kind, book, turn, place from p where place <= 40""")
def planned_injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injections drawn by kind, books taking turns."""
    return ev.planned(table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_mktsegment as kind", "c_nationkey as book"), 40, 3, 7)


@query("""with r as (select user_id % 5 as book, event_id as id, user_id as character, value as v from events where event_type = 'purchase'),
c as (select event_id as corruption, user_id % 5 as book, event_id as key, value + 1000 as nv from events where event_type = 'purchase'),
x as (select c.corruption, r.character, r.id, r.v as old, case when r.id = c.key then c.nv else r.v end as v from r join c on c.book = r.book),
w as (select corruption, coalesce(v - lag(v) over u > 900, false) as jump, coalesce(old - lag(old) over u > 900, false) as was from x window u as (partition by corruption, character order by id))
select corruption, count(*) filter (where jump) as jumps, count(*) filter (where jump and not was) as added, count(*) filter (where was and not jump) as removed from w group by 1""")
def corruption_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corruption of a value judged as if its book had been copied."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    rows = e.selectExpr("user_id % 5 as book", "event_id as id", "user_id as character", "value as v")
    return ev.corrupted_jumps(rows, e.selectExpr("event_id as corruption", "user_id % 5 as book", "event_id as id", "value + 1000 as value"), 900)


_TABLES = {
    "age": "select *, age_value as low, age_value + k % 2 as high, case when character >= 5 then character - 5 end as other from {s} where event_type = 'purchase'",
    "span": "select *, case when k % 3 = 0 then 'retrospective' when k % 3 = 1 then 'future' else 'advance' end as kind, cast(k % 4 as double) as years from {s} where event_type = 'click'",
    "trait": "select *, concat('c', cast(k % 3 as varchar(9))) as value, k % 13 <> 0 as own_look from {s} where event_type = 'error'",
    "life": "select * from {s} where event_type = 'signup'",
}


@query(f"with {p.STATEMENTS_SQL}, " + ", ".join(f"t_{n} as ({q.format(s='statements')})" for n, q in _TABLES.items()) + " " + " union all ".join(f"""select '{k}' as type, book, pos, '{c}' as "column", {v.replace(' as string)', ' as varchar)')} as value from t_{n} where {w}""" for k, n, w, c, v in ev.CORRUPTIONS))
def planned_corruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edit of the nine types of corruption that can be made."""
    s = p.statements(spark, sf_dir)
    return ev.corruptions({n: spark.sql(q, s=s) for n, q in _TABLES.items()})


@query("""with a as (select o_orderpriority as metric, round(avg(o_totalprice), 2) as v from orders where o_orderstatus = 'O' group by 1), b as (select o_orderpriority as metric, round(avg(o_totalprice), 2) as v from orders where o_orderstatus = 'F' and o_orderpriority <> '5-LOW' group by 1)
select coalesce(a.metric, b.metric) as metric, a.v as a, b.v as b, round(b.v - a.v, 4) as delta from a full join b on b.metric = a.metric""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two runs side by side."""
    o = table(spark, sf_dir, "orders")
    side = lambda w: o.where(w).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))
    return ev.compared(side("o_orderstatus = 'O'"), side("o_orderstatus = 'F' and o_orderpriority <> '5-LOW'"))


@query("select l_partkey % 97 as attribute, count(*) as n from lineitem group by 1 order by n desc, min(l_orderkey * 10 + l_linenumber), attribute limit 40")
def top_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 most frequent attributes."""
    return ev.top_attributes(table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 97 as attribute", "l_orderkey * 10 + l_linenumber as pos"))


@query("""with p as (select l_returnflag as category, l_suppkey as character, l_partkey % 30 as attribute, l_orderkey % 40 as chapter, lower(l_linestatus) as value from lineitem), g as (select category, character, attribute, count(distinct chapter) as chapters, count(distinct value) as vals, count(*) as n from p group by all)
select category, sum(n)::bigint as facts, count(distinct character) as characters, count(*) as groups, count(*) filter (where chapters >= 2) as repeated, count(*) filter (where vals >= 2) as differing from g group by 1""")
def probe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, groups, and those repeated or differing, by category."""
    p = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as category", "l_suppkey as character", "l_partkey % 30 as attribute", "l_orderkey % 40 as chapter", "lower(l_linestatus) as value")
    g = p.groupBy("category", "character", "attribute").agg(F.countDistinct("chapter").alias("chapters"), F.countDistinct("value").alias("vals"), F.count("*").alias("n"))
    return g.groupBy("category").agg(F.sum("n").alias("facts"), F.countDistinct("character").alias("characters"), F.count("*").alias("groups"), F.count_if(F.col("chapters") >= 2).alias("repeated"), F.count_if(F.col("vals") >= 2).alias("differing"))
