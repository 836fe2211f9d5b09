"""Queries: what the checks would say of edited statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave import scratch
from taleweave.catalog import query
from taleweave.functions.kin import CONTRARY
from taleweave.operators import whatif
from taleweave.plans import checking as c
from taleweave.plans import projections as p

_SPAN = ["char_start as id", "book", "chapter", "pos", f"{p.SPAN_YEARS} as years", "case k % 25 when 0 then 'advance' when 1 then 'retrospective' else 'future' end as kind", "is_flashback"]
_SPAN_ROWS = "event_type = 'click' and k % 25 <= 2"
_TRAIT = ["char_start as id", "book", "character", "chapter", "pos", "case when k % 2 = 0 then 'eye_color' else 'hair_color' end as {group}", "concat('c', cast(k % 3 as varchar(9))) as value", "k % 13 = 0 as disguised", "k % 17 = 0 as temporary", "is_flashback", "is_speculative", "concat('c', cast((k + 1) % 3 as varchar(9))) as contrary"]
_COMPARABLE = "not is_flashback and not is_speculative and not disguised and not temporary"
_KIN = ["char_start as id", "book", "character as person", "character + 5 * (1 + k % 2) as other", "case k % 7 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(c._KIN_LIST)) + " end as relation", "pos", "char_start as tie", "k % 10 = 3 as address", "is_speculative"]
_KIN_ROWS = "event_type = 'view'"


def statement_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that the checks read, with what the planning of edits needs."""
    s = p.statements(spark, sf_dir)
    count = lambda rows, where, keys: rows.join(rows.where(where).groupBy(*keys).agg((F.count("*") >= 2).alias("often")), keys, "left").withColumn("often", F.coalesce("often", F.lit(False)))
    ages = c.ages(spark, sf_dir).withColumn("id", F.col("char_start"))
    present = ages.where("not is_flashback and not is_speculative and low <= 120").select("book", "character").distinct()
    traits = s.where(p.IS_TRAIT).selectExpr(*[x.replace("{group}", "`group`") for x in _TRAIT]).withColumn("comparable", F.expr(_COMPARABLE))
    kin = s.where(_KIN_ROWS).selectExpr(*_KIN)
    contrary = F.create_map(*[F.lit(x) for pair in CONTRARY.items() for x in pair])
    lives = s.select(F.col("char_start").alias("id"), "book", "character", "chapter", "pos", "is_speculative", "event_type", "k")
    deaths, presences = (lives.where(w).drop("event_type", "k") for w in (p.IS_DEATH, p.IS_PRESENCE))
    return {
        "ages": whatif.with_other(ages, present), "spans": s.where(_SPAN_ROWS).selectExpr(*_SPAN),
        "traits": count(traits, "comparable", ["book", "character", "group"]),
        "kin": count(kin, "not is_speculative", ["book", "person", "other"]).withColumn("contrary", contrary[F.col("relation")]),
        "deaths": whatif.with_later(deaths, presences), "presences": presences,
    }


_EDITS_SQL = f"""edits as (
  select 'flashback' as type, book, pos, character as c, low as l, high as h, false as f, is_speculative as s from ages where is_flashback and not is_speculative
  union all select 'speculative', book, pos, character, low, high, is_flashback, false from ages where is_speculative and not is_flashback
  union all select 'value', book, pos, character, low + 12, low + 12, is_flashback, is_speculative from ages where not is_flashback and not is_speculative and low <= 120 and low = high
  union all select * from (select 'misattributed', book, pos, (select min(o.character) from present o where o.book = a.book and o.character <> a.character) as c, low, high, is_flashback, is_speculative from ages a where not is_flashback and not is_speculative and low <= 120) where c is not null),
span_rows as (select {', '.join(_SPAN)} from statements where {_SPAN_ROWS}),
span_edits as (select * from span_rows where kind <> 'advance' and years >= 1 and not is_flashback),
traits as (select * exclude (contrary), contrary, {_COMPARABLE} as comparable from (select {', '.join(_TRAIT).replace('{group}', '"group"')} from statements where {p.IS_TRAIT})),
trait_edits as (select * from traits t where comparable and (select count(*) from traits o where o.book = t.book and o.character = t.character and o."group" = t."group" and o.comparable) >= 2),
contraries as (select * from (values {', '.join(f"('{a}', '{b}')" for a, b in CONTRARY.items())}) t(relation, contrary)),
kin as (select {', '.join(_KIN)} from statements where {_KIN_ROWS}),
kin_edits as (select k.*, contrary from kin k join contraries using (relation) where not is_speculative and (select count(*) from kin o where o.book = k.book and o.person = k.person and o.other = k.other and not o.is_speculative) >= 2),
deaths as (select * from statements where {p.IS_DEATH}), presences as (select * from statements where {p.IS_PRESENCE}),
death_edits as (
  select 'fact_speculative' as type, book, pos, character as c from deaths d where is_speculative and exists (select 1 from presences o where o.book = d.book and o.character = d.character and o.chapter > d.chapter)
  union all select * from (select 'fact_misattributed', book, pos, (select min(o.character) from presences o where o.book = d.book and o.character <> d.character and o.chapter > d.chapter) as c from deaths d where not is_speculative) where c is not null)"""

_BEFORE = "lag(pos) over w as a_pos, lag(low) over w as a_low, lag(high) over w as a_high, lag(is_flashback) over w as a_flash, lag(off) over w as a_off, lag(y_le) over w as a_y, lag(z_le) over w as a_z"
_GAP = "case when z_lt - a_z > 0 then null else y_lt - a_y - off + a_off end"
_VERDICT = f"a_pos is not null and ((not a_flash and not is_flashback and high < a_low) or greatest(0.0, low - (a_high + ({_GAP})), (a_low + ({_GAP})) - high) > 1.0)"
_OFF = "case when not is_flashback then 0.0 else years_before end as off"
_VALID = "not is_speculative and (not is_flashback or years_before is not null)"


def _changes(checker: str, cases: str, after: str, before: str) -> str:
    """Issues ``after(type, pos, a, b)`` of each case of ``cases(type, book, pos)`` against ``before(book, a, b)``."""
    return f"""select type, pos, '{checker}' as checker, a, b, 'added' as change from (select * from {after} except select c.type, c.pos, i.a, i.b from {cases} c join {before} i using (book))
union all select type, pos, '{checker}', a, b, 'removed' from (select c.type, c.pos, i.a, i.b from {cases} c join {before} i using (book) except select * from {after})"""


_WHAT_IF = f"""with {c.BASE_SQL},
present as (select distinct book, character from ages where not is_flashback and not is_speculative and low <= 120),
{_EDITS_SQL},
summed as (select *, (select coalesce(sum(coalesce(years, 0)), 0) from spans s where s.book = x.book and s.pos < x.pos) as y_lt, (select coalesce(sum(coalesce(years, 0)), 0) from spans s where s.book = x.book and s.pos <= x.pos) as y_le,
  (select count(*) from spans s where s.book = x.book and s.pos < x.pos and years is null) as z_lt, (select count(*) from spans s where s.book = x.book and s.pos <= x.pos and years is null) as z_le from ages x),
age_base as (select book, a_pos as a, pos as b from (select *, {_BEFORE} from (select *, {_OFF} from summed where {_VALID}) window w as (partition by book, character order by pos)) where {_VERDICT}),
copied as (select e.type, e.pos as edit, a.book, a.pos, if(a.pos = e.pos, e.c, a.character) as character, if(a.pos = e.pos, e.l, a.low) as low, if(a.pos = e.pos, e.h, a.high) as high, if(a.pos = e.pos, e.f, a.is_flashback) as is_flashback,
  if(a.pos = e.pos, e.s, a.is_speculative) as is_speculative, years_before, y_lt, y_le, z_lt, z_le from edits e join summed a on a.book = e.book),
age_after as (select type, edit as pos, a_pos as a, pos as b from (select *, {_BEFORE} from (select *, {_OFF} from copied where {_VALID}) window w as (partition by type, edit, character order by pos)) where {_VERDICT}),
moved as (select e.pos as edit, a.* exclude (y_lt, y_le), y_lt + if(e.pos < a.pos, e.years, 0) as y_lt, y_le + if(e.pos <= a.pos, e.years, 0) as y_le from span_edits e join summed a on a.book = e.book),
span_after as (select 'time_span' as type, edit as pos, a_pos as a, pos as b from (select *, {_BEFORE} from (select *, {_OFF} from moved where {_VALID}) window w as (partition by edit, character order by pos)) where {_VERDICT}),
look_base as (select book, a, pos as b from (select *, lag(pos) over w as a, lag(value) over w as v from traits where comparable window w as (partition by book, character, "group" order by pos)) where v <> value),
look_after as (select 'fact_value' as type, edit as pos, a, pos as b from (select *, lag(pos) over w as a, lag(v2) over w as v from (select e.pos as edit, t.*, if(t.pos = e.pos, e.contrary, t.value) as v2 from trait_edits e join traits t on t.book = e.book where t.comparable)
  window w as (partition by edit, character, "group" order by pos)) where v <> v2),
{c.RELATIONS_SQL},
kin_all as (select 'fact_relation' as type, e.pos as edit, k.* replace (if(k.pos = e.pos, e.contrary, k.relation) as relation) from kin_edits e join kin k on k.book = e.book union all select 'none', 0, * from kin),
kin_turned as (select type, edit, book, pos, tie, address, k.relation, link, side, cast(person as varchar) > cast(other as varchar) as sw, person, other, generations, sex_a, sex_b, a_older from kin_all k join relations r on r.relation = k.relation where not is_speculative and person <> other),
kin_one as (select type, edit, book, pos, tie, address, link, side, case when sw then other else person end as first, case when sw then person else other end as second,
  case when sw then -generations else generations end as g, case when sw then sex_b else sex_a end as xa, case when sw then sex_a else sex_b end as xb, case when sw then not a_older else a_older end as o from kin_turned),
kin_pairs as (select *, lag(pos) over w as a, lag(address) over w as aa, lag(g) over w as ag, lag(link) over w as al, lag(side) over w as aside, lag(xa) over w as axa, lag(xb) over w as axb, lag(o) over w as ao from kin_one window w as (partition by type, edit, book, first, second order by pos, tie)),
kin_why as (select *, case when ag <> g then 'generation' when al <> link then 'link' when aside <> side then case when al = 'cousin' then 'cousin_kind' else 'side' end when axa <> xa then 'sex' when axb <> xb then 'sex' when ao <> o then 'age_order' end as reason from kin_pairs where a is not null),
kin_found as (select * from kin_why where reason is not null and not ((aa or address) and (reason = 'cousin_kind' or (reason = 'link' and ag = 0)))),
kin_base as (select book, a, pos as b from kin_found where type = 'none'), kin_after as (select type, edit as pos, a, pos as b from kin_found where type <> 'none'),
death_all as (select e.type, e.pos as edit, d.book, if(d.pos = e.pos, e.c, d.character) as character, d.pos, d.chapter, if(d.pos = e.pos, false, d.is_speculative) as is_speculative from death_edits e join deaths d on d.book = e.book union all select 'none', 0, book, character, pos, chapter, is_speculative from deaths),
died as (select type, edit, book, character, min(pos) as a, arg_min(chapter, pos) as chapter from death_all where not is_speculative group by all),
revived as (select type, edit, d.book, a, min(s.pos) as b from died d join presences s on s.book = d.book and s.character = d.character and s.chapter > d.chapter group by type, edit, d.book, d.character, a),
revival_base as (select book, a, b from revived where type = 'none'), revival_after as (select type, edit as pos, a, b from revived where type <> 'none'),
span_cases as (select 'time_span' as type, book, pos from span_edits), look_cases as (select 'fact_value' as type, book, pos from trait_edits), kin_cases as (select 'fact_relation' as type, book, pos from kin_edits),
changes as ({_changes('age_arithmetic', 'edits', 'age_after', 'age_base')} union all {_changes('age_arithmetic', 'span_cases', 'span_after', 'age_base')} union all {_changes('appearance', 'look_cases', 'look_after', 'look_base')}
  union all {_changes('kinship', 'kin_cases', 'kin_after', 'kin_base')} union all {_changes('revival', 'death_edits', 'revival_after', 'revival_base')})
select type || ':' || (pos % 4294967296)::varchar as "case", checker, a % 4294967296 as a, b % 4294967296 as b, change from changes"""


@query(_WHAT_IF)
def what_if_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edit of the nine types that the statements allow, and the issues each adds or removes."""
    tables = {name: scratch.stored(rows, f"whatif-{name}") for name, rows in statement_tables(spark, sf_dir).items()}
    return whatif.what_if(tables, c.relation_table(spark), scratch.stored(whatif.planned_edits(tables), "whatif-edits"))
