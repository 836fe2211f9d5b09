"""Queries: listings, overviews, reports and edits over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.catalog import query
from taleweave.operators import records
from taleweave.plans import projections as p
from taleweave.plans.projections import table

_FACT = "book, character, chapter, char_start, event_type as category, k"


@query(f"with {p.STATEMENTS_SQL} select {_FACT}, 'u' || character as name from statements where event_type = 'error' and chapter between 2 and 4")
def facts_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a category in a chapter range with character names."""
    s = p.statements(spark, sf_dir)
    names = s.select("character").distinct().withColumn("name", F.concat(F.lit("u"), F.col("character").cast("string")))
    return records.list_facts(s.selectExpr(*_FACT.split(", ")), names, "error", 2, 4)


@query(f"with {p.STATEMENTS_SQL} select book, chapter, char_start, {p.SPAN_YEARS} as years, is_flashback from statements where {p.IS_SPAN} and chapter between 1 and 5")
def time_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time spans of a chapter range in narrative order."""
    s = p.statements(spark, sf_dir).where(p.IS_SPAN).where(records.in_chapters(F.col("chapter"), 1, 5))
    return s.selectExpr("book", "chapter", "char_start", f"{p.SPAN_YEARS} as years", "is_flashback").orderBy("chapter", "char_start")


@query("select c_custkey as character, c_name as name from customer where c_name = 'Customer#000000012' or c_custkey in (select o_custkey from orders where o_orderpriority || '-' || o_orderkey = '1-URGENT-12') order by 1 limit 1")
def character_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character by name or alias."""
    chars = table(spark, sf_dir, "customer").selectExpr("c_custkey as character", "c_name as name")
    aliases = table(spark, sf_dir, "orders").selectExpr("o_custkey as character", "concat(o_orderpriority, '-', o_orderkey) as alias")
    return records.find_character(chars, aliases, " Customer#000000012 ")


@query("select p_partkey, p_name from part where p_type in (select p_type from part group by p_type order by count(*) desc, p_type limit 3) and p_size between 10 and 20")
def in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the three commonest types."""
    part = table(spark, sf_dir, "part")
    top = part.groupBy("p_type").count().orderBy(F.desc("count"), "p_type").limit(3)
    return part.where(F.col("p_size").between(10, 20)).join(top, "p_type", "left_semi").select("p_partkey", "p_name")


@query("select doc_id from documents where contains(text, 'thereon') or contains(text, 'queleau') or contains(text, 'ungeheit')")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that contain any of a character's names (F8)."""
    return records.mentions(table(spark, sf_dir, "documents"), ["thereon", "queleau", "ungeheit"]).select("doc_id")


@query("select o_orderkey, md5(cast(o_orderkey as varchar)) as id from orders where starts_with(md5(cast(o_orderkey as varchar)), (select min(substr(md5(cast(o_orderkey as varchar)), 1, 16)) from orders))")
def id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row by the unique beginning of its id."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "md5(cast(o_orderkey as string)) as id")
    return records.by_prefix(rows, "id", rows.agg(F.min(F.substring("id", 1, 16))).first()[0])


@query(f"with {p.CHAPTERS_SQL} select book, number, length(content) as char_count, sha256(content) as content_hash, status from chapters")
def chapters_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with numbers, sizes and content hashes."""
    return p.chapters(spark, sf_dir).select("book", "number", F.length("content").cast("bigint").alias("char_count"), F.sha2("content", 256).alias("content_hash"), "status")


@query(f"with {p.CHAPTERS_SQL} select book, min(number) as first_missing, count(*) as missing, (select max(number) from chapters c where c.book = chapters.book) as last_chapter from chapters where status <> 'extracted' and number <= 40 group by book")
def unextracted_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't extracted up to a chapter."""
    c = p.chapters(spark, sf_dir).select("book", "number", "status")
    last = c.groupBy("book").agg(F.max("number").alias("last_chapter"))
    out = c.where("status <> 'extracted' and number <= 40").groupBy("book").agg(F.min("number").alias("first_missing"), F.count("*").alias("missing"))
    return out.join(last, "book")


@query(f"""with {p.STATEMENTS_SQL}, readings as (select distinct book, chapter, event_type as kind from statements where user_part <> 0 or event_type <> 'error')
select book, min(chapter) as chapter from (select book, chapter from readings where kind in ('purchase', 'error') group by all having count(distinct kind) < 2) group by book""".replace("user_part <> 0", "(chapter * 7 + book) % 3 <> 0"))
def lacking_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's first chapter without readings of all kinds."""
    r = p.statements(spark, sf_dir).where("(chapter * 7 + book) % 3 <> 0 or event_type <> 'error'").selectExpr("book", "chapter", "event_type as kind")
    return records.first_lacking(r.where("kind in ('purchase', 'error')").distinct(), ["purchase", "error"])


@query("""with c as (select c_nationkey as book, count(*) as chapters, count(*) filter (where c_mktsegment = 'BUILDING') as extracted, count(*) filter (where c_acctbal < 0) as failed from customer group by 1), s as (select s_nationkey as book, count(*) as characters from supplier group by 1)
select n_nationkey as book, n_name as title, coalesce(chapters, 0) as chapters, coalesce(extracted, 0) as extracted, coalesce(failed, 0) as failed, coalesce(characters, 0) as characters from nation left join c on c.book = n_nationkey left join s on s.book = n_nationkey""")
def book_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with counts of chapters by status and characters."""
    books = table(spark, sf_dir, "nation").selectExpr("n_nationkey as book", "n_name as title")
    chapters = table(spark, sf_dir, "customer").selectExpr("c_nationkey as book", "case when c_mktsegment = 'BUILDING' then 'extracted' when c_acctbal < 0 then 'failed' end as status", "c_acctbal")
    chapters = chapters.selectExpr("book", "status", "c_acctbal")
    c = chapters.groupBy("book").agg(F.count("*").alias("chapters"), F.count_if(F.col("status") == "extracted").alias("extracted"), F.count_if(F.col("c_acctbal") < 0).alias("failed"))
    n = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("book")).agg(F.count("*").alias("characters"))
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("chapters", "extracted", "failed", "characters")]
    return books.join(c, "book", "left").join(n, "book", "left").select("book", "title", *zero).orderBy(F.desc("book"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "md5(cast(o_orderkey as string)) as fingerprint", "o_orderkey", "cast(o_custkey % 7 as string) as key", "if(o_orderstatus = 'O', 'open', 'resolved') as status",
        "case o_orderkey % 3 when 0 then 'confirmed' when 1 then 'suspected_review' else 'insufficient_info' end as confidence", "array(o_custkey % 50, o_custkey % 31) as chapters")


@query("""with issues as (select md5(cast(o_orderkey as varchar)) as fingerprint, o_custkey % 7 as key, case when o_orderstatus = 'O' then 'open' else 'resolved' end as status, o_orderkey % 3 as rank, least(o_custkey % 50, o_custkey % 31) as first_chapter,
  case o_orderkey % 3 when 0 then 'confirmed' when 1 then 'suspected_review' else 'insufficient_info' end as confidence from orders),
latest as (select md5(cast(l_orderkey as varchar)) as fingerprint, l_partkey % 7 as key, arg_max(case when l_suppkey % 2 = 0 then 'genuine' else 'false_alarm' end, l_linenumber * 100000000000 + l_partkey * 10000 + l_suppkey) as verdict from lineitem group by all)
select i.fingerprint, confidence, status, verdict, cast(rank as integer) as rank, first_chapter from issues i left join latest l on l.fingerprint = i.fingerprint and l.key = i.key where status = 'open' and coalesce(verdict, '') <> 'false_alarm'""")
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open issues with their valid verdicts, in report order."""
    verdicts = table(spark, sf_dir, "lineitem").selectExpr("md5(cast(l_orderkey as string)) as fingerprint", "cast(l_partkey % 7 as string) as key", "if(l_suppkey % 2 = 0, 'genuine', 'false_alarm') as verdict", "'r' as reason", "l_linenumber * 100000000000 + l_partkey * 10000 + l_suppkey as created")
    return records.report(_issues(spark, sf_dir), verdicts)


@query("""with b as (select md5(cast(o_orderkey as varchar)) as fingerprint, o_orderpriority as kind from orders where o_orderkey % 3 <> 0), a as (select md5(cast(o_orderkey as varchar)) as fingerprint, o_orderpriority as kind from orders where o_orderkey % 4 <> 0)
select 'added' as change, kind, count(*) as n from a where fingerprint not in (select fingerprint from b) group by all union all select 'removed', kind, count(*) from b where fingerprint not in (select fingerprint from a) group by all""")
def issue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that an edit adds and removes, by kind."""
    o = table(spark, sf_dir, "orders")
    side = lambda m: o.where(f"o_orderkey % {m} <> 0").selectExpr("md5(cast(o_orderkey as string)) as fingerprint", "o_orderpriority as kind")
    return records.changes(side(3), side(4)).groupBy("change", "kind").agg(F.count("*").alias("n"))


@query("""with e as (select l_orderkey as issue, l_linenumber as n, l_partkey % 50 as chapter, l_suppkey % 40 as s, l_suppkey % 11 as subject from lineitem),
f as (select ps as fact_id, ps % 50 as chapter, ps % 40 as s, ps % 11 as character from (select p_partkey as ps from part)), sp as (select min(c_custkey) as span_id, c_custkey % 50 as chapter, c_custkey % 40 as s from customer group by 2, 3),
m as (select e.*, f.fact_id, row_number() over (partition by issue, n order by coalesce(f.character = e.subject, false) desc, f.fact_id asc nulls last) as place from e left join f on f.chapter = e.chapter and f.s = e.s)
select issue, n, fact_id, case when fact_id is null then sp.span_id end as span_id from m left join sp on sp.chapter = m.chapter and sp.s = m.s where place = 1""")
def evidence_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact or span behind each piece of evidence."""
    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as issue", "l_linenumber as n", "l_partkey % 50 as chapter", "l_suppkey % 40 as char_start", "l_suppkey % 40 + 5 as char_end", "l_suppkey % 11 as subject")
    f = table(spark, sf_dir, "part").selectExpr("p_partkey as fact_id", "p_partkey % 50 as chapter", "p_partkey % 40 as char_start", "p_partkey % 40 + 5 as char_end", "p_partkey % 11 as character")
    s = table(spark, sf_dir, "customer").selectExpr("c_custkey as span_id", "c_custkey % 50 as chapter", "c_custkey % 40 as char_start", "c_custkey % 40 + 5 as char_end")
    return records.placed_facts(e, f, s)


@query(f"with {p.CHAPTERS_SQL} select book, case when number > 5 then number - 1 else number end as number, doc_id from chapters where number <> 5")
def chapter_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books after deleting a chapter, the later ones renumbered."""
    return records.without_chapter(p.chapters(spark, sf_dir).select("book", "number", "doc_id"), 5)


@query(f"""with {p.CHAPTERS_SQL}, g as (select c.book, number, length(content) as size, least((number - 1) // 3, greatest(n // 3 - 1, 0)) as merged from chapters c join (select book, count(*) as n from chapters group by book) t on t.book = c.book)
select book, number, merged, coalesce(sum(size + 1) over (partition by book, merged order by number rows between unbounded preceding and 1 preceding), 0)::bigint as begin from g""")
def chapters_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three chapters as one, with their places (E5)."""
    return records.merged_chapters(p.chapters(spark, sf_dir))


@query(f"with {p.CHAPTERS_SQL} select book, number, doc_id % 4 <> 0 and doc_id % 3 <> 0 as reused from chapters")
def readings_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters whose stored reading is of their present text and version."""
    c = p.chapters(spark, sf_dir)
    stored = c.selectExpr("book", "number", "sha2(if(doc_id % 4 = 0, concat(content, '!'), content), 256) as content_hash", "if(doc_id % 3 = 0, 'v1', 'v2') as version")
    return records.reusable(c, stored, "v2")


@query("select name, count(*) as n from (select n_name as name from nation union all select r_name from region union all select n_name from nation where n_nationkey < 5) group by name")
def names_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of characters, canonical and aliases, duplicates kept."""
    n = table(spark, sf_dir, "nation")
    names = n.selectExpr("n_name as name").unionByName(table(spark, sf_dir, "region").selectExpr("r_name as name")).unionByName(n.where("n_nationkey < 5").selectExpr("n_name as name"))
    return names.groupBy("name").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 20")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 runs."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)


@query("select o_custkey, count(*) filter (where o_orderpriority = '1-URGENT') as urgent, count(*) filter (where o_orderpriority = '5-LOW') as low from orders group by o_custkey")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of categories by book as columns."""
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return wide.select("o_custkey", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))
