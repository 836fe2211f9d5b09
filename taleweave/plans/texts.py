"""Queries: text functions over documents, sources, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave import scratch
from taleweave.catalog import query
from taleweave.functions import names, text
from taleweave.plans import projections as p
from taleweave.plans.projections import table
from taleweave.sources import books
from taleweave.streaming import append


@query(f"""with {p.CHAPTERS_SQL}, l as (select book, number, length(content) as size, string_split(content, chr(10)) as parts from chapters),
x as (select book, number, size, unnest(parts) as line, generate_subscripts(parts, 1) as n from l),
y as (select *, coalesce(sum(length(line) + 1) over (partition by book, number order by n rows between unbounded preceding and 1 preceding), 0) as start from x),
z as (select *, row_number() over (partition by book, number order by n) - 1 as i, count(*) over (partition by book, number) as c from y where length(trim(line)) > 0)
select book, number, i::integer as i, start::integer as start, (start + length(line))::integer as "end", case when size < 3000 then i < c // 2 else start < 1500 end as in_head, case when size < 3000 then i >= c // 2 else start + length(line) > size - 1500 end as in_tail from z""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with offsets and note regions."""
    return text.paragraphs(p.chapters(spark, sf_dir))


@query()
def passage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter's passages of about 500 characters (R1, D10); held to their properties in the tests."""
    return text.with_spans(p.chapters(spark, sf_dir), ["book", "number"], "content", text.passages)


@query()
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter's chunks of at most 8,000 characters."""
    return text.with_spans(p.chapters(spark, sf_dir), ["book", "number"], "content", text.chunks)


@query("""with d as (select doc_id, text, least(length(text), 300) as s from documents)
select doc_id, regexp_extract(substr(text, 1, s), '[^。！？!?\n]*$') || substr(text, s + 1, 20) || regexp_extract(substr(text, s + 21), '^[^。！？!?\n]*') as sentence from d""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence around a place of each text."""
    d = table(spark, sf_dir, "documents").withColumn("s", F.least(F.length("text"), F.lit(300)))
    return d.select("doc_id", text.sentence_at(F.col("text"), F.col("s"), F.col("s") + 20).alias("sentence"))


@query(r"""select page_id, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?i)</(p|h1|div|li|title|footer)>|<br>', chr(10), 'g'), '<[^>]+>', '', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) as text from pages""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text lines in SQL."""
    return table(spark, sf_dir, "pages").select("page_id", books.page_text(F.col("html")).alias("text"))


@query("with x as (select item_id, '[' || item_id || ']' || text as value from benchmark) select item_id, regexp_extract(value, '^\\[(\\d+)\\]', 1)::integer as number, regexp_replace(value, '^\\[\\d+\\]', '') as text from x")
def numbered_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines read into numbers and texts."""
    return books.numbered_lines(table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit("]"), F.col("text")).alias("value")))


@query("select cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k, count(*) as n from events group by 1")
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON replies parsed by a declared schema, a code fence stripped."""
    fenced = table(spark, sf_dir, "events").select(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")).alias("reply"))
    parsed = fenced.select(F.from_json(F.regexp_replace("reply", "^```[a-z]*\n|\n```$", ""), "k bigint").alias("r"))
    return parsed.groupBy(F.col("r.k").alias("k")).agg(F.count("*").alias("n"))


@query("""select 'duplicate name' as rule, count(*)::bigint as violations from (select c_name from customer group by 1 having count(*) > 1) union all select 'unknown book', count(*) from customer where c_nationkey not in (select n_nationkey from nation)
union all select 'unknown document', count(*) from labels where doc_id not in (select doc_id from documents) union all select 'empty text', count(*) from documents where coalesce(text, '') = ''""")
def data_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rules as counts of violations."""
    t = lambda n: table(spark, sf_dir, n)
    found = {
        "duplicate name": t("customer").groupBy("c_name").count().where("count > 1"), "unknown book": t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti"),
        "unknown document": t("labels").join(t("documents").select("doc_id"), "doc_id", "left_anti"), "empty text": t("documents").where("coalesce(text, '') = ''"),
    }
    out = None
    for rule, rows in found.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out




@query()
def characters_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions resolved to characters, part of a book by part, with the log of what was made (C4, J21); held against one walk in the tests."""
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'error')")
    rows = e.selectExpr(
        "cast(user_id % 5 as int) as book", "cast(extract(day from ts) as int) as chapter", "cast(event_id as int) as seq", "if(event_id % 9 = 0, 'reveal', 'statement') as what", "cast(event_id % 3 as int) as kind",
        "concat('林', cast(user_id % 40 as string)) as mention", "if(event_id % 9 = 0, concat('赵', cast(user_id % 23 as string)), if(event_id % 4 = 0, concat('赵', cast(user_id % 23 as string)), null)) as name", "concat('林', cast(user_id % 40 as string), '来了') as quote",
    )
    return names.resolved(rows)


@query(f"""with {p.STATEMENTS_SQL}, said as (select * from statements where not is_flashback and not is_speculative)
select book, character, arg_max(age_value, pos) filter (where event_type = 'purchase') as age, arg_max(k % 3, pos) filter (where event_type = 'error') as look, count(*) as n from said group by all""")
def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold kept by a stream of arriving statements (2.11)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf_dir, "events").schema.fields)
    rows = append.arriving(spark, sf_dir, "events.parquet", schema).selectExpr(*p.STATEMENTS).selectExpr("*", f"{p.POSITION} as pos")
    folder = scratch.new_folder(spark, "stream")
    return append.run_to_table(append.last_known(rows), f"{folder}/state", f"{folder}/checkpoint")


@query("""with c as (select l_orderkey as person, l_linenumber as chunk, l_suppkey % 4 as place, count(*) as n from lineitem group by all), m as (select *, coalesce(max(n) over (partition by person, place order by chunk rows between unbounded preceding and 1 preceding), 0) as before from c)
select person, chunk, place, greatest(n - before, 0)::bigint as added from m""")
def overlap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that a later chunk adds beyond the most any earlier one had."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("person"), F.col("l_linenumber").alias("chunk"), (F.col("l_suppkey") % 4).alias("place")).agg(F.count("*").alias("n"))
    before = F.max("n").over(Window.partitionBy("person", "place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return c.select("person", "chunk", "place", F.greatest(F.col("n") - F.coalesce(before, F.lit(0)), F.lit(0)).alias("added"))
