"""Queries: text functions over every row of a table, each row's input drawn from its columns.

Numerals are written from the numbers of ``lineitem``; texts are the documents. The oracles state what must come out by other means than the functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.catalog import query
from taleweave.functions import text
from taleweave.operators import records
from taleweave.plans import projections as p
from taleweave.plans.projections import table

_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


_DIGIT = "substr('零一二三四五六七八九', cast({d} as int) + 1, 1)"
_UNITS = [_DIGIT.format(d=d) for d in ("1 + l_partkey % 9", "1 + l_suppkey % 9", "1 + l_orderkey % 9", "1 + l_linenumber % 9")]
#: A number's word, by the line: digits by place, digits, thousands to ones, or ten thousands; and one that is none.
_WORD = (
    "case l_linenumber % 5 when 0 then translate(cast(l_partkey + 10 as varchar(20)), '0123456789', '零一二三四五六七八九') when 1 then cast(l_partkey as varchar(20)) "
    f"when 2 then {_UNITS[0]} || '千' || {_UNITS[1]} || '百' || {_UNITS[2]} || '十' || {_UNITS[3]} when 3 then {_UNITS[0]} || '万' || {_UNITS[1]} || '千' else {_UNITS[0]} || '甲' end"
)


@query(f"""select {_ID}, {_WORD} as word, case l_linenumber % 5 when 0 then l_partkey + 10 when 1 then l_partkey when 2 then (1 + l_partkey % 9) * 1000 + (1 + l_suppkey % 9) * 100 + (1 + l_orderkey % 9) * 10 + 1 + l_linenumber % 9
when 3 then (1 + l_partkey % 9) * 10000 + (1 + l_suppkey % 9) * 1000 end as n from lineitem""")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals of every row's numbers read as numbers."""
    rows = table(spark, sf_dir, "lineitem").select(*_ID.split(", "), F.expr(_WORD).alias("word"))
    return rows.select("*", text.parse_number(F.col("word")).alias("n"))


_D = "substr('零一二三四五六七八九', ({d} + 1)::bigint, 1)"


@query(f"""with x as (select {_ID}, l_partkey % 1003 as n from lineitem), y as (select *, n // 100 as h, n // 10 % 10 as t, n % 10 as o from x)
select {_ID}, n, case when n < 1 or n > 999 then null else (case when h > 0 then {_D.format(d='h')} || '百' else '' end) || (case when t > 1 or (t = 1 and h > 0) then {_D.format(d='t')} || '十' when t = 1 then '十' when h > 0 and o > 0 then '零' else '' end)
|| (case when o > 0 then {_D.format(d='o')} else '' end) end as word from y""")
def numbers_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's number written as a numeral."""
    return table(spark, sf_dir, "lineitem").select(*_ID.split(", "), (F.col("l_partkey") % 1003).alias("n")).select("*", text.chinese(F.col("n")).alias("word"))


@query(r"""with q as (select doc_id, text, regexp_replace(substr(text, 1 + length(text) // 3, 40), '^\s+|\s+$', '', 'g') as quote from documents)
select doc_id, quote, case when length(quote) > 0 then strpos(text, quote) - 1 end as at_start, case when length(quote) > 0 then strpos(text, quote) - 1 + length(quote) end as at_end from q""")
def quotes_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a quote from each document first stands in it."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", r"regexp_replace(substr(text, cast(1 + floor(length(text) / 3) as int), 40), '^\\s+|\\s+$', '') as quote")
    return text.located(rows).select("doc_id", "quote", "at_start", "at_end")


#: Each non-blank line of a document, from the k = 0th, becomes a chapter of a book: seven to a volume, of which
#: the fifth skips two numbers and the sixth is misprinted as 3; two lines of text look like headings and aren't.
_NUMBERED = "k % 7 + 1 + case when k % 7 >= 4 then 2 else 0 end"
_HEAD = f"""case when k % 7 = 5 then concat('第3章 误', cast(k as {{s}})) when k % 3 = 0 then concat('第', cast({_NUMBERED} as {{s}}), '章 起', cast(k as {{s}}))
 when k % 3 = 1 then concat('第', substr('一二三四五六七八九', cast({_NUMBERED} as int), 1), '回　承', cast(k as {{s}})) else concat('第', substr('一二三四五六七八九', cast({_NUMBERED} as int), 1), '章转', cast(k as {{s}})) end"""
_VOLUME = "case when k > 0 and k % 7 = 0 then concat('第', cast(cast(floor(k / 7) as int) + 1 as {s}), '卷 风云', chr(10)) else '' end"
_BODY = "concat(line, chr(10), '第九十章，他走了。', chr(10), '第二部电影上映那天，他没去。')"


@query(rf"""with l as (select doc_id, unnest(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_matches(x, '[^\s\p{{Z}}]'))) as line,
 generate_subscripts(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_matches(x, '[^\s\p{{Z}}]')), 1) - 1 as k from documents where text is not null)
select doc_id as book, (k + 1)::integer as number, {_HEAD.format(s='varchar')} as title, sha256({_BODY}) as content_sha256 from l""")
def chapters_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a book of many chapters and volumes, cut at its headings again."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split(text.normalize_newlines(F.col("text")), "\n", -1).alias("lines"))
    solid = F.filter("lines", lambda x: x.rlike(r"(?U)[^\s\p{Z}]"))
    of = lambda sql: F.expr(f"transform(solid, (line, k) -> {sql})")
    chapter = f"concat({_VOLUME.format(s='string')}, {_HEAD.format(s='string')}, chr(10), {_BODY})"
    books = d.select("doc_id", solid.alias("solid")).select(F.col("doc_id").alias("book"), F.concat(F.lit("\ufeff题\r\n"), F.array_join(of(chapter), "\r\n")).alias("text"))
    return text.split_books(books.where("text <> '\ufeff题\r\n'")).select("book", "number", "title", F.sha2("content", 256).alias("content_sha256"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-blank lines of each document; every seventh document has notes put before and after."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    head, tail = F.array(F.lit("PS：thanks"), F.lit("（作者有话说） hi")), F.array(F.lit("作者的话：bye"), F.lit("see you"))
    noted = F.when(F.col("doc_id") % 7 == 0, F.concat(head, lines, tail)).otherwise(lines)
    return d.select(F.col("source").alias("book"), F.col("doc_id").alias("number"), F.posexplode(noted).alias("i", "line"))


@query(r"""with l as (select source as book, doc_id as number, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0) as lines from documents where text is not null),
n as (select book, number, case when number % 7 = 0 then list_concat(['PS：thanks', '（作者有话说） hi'], lines, ['作者的话：bye', 'see you']) else lines end as lines from l),
f as (select book, number, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as i, len(lines) // 2 as half, len(lines) as n from n),
m as (select *, regexp_matches(line, '^\s*([【\[（(]\s*(作者有话说|ps|the)\s*[】\]）)]|(作者有话说|作者的话|题外话|p\.?s\.?|the)\s*([:：]|$|\s))', 'i') as note from f),
e as (select book, number, n, half, min(i) filter (where not note) as plain, min(i) filter (where note and i >= half) as tail_from from m group by book, number, n, half)
select book, number, false as tail, 0 as first, least(half, coalesce(plain, n))::bigint as last from e where least(half, coalesce(plain, n)) > 0 union all select book, number, true, tail_from::integer, n from e where tail_from is not null""")
def note_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of author's notes at each document's ends, by built-in and a registered marker."""
    return text.note_runs(_lines(spark, sf_dir), ["the"]).select("book", "number", "tail", "first", F.col("last").cast("bigint").alias("last"))


@query("""with d as (select doc_id, text, length(text) // 2 as s from documents where length(text) > 0), g as (select doc_id, pad, substr(text, (greatest(s - pad, 0) + 1)::bigint, (least(s + 1 + pad, length(text)) - greatest(s - pad, 0))::bigint) as w, text from d, (select unnest(range(0, 41, 5)) as pad))
select doc_id, min(pad) filter (where (length(text) - length(replace(text, w, ''))) = length(w))::integer as pad from g group by doc_id""")
def unique_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the middle character of each document must grow before its text occurs once."""
    rows = table(spark, sf_dir, "documents").where("length(text) > 0").selectExpr("doc_id", "text", "cast(floor(length(text) / 2) as int) as s", "cast(floor(length(text) / 2) as int) + 1 as e")
    return rows.select("doc_id", text.window_pad("text", "s", "e").alias("pad"))


_AGES = r"select doc_id, len(regexp_extract_all(replace(text, ' ', '岁'), '[\d零〇一二两三四五六七八九十百几]+岁')) as mentions from documents"


@query(_AGES)
def age_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated ages in each text (X32); a number before a blank stands for one."""
    return table(spark, sf_dir, "documents").select("doc_id", text.age_mentions(F.replace("text", F.lit(" "), F.lit("岁"))).alias("mentions"))


@query(f"with {p.CHAPTERS_SQL}, a as ({_AGES}), r as (select c.book, c.number, a.mentions, row_number() over (partition by c.book order by mentions desc, number) as place from chapters c join a using (doc_id) where number >= 4) select book, number, mentions from r where place <= 2")
def dense_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two chapters of each book with most stated ages."""
    rows = p.chapter_numbers(spark, sf_dir).join(age_mentions(spark, sf_dir), "doc_id")
    return records.dense_first(rows.select("book", "number", "mentions"))


@query("""with recursive c as (select doc_id, 0::bigint as start, least(length(text), 8000)::bigint as "end" from documents where length(text) > 0 union all
select doc_id, case k when 0 then start else m - 100 end, case k when 0 then m + 100 else "end" end from (select doc_id, start, "end", start + ("end" - start) // 2 as m, unnest([0, 1]) as k from c where "end" - start > 1000 and ("end" - start > 3000 or (doc_id + start) % 3 = 0)))
select * from c where not ("end" - start > 1000 and ("end" - start > 3000 or (doc_id + start) % 3 = 0))""")
def chunks_halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose reply was cut off, halved until it wasn't or they are small."""
    rows = table(spark, sf_dir, "documents").where("length(text) > 0").selectExpr("doc_id", "0L as start", "cast(least(length(text), 8000) as bigint) as end")
    return text.halved(rows, "end - start > 3000 or (doc_id + start) % 3 = 0")


_READS = ["l_orderkey as run", "l_linenumber * 100000 + l_partkey as seq", "l_partkey % 5000 as start", "l_partkey % 5000 + l_suppkey * 37 % 2600 as {end}", "l_suppkey"]


@query(f"""with r as (select {', '.join(_READS).replace('{end}', '"end"')} from lineitem), s as (select *, least("end" - start, 2000) as size from r),
b as (select *, coalesce(sum(size) over (partition by run order by seq, l_suppkey rows between unbounded preceding and 1 preceding), 0) as before from s),
x as (select run, seq, l_suppkey, start, start + greatest(least(size, 3000 - before), 0)::bigint as stop, "end" - start > 2000 as cut from b)
select *, list_filter([[100, 400], [2000, 2600]], lambda n: n[1] < stop and start < n[2]) as notes from x""")
def capped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that an agent's run may read, with the author's notes in them."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[x.replace("{end}", "`end`") for x in _READS])
    return records.capped_reads(rows, ["seq", "l_suppkey"], [(100, 400), (2000, 2600)]).select("run", "seq", "l_suppkey", "start", "stop", "cut", "notes")


@query()
def passages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place of each document read with its sentences around it (R9); held against brute force in the tests."""
    rows = table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "text", "cast(floor(length(text) / 3) as int) as start", "cast(floor(length(text) / 3) as int) + 40 as end")
    return text.read_passages(rows).select("doc_id", "begin", "stop", "focus_start", "focus_end")


@query("""with a as (select o_orderkey as q, [o_custkey % 5 - 1, o_custkey % 7 - 1, o_orderkey % 3 - 1] as clues, [o_orderpriority, o_orderstatus, o_orderpriority || '!'] as reasons from orders), x as (select q, unnest(clues) as clue, unnest(reasons) as reason, generate_subscripts(clues, 1) - 1 as n from a)
select q, n::integer as n, clue, reason from x where clue <> -1""")
def question_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's clue places with their reasoning; those without a place left out."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as q", "array(o_custkey % 5 - 1, o_custkey % 7 - 1, o_orderkey % 3 - 1) as clues", "array(o_orderpriority, o_orderstatus, o_orderpriority || '!') as reasons")
    return records.clue_questions(rows)


@query("""with n as (select o_custkey % 50 as book, 'n' || (o_orderkey % 90) as name, o_orderkey as character, o_orderstatus = 'F' as canonical from orders), w as (select book, name, arg_min(character, (case when canonical then 0 else 1000000000000 end) + character) as who from n group by all),
s as (select l_orderkey as id, l_linenumber as line, l_partkey, l_suppkey % 50 as book, case when l_partkey % 2 = 0 then 'n' || (l_partkey % 120) end as other_name, 'n' || (l_orderkey % 120) as other_mention from lineitem)
select s.*, coalesce(a.who, b.who) as other from s left join w a on a.book = s.book and a.name = s.other_name left join w b on b.book = s.book and b.name = s.other_mention""")
def kin_other_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a kinship statement's other side means: by name, else by mention."""
    names_ = table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 as book", "'n' || (o_orderkey % 90) as name", "o_orderkey as character", "o_orderstatus = 'F' as canonical")
    said = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as id", "l_linenumber as line", "l_partkey", "l_suppkey % 50 as book", "if(l_partkey % 2 = 0, 'n' || (l_partkey % 120), null) as other_name", "'n' || (l_orderkey % 120) as other_mention")
    return records.other_side(said, names_).select("id", "line", "l_partkey", "book", "other_name", "other_mention", "other")


@query(f"""with {p.CHAPTERS_SQL} select book, number, doc_id % 4 <> 0 and doc_id % 3 <> 0 and doc_id % 5 <> 0 as held, case when doc_id % 4 <> 0 and doc_id % 3 <> 0 and doc_id % 5 <> 0 then number * 130 + 10 end as start,
case when doc_id % 4 <> 0 and doc_id % 3 <> 0 and doc_id % 5 <> 0 then substr(content, 11, 20) end as quote from chapters where length(content) >= 40""")
def readings_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored readings whose text, version and quotes still hold, moved to the chapter's new place."""
    c = p.chapters(spark, sf_dir).where("length(content) >= 40")
    # a quote put wrong is cut short too, so that it can't stand there by chance
    wrong = "doc_id % 5 = 0"
    statement = f"array(named_struct('quote', if({wrong}, '\\u0001', substr(content, 11, 20)), 'start', number * 100 + 10, 'end', number * 100 + 30))"
    stored = c.selectExpr("book", "number", "sha2(if(doc_id % 4 = 0, concat(content, '!'), content), 256) as content_hash", "if(doc_id % 3 = 0, 'v1', 'v2') as version", "number * 100 as begin", f"to_json({statement}) as statements")
    got = records.shifted_readings(stored, c.selectExpr("book", "number", "content", "number * 130 as begin"), "v2")
    first = F.get(F.from_json("statements", "array<struct<quote:string,start:bigint,end:bigint>>"), 0)
    return got.select("book", "number", F.col("statements").isNotNull().alias("held"), first["start"].alias("start"), first["quote"].alias("quote"))


@query(f"with {p.CHAPTERS_SQL} select book, min(number) as number from chapters where doc_id % 7 = 3 group by book")
def notes_rescanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's first chapter whose story text a new note marker changes."""
    c = p.chapters(spark, sf_dir)
    return records.recompute_from(c.selectExpr("book", "number", "content as story"), c.selectExpr("book", "number", "if(doc_id % 7 = 3, concat(content, '.'), content) as story"))


@query(f"""with {p.CHAPTERS_SQL}, n as (select book, max(number) + 1 as number from chapters group by book)
select book, number, sha256(coalesce(case when number % 9 = 2 then 'new' || chr(10) || 'text' else content end, '')) as content_sha256 from chapters union all select book, number, sha256('the end') from n""")
def chapters_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books after replacing some chapters and appending one."""
    c = p.chapters(spark, sf_dir).select("book", "number", F.coalesce("content", F.lit("")).alias("content"))
    new = c.where("number % 9 = 2").select("book", "number", F.lit("new\r\ntext").alias("content"))
    more = c.select("book").distinct().withColumn("content", F.lit("the end"))
    return records.appended(records.replaced(c, new), more).select("book", "number", F.sha2("content", 256).alias("content_sha256"))


@query("""with l as (select source, doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null), s as (select * from l where length(trim(line, ' ')) > 0)
select source, count(distinct doc_id) as chapters, count(*) as examined, count(*) filter (where regexp_matches(line, '^\\s*the(\\s*[:：]|\\s*$|\\s)', 'i')) as flagged from s group by source""")
def note_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmarked paragraphs examined and flagged as notes, by book."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = d.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0)
    return lines.groupBy("source").agg(F.countDistinct("doc_id").alias("chapters"), F.count("*").alias("examined"), F.count_if(text.is_note(F.col("line"), ["the"])).alias("flagged"))
