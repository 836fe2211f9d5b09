"""Queries: passage search over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave import scratch
from taleweave.catalog import query
from taleweave.operators import evaluation, index, retrieval
from taleweave.plans.projections import table

#: The stated queries: every hundredth vector, and all benchmark items.
_V = """q as (select vec_id as query, embedding as v from embeddings where vec_id % 100 = 0), s as (select q.query, e.vec_id as passage,
  list_sum(list_transform(list_zip(e.embedding, q.v), lambda x: x[1]::double * x[2]::double)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q.v, lambda x: x::double * x::double)))) as cosine from embeddings e, q),
vr as (select * from (select query, passage, row_number() over (partition by query order by round(cosine, 9) desc, passage) as place from s) where place <= 50)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS + retrieval.LATIN_STOP_WORDS) + "]"
_NAMES = ["Alpha One", "der", "沈墨"]
_HIDDEN = "regexp_replace(lower({t}), 'alpha one|der|沈墨', ' ', 'g')"
_TOK = (
    "list_filter(list_distinct(list_concat(regexp_extract_all(lower({t}), 'alpha one|der|沈墨'), flatten(list_transform(string_split_regex(" + _HIDDEN + ", '[^一-鿿]+'), lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))), "
    "list_filter(string_split_regex(" + _HIDDEN + ", '[^一-鿿]+'), lambda x: length(x) = 1), list_filter(string_split_regex(" + _HIDDEN + ", '[^\\p{{L}}\\p{{N}}]+|[一-鿿]+'), lambda x: x <> ''))), lambda x: not list_contains(" + _STOP + ", x))"
)
_K = f"""dt as (select doc_id as passage, unnest({_TOK.format(t="text")}) as token from documents), qt as (select item_id as query, unnest({_TOK.format(t="text")}) as token from benchmark),
h as (select query, passage, count(*) as hits from dt join qt using (token) group by all), kr as (select * from (select query, passage, row_number() over (partition by query order by hits desc, passage) as place from h) where place <= 50)"""


def indexable(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("passage"), index.source_key(F.col("text"), "whole").alias("source_key"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.vector_ranking(e.where("vec_id % 100 = 0").selectExpr("vec_id as query", "embedding as vector"), e.selectExpr("vec_id as passage", "embedding as vector"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), retrieval.tokens(F.col("text"), _NAMES).alias("tokens"))
    return index.ranked(q, index.built(indexable(table(spark, sf_dir, "documents")), _NAMES).postings)[0]


@query(f"with {_V} select query, passage, place from vr")
def vector_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest passages of each query by cosine."""
    return vectors(spark, sf_dir).select("query", "passage", "place")


@query(f"with {_K} select query, passage, place from kr")
def keyword_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 passages with most of each query's words."""
    return keywords(spark, sf_dir).select("query", "passage", "place")


@query(f"""with {_V}, {_K}, mixed as (select query, passage, 'vector' as src, 0 as o, place from vr union all select query, passage, 'keyword', 1, place from kr),
f as (select query, passage, round(sum(1.0::double / (60 + place)), 6) as score, list_sort(list(src)) as matched_by, min(o * 1000 + place) as first from mixed group by all)
select query, passage, score, matched_by, rank from (select *, row_number() over (partition by query order by score desc, first, passage) as rank from f) where rank <= 5""")
def fused_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings fused."""
    return retrieval.fused({"vector": vectors(spark, sf_dir), "keyword": keywords(spark, sf_dir)})


_PLAIN = "lower(regexp_replace({t}, '[\\s\\p{{P}}\\p{{Z}}\\p{{C}}]', '', 'g'))"
_Q = f"""qx as (select b.item_id as query, d.doc_id as passage from documents d join (select item_id, {_PLAIN.format(t="text")} as wanted from benchmark) b on length(wanted) >= 6 and contains({_PLAIN.format(t="d.text")}, wanted))"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.quoted(table(spark, sf_dir, "benchmark").selectExpr("item_id as query", "text"), table(spark, sf_dir, "documents").selectExpr("doc_id as passage", "text"))


@query(f"with {_Q} select query, passage from qx")
def quoted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that hold a query word for word, punctuation aside."""
    return quotes(spark, sf_dir)


@query(f"""with {_K}, {_Q}, mixed as (select query, passage, 'keyword' as src, 0 as o, place from kr union all select query, passage, 'exact', 9, null from qx),
f as (select query, passage, round(sum(coalesce(1.0::double / (60 + place), 0)), 6) as score, list_sort(list(src)) as matched_by, min(o * 1000 + coalesce(place, 0)) as first from mixed group by all)
select query, passage, score, matched_by, rank from (select *, row_number() over (partition by query order by list_contains(matched_by, 'exact') desc, score desc, first, passage) as rank from f) where rank <= 5""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search with quotes first."""
    return retrieval.fused({"keyword": keywords(spark, sf_dir)}, quotes(spark, sf_dir))


_BIGRAMS = """c as (select {k} as id, text, unnest(range(1, greatest(length(text), 1))) as i from {t}), b as (select id, (unicode(substr(text, i, 1)) * 31 + unicode(substr(text, i + 1, 1))) % 256 as dim from c), n as (select id, dim, count(*)::double as n from b group by all),
l as (select id, sqrt(sum(n * n)) as length from n group by 1)"""


@query(f"with {_BIGRAMS.format(k='item_id', t='benchmark')} select id as item_id, dim, round(n / length, 6) as value from n join l using (id)")
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a vector of hashed character pairs, its places that aren't 0."""
    v = retrieval.embedded(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")
    return v.select("item_id", F.posexplode("vector").alias("dim", "value")).where("value > 0").select("item_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query()
def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search for every benchmark text in documents of some chapters that name a character: vectors, keywords, quotes (R8); held against brute force in the tests."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id as passage", "cast(doc_id % 40 as int) as chapter", "text")
    return retrieval.search(table(spark, sf_dir, "benchmark").selectExpr("item_id as query", "text"), retrieval.in_scope(d, 5, 30, ["the", "der", "la"]).select("passage", "text"), _NAMES)


@query(f"""with {_V}, r as (select vr.*, e.label = z.label as relevant from vr join embeddings e on e.vec_id = passage join embeddings z on z.vec_id = query where passage <> query),
p as (select query, min(place) filter (where relevant) as first, count(*) filter (where relevant and place <= 10) as got, count(*) filter (where relevant) as n from r group by 1)
select round(avg((coalesce(first, 1000000000) <= 5)::int), 4) as hit_5, round(avg((coalesce(first, 1000000000) <= 10)::int), 4) as hit_10, round(sum(got)::double / sum(n), 4) as coverage_10, round(avg(coalesce(1.0::double / first, 0)), 4) as mrr from p""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, coverage and reciprocal rank of the vector ranking."""
    e = table(spark, sf_dir, "embeddings")
    ranked = vectors(spark, sf_dir).where("passage <> query").join(e.selectExpr("vec_id as passage", "label"), "passage").join(e.selectExpr("vec_id as query", "label as wanted"), "query")
    return evaluation.retrieval_metrics(ranked.select("query", "place", (F.col("label") == F.col("wanted")).alias("relevant")))


_EDITED = "case when doc_id % 10 = 3 then concat(coalesce(text, ''), ' Alpha One again') else text end"
_LEFT = "doc_id % 17 <> 5"


@query(f"""with now as (select doc_id as passage, {_EDITED} as text from documents where {_LEFT}), dt as (select passage, unnest({_TOK.format(t="text")}) as token from now),
n as (select count(*) filter (where doc_id % 17 = 5) as dropped, count(*) filter (where doc_id % 17 <> 5 and doc_id % 10 = 3) as rebuilt, count(*) filter (where doc_id % 17 <> 5 and doc_id % 10 <> 3) as kept from documents)
select token, count(*) as passages, sum(passage)::bigint as checksum, any_value(kept) as kept, any_value(rebuilt) as rebuilt, any_value(dropped) as dropped from dt, n group by token""")
def index_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword index after some documents changed and some went: each word's passages, and how many were cut anew."""
    documents = table(spark, sf_dir, "documents")
    old = index.built(indexable(documents), _NAMES)
    folder = scratch.new_folder(spark, "keyword-index")
    index.save(old, folder)
    now = indexable(documents.where(_LEFT).withColumn("text", F.expr(_EDITED)))
    new, counts = index.refreshed(index.load(spark, folder), now, _NAMES)
    index.save(new, folder)
    words = index.load(spark, folder).postings.groupBy("token").agg(F.count("*").alias("passages"), F.sum("passage").alias("checksum"))
    return words.select("*", *[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()])


_PLAIN_TOK = _TOK.replace(_HIDDEN, "lower({t})").replace("regexp_extract_all(lower({t}), 'alpha one|der|沈墨'), ", "")


@query(f"""with b as (select doc_id as passage, list_sort({_PLAIN_TOK.format(t="text")}) as before, list_sort({_TOK.format(t="text")}) as tokens from documents)
select passage, len(before) as n_before, len(tokens) as n_now, list_sort(list_filter(tokens, lambda x: not list_contains(before, x))) as added from b where before <> tokens""")
def index_recut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages whose words change once names are known; only texts that hold one are cut again."""
    documents = table(spark, sf_dir, "documents")
    _, changed = index.recut(index.built(indexable(documents), []), indexable(documents).select("passage", "text"), _NAMES, _NAMES)
    return changed.select("passage", F.size("before").cast("bigint").alias("n_before"), F.size("tokens").cast("bigint").alias("n_now"), F.sort_array(F.array_except("tokens", "before")).alias("added"))
