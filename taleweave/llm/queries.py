"""The corpus operators' queries, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 2-word shingle sets at similarity 0.8 or more."""
    from taleweave.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids by the public ranks, and their bytes decoded again, as digests."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from taleweave.llm.bpe import decode, encode, load_ranks

    codec = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = decode(encode(table(spark, sf_dir, "documents"), codec), codec, text=False)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in as few sequences of 2048 as the reduction and best fit find."""
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from taleweave.llm.packing import pack, token_pieces

    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests, 2048, ["doc_id", "piece", "start", "ids_crc32"])


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, equal payloads as revisits, written to archives and read back."""
    from taleweave.llm.warc_pages import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, their likeness, and block-table searches."""
    from taleweave.llm.simhash import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, the base rules, and the verdict of risk-controlled cutoffs."""
    from taleweave.llm.quality import judged

    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many documents of its source have."""
    from pyspark.sql import functions as F

    from taleweave.llm.lines import without_boilerplate

    rows = without_boilerplate(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


ORACLES["op4_line_dedup"] = r"""
with lines as (select doc_id, source, string_split(text, chr(10)) as parts from documents where text is not null),
flat as (select doc_id, source, unnest(parts) as line, generate_subscripts(parts, 1) as pos from lines),
solid as (select *, length(translate(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0 as has_word from flat),
pages as (select source, count(*) as pages from documents group by source),
counted as (select source, line, count(*) as n from (select distinct doc_id, source, line from solid where has_word) group by source, line),
often as (select source, line from counted join pages using (source) where n >= 5 and n > 0.08 * pages),
marked as (select s.doc_id, s.line, s.pos, o.line is not null as gone from solid s left join often o on o.source = s.source and o.line = s.line),
kept as (
  select doc_id, sum(gone::bigint)::bigint as n_dropped, count(*) as n_lines,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text
  from marked group by doc_id
)
select d.doc_id, case when coalesce(d.text, '') = '' then 0 else k.n_lines end as n_lines, coalesce(k.n_dropped, 0)::bigint as n_dropped,
       length(coalesce(k.text, ''))::bigint as n_chars_left, sha256(coalesce(k.text, '')) as text_sha256
from documents d left join kept k using (doc_id)
"""


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of 200-byte strings that start at two places or more."""
    from pyspark.sql import functions as F

    from taleweave.llm.suffix import without_repeats

    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return rows.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language, learned from four fifths of the documents."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from taleweave.llm.langid import learn_from, load_pieces, predict

    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    model = learn_from(docs.where(remainder != 0), load_pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return predict(docs, model).select("doc_id", (remainder == 0).alias("held_out"), "lang_pred", "score")


@query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text by a recurrent block labeller."""
    from pyspark.sql import functions as F

    from taleweave.llm.htmltext import learn_from, main_text

    pages = table(spark, sf_dir, "pages")
    return main_text(pages, learn_from(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as prefix, middle and suffix in one of three forms, and the text rebuilt from it, as digests."""
    from pyspark.sql import functions as F

    from taleweave.llm.infill import fill_in_middle, restore

    rows = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = r"""
with hashed as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units
  from documents
),
numbers as (
  select *, len(units) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from hashed
),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
         case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from numbers
),
parts as (
  select *, array_to_string(list_slice(units, 1, low), '') as prefix, array_to_string(list_slice(units, low + 1, high), '') as middle, array_to_string(list_slice(units, high + 1, n), '') as suffix
  from cuts
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the four leading components of the distinct vectors, with unit variance."""
    from taleweave.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


@query
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability by a suffix tree learned from four fifths of the documents."""
    from pyspark.sql import functions as F

    from taleweave.llm.suffixtree import learn, score

    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    model = learn(docs.where(remainder != 1))
    tokens = F.lit(model["tree"].tokens).cast("long").alias("train_tokens")
    return score(docs, model).select("doc_id", (remainder == 1).alias("held_out"), "n_tokens", "n_known", tokens, "base_score", "score")
