"""Hybrid passage search for many queries at once: cosine, keywords, rank fusion, exact quotes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave.functions.text import by_size
from taleweave.scratch import stored

#: Candidates of each ranking, the constant of reciprocal rank fusion, the shortest quote (fixed values).
CANDIDATES, RRF_K, QUOTE_CHARS = 50, 60, 6
#: Vectors of a block of passages and of queries; characters of quotes that a task looks for at once.
PASSAGE_BLOCK, QUERY_BLOCK, QUOTE_BLOCK = 4096, 1024, 8_000_000
#: Cells that vectors are dealt to, at most.
CENTRES = 256
#: Words too frequent to match by (fixed values).
STOP_WORDS = ["的", "了", "着", "是", "在", "和", "与", "也", "就", "都", "而", "及", "或", "一个", "这", "那", "他", "她", "它", "我", "你", "们", "吗", "呢", "吧", "啊"]
LATIN_STOP_WORDS = ["the", "of", "and", "to", "in", "is", "de", "la", "le", "der", "die", "und", "el", "en"]
#: Places of an embedding.
DIMENSIONS = 256


def _top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` of each query. The rank limit is taken in each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("bigint")
    return rows.withColumn("place", place).where(F.col("place") <= k)


def _unit(vectors: Iterable) -> np.ndarray:
    """Rows scaled to length 1; zero stays zero."""
    m = np.asarray(list(vectors), np.float64)
    m = m.reshape(len(m), -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def _first(cosine: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest, ties by id; only those that reach the k-th are sorted."""
    at = np.flatnonzero(cosine >= np.partition(cosine, -k)[-k]) if k < len(cosine) else np.arange(len(cosine))
    return at[np.lexsort((ids[at], -cosine[at]))[:k]]


def _cells(passages: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(cell, block, ids, values, angle)``: unit vectors by their nearest centre, in blocks, with each block's widest angle from it."""
    shipped = passages.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                m = _unit(batch["vector"])
                cosine = m @ shipped.value.T
                cell = cosine.argmax(axis=1)
                yield pd.DataFrame({"id": batch["id"], "vector": list(m), "cell": cell, "angle": np.arccos(np.clip(cosine[np.arange(len(m)), cell], -1, 1))})

    rows = passages.select(F.col("passage").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    placed = stored(rows.mapInPandas(nearest, "id long, vector array<double>, cell int, angle double"), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))  # a row for each centre at most
    split = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.floor(F.col("n") / PASSAGE_BLOCK) + 1))
    packed = split.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "vector")).alias("vs"), F.max("angle").alias("angle"))
    return stored(packed.select("cell", "block", F.col("vs.id").alias("ids"), F.flatten("vs.vector").alias("values"), "angle"), "cells")


def _products(asked: DataFrame, cells: DataFrame, parts: int, k: int) -> DataFrame:
    """``asked(query, vector, cell, block)`` -> the ``k`` nearest of each query in each block, ``(query, passage, cosine)``.

    Queries meet blocks by key; those of one block are packed in ``parts``, so a pair of blocks is one product of matrices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a batch holds many pairs of blocks; only one is multiplied at a time
                q_ids, q_values, p_ids, p_values = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(4))
                # rounded, so that sums taken in another order give the same places
                cosine = np.round(q_values.reshape(len(q_ids), -1) @ p_values.reshape(len(p_ids), -1).T, 9)
                best = [_first(one, p_ids, k) for one in cosine]
                of = np.repeat(np.arange(len(q_ids)), [len(x) for x in best])
                at = np.concatenate(best)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[of]), pa.array(p_ids[at]), pa.array(cosine[of, at])], names=["query", "passage", "cosine"])

    key = ["cell", "block"]
    packed = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts))).groupBy(*key, "part").agg(F.collect_list(F.struct("query", "vector")).alias("qs"))
    met = packed.select(*key, F.col("qs.query").alias("q_ids"), F.flatten("qs.vector").alias("q_values")).join(cells, key)
    return met.select("q_ids", "q_values", "ids", "values").mapInArrow(run, "query long, passage long, cosine double")


def vector_ranking(queries: DataFrame, passages: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """``queries(query, vector)``, ``passages(passage, vector)`` -> places by cosine, ties by passage. Exact.

    Passages lie in cells around ``CENTRES`` of their own number; a query first meets the cells
    nearest to it, until they hold ``k`` passages. A cell whose widest angle keeps it below the
    k-th of those is never met. A zero vector has cosine 0.
    """
    spark = passages.sparkSession
    sample = passages.select(F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("vector")).limit(CENTRES).collect()
    if not sample:
        return spark.createDataFrame([], "query long, passage long, cosine double, place long")
    centres = _unit(r["vector"] for r in sample)
    cells = _cells(passages, centres)
    blocks = cells.select("cell", "block", F.size("ids").alias("n"), "angle")
    bounds = blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")).toPandas()  # a row for each centre at most
    shipped = spark.sparkContext.broadcast((centres[bounds["cell"]], bounds["cell"].to_numpy(), bounds["n"].to_numpy(), bounds["angle"].to_numpy()))

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        around, names, sizes, wide = shipped.value
        for batch in batches:
            if len(batch):
                m = _unit(batch["vector"])
                # no vector of a cell is nearer to the query than its centre less the cell's width
                apart = np.arccos(np.clip(m @ around.T, -1, 1)) - wide[None, :]
                top = np.where(~m.any(axis=1)[:, None], 1.0, np.cos(np.clip(apart, 0, np.pi)) + 1e-8)
                for i, row in zip(batch["query"], top):
                    order = np.argsort(-row, kind="stable")
                    before = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
                    yield pd.DataFrame({"query": i, "cell": names[order], "first": before < k, "most": row[order]})

    own = queries.select(F.col("query").cast("bigint").alias("query"), F.col("vector").cast("array<double>").alias("vector"))
    met = stored(own.mapInPandas(bounded, "query long, cell int, first boolean, most double"), "bounds")
    scaled = lambda batches: (pd.DataFrame({"query": b["query"], "vector": list(_unit(b["vector"]))}) for b in batches if len(b))
    units = stored(own.mapInPandas(scaled, "query long, vector array<double>"), "units")
    parts = units.count() // QUERY_BLOCK + 1

    def products(rows: DataFrame) -> DataFrame:
        asked = rows.join(blocks.select("cell", "block"), "cell").select("query", "cell", "block").join(units, "query")
        return _products(asked, cells, parts, k)

    near = stored(products(met.where("first")), "near")
    order = [F.col("cosine").desc(), F.col("passage")]
    least = _top(near, order, k).where(F.col("place") == k).select("query", F.col("cosine").alias("least"))
    rest = met.where("not first").join(least, "query", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least")))
    return _top(near.unionByName(products(rest)), order, k)


def embedded(rows: DataFrame, key: str, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """``(key, vector)``: counts of neighbouring characters, hashed to ``dimensions`` places and scaled to length 1.

    The stand-in for an embedding model; a text of fewer than two characters has the zero vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in by_size(batch)):
            vectors = np.zeros((part.num_rows, dimensions))
            for v, t in zip(vectors, part.column(1).to_pylist()):
                c = np.frombuffer((t or "").encode("utf-32-le"), "<u4").astype(np.int64)
                v += np.bincount((c[:-1] * 31 + c[1:]) % dimensions, minlength=dimensions)
                v /= np.sqrt((v * v).sum()) or 1.0
            places = np.arange(part.num_rows + 1, dtype=np.int32) * dimensions
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(places), pa.array(vectors.ravel()))], names=[key, "vector"])

    return rows.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, vector array<double>")


_CJK = "一-鿿"
_RUN = re.compile(f"[{_CJK}]+")


def _words(texts: pa.Array, taken: re.Pattern | None) -> pa.Array:
    """The distinct words of each lower-cased text; ``taken`` finds the names."""
    texts, named = texts.to_pylist(), []
    if taken:
        cut = [None if t is None else taken.split(t) for t in texts]
        texts, named = [None if c is None else " ".join(c[::2]) for c in cut], [c and c[1::2] for c in cut]
    plain = pc.replace_substring_regex(pa.array(texts, pa.large_string()), "[^\\pL\\pN]+", " ")
    found = []
    for i, (t, chinese) in enumerate(zip(plain.to_pylist(), pc.match_substring_regex(plain, f"[{_CJK}]").to_pylist())):
        if t is None:
            found.append(None)
            continue
        words = dict.fromkeys(named[i] if named else [])
        if chinese:
            for run in _RUN.findall(t):
                words.update(dict.fromkeys([run[j : j + 2] for j in range(len(run) - 1)] or [run]))
            t = _RUN.sub(" ", t)
        words.update(dict.fromkeys(t.split()))
        for w in STOP_WORDS + LATIN_STOP_WORDS:
            words.pop(w, None)
        found.append(list(words))
    return pa.array(found, pa.list_(pa.string()))


def tokens(text: Column, names: list[str] | None = None) -> Column:
    """The distinct words of a text, lower-cased, stop words dropped.

    Names of two characters or more are words wherever they stand, the longest first; of other
    runs of Chinese characters each neighbouring pair is one (or the one character of a run of
    one), of letters and digits each run.
    """
    known = sorted({n.strip().lower() for n in names or [] if len(n.strip()) >= 2}, key=lambda n: (-len(n), n))
    taken = re.compile(f"({'|'.join(map(re.escape, known))})") if known else None

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        parts = [_words(part, taken) for part in by_size(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return cut(F.lower(text))


def keyword_ranking(queries: DataFrame, passages: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """``queries(query, tokens)``, ``passages(passage, tokens)`` -> places by distinct query words present, ties by passage.

    Words are joined, so only passages that share one are touched.
    """
    q = queries.select("query", F.explode(F.array_distinct("tokens")).alias("token"))
    p = passages.select("passage", F.explode(F.array_distinct("tokens")).alias("token"))
    hits = p.join(q, "token").groupBy("query", "passage").agg(F.count("*").alias("hits"))
    return _top(hits, [F.col("hits").desc(), F.col("passage")], k)


def fused(rankings: dict[str, DataFrame], exact: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Rankings -> ``(query, passage, score, matched_by, rank)`` by reciprocal rank fusion.

    Passages that hold the query word for word come first; ties go by the place in the first
    ranking, then in the next, then by passage.
    """
    both = None
    for i, (name, ranking) in enumerate(rankings.items()):
        rows = ranking.select("query", "passage", F.lit(name).alias("by"), F.lit(i).alias("order"), "place")
        both = rows if both is None else both.unionByName(rows)
    if exact is not None:
        both = both.unionByName(exact.select("query", "passage", F.lit("exact").alias("by"), F.lit(9).alias("order"), F.lit(None).cast("bigint").alias("place")))
    scores = both.groupBy("query", "passage").agg(
        F.round(F.sum(F.when(F.col("place").isNull(), 0.0).otherwise(1 / (RRF_K + F.col("place")))), 6).alias("score"), F.array_sort(F.collect_set("by")).alias("matched_by"),
        F.min(F.struct("order", "place")).alias("first"),
    )
    order = [F.array_contains("matched_by", "exact").desc(), F.col("score").desc(), F.col("first"), F.col("passage")]
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("bigint")
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "passage", "score", "matched_by", "rank")


def plain(text: Column) -> Column:
    """Text as quotes are compared: lower case, without white space, punctuation and control characters."""
    return F.lower(F.regexp_replace(text, "[\\s\\p{P}\\p{Z}\\p{C}]", ""))


def quoted(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """``queries(query, text)``, ``passages(passage, text)`` -> passages that contain a query as a quote.

    Queries of fewer than ``QUOTE_CHARS`` characters, punctuation aside, aren't quotes. The stated
    queries are looked for all at once, in one pass over a passage's characters; beyond
    ``QUOTE_BLOCK`` characters of queries there is a pass for each block of them.
    """
    q = queries.select("query", plain(F.col("text")).alias("wanted")).where(F.length("wanted") >= QUOTE_CHARS)
    p = passages.select("passage", plain(F.col("text")).alias("plain"))
    blocks = (q.agg(F.sum(F.length("wanted"))).first()[0] or 0) // QUOTE_BLOCK + 1
    kinds = dict(q.dtypes)["query"], dict(p.dtypes)["passage"]

    def search(block: int) -> DataFrame:
        wanted: dict[str, list] = {}
        for r in q.where(F.pmod(F.xxhash64("wanted"), F.lit(blocks)) == block).collect():  # about QUOTE_BLOCK characters
            wanted.setdefault(r["wanted"], []).append(r["query"])
        shipped = passages.sparkSession.sparkContext.broadcast(wanted)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for key, ids in shipped.value.items():
                machine.add_word(key, ids)
            machine.make_automaton()
            for batch in batches:
                rows = [(i, passage) for passage, t in batch.itertuples(index=False) if t and len(machine) for i in {i for _, ids in machine.iter(t) for i in ids}]
                yield pd.DataFrame(rows, columns=["query", "passage"])

        return p.mapInPandas(run, f"query {kinds[0]}, passage {kinds[1]}")

    out = search(0)
    for block in range(1, blocks):
        out = out.unionByName(search(block))
    return out


def in_scope(passages: DataFrame, first: int | None = None, last: int | None = None, names: list[str] | None = None) -> DataFrame:
    """``passages(chapter, text, ...)`` of a range of chapters that contain any of a character's names."""
    rows = passages.where(F.col("chapter").between(first or 1, last or 100_000))
    if names is None:
        return rows
    found = F.lit(False)
    for n in names:
        found = found | F.contains(F.col("text"), F.lit(n))
    return rows.where(found)


def search(queries: DataFrame, passages: DataFrame, names: list[str] | None = None, k: int = 5) -> DataFrame:
    """``queries(query, text)``, ``passages(passage, text)`` -> the ``k`` best of each query: vectors and keywords fused, quotes first."""
    vectors = vector_ranking(embedded(queries, "query"), embedded(passages, "passage"))
    words = lambda d, key: d.select(key, tokens(F.col("text"), names).alias("tokens"))
    return fused({"vector": vectors, "keyword": keyword_ranking(words(queries, "query"), words(passages, "passage"))}, quoted(queries, passages), k)
