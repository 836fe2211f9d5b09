"""Keyword index and vector cells against plain rankings, with the work they save, and kept versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleweave.operators import index, retrieval


def words_of(rng, n, vocabulary):
    return [f"w{min(int(rng.expovariate(1) * vocabulary / 5), vocabulary - 1)}" for _ in range(n)]


def passages(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(words_of(rng, rng.randrange(0, 80), 400))) for i in range(n)] + [(n, None), (n + 1, "")]
    return spark.createDataFrame(rows, "passage long, text string").withColumn("source_key", index.source_key(F.col("text"), 500, 100))


def places(df):
    return sorted((r.query, r.passage, r.place) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 50])
def test_bounded_ranking_is_the_plain_one(spark, monkeypatch, k):
    monkeypatch.setattr(index, "PROBED", 20)
    rng = random.Random(k)
    own = index.built(passages(spark), [])
    asked = [(i, words_of(rng, rng.randrange(1, 25), 400) + ["nowhere"] * (i % 2)) for i in range(30)] + [(90, ["w0"]), (91, []), (92, ["nowhere"]), (93, ["w0"] * 3)]
    queries = spark.createDataFrame(asked, "query long, tokens array<string>")
    found, pairs = index.ranked(queries, own.postings, k)
    plain = retrieval.keyword_ranking(queries, own.passages, k)
    assert places(found) == places(plain)
    hits = {(r.query, r.passage): r.hits for r in plain.collect()}
    assert all(r.hits == hits[r.query, r.passage] for r in found.collect())
    every = own.postings.join(queries.select("query", F.explode(F.array_distinct("tokens")).alias("token")), "token").select("query", "passage").distinct().count()
    assert pairs.count() == pairs.select("query", "passage").distinct().count() <= every
    if k == 5:
        assert pairs.count() < every * 0.6


def test_a_changed_text_alone_is_cut_again(spark, tmp_path, monkeypatch):
    first = passages(spark)
    index.save(index.built(first, []), f"{tmp_path}/i")
    now = first.where("passage % 7 <> 0").withColumn("text", F.when(F.col("passage") % 5 == 1, F.concat("text", F.lit(" newword"))).otherwise(F.col("text")))
    now = now.withColumn("source_key", index.source_key(F.col("text"), 500, 100)).union(spark.createDataFrame([(1000, "w1 newword", "k")], "passage long, text string, source_key string"))
    fresh, counts = index.refreshed(index.load(spark, f"{tmp_path}/i"), now, [])
    left = [i for i in range(302) if i % 7]
    changed = [i for i in left if i % 5 == 1 and i < 300]
    assert counts == {"rebuilt": len(changed) + (301 % 5 == 1 and 301 % 7 > 0) + 1, "dropped": 302 - len(left), "kept": len(left) - len(changed) - (301 % 5 == 1 and 301 % 7 > 0)}
    rows = lambda df: sorted((r.token, r.passage, r.n) for r in df.collect())
    assert rows(fresh.postings) == rows(index.built(now, []).postings)
    assert index.save(fresh, f"{tmp_path}/i") == 2
    assert rows(index.load(spark, f"{tmp_path}/i").postings) == rows(fresh.postings)
    assert rows(index.load(spark, f"{tmp_path}/i", 1).postings) == rows(index.built(first, []).postings)


def test_kept_postings_are_lists_of_passages(spark, tmp_path):
    own = index.built(passages(spark).repartition(2), [])
    index.save(own, f"{tmp_path}/i")
    kept = index.load(spark, f"{tmp_path}/i")
    rows = lambda df: sorted((r.token, r.passage, r.n) for r in df.collect())
    assert rows(kept.postings) == rows(own.postings) and kept.lists.count() < own.postings.count() / 2
    assert index.built(passages(spark, 5).where("passage < 0"), []).postings.count() == 0
    index.save(index.built(passages(spark, 5).where("passage >= 5"), []), f"{tmp_path}/empty")
    assert index.load(spark, f"{tmp_path}/empty").postings.count() == 0 and index.load(spark, f"{tmp_path}/empty").passages.count() == 2


def test_a_text_is_cut_once_and_ranked_by_numbers(spark):
    own = index.built(passages(spark), [])
    assert own.postings._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    queries = spark.createDataFrame([(1, ["w1", "w2", "w1"]), (2, ["w0"])], "query long, tokens array<string>")
    plan = index.ranked(queries, own.postings, 5)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "token" not in plan
    ids, cosine = np.array([5, 3, 9, 1]), np.array([0.5, 0.7, 0.5, 0.5])
    assert [retrieval._first(cosine, ids, k).tolist() for k in (1, 2, 4, 9)] == [[1], [1, 3], [1, 3, 0, 2], [1, 3, 0, 2]]


def test_few_changes_shuffle_no_words(spark, tmp_path):
    index.save(index.built(passages(spark), []), f"{tmp_path}/i")
    fresh, counts = index.refreshed(index.load(spark, f"{tmp_path}/i"), passages(spark).where("passage <> 3"), [])
    plan = fresh.passages._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert counts == {"rebuilt": 0, "dropped": 1, "kept": 301} and fresh.passages.count() == 301


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    own = index.built(passages(spark, 20), [])
    with pytest.raises(LookupError):
        index.load(spark, f"{tmp_path}/none")
    index.save(own, f"{tmp_path}/i")
    own.passages.limit(3).write.parquet(f"{tmp_path}/i/v2/passages")  # a writer that died
    assert index.load(spark, f"{tmp_path}/i").passages.count() == 22
    assert index.save(own, f"{tmp_path}/i") == 2 and index.load(spark, f"{tmp_path}/i").passages.count() == 22


def test_new_names_are_cut_in_texts_that_hold_them(spark):
    texts = spark.createDataFrame([(1, "宇智波鼬来了"), (2, "鼬 said hello Big Tom there"), (3, "nothing"), (4, None)], "passage long, text string")
    rows = texts.withColumn("source_key", index.source_key(F.col("text")))
    own = index.built(rows, [])
    new, changed = index.recut(own, texts, ["宇智波鼬", "Big Tom", "x"], ["宇智波鼬", "Big Tom", "x"])
    assert sorted(r.passage for r in changed.collect()) == [1, 2]
    whole = index.built(rows, ["宇智波鼬", "Big Tom"])
    as_sets = lambda i: {r.passage: frozenset(r.tokens) for r in i.passages.collect()}
    assert as_sets(new) == as_sets(whole)
    assert {(r.token, r.passage) for r in new.postings.collect()} == {(r.token, r.passage) for r in whole.postings.collect()}


def test_a_recut_cuts_each_text_once_a_side(spark, monkeypatch):
    monkeypatch.setattr(index.scratch, "stored", lambda df, name: df)
    rows = passages(spark)
    _, changed = index.recut(index.built(rows, []), rows.select("passage", "text"), ["w1 w"], ["w1 w"])
    assert changed._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2


@pytest.mark.parametrize("centres, k", [(1, 3), (7, 5), (64, 50)])
def test_vector_cells_lose_nothing(spark, monkeypatch, centres, k):
    monkeypatch.setattr(retrieval, "CENTRES", centres)
    monkeypatch.setattr(retrieval, "PASSAGE_BLOCK", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(k)
    around = rng.standard_normal((6, 8))
    vectors = np.round(around[rng.integers(0, 6, 200)] + 0.3 * rng.standard_normal((200, 8)), 2)
    vectors[:5], vectors[5:9] = 0, vectors[10]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "passage long, vector array<double>")
    found = retrieval.vector_ranking(rows.where("passage % 9 = 0").withColumnRenamed("passage", "query"), rows, k)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    want = []
    for q in range(0, 200, 9):
        cosine = np.round(unit @ unit[q], 9)
        want += [(q, int(p), place) for place, p in enumerate(np.lexsort((np.arange(200), -cosine))[:k], 1)]
    assert places(found) == sorted(want)


def test_searches_have_no_loops_over_pairs(spark):
    from taleweave import catalog, plans  # noqa: F401

    for name in ("vector_ranking", "keyword_ranking", "fused_ranking", "retrieval_metrics", "search_text", "scoped_search"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    assert retrieval.vector_ranking(*[spark.createDataFrame([], f"{c} long, vector array<double>") for c in ("query", "passage")]).count() == 0
