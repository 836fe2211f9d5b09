"""Near-dedup where doc_ids repeat with different texts, and the pipeline on empty and odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus_ops import SF, components, near_copies, shingles, texts


def by_id(values, ids, size):
    """Smallest id reachable from each id, all rows of an id being one node."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t, size) for t in values]
    for i, c in enumerate(components(sets)):
        if sets[i]:
            a, b = sorted((find(ids[i]), find(ids[c])))
            root[b] = a
    return {i: find(i) for i in ids}


def words(letter, n=60):
    return [f"{letter}{i}" for i in range(n)]


@pytest.mark.parametrize("ids", [[1, 1, 2, 3], [5, 5, 2, 3], [3, 3, 5, 5], [9, 9, 1, 9]])
def test_each_text_of_a_repeated_id_is_compared(spark, ids):
    from taleweave.llm.minhash import near_duplicates

    values = [" ".join(words("x")), " ".join(words("y")), " ".join(words("y")[:-1]), " ".join(words("x")[:-1])]
    got = {r.doc_id: r.component_id for r in near_duplicates(texts(spark, values, ids), 2).collect()}
    assert got == by_id(values, ids, 2) and len(set(got.values())) == 1


def test_an_id_joins_the_classes_of_its_texts(spark):
    from taleweave.llm.minhash import near_duplicates

    # id 8 has copies of two texts that others have too; neither class is named after it
    values = [" ".join(words(x)) for x in "ababc"]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(texts(spark, values, [3, 4, 8, 8, 9]), 2).collect()}
    assert got == {(3, 3), (4, 3), (8, 3), (9, 9)}


@pytest.mark.parametrize("seed", range(3))
def test_random_ids_with_several_texts(spark, seed):
    from taleweave.llm.minhash import near_duplicates

    random.seed(seed)
    values = near_copies(seed)
    ids = [random.randrange(len(values)) for _ in values]
    rows = near_duplicates(texts(spark, values, ids).repartition(3), 2).collect()
    want = by_id(values, ids, 2)
    assert len(rows) == len(values) and all((r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id) for r in rows)


def test_filter_by_few_and_many_keys(spark, monkeypatch):
    from taleweave.llm import keyed

    rows, keys = spark.range(20).withColumnRenamed("id", "k"), spark.createDataFrame([(3,), (5,), (99,)], "k long")
    for most in (10, 1):
        monkeypatch.setattr(keyed, "MOST_KEYS", most)
        assert sorted(r.k for r in keyed.filtered(rows, keys, "k", "left_semi").collect()) == [3, 5]
        assert keyed.filtered(rows, keys, "k", "left_anti").count() == 18


def test_rows_that_share_a_node_number_are_told_apart(spark, monkeypatch):
    import corpus_pipeline as pipeline

    real = F.xxhash64
    # numbers of so few values that different rows share them; the second hash stays whole
    monkeypatch.setattr(pipeline.F, "xxhash64", lambda *c: real(*c) if len(c) != 2 or c[0] == "node" else F.pmod(real(*c), F.lit(3)))
    values = [" ".join(words(x)) for x in "abcdefgh"] * 2 + [" ".join(words("a")[1:])]
    ids = [*range(8), *range(8), 20]
    got = pipeline.near_dedup(spark, texts(spark, values, ids), SF).collect()
    assert sorted(r.doc_id for r in got) == list(range(8))


def test_pipeline_on_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as pipeline

    names = ["node", "second", "row", "solid", "component_id", "rank", "kept", "text_a", "stratum", "length", "piece"]
    for name, n in (("none", 0), ("some", 150)):
        folder = tmp_path / name
        docs = spark.read.parquet(f"{SF}/documents.parquet").limit(n)
        docs.withColumns({c: F.lit(1) for c in names}).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").limit(n).write.parquet(f"{folder}/labels.parquet")
        rows = pipeline.run(spark, str(folder))
        assert (rows.count() > 0) == (n > 0)
        docs.write.parquet(f"{folder}-plain/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").limit(n).write.parquet(f"{folder}-plain/labels.parquet")
        plain = pipeline.run(spark, f"{folder}-plain")
        key = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert sorted(map(tuple, rows.select(*key).collect())) == sorted(map(tuple, plain.select(*key).collect()))
