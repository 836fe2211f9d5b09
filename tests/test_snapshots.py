"""Kept runs against the whole fold at every chapter, and streams whose chapters come late."""

import random

import pytest
from pyspark.sql import functions as F

from taleweave.operators import core, snapshots
from taleweave.streaming import append

FACTS = "book string, character long, chapter int, pos long, is_flashback boolean, is_speculative boolean, category string, attribute string, num double, num_max double, text string, own_look boolean"
SPANS = "book string, chapter int, pos long, years double"


def rows(seed, chapters=range(0, 25), n=220):
    rng = random.Random(seed)
    facts, spans = [], []
    for i in range(n):
        chapter = rng.choice(list(chapters))
        attribute = rng.choice(["absolute_age", "absolute_age", "life_stage", "eye_color", "hair_color", "died"])
        age = float(rng.randrange(3, 60)) if attribute == "absolute_age" else None
        facts.append((rng.choice("xy"), rng.randrange(5), chapter, chapter * 1000 + i, rng.random() < 0.1, rng.random() < 0.1, "appearance" if attribute.endswith("color") else "other", attribute, age, rng.choice([None, 0.0, 70.0]) if age else None, rng.choice(["a", "b"] if attribute == "life_stage" else [None, "a", "b"]), rng.choice([None, True, False])))
    for i in range(n // 5):
        chapter = rng.choice(list(chapters))
        spans.append((rng.choice("xy"), chapter, chapter * 1000 + n + i, rng.choice([None, 1.0, 2.0, 5.0, 7.0])))
    return facts, spans


def as_set(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


@pytest.mark.parametrize("every", [1, 4, 50])
def test_state_after_every_chapter_is_the_fold(spark, every):
    f, s = rows(every)
    facts, spans = spark.createDataFrame(f, FACTS).cache(), spark.createDataFrame(s, SPANS).cache()
    asked = spark.createDataFrame([(b, n) for b in "xyz" for n in range(-1, 27, 1 if every == 4 else 5)], "book string, n long")
    got = snapshots.state_after(snapshots.summarised(facts, spans, every), facts, spans, asked)
    upto = lambda d: d.join(asked, "book").where("chapter <= n").withColumn("book", F.struct("book", "n")).drop("n")
    whole = core.fold(upto(facts), upto(spans))
    want = whole.select("book.book", "book.n", *[c for c in whole.columns if c != "book"])
    assert as_set(got) == as_set(want) and got.count() > 20
    assert as_set(snapshots.state_now(snapshots.summarised(facts, spans, every))) == as_set(core.fold(facts, spans))


def test_a_changed_chapter_is_read_again_with_its_run_alone(spark):
    f, s = rows(3)
    facts, spans = spark.createDataFrame(f, FACTS), spark.createDataFrame(s, SPANS)
    runs = snapshots.summarised(facts, spans, 4)
    now_f = facts.where("not (book = 'x' and chapter = 9)").unionByName(spark.createDataFrame([("x", 1, 9, 9999, False, False, "other", "absolute_age", 33.0, None, None, None)], FACTS))
    now_s = spans.where("not (book = 'x' and chapter = 9)").unionByName(spark.createDataFrame([("x", 9, 9001, None)], SPANS))
    new, read = snapshots.rebuilt(runs, spark.createDataFrame([("x", 9)], "book string, chapter int"), now_f, now_s)
    assert as_set(snapshots.state_now(new)) == as_set(core.fold(now_f, now_s))
    assert read == now_f.where("book = 'x' and chapter between 8 and 11").count() < facts.count() / 4


def test_restoring_keeps_whole_runs_before_the_cut(spark):
    f, s = rows(4)
    facts, spans = spark.createDataFrame(f, FACTS), spark.createDataFrame(s, SPANS)
    kept, again = snapshots.restored(snapshots.summarised(facts, spans, 4), spark.createDataFrame([("x", 10), ("x", 18)], "book string, chapter int"))
    assert [tuple(r) for r in again.collect()] == [("x", 8)]
    before = lambda d: d.where("book = 'y' or chapter < 8")
    assert as_set(snapshots.state_now(kept)) == as_set(core.fold(before(facts), before(spans)))


def stream_rows(spark, f, s):
    facts = spark.createDataFrame(f, FACTS).withColumns({"is_span": F.lit(False), "years": F.lit(None).cast("double")})
    return facts.unionByName(spark.createDataFrame(s, SPANS).withColumn("is_span", F.lit(True)), allowMissingColumns=True)


def test_chapters_in_any_order_and_a_failed_trigger(spark, tmp_path, monkeypatch):
    f, s = rows(6)
    every = stream_rows(spark, f, s)
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in every.schema.fields)
    order = list(range(25))
    random.Random(1).shuffle(order)
    folder, target, checkpoint = f"{tmp_path}/in", f"{tmp_path}/core", f"{tmp_path}/checkpoint"

    def arrive(chapters):
        every.where(F.col("chapter").isin(chapters)).coalesce(1).write.mode("append").parquet(folder)

    run = lambda: append.run_core(append.arriving(spark, folder, "*.parquet", schema, 1), target, checkpoint, 4)
    expected = lambda chapters: as_set(core.fold(*(spark.createDataFrame([r for r in d if r[2 if d is f else 1] in chapters], k) for d, k in ((f, FACTS), (s, SPANS)))))
    listener = append.Progress()
    spark.streams.addListener(listener)
    arrive(order[:8])
    assert as_set(snapshots.state_now(run())) == expected(order[:8])
    arrive(order[8:15])
    arrive(order[15:20])
    assert as_set(snapshots.state_now(run())) == expected(order[:20])
    arrive(order[20:])
    write = append.write_version

    def fails(tables, where, number):
        next(iter(tables.values())).write.mode("overwrite").parquet(f"{where}/batch={number}/states")
        raise OSError("lost")

    monkeypatch.setattr(append, "write_version", fails)
    with pytest.raises(Exception):
        run()
    old = snapshots.Runs(append.read_version(spark, f"{target}/runs", "states"), append.read_version(spark, f"{target}/runs", "clocks"), 4)
    assert as_set(snapshots.state_now(old)) == expected(order[:20])  # readers still have the last whole version
    monkeypatch.setattr(append, "write_version", write)
    assert as_set(snapshots.state_now(run())) == expected(order)
    spark.streams.removeListener(listener)
    assert len({b for b, n, _ in listener.rows if n}) >= 3
