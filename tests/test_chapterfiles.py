import json
import os

import pytest
from pyspark.sql import functions as F

from taleweave.sources.chapterfiles import read_chapter_files, write_chapter_files

ROWS = [("a", 1, "t", "one\ntwo   three"), ("a", 2, None, ""), ("b", 1, "雪", "雪" * 5000), (None, None, None, None), ("b", 1, "雪", "雪" * 5000)]
KIND = "book string, number long, title string, content string"


@pytest.mark.parametrize("size", [1, 7, 1000, 1 << 26])
def test_round_trip_by_ranges_of_any_size(spark, tmp_path, size):
    rows = ROWS if size > 7 else [r for r in ROWS if len(r[3] or "") < 99]
    write_chapter_files(spark.createDataFrame(rows, KIND).repartition(2), str(tmp_path))
    got = read_chapter_files(spark, str(tmp_path), size).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    where = f"file://{tmp_path}"
    write_chapter_files(spark.createDataFrame(ROWS, KIND), where)
    before = sorted(os.listdir(tmp_path))
    bad = spark.range(9).repartition(3).select(F.lit("x").alias("book"), "id", F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise("y").alias("content")).withColumnRenamed("id", "number")
    with pytest.raises(Exception, match="lost"):
        write_chapter_files(bad, where)
    assert sorted(os.listdir(tmp_path)) == before and read_chapter_files(spark, where).count() == len(ROWS)
    write_chapter_files(spark.createDataFrame([], KIND), where)
    assert read_chapter_files(spark, where).count() == 0


def test_other_encodings_and_places_of_errors(spark, tmp_path):
    lines = ['{"book": "书", "number": 1, "content": "雪"}'.encode("gb18030"), b"", '{"book": "c", "number": 2}'.encode("utf-8-sig"), b"[1]"]
    for n, name in ((3, "good"), (4, "bad")):
        content = b"\n".join(lines[:n])
        os.makedirs(tmp_path / name)
        (tmp_path / name / "x.jsonl").write_bytes(content)
        (tmp_path / name / "selection.json").write_text(json.dumps({"files": [{"name": "x.jsonl", "bytes": len(content)}]}))
    assert [tuple(r) for r in read_chapter_files(spark, str(tmp_path / "good")).collect()] == [("书", 1, None, "雪"), ("c", 2, None, None)]
    with pytest.raises(Exception, match=f"x.jsonl, byte {len(b'|'.join(lines[:3])) + 1}: not a chapter"):
        read_chapter_files(spark, str(tmp_path / "bad")).collect()
