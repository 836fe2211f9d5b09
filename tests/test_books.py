"""Headings and chapters, spans widened to sentences, and the walk that resolves names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from taleweave.functions import names, text
from taleweave.graph import smallest_reachable


def kinds(spark, *lines):
    df = spark.createDataFrame([(list(lines),)], "lines array<string>").select(text.headings(F.col("lines")).alias("m"))
    found = {r["at"]: r["kind"] for r in df.first()["m"]}
    return [found.get(i, "text") for i in range(len(lines))]


def test_headings_in_and_out_of_sequence(spark):
    assert kinds(spark, "第一章 起", "第二章 承", "第二章 下", "第九章 跳") == ["heading"] * 4
    assert kinds(spark, "第一章 起", "第五十章，他走了") == ["heading", "text"]
    assert kinds(spark, "第182章 甲", "第一八十三章 误", "第184章 乙") == ["heading"] * 3
    assert kinds(spark, "第三章 起", "第二卷 风云", "第一章 再起", "第二部电影上映那天，他没去。") == ["heading", "volume", "heading", "text"]
    assert kinds(spark, "尾声渐远", "尾声", "第一卷 第七章 浮游") == ["text", "heading", "heading"]
    assert kinds(spark, "第一卷 第九章 甲", "第二卷 第一章 乙", "第二卷 第二章 丙") == ["heading"] * 3
    assert kinds(spark, "第５章 全角", "第六章" + "长" * 60, "第七章" + "长" * 120, "第三卷的书稿") == ["heading", "heading", "text", "text"]
    assert kinds(spark, "第九章 甲", "第一章 来暗杀他的人。", "第一章 又起", "第2章 再") == ["heading", "text", "heading", "heading"]


def test_chapters_of_books(spark):
    def chapters(t):
        rows = text.split_books(spark.createDataFrame([(1, t)], "book int, text string")).orderBy("number").collect()
        return [(r.number, r.title, r.content) for r in rows]

    assert chapters(None) == chapters("") == chapters(" \n　") == [] and chapters("\n 正文 \n") == [(1, "全文", "正文")]
    assert chapters("﻿前言\r\n第一章 甲\r\n\r\na\r\nb\r\n第二章 空\r第三章 丙\n　c\n\n") == [(1, "第一章 甲", "a\nb"), (2, "第三章 丙", "　c")]
    assert chapters("第一章 甲\na\n第二卷 风\nb\n第一章 乙\nc") == [(1, "第一章 甲", "a\nb"), (2, "第一章 乙", "c")]
    assert chapters("第一章 甲\n第二章 乙") == []


def test_corpora_that_split_as_stated(spark):
    from taleweave.sources.books import consistent

    rows = [("good", ["第一章 甲\na", "第二章 乙\nb"]), ("bad", ["第一章 甲\na", "b"]), ("none", []), ("good", ["x"])]
    kept = consistent(spark.createDataFrame(rows, "novel string, chapters array<string>"))
    assert sorted((r.novel, len(r.chapters)) for r in kept.collect()) == [("good", 1), ("good", 2), ("none", 0)]


def test_spans_are_widened_to_sentences():
    rng = random.Random(2)
    for _ in range(400):
        t = "".join(rng.choice("ab 。！\n”c") for _ in range(rng.randrange(0, 60)))
        start, end, context = rng.randrange(-3, 65), rng.randrange(-3, 65), rng.randrange(0, 20)
        begin, stop, a, b = text.read_around(t, start, end, context)
        first, last = sorted(min(max(x, 0), len(t)) for x in (start, end))
        ends = [m.end() for m in re.finditer(text.SENTENCE_END, t)] + [len(t)]
        near = [e for e in [0, *ends] if first - context <= e <= first]
        far = [e for e in ends if last <= e <= last + context]
        want = near[0] if near else max(0, first - context)
        while want < first and t[want].isspace():
            want += 1
        assert (begin, stop) == (want, far[-1] if far else min(len(t), last + context)), (t, start, end, context)
        assert t[begin + a : begin + b] == t[first:last]


def resolved(spark, rows, schema="book string, chapter int, seq int, what string, mention string, name string, quote string, kind int"):
    return names.resolved(spark.createDataFrame(rows, schema))


def who(log):
    return {(r.chapter, r.seq): r.character for r in log if r.what == "statement"}


def test_names_are_made_given_revealed_and_merged(spark):
    say = lambda c, s, mention, name=None, quote="", kind=0: ("b", c, s, "statement", mention, name, quote, kind)
    rows = [
        say(1, 1, "疤脸刀客"), say(1, 2, "赵无极老先生", "赵无极", "赵无极老先生来了"), say(1, 3, "赵无极老先生"), say(1, 4, "他"), say(1, 5, "雪娘", "赵无极", "雪娘"), say(1, 6, "雪娘"), say(1, 7, None, None, None),
        ("b", 2, 1, "reveal", "疤脸刀客", "赵无极", None, 0), ("b", 2, 2, "reveal", "nobody", "某人", None, 0), say(2, 3, "赵无极"), say(2, 4, "衡王", "朱允熞", "衡王朱允熞到了"), say(2, 5, "衡王"),
    ]
    log = resolved(spark, rows).collect()
    people = who(log)
    assert people[1, 1] != people[1, 2] == people[1, 3] == people[1, 5] and people[1, 4] is None and people[1, 7] is None
    assert people[1, 6] not in (people[1, 1], people[1, 2], None)  # a name without evidence isn't kept
    assert people[2, 3] == people[1, 1] and people[2, 4] == people[2, 5]
    assert sorted((r.what, r.name, r.into) for r in log if (r.chapter, r.seq) == (2, 1)) == [("alias", "疤脸刀客", None), ("merge", "赵无极", people[1, 1]), ("rename", "赵无极", None)]
    assert sum(r.what == "statement" for r in log) == 10 and resolved(spark, rows).where("chapter = 2 and seq = 2").count() == 0


def readings(seed, n=250):
    rng = random.Random(seed)
    surnames, given = "赵钱孙李", ["云", "山川", "若水", "明", "长老", "姑娘"]
    some = [s + g for s in surnames for g in given] + ["疤脸", "阿飞", "林间客", "他", "那人", "老者", ""]
    rows = []
    for i in range(n):
        mention, name = rng.choice(some), rng.choice([None, None, *some])
        rows.append((rng.choice("xy"), 1 + i // 25, i, "reveal" if i % 11 == 10 else "statement", mention, name or ("赵若水" if i % 11 == 10 else None), rng.choice(["", f"{mention}和{name}来了"]), rng.randrange(3)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_parts_are_read_as_one_walk(spark, seed, monkeypatch):
    rows = readings(seed)
    log = resolved(spark, rows)
    apart = sorted(map(tuple, log.collect()), key=repr)
    monkeypatch.setattr(names, "parts", lambda r: r.select("book", F.explode(F.array("mention.text", "name.text")).alias("text"), F.lit(0).cast("long").alias("part")).distinct())
    assert sorted(map(tuple, resolved(spark, rows).where("character is not null or what = 'statement'").collect()), key=repr) == apart
    assert {r[3] for r in apart} >= {"create", "alias", "rename", "statement", "promote"}


def test_many_tasks_for_one_book(spark):
    rows = [("b", 1, i, "statement", f"Name{i % 40} Of{i % 40}", None, "", 0) for i in range(200)]
    marked = names.parts(spark.createDataFrame(rows, "book string, chapter int, seq int, what string, mention string, name string, quote string, kind int").withColumns({c: v for x in ("mention", "name") for c, v in ((x, F.struct(F.coalesce(x, F.lit("")).alias("text"))), (f"{x}_usable", F.col(x).isNotNull()))}))
    assert marked.select("part").distinct().count() == 40


@pytest.mark.parametrize("seed", range(2))
def test_a_kind_sees_what_it_would_have_made_alone(spark, seed):
    rng = random.Random(seed)
    rows = [("b", 1 + i // 20, i, "statement", f"N{rng.randrange(30)}", None, "", rng.randrange(3)) for i in range(160)]
    log = resolved(spark, rows).cache()
    for kind in range(3):
        alone = names.seen_by(resolved(spark, [r for r in rows if r[-1] <= kind]), 2)
        assert {r.name for r in names.seen_by(log, kind).collect()} == {r.name for r in alone.collect()}
    assert log.where("what = 'promote'").count() > 5


def test_forms_of_names(spark):
    pairs = [("水门", "波风水门", True), ("天河真人", "天河子", True), ("景儿", "罗景", True), ("陆长老", "陆辰照", True), ("许思安", "许采文", False), ("武老伯", "武松", True), ("", "甲乙", True), ("雪娘", "雄雕", False), ("玉帝", "玉衡", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    forms = df.select("want", names.shares_name(F.col("a"), F.col("b")).alias("got"), names.name_form(F.col("a")).alias("a"), names.name_form(F.col("b")).alias("b")).collect()
    assert [(r.got, names.one_person(r.a, r.b)) for r in forms] == [(r.want, r.want) for r in forms]


@pytest.mark.parametrize("seed", range(3))
def test_parts_of_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.part for r in smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_references_cut_short_stay_text(spark):
    from taleweave.sources import books

    pages = [("<title>a &amp; b &am</title><p>c &amp</p><p>&nbsp;d&nbsp;</p><p>　e &eacute;&#233;&#xE9; &amp;lt; &nosuch; &notit; &quot</p>",), ("<p>　</p>",), (None,)]
    got = [r[0] for r in spark.createDataFrame(pages, "html string").select(books.page_text("html")).collect()]
    assert got == ["a & b &am\nc &amp\nd\ne ééé &lt; &nosuch; &notit; &quot", "", None]
