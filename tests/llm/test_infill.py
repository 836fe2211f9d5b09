"""Fill-in-the-middle against a plain reading of its definition, and exact round trips."""

import hashlib
import random
import re

import pytest

from taleweave.llm.infill import fill_in_middle, restore
from tests.comparing import assert_same, connection
from tests.llm.test_corpus_ops import SF, texts

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text, percent=50, spm_percent=80, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    p, s, m = marks
    if not text or any(x in text for x in marks) or h3 % 100 >= percent:
        return n, "plain", text, None, None
    spm = h4 % 100 < spm_percent
    return n, "spm" if spm else "psm", s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle, len(prefix), len(middle)


def many():
    random.seed(5)
    alphabet = ["a", "B", "é", "文", "𝒳", " ", "  ", "\n", "\t", "\x0b", "\x85", " ", "\x00", "<", "<P", "S>", "<<S", "M>"]
    out = [None, "", " ", "\n\t ", "a", " a", "a ", "<P>", "a <S> b", "x<M>", "<P", "\x00", "same text", "same text"]
    out += ["".join(random.choice(alphabet) for _ in range(random.randrange(1, 40))) for _ in range(200)]
    return [*out, "wort " * 60_000, "x" * 300_000, " " * 200_000]


@pytest.mark.parametrize("percent, spm_percent", [(50, 80), (100, 0), (100, 100), (0, 50), (100, 50)])
def test_fill_in_middle(spark, percent, spm_percent):
    values = many()
    rows = restore(fill_in_middle(texts(spark, values).repartition(3), percent=percent, spm_percent=spm_percent)).collect()
    assert len(rows) == len(values)
    for r in rows:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == expected(r.doc_id, values[r.doc_id], percent, spm_percent)
        assert r.restored == (values[r.doc_id] or "")


def test_repeated_and_missing_ids_and_empty_tables(spark):
    values = ["one two three", "one two three", "four five", None]
    rows = restore(fill_in_middle(texts(spark, values, [7, 7, None, None]), percent=100)).collect()
    assert sorted((r.output for r in rows)) == sorted(expected(i, t, 100)[2] for i, t in zip([7, 7, None, None], values))
    assert restore(fill_in_middle(texts(spark, values).limit(0))).count() == 0
    blank = spark.createDataFrame([(None, None, 1), ("psm", None, 2), (None, "x", 3)], "form string, output string, restored int")
    assert [r.restored for r in restore(blank).collect()] == [None] * 3


@pytest.mark.parametrize("marks", [("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("", "a", "b"), ("aa", "b", "c"), ("a", "a", "b")])
def test_marks_that_can_be_misread_are_refused(marks, spark):
    with pytest.raises(ValueError):
        fill_in_middle(texts(spark, ["a"]), marks=marks)


def test_own_marks(spark):
    values = ["a b c d <P> e", "[p] x y"]
    rows = restore(fill_in_middle(texts(spark, values), percent=100, marks=("[p]", "[s]", "[m]")), ("[p]", "[s]", "[m]")).collect()
    for r in rows:
        assert r.restored == values[r.doc_id] and (r.form == "plain") == (r.doc_id == 1)


def test_query_matches_its_oracle(spark):
    from taleweave.llm.queries import ORACLES, QUERIES

    assert_same(QUERIES["op11_fill_in_middle"](spark, SF), connection(SF), ORACLES["op11_fill_in_middle"])
