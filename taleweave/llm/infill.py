"""Fill-in-the-middle transformation, as a pyarrow.compute pipeline over Arrow batches.

A batch of texts becomes list arrays of units; the lists are flattened with the index of the row
each unit came from, a unit's ordinal in its row tells its role (prefix, middle, suffix), the units
of each role are filtered out and rebuilt into lists, joined, and put together in the row's form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm import bytetext

#: The marks of prefix, suffix and middle (fixed values).
MARKS = ("<P>", "<S>", "<M>")
#: A unit: white space and the word after it, or white space that nothing follows; over UTF-8 bytes.
_UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: A byte that UTF-8 never uses; it is put after each unit.
_END = b"\xff"
#: Bytes of text that a task works on at once; a longer text is worked on alone.
_SLICE = 4 << 20


def _checked(marks: tuple[str, str, str]) -> list[bytes]:
    """The marks as bytes. One mark's end mustn't be another's start, else an output could be read in two ways."""
    found = [m.encode() for m in marks]
    clash = any(a[k:] == b[: len(a) - k] for a in found for b in found for k in range(1, len(a))) or any(a in b for i, a in enumerate(found) for j, b in enumerate(found) if i != j)
    if len(found) != 3 or not all(found) or clash:
        raise ValueError("three marks are needed, none empty, within another, or beginning as another ends")
    return found


def _remainder(h: pa.Array, m: pa.Array) -> pa.Array:
    return pc.subtract(h, pc.multiply(pc.divide(h, m), m))


def _joined(units: pa.Array, parents: pa.Array, role: pa.Array, counts: pa.Array) -> pa.Array:
    """The units of one role, rebuilt into a list for each row and joined. ``counts`` is how many each row has."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts.to_numpy(zero_copy_only=False))])
    kept = units.filter(role)
    if len(kept) != ends[-1]:
        raise ValueError("the units of a role don't add up")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), kept), b"")


def split_parts(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """(units of each text, [prefix, middle, suffix]) of ``texts`` without nulls.

    The prefix ends after the smaller of ``first`` and ``second`` modulo n + 1 units, the middle after the larger.
    """
    # the end mark also follows the last unit, so each list has one empty unit more
    lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=_UNIT, replacement=rb"\0" + _END), pattern=_END)
    n = pc.subtract(pc.cast(pc.list_value_length(lists), pa.int64()), 1)
    places = pc.add(n, 1)
    a, b = _remainder(first, places), _remainder(second, places)
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    units, parents = lists.flatten(), pc.list_parent_indices(lists)
    begins = pa.array(lists.offsets.to_numpy()[:-1].astype(np.int64) - int(lists.offsets[0].as_py()) if len(lists) else np.zeros(0, np.int64))
    ordinal = pc.subtract(pa.array(np.arange(len(units), dtype=np.int64)), begins.take(parents))
    before, within = pc.less(ordinal, low.take(parents)), pc.less(ordinal, high.take(parents))
    real = pc.less(ordinal, n.take(parents))
    roles = [before, pc.and_not(within, before), pc.and_not(real, within)]
    counts = [low, pc.subtract(high, low), pc.subtract(n, high)]
    return n, [_joined(units, parents, role, count) for role, count in zip(roles, counts)]


def _transform(marks: list[bytes], percent: int, spm_percent: int):
    p, s, m = (pa.scalar(x, pa.binary()) for x in marks)

    def put(*parts) -> pa.Array:
        return pc.binary_join_element_wise(*parts, b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.slices(batches, 1, _SLICE):
            texts = pc.fill_null(batch.column(1).cast(pa.binary()), b"")
            h1, h2, h3, h4 = (batch.column(i) for i in range(2, 6))
            n, (prefix, middle, suffix) = split_parts(texts, h1, h2)
            hundred = pa.scalar(100, pa.int64())
            marked = pc.or_(pc.or_(*(pc.match_substring(texts, x) for x in marks[:2])), pc.match_substring(texts, marks[2]))
            plain = pc.or_(pc.or_(pc.equal(n, 0), marked), pc.greater_equal(_remainder(h3, hundred), percent))
            spm = pc.less(_remainder(h4, hundred), spm_percent)
            form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
            output = pc.if_else(plain, texts, pc.if_else(spm, put(s, suffix, p, prefix, m, middle), put(p, prefix, s, suffix, m, middle)))
            none = pa.scalar(None, pa.int64())
            chars = [pc.if_else(plain, none, pc.cast(pc.utf8_length(x.cast(pa.string())), pa.int64())) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, form, output.cast(pa.string()), *chars], names=["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n, form, output, prefix_chars, middle_chars)``, a row each.

    A text is cut into ``n`` units (white space of 0x20 and 0x09-0x0D with the word after it, or
    what white space ends the text). Four numbers from the SHA-256 of ``seed:doc_id`` choose two
    cuts and the form: ``psm`` is mark P, prefix, mark S, suffix, mark M, middle; ``spm`` is mark S,
    suffix, mark P, prefix, mark M, middle; ``plain`` is the text as it is, for ``100 - percent`` %
    of the texts, for empty ones and for those that contain a mark. ``spm_percent`` % of the others
    are spm. Equal rows get equal outputs.

    Null text: as empty. Null doc_id: as an empty string in the hash. ``prefix_chars`` and
    ``middle_chars`` count code points, null where plain. A text is never divided; other columns,
    whatever their names, are not read. No rows: an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), digest.alias("digest")).select("doc_id", "text", *numbers)
    return rows.mapInArrow(_transform(_checked(marks), percent, spm_percent), f"doc_id {kind}, n long, form string, output string, prefix_chars long, middle_chars long")


def _halves(column: pa.Array, mark: bytes) -> tuple[pa.Array, pa.Array]:
    """What stands before the first ``mark`` of each value, and what after it."""
    lists = pc.split_pattern(column, pattern=mark, max_splits=1)
    return pc.list_element(lists, 0), pc.list_element(lists, 1)


def _back(output: pa.Array, marks: list[bytes], spm: bool) -> pa.Array:
    p, s, m = marks
    one, two = (s, p) if spm else (p, s)
    begun, rest = _halves(_halves(output, one)[1], two)
    ended, middle = _halves(rest, m)
    prefix, suffix = (ended, begun) if spm else (begun, ended)
    return pc.binary_join_element_wise(prefix, middle, suffix, b"")


def restore(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``rows(..., form, output)`` -> the same rows with ``restored``: the text, from the form and the output alone.

    Null form or output: null. A column ``restored`` that is there is replaced.
    """
    found = _checked(marks)
    rows = rows.drop("restored")
    at = {name: rows.columns.index(name) for name in ("form", "output")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.slices(batches, at["output"], _SLICE):
            form, output = batch.column(at["form"]), batch.column(at["output"]).cast(pa.binary())
            places, parts = [], []
            for kind in ("plain", "psm", "spm"):
                of_kind = pc.fill_null(pc.and_(pc.equal(form, kind), pc.is_valid(output)), False)
                own = output.filter(of_kind)
                parts.append(own if kind == "plain" or not len(own) else _back(own, found, kind == "spm"))
                places.append(np.flatnonzero(of_kind.to_numpy(zero_copy_only=False)))
            row = np.full(batch.num_rows, -1, np.int64)
            row[np.concatenate(places)] = np.arange(sum(map(len, places)))
            text = pa.concat_arrays([x.cast(pa.binary()) for x in parts]).take(pa.array(row, mask=row < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], names=[*batch.schema.names, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, restored string")
