"""Packing of tokenised documents into sequences of a fixed length.

The lengths are bounded by the capacity, so the whole instance is a histogram of at most
``capacity`` counts, whatever the number of documents. The plan is made on that histogram:
a Martello-Toth reduction fixes the bins that dominate all others with the same item, the
rest is packed best-fit decreasing with multiplicities. Documents then find their place by
their rank among the documents of their length; ranks come from salted groups, so no length,
however frequent, is ranked in one task.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave.llm import bytetext, ragged
from taleweave.llm.scratch import stored

#: Rows of one length that one task ranks, about.
GROUP_ROWS = 50_000
_loaded: dict = {}


def _fitting(lengths: list[int], room: int) -> int:
    """The greatest length not above ``room``, or 0. ``lengths`` is ascending."""
    at = bisect_left(lengths, room + 1)
    return lengths[at - 1] if at else 0


def _smaller_of_two(lengths: list[int], left: dict[int, int], room: int) -> int:
    """The greatest length that can be the smaller of two items that fit in ``room`` together, or 0."""
    at = bisect_left(lengths, room // 2 + 1)
    for i in range(at - 1, -1, -1):
        y = lengths[i]
        if left[y] >= 2 or (i + 1 < len(lengths) and lengths[i + 1] <= room - y):
            return y
    return 0


def _dominating(length: int, left: dict[int, int], order: list[int], capacity: int) -> tuple[tuple[int, ...], int] | None:
    """The bin that dominates all bins with an item of this length, and how often it can be filled; None if none is found."""
    room = capacity - length
    left[length] -= 1  # an item isn't its own partner
    lengths = order if left[length] else [x for x in order if x != length]
    try:
        best = _fitting(lengths, room)
        if not best:
            return (length,), left[length] + 1
        smallest: list[int] = []
        for x in lengths:
            smallest += [x] * min(left[x], 3 - len(smallest))
            if len(smallest) == 3:
                break
        partners: tuple[int, ...] | None = None
        if best == room or sum(smallest[:2]) > room or len(smallest) < 2:
            partners = (best,)
        elif len(smallest) < 3 or sum(smallest) > room:  # two items at most fit beside this one
            pair = _smaller_of_two(lengths, left, room)
            left[best] -= 1
            second = _fitting([x for x in lengths if left[x]], room - best)
            left[best] += 1
            if second and second >= pair:
                partners = (best, second)
        if partners is None:
            return None
    finally:
        left[length] += 1
    items = (length, *partners)
    return items, min(left[x] // items.count(x) for x in set(items))


def reduce_dominated(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction: (fixed bins with how often, the counts that remain).

    Taken for each length from the greatest down, in passes until one fixes nothing. A bin with the
    item that dominates all feasible ones is in some best packing, and is fixed: the item alone if
    nothing fits beside it; with the greatest other item that fits, if that leaves no room or no two
    items fit; with that and the greatest that then fits, if no three fit and no other pair has a
    greater smaller item. For each other bin's items, larger ones of the fixed bin can stand in.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    order, fixed = sorted(left), []
    while True:
        done = len(fixed)
        for length in sorted(left, reverse=True):
            while left.get(length):
                found = _dominating(length, left, order, capacity)
                if found is None:
                    break
                items, times = found
                fixed.append((items, times))
                for k in items:
                    left[k] -= times
                for k in set(items):
                    if not left[k]:
                        del left[k]
                        order.remove(k)
        if len(fixed) == done:
            return fixed, left


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: bins as (lengths, how often)."""
    groups: dict[int, list[list]] = {}  # by room left: [lengths, how many bins]
    rooms: list[int] = []

    def put(items: tuple[int, ...], times: int) -> None:
        room = capacity - sum(items)
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([items, times])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            room = rooms[at]
            items, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = min(room // length, n)  # the same bins stay the best fit for their next item
            whole = min(times, n // each)
            put(items + (length,) * each, whole)
            if times > whole:
                put(items, times - whole)
            n -= whole * each
    return [(items, times) for found in groups.values() for items, times in found]


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Slots: for each length and rank range, the first sequence and the place in it."""
    fixed, left = reduce_dominated(histogram, capacity)
    slots, sequence, given = [], 0, dict.fromkeys(histogram, 0)
    for items, times in fixed + best_fit(left, capacity):
        place = 0
        for length in items:
            slots.append((length, given[length], sequence, place))
            given[length] += times
            place += length
        sequence += times
    slots.sort()
    columns = np.array(slots, np.int64).reshape(-1, 4)
    return {"length": columns[:, 0], "rank": columns[:, 1], "sequence": columns[:, 2], "place": columns[:, 3]}


def _assign(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.value
        rank_bits = np.int64(1 << 48)
        keys = p["length"] * rank_bits + p["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            slot = np.searchsorted(keys, length * rank_bits + rank, "right") - 1
            sequence = p["sequence"][slot] + rank - p["rank"][slot]
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "__rank"]
            names = [name for name in batch.schema.names if name != "__rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(p["place"][slot])], names=[*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """``pieces(length, ...)``, lengths 1 .. capacity -> the same rows with ``sequence_id`` and ``offset``.

    Each sequence is filled from 0 without gaps and holds at most ``capacity``. ``order``
    names columns that tell the rows apart; rows equal in all of them may change places.
    No rows: an empty result. A length outside 1 .. capacity is an error. Columns named
    sequence_id, offset or __rank are not allowed in.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    total = pieces.count()
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(max(1, math.ceil(total / GROUP_ROWS)))))
    counts = stored(salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # at most ``capacity`` rows
    if any(not k or k < 1 or k > capacity for k in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = Window.partitionBy("length", "__salt").orderBy(*order)
    ranked = salted.join(bases, ["length", "__salt"]).withColumn("__rank", F.col("__base") + F.row_number().over(own) - 1)
    ranked = ranked.select(*pieces.columns, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_assign(spark.sparkContext.broadcast(plan(histogram, capacity))), schema)


#: A character that stands alone between distinct words, so that their ids can be told apart.
_BETWEEN = "\x01"


def _tokenizer(text: str):
    key = hash(text)
    if key not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(text)
        mark = tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        whole = tokenizer.encode(f"a {_BETWEEN} a", add_special_tokens=False).ids
        if len(mark) != 1 or whole.count(mark[0]) != 1:
            raise ValueError("this tokenizer doesn't keep words apart")
        _loaded[key] = tokenizer, mark[0], ragged.Known()
    return _loaded[key]


def _word_ids(tokenizer, mark: int, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each word, ragged. Words go in long strings, a mark between each two."""
    strings, plain, odd = [], [], []
    for i, w in enumerate(words):
        (odd if _BETWEEN in w else plain).append(i)
    for k in range(0, len(plain), 2000):
        strings.append(f" {_BETWEEN} ".join([words[i] for i in plain[k : k + 2000]] + [""]))
    flat = [np.array(e.ids, np.int32) for k in range(0, len(strings), 8) for e in tokenizer.encode_batch_fast(strings[k : k + 8], add_special_tokens=False)]
    joined = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    marks = np.flatnonzero(joined == mark)
    if len(marks) != len(plain):
        raise ValueError("the marks between words don't come back")
    ids = np.delete(joined, marks)
    stops = marks - np.arange(len(marks))
    rest = [np.array(tokenizer.encode(words[i], add_special_tokens=False).ids, np.int32) for i in odd]
    ends = np.concatenate([np.zeros(1, np.int64), stops, (stops[-1] if len(stops) else 0) + np.cumsum([len(x) for x in rest], dtype=np.int64)])
    back = np.argsort(np.array(plain + odd, np.int64), kind="stable")
    return ragged.gather(np.concatenate([ids, *rest]), ends, back)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, piece, start, length, ids binary)``, a row per piece.

    A document is its text's ids (no special tokens added) and ``end_id``; one longer than
    ``capacity`` is cut there. ``ids`` are little-endian unsigned 32-bit numbers. Null text:
    ``end_id`` alone. The tokenizer must drop white space and keep words apart (checked);
    each distinct word of a batch, equal byte for byte, is then encoded once. Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.slices(batches, 1, 8 << 20):
            tokenizer, mark, known = _tokenizer(shipped.value)
            data, offsets = bytetext.raw_bytes(batch.column(1))
            starts, _, text = bytetext.words(data, offsets)
            distinct, which = ragged.distinct_words(data, starts)
            flat, flat_ends = known.results(distinct, lambda new: _word_ids(tokenizer, mark, [distinct[i].decode() for i in new.tolist()]))  # noqa: B023
            bounds = np.searchsorted(text, np.arange(len(offsets)))
            rows: tuple[list, ...] = ([], [], [], [], [])
            keys = batch.column(0).to_pylist()
            for a, b in bytetext.chunks(offsets):
                ids, word_ends = ragged.gather(flat, flat_ends, which[bounds[a] : bounds[b]])
                stops = word_ends[bounds[a : b + 1] - bounds[a]]
                for i in range(a, b):
                    own = np.append(ids[stops[i - a] : stops[i - a + 1]], end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        for column, value in zip(rows, (keys[i], piece, start, len(part), part.tobytes())):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")
