"""Exact removal of byte strings that occur more than once in a corpus.

Every string of ``length`` bytes is assigned to an anchor inside it, chosen by its content
alone (the least hash of its ``GRAM``-byte parts, the leftmost of equal ones), so equal
strings have equal anchors in the same place. Strings whose anchor occurs once in the corpus
are unique. For the others the stretch of text around each anchor is put into a block with
all stretches of that anchor, the anchor itself, equal byte for byte, as a single symbol; in
a block, a breadth-first backward extension over the Burrows-Wheeler transform sets the
common prefix of neighbouring suffixes in increasing order, and stops at the length wanted:
the neighbours left unset are the repeats. Stretches equal by 128-bit digest are one row
before that, and the parts of an anchor too frequent for one block compare what they found
by the strings' 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from taleweave.llm import bytetext
from taleweave.llm.scratch import stored

#: Bytes that an anchor's hash covers.
GRAM = 80
#: Bytes that are hashed at once; a longer text is cut so that each string is in one window.
WINDOW = 1 << 17
#: Bytes of an anchor's stretches above which they are dealt to several blocks.
BLOCK_BYTES = 1 << 20
#: Bytes from which a block is full, at the next anchor; a task holds about 100 times as much.
FULL_BYTES = 1 << 18
#: Bytes of stretches in a task, about.
TASK_BYTES = 2 << 20


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For texts in one byte array: (first start, starts, anchor's place in it, anchor hash) of each anchor's strings.

    A run of neighbouring starts whose strings share an anchor is a stretch; it spans the
    bytes from its first start to ``length`` after its last. ``data`` has ``WINDOW`` +
    ``length`` bytes at most, so that places take a fixed number of a hash's bits.
    """
    gram = min(GRAM, length)
    width = length - gram + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    h = bytetext.rolling_hash(bytetext.prefix_hash(data, False), gram)
    low = np.uint64((1 << (WINDOW + length).bit_length()) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes is the least
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    start = np.arange(len(least))
    inside = start + length <= np.repeat(offsets[1:], np.diff(offsets))[: len(start)]
    start, anchor = start[inside], (least[inside] & low).astype(np.int64)
    if not len(start):
        return none
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    begin = start[first]
    return begin, np.diff(np.append(first, len(start))), anchor[first] - begin, h[anchor[first]]


def _windows(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, stop text, first byte, stop byte): every start of a string is in one window."""
    for a, b in bytetext.chunks(offsets, WINDOW):
        if offsets[b] - offsets[a] <= WINDOW:
            yield a, b, int(offsets[a]), int(offsets[b])
        else:
            for at in range(int(offsets[a]), int(offsets[b]), WINDOW):
                yield a, b, at, min(at + WINDOW + length - 1, int(offsets[b]))


def _anchors(length: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.slices(batches, 0, 4 << 20):
            data, offsets = bytetext.raw_bytes(batch.column(0))
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)]
            found: list[list[np.ndarray]] = [[] for _ in range(8)]
            for a, b, lo, hi in _windows(offsets, length):
                own = np.clip(offsets[a : b + 1], lo, hi) - lo
                begin, count, at, anchor = _stretches(data[lo:hi], own, length)
                found[0].append(anchor.view(np.int64))
                if full:
                    raw = data[lo:hi].tobytes()
                    digests = b"".join([xxh3_128_digest(raw[x:y]) for x, y in zip(begin.tolist(), (begin + count + length - 1).tolist())])
                    whole = np.frombuffer(digests, "<i8").reshape(-1, 2)
                    text = a + np.searchsorted(own, begin, "right") - 1
                    more = whole[:, 0], whole[:, 1], *(k[text] for k in keys), begin + lo - offsets[text], count.astype(np.int32), at.astype(np.int32)
                    for column, values in zip(found[1:], more):
                        column.append(values)
            names = ["anchor", "whole", "whole2", "id", "hash", "start", "starts", "at"] if full else ["anchor"]
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found[: len(names)]], names=names)

    return run


def suffix_order(symbols: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    """Suffix array of distinct-ended symbols by prefix doubling; only tied suffixes are sorted again.

    Returns the order, its inverse, and from the first sort, by ``v`` <= ``most`` symbols:
    v, where suffixes begin that differ from the one before within v symbols, and which of
    these do so at the last one.
    """
    n, base, step = len(symbols), int(symbols.max()) + 2, 1
    ahead = symbols.astype(np.int64) + 1
    key = ahead.copy()
    while step < most and base ** (step + 1) < 1 << 62:
        key *= base
        key[: n - step] += ahead[step:]
        step += 1
    order = np.argsort(key)
    key = key[order]
    begin = np.concatenate([[True], key[1:] != key[:-1]])
    key //= base
    last = np.flatnonzero(begin & np.concatenate([[step == 1], key[1:] == key[:-1]]))
    value, borders = step, begin
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    tied = np.flatnonzero(~(begin & np.append(begin[1:], True)))
    while len(tied):
        rows = order[tied]
        key = rank[rows] * np.int64(n + 1) + rank[rows + step]  # a tied suffix goes on beyond step
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        order[tied] = rows
        begin = np.concatenate([[True], key[1:] != key[:-1]])
        # a group's rank is the place of its first suffix
        rank[rows] = tied[np.maximum.accumulate(np.where(begin, np.arange(len(tied)), 0))]
        tied = tied[~(begin & np.append(begin[1:], True))]
        step *= 2
    return order.astype(np.int32), rank.astype(np.int32), value, borders, last.astype(np.int32)


def _interval_ends(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The next known border after each; ``known`` has one more at its end."""
    ends = found + 1
    open_ = np.flatnonzero(~known[ends])
    for _ in range(6):  # most intervals are short
        if not len(open_):
            return ends
        ends[open_] += 1
        open_ = open_[~known[ends[open_]]]
    borders = np.flatnonzero(known)
    ends[open_] = borders[np.searchsorted(borders, ends[open_])]
    return ends


def repeated_starts(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, whether each suffix shares ``least`` symbols or more with the one before it).

    Breadth-first over the intervals of the Burrows-Wheeler transform. A border between
    suffixes that is found at common prefix ``v`` opens the interval that starts there;
    extended to the left by each of the interval's preceding symbols, it tells the borders of
    common prefix ``v + 1``. Borders not found before ``least`` are repeats. The last symbol
    must differ from all others.
    """
    order, rank, value, borders, found = suffix_order(symbols, least)
    n = len(order)
    back = rank[order - 1]  # LF mapping; the suffix of place 0 gets the last one
    following = order + 1
    following[following == n] = 0
    ahead = rank[following]
    head = symbols[order]
    same_head = np.concatenate([[False], head[1:] == head[:-1]])
    known = np.append(borders, True)
    mark = np.empty(n, np.int32)
    for _ in range(least - value):
        if not len(found):
            break
        sizes = _interval_ends(known, found) - found
        base = np.repeat(found, sizes)
        skip = found.copy()
        skip[1:] -= np.cumsum(sizes[:-1], dtype=np.int32)
        at = np.arange(len(base), dtype=np.int32) + np.repeat(skip, sizes)
        to = back[at]
        new = (at != rank[0]) & ~known[to]
        to, base = to[new], base[new]
        to = to[~same_head[to] | (ahead[to - 1] < base)]
        place = np.arange(len(to), dtype=np.int32)
        mark[to] = place
        found = to[mark[to] == place]
        known[found] = True
    return order, ~known[:-1]


def _block(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For stretches and their anchors' places: (stretch, start in it, whether repeated in the block, class) of each start."""
    n, gram = len(at), min(GRAM, length)
    sizes = np.diff(offsets)
    symbols = np.empty(len(data) + n, np.int32)
    row = np.repeat(np.arange(n), sizes)
    symbols[np.arange(len(data)) + row] = data
    begins = offsets[:-1] + np.arange(n)
    symbols[begins + sizes] = 256 + np.arange(n)  # every end differs, so nothing is common across it
    # all strings of a stretch hold its anchor: one symbol, the same for the same bytes only
    anchors = data[(offsets[:-1] + at)[:, None] + np.arange(gram)]
    equal = pa.FixedSizeBinaryArray.from_buffers(pa.binary(gram), n, [None, pa.py_buffer(anchors)]).dictionary_encode().indices.to_numpy()
    symbols[begins + at] = 256 + n + equal
    change = np.zeros(len(symbols) + 1, np.int8)
    change[begins + at + 1] += 1
    change[begins + at + gram] -= 1
    symbols = symbols[np.cumsum(change[:-1], dtype=np.int8) == 0]
    present = np.zeros(int(symbols.max()) + 1, bool)
    present[symbols] = True
    order, same = repeated_starts((np.cumsum(present, dtype=np.int32) - 1)[symbols], length - gram + 1)
    class_of = np.empty(len(symbols), np.int64)
    class_of[order] = np.cumsum(~same)
    repeated = np.zeros(len(symbols), bool)
    repeated[order[same]] = True
    repeated[order[np.flatnonzero(same) - 1]] = True
    starts = sizes - length + 1
    row = np.repeat(np.arange(n), starts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    place = (begins - np.arange(n) * (gram - 1))[row] + start  # no start is behind its anchor
    return row, start, repeated[place], class_of[place]


def _runs(mask: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True within each row."""
    border = row[1:] != row[:-1]
    first = mask & np.concatenate([[True], ~mask[:-1] | border]) if len(mask) else mask
    last = mask & np.concatenate([~mask[1:] | border, [True]]) if len(mask) else mask
    return np.flatnonzero(first), np.flatnonzero(last)


def _find(length: int, full_bytes: int):
    """Rows in order of (anchor, part) -> runs of repeated starts; for split anchors also open classes."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        data, offsets = bytetext.raw_bytes(rows.column("bytes").combine_chunks())
        row, start, repeated, class_of = _block(data, offsets, column("at").astype(np.int64), length)
        a, b = _runs(repeated, row)
        which, first, stop = row[a], start[a], start[b] + 1
        one = two = np.zeros(0, np.int64)
        several = np.flatnonzero(column("parts")[row] > 1)
        if len(several):
            # one row of each class in the block is enough to be met by other blocks
            places = several[np.unique(class_of[several], return_index=True)[1]]
            raw, at = data.tobytes(), offsets[row[places]] + start[places]
            digests = np.frombuffer(b"".join([xxh3_128_digest(raw[x : x + length]) for x in at.tolist()]), "<i8").reshape(-1, 2)
            one, two = digests[:, 0], digests[:, 1]
            which, first, stop = np.append(which, row[places]), np.append(first, start[places]), np.append(stop, start[places] + 1)
        none = np.zeros(len(a), bool), np.ones(len(one), bool)
        across = [pa.array(np.append(np.zeros(len(a), np.int64), x), mask=~np.concatenate(none)) for x in (one, two)]
        keys = [pa.array(column(k)[which]) for k in ("anchor", "whole", "whole2")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(first), pa.array(stop), *across], names=["anchor", "whole", "whole2", "first", "stop", "one", "two"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False), dtype=np.int64)])
            new = np.concatenate([[last != (anchor[0], part[0])], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
            last, begun = (anchor[-1], part[-1]), 0
            for i in np.flatnonzero(new).tolist():
                if size + ends[i] - ends[begun] >= full_bytes:
                    held.append(batch.slice(begun, i - begun))
                    yield flush(held)
                    held, size, begun = [], 0, i
            held.append(batch.slice(begun))
            size += ends[-1] - ends[begun]
        if held:
            yield flush(held)

    return run


def _cut_stretches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.slices(batches, 0, 4 << 20):
            data, offsets = bytetext.raw_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            rows = wanted.flatten()
            field = {f.name: rows.field(f.name).to_numpy(zero_copy_only=False) for f in rows.type}
            begin = np.repeat(offsets[:-1], pc.list_value_length(wanted).to_numpy()) + field["start"]
            raw = data.tobytes()
            cut = [raw[x:y] for x, y in zip(begin.tolist(), (begin + field["starts"] + length - 1).tolist())]
            names = ["anchor", "part", "parts", "whole", "whole2", "at"]
            yield pa.RecordBatch.from_arrays([*(pa.array(field[k]) for k in names), pa.array(cut, pa.binary())], names=[*names, "bytes"])

    return run


def _remove(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in bytetext.slices(batches, 1, 6 << 20):
        data, offsets = bytetext.raw_bytes(batch.column(1))
        spans = batch.column(2)
        counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
        base, flat = np.repeat(offsets[:-1], counts), spans.flatten()
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, base + flat.field("a").to_numpy(), 1)
        np.add.at(change, base + flat.field("b").to_numpy(), -1)
        gone = np.cumsum(change[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = np.diff(before[offsets])
        row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(offsets))
        runs = np.bincount(row[_runs(gone, row)[0]], minlength=batch.num_rows)
        raw, ends = data[~gone].tobytes(), (offsets - before[offsets]).tolist()
        kept = [raw[x:y] for x, y in zip(ends, ends[1:])]
        out = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), out], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(texts: DataFrame, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``texts(id, hash, text)``, no two rows with one (id, hash) -> ``(id, hash, a, b)``: byte spans made of repeated strings, overlapping."""
    kinds = dict(texts.dtypes)
    key = ["anchor", "whole", "whole2"]
    source = texts.select("text", "id", "hash")
    seen = source.select("text").mapInArrow(_anchors(length, False), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    seen = stored(seen, "seen")  # an aggregate in the join's stage would keep Spark from splitting a hot anchor
    places = source.mapInArrow(_anchors(length, True), f"anchor long, whole long, whole2 long, id {kinds['id']}, hash long, start long, starts int, at int")
    places = stored(places.join(seen, "anchor"), "places")
    # equal stretches repeat each other throughout; different ones are compared, one row of each
    same = places.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct("id", "hash", "start", "starts", "at")).alias("one"))
    same = stored(same, "stretches")
    several = same.groupBy("anchor").agg(F.count("*").alias("different"), F.sum(F.col("one.starts") + length - 1).alias("bytes")).where("different > 1")
    several = stored(several.select("anchor", "bytes", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("parts")), "several")
    tasks = (several.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES + 1
    rows = same.join(several, "anchor").withColumn("part", F.pmod(F.xxhash64("whole"), F.col("parts")).cast("int"))
    wanted = rows.groupBy("one.id", "one.hash").agg(F.collect_list(F.struct(*key, "part", "parts", "one.start", "one.starts", "one.at")).alias("wanted"))
    cut = texts.join(wanted, ["id", "hash"]).select("text", "wanted")
    stretches = cut.mapInArrow(_cut_stretches(length), "anchor long, part int, parts int, whole long, whole2 long, at int, bytes binary")
    blocks = stretches.repartition(tasks, "anchor", "part").sortWithinPartitions("anchor", "part").select("anchor", "part", "parts", "whole", "whole2", "at", "bytes")
    found = blocks.mapInArrow(_find(length, min(block_bytes, FULL_BYTES)), "anchor long, whole long, whole2 long, first long, stop long, one long, two long")
    found = stored(found, "found")
    across = found.where("one is not null")
    met = across.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    runs = found.where("one is null").union(across.join(met, ["one", "two"]).select(*found.columns)).select(*key, "first", "stop")
    runs = runs.groupBy(*key).agg(F.collect_list(F.struct("first", "stop")).alias("runs"))
    copied = same.where("copies > 1").select(*key, F.lit(True).alias("copied"))
    known = copied.withColumn("runs", F.lit(None).cast("array<struct<first:bigint,stop:bigint>>")).unionByName(
        runs.join(copied, key, "left_anti").select(*key, F.lit(False).alias("copied"), "runs")
    )
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("starts").cast("long").alias("stop")))
    marked = places.join(known, key).select("id", "hash", "start", F.explode(F.when(F.col("copied"), all_).otherwise(F.col("runs"))).alias("r"))
    return marked.select("id", "hash", (F.col("start") + F.col("r.first")).alias("a"), (F.col("start") + F.col("r.stop") + length - 1).alias("b"))


def without_repeats(docs: DataFrame, length: int = 200, block_bytes: int = BLOCK_BYTES, as_text: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(row, n_bytes, n_removed, n_spans, kept)``; ``row`` is the input row.

    ``kept`` is binary, or with ``as_text`` a string without the bytes of characters cut in two.

    Texts are taken as UTF-8 bytes; every byte is removed that is covered by a string of
    ``length`` bytes that starts at another place too, in the same or another text, as the
    input stands. Strings don't cross texts. Null text: empty. Rows repeated as a whole are
    repeats of each other and count as one row before their strings are looked at, however
    many there are; rows that only share a doc_id, or have none, are told apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    texts = keyed.select("id", "hash", "text")
    again = stored(texts.groupBy("id", "hash").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where("n > 1").drop("n"), "again")
    once = texts.join(again, ["id", "hash"], "left_semi").groupBy("id", "hash").agg(F.any_value("text").alias("text"))
    spans = repeated_spans(texts.join(again, ["id", "hash"], "left_anti").unionByName(once), length, block_bytes)
    whole = again.where(F.col("size") >= length).select("id", "hash", F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("b"))
    lists = spans.unionByName(whole).groupBy("id", "hash").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = keyed.join(lists, ["id", "hash"], "left").select("row", "text", "spans")
    kind = docs.select(F.struct(*docs.columns).alias("row")).dtypes[0][1]
    rest = "string" if as_text else "binary"
    return joined.mapInArrow(lambda batches: _remove(batches, as_text), f"row {kind}, n_bytes long, n_removed long, n_spans long, kept {rest}")
