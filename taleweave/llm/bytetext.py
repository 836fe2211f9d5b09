"""Vectorised byte-level text helpers that run inside Arrow tasks.

A batch of texts is one byte array with offsets. Word boundaries, word hashes and
shingle hashes come from a few numpy passes over it; there is no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from taleweave.llm import ragged

#: Bytes handled at once, so that the 64-bit working arrays stay in a core's cache.
CHUNK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict = {}


def _byte_table() -> np.ndarray:
    if "bytes" not in _tables:
        _tables["bytes"] = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["bytes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for positions 0 .. n-1."""
    if "pow" not in _tables or len(_tables["pow"][0]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        both = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _tables["pow"] = tuple(both)
    return _tables["pow"]


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and low bits of hashes are usable."""
    h = h + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a text column has about ``limit`` bytes; at least a row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
        for first, last in chunks(ends, limit):
            yield batch.slice(first, last - first)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word (a run of bytes other than 0x20 and 0x09-0x0D)."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    space = _SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[1:-1]
    before[0] = after[-1] = True
    inner = edges[(edges > 0) & (edges < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray, lower: bool) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any byte span."""
    values = (_byte_table()[_LOWER] if lower else _byte_table())[data]
    values *= _powers(len(data))[0][: len(data)]
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = prefix[ends] - prefix[starts]
    h *= _powers(len(prefix))[1][starts]
    return mixed(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def rolling_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of the ``size`` bytes from every place on, without gathering."""
    h = prefix[size:] - prefix[:-size]
    h *= _powers(len(prefix))[1][: len(h)]
    h ^= np.uint64(size << 40)
    return mixed(h)


def word_classes(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, A-Z lower-cased, and each word's number among them, compared byte by byte."""
    spans, which = ragged.distinct_words(_LOWER[data], starts)
    numbers: dict[bytes, int] = {}
    again = np.array([numbers.setdefault(x, len(numbers)) for x in spans], np.int64)
    return list(numbers), again[which] if len(which) else which


_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, mixed anew for every eight bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    sizes = ends - starts
    one, two = mixed(sizes.astype(np.uint64), 11), mixed(sizes.astype(np.uint64), 12)
    rows, done = np.arange(len(starts)), 0
    while len(rows):
        chunk = eight[starts[rows] + done] & _KEPT[np.minimum(sizes[rows] - done, 8)]
        one[rows] = mixed(one[rows] * np.uint64(0x9FB21C651E98DF25) + chunk, 13)
        two[rows] = mixed((two[rows] ^ chunk) * np.uint64(0xC2B2AE3D27D4EB4F), 14)
        done += 8
        rows = rows[sizes[rows] > done]
    return one, two


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text in turn, its set of distinct ``size``-word shingles: (ascending 64-bit hashes, a second hash of each).

    A-Z is lower-cased. A text of fewer words than ``size`` has its whole sequence as the one
    shingle; a text without words has the empty set.
    """
    for first, last in chunks(offsets):
        part = _LOWER[data[offsets[first] : offsets[last]]]
        off = offsets[first : last + 1] - offsets[first]
        starts, ends, text = words(part, off)
        h = word_hashes(part, starts, ends)
        bounds = np.searchsorted(text, np.arange(last - first + 1))
        one, two = (_sequence_hash([x[i : len(x) - size + 1 + i] for i in range(size)]) if len(x) >= size else x[:0] for x in h)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                own, at = np.unique(one[a : b - size + 1], return_index=True)
                yield own, two[a + at]
            elif b > a:
                yield tuple(_sequence_hash([x[i : i + 1] for i in range(a, b)]) for x in h)
            else:
                yield h[0][:0], h[1][:0]


def shingle_numbers(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sets of ``shingle_sets`` as ascending numbers, equal within the call for equal words and for no others."""
    starts, _, text = words(data, offsets)
    distinct, which = word_classes(data, starts)
    n, out = len(text), []
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    count, code = len(distinct), which
    for i in range(1, size if n >= size else 1):  # runs of words are numbered anew for each word more
        _, code = np.unique(code[: n - i] * np.int64(len(distinct)) + which[i:], return_inverse=True)
        count = max(count, int(code.max()) + 1 if len(code) else 0)
    short: dict[tuple, int] = {}
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(code[a : b - size + 1]))
        elif b > a:
            out.append(np.array([count + short.setdefault(tuple(which[a:b].tolist()), len(short))], np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _sequence_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for column in columns:
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + column)
    return out
