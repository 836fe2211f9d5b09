"""Work once for each distinct span of a batch, then spread the results (Arrow and numpy only)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def gather(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``rows`` of the ragged array (flat, ends), concatenated, and their ends (with a leading 0)."""
    counts = ends[rows + 1] - ends[rows]
    out = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    at = np.repeat(ends[rows] - out[:-1], counts)
    at += np.arange(out[-1])
    return flat[at], out


class Known:
    """Ragged results of byte strings seen before in this worker, of the first ``most`` of them."""

    def __init__(self, most: int = 1 << 19, kind: type = np.int32, longest: int = 64):
        self.most, self.longest = most, longest
        self.rows: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, kind), np.zeros(1, np.int64)

    def results(self, keys: list[bytes], missing: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ragged results of ``keys``; ``missing`` makes those of the places it is given. Keys above ``longest`` aren't remembered."""
        row = np.fromiter((self.rows.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(row < 0)
        if not len(new):
            return gather(self.flat, self.ends, row)
        flat, ends = missing(new)
        row[new] = len(self.ends) - 1 + np.arange(len(new))
        out = gather(np.concatenate([self.flat, flat]), np.concatenate([self.ends, self.ends[-1] + ends[1:]]), row)
        # once full, what came first stays: frequent words come early
        short = np.flatnonzero(np.fromiter((len(keys[i]) <= self.longest for i in new.tolist()), bool, len(new)))[: self.most - len(self.rows)]
        if len(short):
            flat, ends = gather(flat, ends, short)
            self.rows.update(zip((keys[i] for i in new[short].tolist()), range(len(self.ends) - 1, len(self.ends) - 1 + len(short))))
            self.flat, self.ends = np.concatenate([self.flat, flat]), np.concatenate([self.ends, self.ends[-1] + ends[1:]])
        return out


def distinct_spans(data: np.ndarray, borders: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(the distinct byte strings between neighbouring borders, number of each one's class), compared byte by byte."""
    borders = np.ascontiguousarray(borders, np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


_BLANKS = b" \t\n\x0b\f\r"


def distinct_words(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """As ``distinct_spans`` for words that start at ``starts``, without the white space after each."""
    spans, which = distinct_spans(data, np.append(starts, len(data)))
    return [x.rstrip(_BLANKS) for x in spans], which
