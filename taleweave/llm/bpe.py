"""Byte-level BPE over Arrow batches with the tokenizers library.

The rank file is turned into a vocabulary and merges over the byte alphabet (each byte has a
printable stand-in character). A text is cut before single spaces, where no match of the
pre-token pattern can cross, and only the distinct pieces of a batch, equal byte for byte, are encoded; as token
ids have known byte lengths, the pieces' ids are found again in one long encoding and spread
over all texts. Decoding looks every id up in the byte table.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from taleweave.llm import bytetext, ragged

_loaded: dict = {}
#: Characters of distinct pieces that are encoded as one string.
_STRING = 1 << 14
#: Bytes of text, or ids, that a task holds decoded or encoded at once.
_SLICE = 6 << 20


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that ``token`` is merged from: what the earlier ranks leave of its bytes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
        if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
            raise ValueError(f"{token!r} can't be reached by merges")
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def load_ranks(path: str, pattern: str) -> dict:
    """The codec of a rank file: a tokenizers description and the bytes of each id."""
    if (path, pattern) in _loaded:
        return _loaded[path, pattern]
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    stand_in = byte_alphabet()
    spelt = {t: "".join(stand_in[b] for b in t) for t in ranks}
    merges = [[spelt[a], spelt[b]] for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1 for a, b in [_halves(t, r, ranks)]]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {spelt[t]: r for t, r in ranks.items()}, "merges": merges}
    text = json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None, "decoder": None, "model": model})
    table = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        table[r] = t
    _loaded[path, pattern] = {"tokenizer": text, "bytes": table}
    return _loaded[path, pattern]


def _opened(codec: dict) -> tuple:
    """The tokenizer and byte table inside a task, once for each worker."""
    key = hash(codec["tokenizer"])
    if key not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        table = codec["bytes"]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in table])])
        _loaded[key] = Tokenizer.from_str(codec["tokenizer"]), np.frombuffer(b"".join(table), np.uint8), ends, ragged.Known(1 << 19)
    return _loaded[key]


def _blank(data: np.ndarray) -> np.ndarray:
    """True at each byte of a white-space character, of Unicode's others than ASCII's too."""
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1F))
    for at in np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))).tolist() if (data >= 0xE1).any() or (data == 0xC2).any() else ():
        width = 2 if data[at] == 0xC2 else 3
        if bytes(data[at : at + width]).decode("utf-8", "replace").isspace():
            blank[at : at + width] = True
    return blank


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces, and whether each can follow another: one space, then no white space to its end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    blank = _blank(data)
    space = data == 0x20
    cut = np.zeros(len(data), bool)
    cut[1:-1] = space[1:-1] & ~blank[:-2] & ~blank[2:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    cut[lasts] = False
    cut[edges] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    return starts, space[starts] & (ends - starts > 1) & ~blank[np.minimum(starts + 1, len(data) - 1)] & ~blank[ends - 1]


def _encode_pieces(tokenizer, sizes: np.ndarray, pieces: list[bytes], single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each piece as a ragged array. Pieces that can follow others are encoded joined."""
    order = np.concatenate([np.flatnonzero(single), np.flatnonzero(~single)])
    strings, have = [], 0
    part: list[bytes] = []
    for i in order[: int(single.sum())].tolist():
        part.append(pieces[i])
        have += len(part[-1])
        if have >= _STRING:
            strings.append(b"".join(part).decode())
            part, have = [], 0
    strings += [b"".join(part).decode()] * bool(part) + [pieces[i].decode() for i in order[int(single.sum()) :].tolist()]
    ids = [np.array(e.ids, np.int32) for k in range(0, len(strings), 64) for e in tokenizer.encode_batch_fast(strings[k : k + 64], add_special_tokens=False)]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[flat])])  # bytes before each id
    lengths = np.array([len(p) for p in pieces], np.int64)
    piece_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths[order])])
    borders = np.searchsorted(at, piece_at)
    if not np.array_equal(at[borders], piece_at):
        raise ValueError("the ids' bytes don't follow the text")
    return ragged.gather(flat, borders, np.argsort(order))


def encode_batch(codec: dict, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of texts in turn: flat ids, their ends per text, and each id's first byte in its text."""
    tokenizer, _, table_ends, known = _opened(codec)
    sizes = np.diff(table_ends)
    data, offsets = bytetext.raw_bytes(column)
    starts, single = _cut(data, offsets)
    pieces, which = ragged.distinct_spans(data, np.append(starts, len(data)))
    joined = np.zeros(len(pieces), bool)
    joined[which] = single  # the same for equal pieces
    flat, flat_ends = known.results(pieces, lambda new: _encode_pieces(tokenizer, sizes, [pieces[i] for i in new.tolist()], joined[new]))
    bounds = np.searchsorted(starts, offsets)
    for a, b in bytetext.chunks(offsets):
        ids, piece_ends = ragged.gather(flat, flat_ends, which[bounds[a] : bounds[b]])
        text_ends = piece_ends[bounds[a : b + 1] - bounds[a]]
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[ids])])[:-1]
        base = np.repeat(offsets[a:b] - offsets[a], np.diff(text_ends))
        yield ids, text_ends, at - base


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.LargeListArray:
    ends, base = [np.zeros(1, np.int64)], 0
    for _, e in parts:
        ends.append(e[1:] + base)
        base += int(e[-1])
    values = np.concatenate([v for v, _ in parts]) if parts else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(ends)), pa.array(values.astype(np.int32, copy=False)))


def encode(docs: DataFrame, codec: dict, offsets: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids array<int>[, char_starts array<int>])``, a row each.

    Each match of the codec's pattern is encoded separately, without special tokens. Null
    text counts as empty: no ids. ``char_starts`` (on request) is the code point of the text
    that holds each id's first byte; ids that split a character share its place. Other
    columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.slices(batches, 1, _SLICE):
            ids, places = [], []
            data, bounds = bytetext.raw_bytes(batch.column(1))
            begun = 0
            for flat, ends, at in encode_batch(shipped.value, batch.column(1)):
                ids.append((flat, ends))
                if offsets:
                    n = len(ends) - 1
                    part = data[bounds[begun] : bounds[begun + n]]
                    chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((part & 0xC0) != 0x80)])
                    base = np.repeat(bounds[begun : begun + n] - bounds[begun], np.diff(ends))
                    # a byte inside a character belongs to the character that began before it
                    places.append((chars[at + base + 1] - 1 - chars[base], ends))
                    begun += n
            columns = [batch.column(0), _lists(ids)] + ([_lists(places)] if offsets else [])
            yield pa.RecordBatch.from_arrays([c.cast(pa.list_(pa.int32())) if pa.types.is_large_list(c.type) else c for c in columns], names=["doc_id", "ids", "char_starts"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", char_starts array<int>" * offsets)


def _list_ends(lists: pa.Array) -> np.ndarray:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def decode(encoded: DataFrame, codec: dict, text: bool = True) -> DataFrame:
    """``encoded(doc_id, ids, ...)`` -> ``(doc_id, ids, decoded binary[, decoded_text])``.

    ``decoded`` joins the ids' bytes, so characters split over ids come whole again;
    ``decoded_text`` has U+FFFD where the ids end inside a character. Null ids: empty.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(a, b - a) for batch in batches for a, b in bytetext.chunks(_list_ends(batch.column(1)), _SLICE // 4))
        for batch in parts:
            _, table, table_ends, _ = _opened(shipped.value)
            lists = batch.column(1)
            values = lists.values.to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            out, total = [], []
            for i in range(len(lists)):
                ids = values[ends[i] : ends[i + 1]] if lists[i].is_valid else values[:0]
                out.append(ragged.gather(table, table_ends, ids.astype(np.int64))[0].tobytes())
                if text:
                    total.append(out[-1].decode("utf-8", "replace"))
            columns = [batch.column(0), lists, pa.array(out, pa.binary())] + [pa.array(total, pa.string())] * text
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded", "decoded_text"][: len(columns)])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary" + ", decoded_text string" * text)
