"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. For each language their probabilities are
learned by expectation maximisation, where a forward-backward pass weighs every segmentation
of a word; a text's score is the forward sum over all segmentations of its words. Pieces don't
cross words, so the sum is taken once for each distinct word of a batch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm import bytetext, ragged

#: Words above so many bytes are learned from and scored with a scale of their own at each byte.
MOST_BYTES = 32
#: Probabilities are scaled by exp(SCALE) a byte, which keeps the sums of words that are not
#: longer within a double's range.
SCALE = 2.5
#: Bytes of long words whose pieces are looked up at once.
_WINDOW = 64
#: Bytes of long words, padded, that are learned from at once.
_LONG = 1 << 16
#: Documents of each language, about and at most, that the probabilities are learned from, and the characters that such a document has at most.
SAMPLE_DOCS, MOST_SAMPLE_DOCS, MOST_SAMPLE_CHARS = 200, 400, 100_000
ROUNDS = 4
_loaded: dict = {}


def load_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces without inner white space, in lower case, and all single bytes."""
    with open(path, "rb") as lines:
        tokens = {base64.b64decode(x.split()[0]) for x in lines}
    kept = {t.lower() for t in tokens if not any(c in t[1:] for c in b" \t\n\x0b\f\r") and t[:1] not in (b"\t", b"\n", b"\x0b", b"\f", b"\r")}
    return sorted(kept | {bytes([b]) for b in range(256)})


class Pieces:
    """A trie of pieces as one transition table; node 0 is where no piece goes on."""

    def __init__(self, pieces: list[bytes]):
        used = sorted({c for p in pieces for c in p})
        self.classes = np.zeros(256, np.uint8)
        self.classes[used] = np.arange(len(used))
        nodes: dict[bytes, int] = {b"": 1}
        for p in pieces:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes) + 1)
        self.step = np.zeros((len(nodes) + 1, len(used)), np.int32)
        for p, node in nodes.items():
            if p:
                self.step[nodes[p[:-1]], self.classes[p[-1]]] = node
        self.ends = np.array([nodes[p] for p in pieces])
        self.longest = max(map(len, pieces))
        self.lengths = np.zeros(len(nodes) + 1, np.int64)
        self.lengths[self.ends] = [len(p) for p in pieces]

    def walk(self, symbols: np.ndarray, usable: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, stop, rows, nodes): the usable pieces at each place of equally long words."""
        n, width = symbols.shape
        for start in range(width):
            rows, node = np.arange(n), np.ones(n, np.int32)
            for stop in range(start + 1, min(width, start + self.longest) + 1):
                node = self.step[node, symbols[rows, stop - 1]]
                alive = node > 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                good = usable[node]
                if good.any():
                    yield start, stop, rows[good], node[good]


def _by_length(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        yield int(sizes[order[a]]), order[a:b]


def _symbols(pieces: Pieces, data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The words as rows of symbols, a space before each."""
    out = np.empty((len(starts), size + 1), np.uint8)
    out[:, 0] = pieces.classes[32]
    out[:, 1:] = pieces.classes[bytetext._LOWER[data[starts[:, None] + np.arange(size)]]]
    return out


def word_scores(model: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """ln of each word's probability in each language, over all segmentations."""
    pieces, scaled = model["pieces"], model["scaled"]
    out = np.empty((len(starts), scaled.shape[1]))
    usable = scaled.max(axis=1) > 0
    sizes = ends - starts
    short = np.flatnonzero(sizes <= MOST_BYTES)
    for size, rows in _by_length(sizes[short]):
        for k in range(0, len(rows), 20_000):
            part = short[rows[k : k + 20_000]]
            symbols = _symbols(pieces, data, starts[part], size)
            forward = np.zeros((size + 2, len(part), scaled.shape[1]))
            forward[0] = 1
            for start, stop, at, node in pieces.walk(symbols, usable):
                forward[stop, at] += forward[start, at] * scaled[node]
            out[part] = np.log(forward[size + 1]) - SCALE * (size + 1)
    long = np.flatnonzero(sizes > MOST_BYTES)
    long = long[np.argsort(sizes[long], kind="stable")]
    most = max(1, (1 << 21) // (_WINDOW * pieces.longest * scaled.shape[1]))
    for k in range(0, len(long), most):
        out[long[k : k + most]] = _long_scores(pieces, scaled, data, starts[long[k : k + most]], ends[long[k : k + most]])
    return out


def _long_scores(pieces: Pieces, scaled: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``word_scores`` of words of any length: the sums of the last places only are held, and scaled at each byte."""
    n, longest, languages = len(starts), pieces.longest, scaled.shape[1]
    sizes = ends - starts + 1  # with the space before each
    recent = np.zeros((longest, n, languages))  # the sums before the last ``longest`` places, by place modulo longest
    recent[0] = 1
    scale, out = np.zeros((n, languages)), np.empty((n, languages))
    rows = np.arange(n)
    # probability of the piece that ends at a place of the window, by its length
    ending = np.zeros((_WINDOW + longest, longest + 1, n, languages))
    for begin in range(0, int(sizes.max()), _WINDOW):
        ending[:longest] = ending[_WINDOW:]
        ending[longest:] = 0
        for start in range(begin, min(begin + _WINDOW, int(sizes.max()))):
            alive, node = rows[sizes > start], np.ones(int((sizes > start).sum()), np.int64)
            for length in range(1, longest + 1):
                there = start + length <= sizes[alive]
                alive, node = alive[there], node[there]
                at = starts[alive] + start + length - 2
                symbol = np.where(at < starts[alive], pieces.classes[32], pieces.classes[bytetext._LOWER[data[np.maximum(at, 0)]]])
                node = pieces.step[node, symbol]
                alive, node = alive[node > 0], node[node > 0]
                if not len(alive):
                    break
                ending[start + length - 1 - begin, length, alive] = scaled[node]
        for stop in range(begin + 1, min(begin + _WINDOW, int(sizes.max())) + 1):
            back = np.arange(1, min(longest, stop) + 1)
            new = (recent[(stop - back) % longest] * ending[stop - 1 - begin, back]).sum(axis=0)
            top = np.where(new > 0, new, 1)
            scale += np.where((sizes >= stop)[:, None], np.log(top), 0)
            recent /= top
            recent[stop % longest] = new / top
            done = sizes == stop
            out[done] = np.where(new[done] > 0, scale[done], -np.inf) - SCALE * stop
    return out


def _long_groups(starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Long words of about one length, ``_LONG`` bytes of them together or one."""
    order = np.argsort(ends - starts, kind="stable")
    order = order[(ends - starts)[order] > MOST_BYTES]
    first = 0
    for i in range(len(order)):
        if i > first and (i - first + 1) * int(ends[order[i]] - starts[order[i]] + 1) > _LONG:
            yield order[first:i]
            first = i
    if len(order):
        yield order[first:]


def _long_pieces(trie: Pieces, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, usable: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, stop, rows, nodes): the usable pieces at each place of words of different lengths, a space before each."""
    sizes, rows, found = ends - starts + 1, np.arange(len(starts)), []
    for start in range(int(sizes.max())):
        alive = rows[sizes > start]
        node = np.ones(len(alive), np.int64)
        for stop in range(start + 1, start + trie.longest + 1):
            there = stop <= sizes[alive]
            alive, node = alive[there], node[there]
            if not len(alive):
                break
            at = starts[alive] + stop - 2
            node = trie.step[node, np.where(at < starts[alive], trie.classes[32], trie.classes[raw[np.maximum(at, 0)]])]
            alive, node = alive[node > 0], node[node > 0]
            good = usable[node]
            if good.any():
                found.append((start, stop, alive[good], node[good]))
    return found


def _expected_long(trie: Pieces, p: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, often: np.ndarray, counted: bool) -> np.ndarray:
    """Expected counts of the pieces in long words, or how often each stands in one (``counted``).

    Forward sums are scaled to 1 at each place, and a piece's share is taken with the scales of the places it spans.
    """
    out = np.zeros(len(trie.step))
    steps = _long_pieces(trie, raw, starts, ends, p > 0)
    if counted:
        for _, _, at, node in steps:
            out += np.bincount(node, often[at], len(out))
        return out
    n, sizes = len(starts), ends - starts + 1
    width = int(sizes.max())
    forward, scale = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    forward[0] = 1
    ready = 0  # places whose forward sums are complete and scaled

    def complete(upto: int) -> None:
        nonlocal ready
        while ready < upto:
            ready += 1
            top = np.where(forward[ready] > 0, forward[ready], 1.0)
            scale[ready] = scale[ready - 1] + np.log(top)
            forward[ready : ready + trie.longest] /= top

    for start, stop, at, node in steps:
        complete(start)
        forward[stop, at] += forward[start, at] * p[node]
    complete(width)
    backward = np.zeros((width + 1, n))
    backward[sizes, np.arange(n)] = 1
    for start, stop, at, node in reversed(steps):
        share = p[node] * backward[stop, at] * np.exp(scale[start, at] - scale[stop, at])
        backward[start, at] += share
        out += np.bincount(node, forward[start, at] * share * often[at], len(out))
    return out


def learn(words: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = ROUNDS) -> dict:
    """Word counts by language -> the model: its languages, pieces and scaled probabilities.

    Words are in lower case (A-Z). The first probabilities are the pieces' frequencies as
    substrings; each round replaces them by the expected counts over all segmentations. Pieces
    hardly expected anywhere go; the rest are smoothed with all languages' mean.
    """
    languages = sorted(words)
    trie = Pieces(pieces)
    counts = np.zeros((len(trie.step), len(languages)))
    every = np.zeros(len(trie.step), bool)
    every[trie.ends] = True
    texts = []
    for k, language in enumerate(languages):
        keys = sorted(words[language])
        raw = np.frombuffer(b"".join(keys), np.uint8)
        ends = np.cumsum([len(w) for w in keys])
        texts.append((raw, ends - [len(w) for w in keys], ends, np.array([words[language][w] for w in keys], float)))
    for turn in range(rounds + 1):
        total = counts.sum(axis=0) + 1e-9
        scaled = np.exp(SCALE * trie.lengths)[:, None] * (counts / total if turn else every[:, None] * np.ones(len(languages)) * 1e-3)
        new = np.zeros_like(counts)
        for k, (raw, starts, ends, often) in enumerate(texts):
            p = scaled[:, k]
            for group in _long_groups(starts, ends):
                new[:, k] += _expected_long(trie, p / np.exp(SCALE * trie.lengths), raw, starts[group], ends[group], often[group], not turn)
            for size, rows in _by_length(ends - starts):
                if size > MOST_BYTES:
                    break
                symbols = _symbols(trie, raw, starts[rows], size)
                steps = list(trie.walk(symbols, p > 0))
                if not turn:
                    for _, _, at, node in steps:
                        new[:, k] += np.bincount(node, often[rows][at], len(new))
                    continue
                forward, backward = np.zeros((size + 2, len(rows))), np.zeros((size + 2, len(rows)))
                forward[0] = backward[size + 1] = 1
                for start, stop, at, node in steps:
                    forward[stop, at] += forward[start, at] * p[node]
                for start, stop, at, node in reversed(steps):
                    backward[start, at] += backward[stop, at] * p[node]
                weight = often[rows] / np.maximum(forward[size + 1], 1e-300)
                for start, stop, at, node in steps:
                    new[:, k] += np.bincount(node, forward[start, at] * p[node] * backward[stop, at] * weight[at], len(new))
        single = trie.lengths == 1
        new[single] += 0.1  # each byte stays possible, so every word has a segmentation
        new[new < 1e-3] = 0
        counts = new
    share = counts / counts.sum(axis=0)
    kept = np.flatnonzero((counts.max(axis=1) >= 0.05) | (trie.lengths == 1))
    share = 0.99 * share + 0.01 * share.mean(axis=1, keepdims=True)
    node_piece = dict(zip(trie.ends.tolist(), pieces))
    small = [node_piece[i] for i in kept.tolist()]
    final = Pieces(small)
    scaled = np.zeros((len(final.step), len(languages)))
    scaled[final.ends] = (share[kept] / share[kept].sum(axis=0)) * np.exp(SCALE * final.lengths[final.ends])[:, None]
    return {"languages": languages, "pieces": final, "scaled": scaled}


def learn_from(docs: DataFrame, pieces: list[bytes], per_language: int = SAMPLE_DOCS, most: int = MOST_SAMPLE_DOCS) -> dict:
    """Learns from ``docs(doc_id, text, lang)`` with neither text nor lang null.

    ``per_language`` documents of each language, about, and never more than ``most``, are taken by
    the hash of their doc_id and text, of those with ``MOST_SAMPLE_CHARS`` characters at most: the model is
    a classifier fitted on a bounded sample. The counts of all their words, of any length, come to
    the driver. A language without words isn't learned.
    """
    usable = docs.where("text is not null and lang is not null").where(F.length("text") <= MOST_SAMPLE_CHARS).select("doc_id", "text", "lang")
    totals = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    words: dict[str, dict[bytes, int]] = {}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(17)), F.lit(1_000_000))
    limits = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1_000_000, int(1_000_000 * per_language / n) + 1))]) if totals else None
    if totals:
        chosen = usable.where(draw < limits[F.col("lang")]).dropDuplicates(["lang", "doc_id", "text"])
        chosen = chosen.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct(draw.alias("draw"), "doc_id", "text"))), 1, most).alias("docs"))
        flat = chosen.select("lang", F.explode("docs").alias("d")).select("lang", F.explode(F.split(F.translate("d.text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+")).alias("word"))
        for r in flat.where(F.octet_length("word") > 0).groupBy("lang", "word").count().collect():
            if r["word"] is not None:
                words.setdefault(r["lang"], {})[r["word"].encode()] = r["count"]
    return learn(words, pieces) if words else {"languages": [], "pieces": None, "scaled": None}


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    ascii_letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    count = np.concatenate([np.zeros(1, np.int64), np.cumsum(ascii_letter)])
    out = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])).tolist():
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, lang_pred, score)``, a row each.

    The language whose pieces give the text's words the highest probability, and its share
    of the sum over all languages (each as likely before). ``und`` with score 0 for null
    text, text without a letter, or a model without languages; ties go to the first language
    in order. Other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    key = f"{id(shipped)}-{shipped.id if hasattr(shipped, 'id') else ''}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        names = own["languages"]
        if names and key not in _loaded:
            _loaded.clear()
            _loaded[key] = ragged.Known(1 << 19, np.float64)
        for batch in bytetext.slices(batches, 1, 6 << 20):
            data, offsets = bytetext.raw_bytes(batch.column(1))
            languages, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if names:
                starts, _, text = bytetext.words(data, offsets)
                distinct, which = ragged.distinct_words(data, starts)

                def missing(new, distinct=distinct):
                    some = [distinct[i] for i in new.tolist()]
                    stops = np.cumsum([len(w) for w in some])
                    found = word_scores(own, np.frombuffer(b"".join(some), np.uint8), stops - [len(w) for w in some], stops)
                    return found.ravel(), np.arange(len(new) + 1) * len(names)

                flat, _ = _loaded[key].results(distinct, missing)
                by_word = flat.reshape(-1, len(names))
                sums = np.stack([np.bincount(text, by_word[which, k], batch.num_rows) for k in range(len(names))], axis=1)
                best = sums.argmax(axis=1)
                share = 1 / np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -700)).sum(axis=1)
                for i in np.flatnonzero(_letters(data, offsets)).tolist():
                    languages[i], scores[i] = names[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")
