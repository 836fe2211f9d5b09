"""Near-duplicate documents by circulant MinHash.

One permutation scatters a shingle over D places; a second one, read from each place
onwards, gives all K signature coordinates: coordinate k is the second permutation shifted
by k. A shingle's K values are therefore one contiguous slice of a table, and a document's
signature is the minimum over its shingles' slices. Bands of the signature propose pairs;
every link is confirmed by the exact similarity of the two full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm import bytetext
from taleweave.llm.components import connected_components
from taleweave.llm.keyed import filtered
from taleweave.llm.scratch import stored

#: Places of the permutations (a power of two).
PLACES = 1 << 20
#: Signature bands and coordinates in each. A pair of similarity 0.8 shares no band with
#: probability (1 - 0.8**6)**50, about 2.5e-7; one of 0.85 with 5e-11.
BANDS, ROWS = 50, 6
#: Shingles whose slices are reduced at once.
_SLICE = 2048
_tables: dict = {}


def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    if coordinates not in _tables:
        rng = np.random.default_rng(7)
        scatter = rng.permutation(PLACES).astype(np.int32)
        circle = rng.permutation(PLACES).astype(np.int32)
        _tables[coordinates] = scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([circle, circle[:coordinates]]), coordinates)
    return _tables[coordinates]


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """All coordinates of a non-empty set of shingle hashes, from the two permutations."""
    scatter, circle = _permutations(coordinates)
    place = scatter[(shingles & np.uint64(PLACES - 1)).astype(np.int64)]
    out = circle[place[:_SLICE]].min(axis=0)
    for i in range(_SLICE, len(place), _SLICE):
        np.minimum(out, circle[place[i : i + _SLICE]].min(axis=0), out=out)
    return out


def _band_hashes(sign: np.ndarray) -> np.ndarray:
    rows = sign.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = bytetext.mixed(h * np.uint64(0x9FB21C651E98DF25) + rows[:, i])
    return h


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytetext.raw_bytes(batch.column(1))
            n, k1, k2, bands = [], [], [], []
            for s, t in bytetext.shingle_sets(data, offsets, size):
                n.append(len(s))
                k1.append(np.add.reduce(bytetext.mixed(s, 1)).view(np.int64) if len(s) else 0)
                k2.append(np.add.reduce(bytetext.mixed(t, 2)).view(np.int64) if len(s) else 0)
                # m shingles or fewer can only match a different set if 1 of m + 1 may differ
                bands.append(_band_hashes(signature(s)).view(np.int64) if 100 * len(s) >= percent * (len(s) + 1) else np.zeros(0, np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), column], schema=_SIGNED)

    return run


def _verify(size: int, percent: int):
    """Keeps the pairs whose full sets, of words and not of hashes, have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.slices(batches, 2, 4 << 20):
            pivot, text = batch.column(1).to_numpy(), pc.fill_null(batch.column(3), "")
            # rows of one pivot follow each other, but a doc_id can have several texts
            new = np.concatenate([[True], (pivot[1:] != pivot[:-1]) | pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)])
            sets = bytetext.shingle_numbers(*bytetext.raw_bytes(pa.concat_arrays([batch.column(2), batch.column(3).take(pa.array(np.flatnonzero(new)))])), size)
            linked = np.zeros(len(pivot), bool)
            for i, at in enumerate((len(pivot) + np.cumsum(new) - 1).tolist()):
                own, other = sets[i], sets[at]
                if len(other):
                    place = np.searchsorted(other, own)
                    place[place == len(other)] = 0
                    both = int((other[place] == own).sum())
                    linked[i] = both > 0 and 100 * both >= percent * (len(own) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _different(texts: DataFrame, again: DataFrame) -> DataFrame:
    """``texts(doc_id, text)`` with rows equal in both once; those of doc_ids that stand alone, not in ``again``, aren't touched."""
    once = texts.join(again, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("hash")).agg(F.any_value("text").alias("text"))
    return texts.join(again, "doc_id", "left_anti").unionByName(once.select("doc_id", "text"))


def _ties(usable: DataFrame, classes: DataFrame, again: DataFrame) -> DataFrame:
    """``(a, b)``: the classes that have a doc_id in common, as one with several texts is one node."""
    own = usable.join(again, "doc_id", "left_semi").join(classes.select("k1", "k2", "n_shingles", "rep"), ["k1", "k2", "n_shingles"]).select("doc_id", "rep").distinct()
    first = own.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return own.join(first, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``pairs(a, b)`` -> those whose texts are similar enough, stored. Only texts of documents in pairs are shuffled."""
    named = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "named")
    texts = filtered(texts, named, "doc_id", "left_semi")
    sides = [texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b")]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")
    return stored(rows.mapInArrow(_verify(size, percent), "a long, b long").distinct(), "links")


#: Counters of shingles, in which rare ones are told from frequent ones; the size of a broadcast.
COUNTERS = 1 << 20


def _count_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s, _ in bytetext.shingle_sets(*bytetext.raw_bytes(batch.column("text")), size):
                np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["counter", "n"])

    return run


def _rare_shingles(size: int, percent: int, shipped):
    """Of each set, in the order from rare to frequent, the first that a similar set must share.

    A set of n similar to a smaller one shares 2p/(1+p) of n with it at least, one of
    another size p of n; so the first n less that many (and one) hold a shared shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        for batch in batches:
            reps, labels = batch.column("rep").to_numpy(), batch.column("label").to_numpy()
            sets = [s for s, _ in bytetext.shingle_sets(*bytetext.raw_bytes(batch.column("text")), size)]
            tokens, rows, close, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
            for i, s in enumerate(sets):
                n = len(s)
                far, near = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                order = np.lexsort((s, counts[(s >> np.uint64(44)).astype(np.int64)]))[:far]
                tokens.append(s[order])
                rows.append(np.full(len(order), i))
                close.append(np.arange(len(order)) < near)
                place.append(np.arange(len(order)))
            row = np.concatenate(rows)
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(reps[row]), pa.array(labels[row]), pa.array(n[row]), pa.array(np.concatenate(close)), pa.array(np.concatenate(place))], names=["token", "rep", "label", "n", "near", "at"])

    return run


def _rare_pairs(rest: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``rest(rep, label)`` -> ``(a, b)``: the pairs of different labels that share a rare shingle."""
    named = stored(rest.select(F.col("rep").alias("doc_id")).distinct(), "named")
    rows = rest.join(filtered(texts, named, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text"), "rep")
    counted = rows.select("text").mapInArrow(_count_shingles(size), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, np.int32)
    counts[found["counter"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**31 - 1)
    shipped = rest.sparkSession.sparkContext.broadcast(counts)
    tokens = rows.mapInArrow(_rare_shingles(size, percent, shipped), "token long, rep long, label long, n long, near boolean, at long")
    often = tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    tokens = stored(tokens.join(often.select("token"), "token"), "tokens")
    other = tokens.where("near").select("token", F.col("rep").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    # the first shingle that two sets share leaves no more for the rest than the shorter remainder
    sized = f"(n > n_b or (n = n_b and rep > b)) and 100 * n_b >= {percent} * n and label <> label_b and {100 + percent} * least(n - at, n_b - at_b) >= {percent} * (n + n_b)"
    return tokens.join(other, "token").where(sized).select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id, kept)``, a row for each row.

    Documents are linked when the similarity of their sets of distinct ``size``-word shingles
    (words: runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased) is ``percent`` / 100
    or more; ``component_id`` is the smallest doc_id that links reach, ``kept`` marks it.

    Null or blank text: the empty set, linked with nothing. Fewer words than ``size``: the
    whole sequence is the one shingle. Repeated doc_ids count as one node, with the links of each
    of their texts. A null doc_id has a null component and is kept. Other columns, whatever their names, are not read.

    Documents whose sets are equal by a 128-bit digest are one class before any pair is
    formed, so a group of copies costs one row; links between classes are confirmed on the
    words themselves. A bucket of classes is compared with its best connected member first.
    Members of buckets that then still hold several components are told apart further by
    their rarest shingles: sets similar enough share one among those, so pairs that share
    none are ruled out without being formed, and no pair that is a link is lost.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(texts.mapInArrow(_sign(size, percent), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    again = stored(signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    texts = _different(texts, again)
    classes = stored(usable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "classes")

    members = classes.select(F.explode("bands").alias("bucket"), "rep", "n_shingles")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(members.join(shared, "bucket"), "members")
    # those with the most neighbours first: the original of many copies is compared before the copies are
    ranks = members.groupBy("rep").agg(F.struct((-F.sum("n")).alias("score"), F.col("rep").alias("id")).alias("rank"))
    members = stored(members.join(ranks, "rep"), "members")
    star = members.groupBy("bucket").agg(F.min("rank").alias("first"), F.min_by("n_shingles", "rank").alias("n_b"))
    fits = f"100 * least(n_shingles, n_b) >= {percent} * greatest(n_shingles, n_b)"
    pairs = members.join(star, "bucket").where("rep <> first.id").where(fits).select(F.col("rep").alias("a"), F.col("first.id").alias("b"))
    checked = stored(pairs.distinct(), "pairs")
    links = stored(_links(checked, texts, size, percent).union(_ties(usable, classes, again)), "links")
    labels = connected_components(links)

    # members of the buckets that still hold several components
    named = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    several = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    rest = stored(named.where("n > 2").join(several.select("bucket"), "bucket").select("rep", "label").distinct(), "open")
    pairs = _rare_pairs(rest, texts, size, percent)
    pairs = stored(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():  # else the join would shuffle all texts for no pair
        new = _links(pairs, texts, size, percent)
        if not new.isEmpty():
            labels = connected_components(links.union(new))
    whole = classes.select("k1", "k2", "n_shingles", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    whole = whole.select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    found = usable.select("doc_id", "n_shingles", "k1", "k2").join(whole, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", "component")
    # a blank row is in the component of its doc_id's other texts
    named = found.join(again, "doc_id", "left_semi").select("doc_id", "component").distinct()
    rest = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles").join(named, "doc_id", "left")
    rest = rest.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    return found.union(rest).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
