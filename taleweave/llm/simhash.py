"""SimHash fingerprints with DataFrame functions only.

Each term's 64-bit hash votes with the term's weight on 64 signed bits. Two bits share one
64-bit sum (32 bits each), so a text's votes are 32 sums that Spark adds up map-side. Texts
within a Hamming radius are found through permuted block tables.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave.llm.scratch import stored

#: A term weighs its characters, but no more than this. Two bits' votes share a sum up to
#: 2**31 in all: 134 million terms of this weight in a text.
MOST_WEIGHT = 16
_PAIR = 0x0000000100000001
_WORD_EDGES = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """The words (runs outside 0x20 and 0x09-0x0D) as an array; ``['']`` if there are none."""
    return F.split(F.trim(text, F.lit(_WORD_EDGES)), "[\\x20\\x09-\\x0D]+")


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``rows(keys..., text)`` -> ``(keys..., fingerprint long)``, a row for each distinct key.

    Terms are the pairs of neighbouring words, or the one word of a one-word text, case
    kept; every occurrence votes with the term's weight. Null, empty and blank texts have the
    fingerprint 0, as has a bit with a tied vote. Equal texts have equal fingerprints.
    """
    split = rows.select(*keys, words_of(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__words"))
    terms = split.select(*keys, "__words", F.posexplode_outer("__words").alias("__at", "__word"))
    following = F.expr("get(__words, __at + 1)")
    lone = following.isNull() & (F.col("__at") > 0)
    weight = F.least(F.length("__word") + F.coalesce(F.length(following) + 1, F.lit(0)), F.lit(MOST_WEIGHT))
    votes = terms.select(*keys, F.xxhash64("__word", following).alias("__h"), F.when(lone, 0).otherwise(weight).cast("long").alias("__w"))
    pairs = [F.sum(F.shiftrightunsigned("__h", j).bitwiseAND(F.lit(_PAIR)) * F.col("__w")).alias(f"__s{j}") for j in range(32)]
    sums = votes.groupBy(*keys).agg(F.sum("__w").alias("__all"), *pairs)
    bits = F.lit(0).cast("long")
    for j in range(64):
        s = F.col(f"__s{j % 32}")
        own = F.shiftrightunsigned(s, 32) if j >= 32 else s.bitwiseAND(F.lit(0xFFFFFFFF))
        bits = bits.bitwiseOR(F.when(own * 2 > F.col("__all"), F.lit((1 << j) - (1 << 64) * (j == 63))).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, bits.alias("fingerprint"))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``radius + 3`` blocks of nearly equal size."""
    n = radius + 3
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_keys(fingerprint: Column, radius: int) -> Column:
    """One key for each table: its number and the bits of the blocks that it puts in front.

    Two fingerprints within the radius agree in at least three of ``radius + 3`` blocks, so
    they meet in the table of those three.
    """
    keys = []
    for table, chosen in enumerate(combinations(_blocks(radius), 3)):
        mask = sum(((1 << bits) - 1) << first for first, bits in chosen)
        keys.append(F.struct(F.lit(table).cast("short").alias("table"), fingerprint.bitwiseAND(F.lit(mask - (1 << 64) * (mask >> 63))).alias("front")))
    return F.array(*keys)


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 3) -> DataFrame:
    """``queries(id, fingerprint)``, ``corpus(fingerprint, n)`` -> ``(id, fingerprint, near, n_rows, distance)``.

    For each query every distinct fingerprint of the corpus within the Hamming ``radius``
    (0 to 13), how many rows have it, and how far it is; its own fingerprint too if it is
    there. A row of the corpus stands for ``n`` rows; those with equal fingerprints are one entry
    of the tables. Null fingerprints match nothing.
    """
    entries = corpus.where("fingerprint is not null").groupBy(F.col("fingerprint").alias("near")).agg(F.sum("n").alias("n_rows"))
    asked = queries.where("fingerprint is not null").select("fingerprint").distinct()
    left = asked.select("fingerprint", F.explode(block_keys(F.col("fingerprint"), radius)).alias("key"))
    right = entries.select("near", "n_rows", F.explode(block_keys(F.col("near"), radius)).alias("key"))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("near")))
    met = left.join(right, "key").where(distance <= radius).select("fingerprint", "near", "n_rows", distance.alias("distance")).distinct()
    return queries.select("id", "fingerprint").join(met, "fingerprint").select("id", "fingerprint", "near", "n_rows", "distance")


#: What tells documents apart that aren't equal: whether there is a doc_id, the doc_id, and the text's hash.
KEY = ["none", "key", "hash"]


def _named(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}.{k}").alias(k) for k in KEY]


def followed(docs: DataFrame, rows_each: int = 50_000) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(none, key, hash, text, n, n_chars, next, head)``, a row for each different document.

    ``n`` rows are equal in doc_id and text. The next document is that with the next higher
    doc_id, the first one after the last; ``next`` has its key, ``head`` as many of its first
    code points as a quarter of this text has. Documents of one doc_id follow each other in
    order of their text's hash, those without a doc_id come first.

    The order is made of the keys alone, in ranges of about ``rows_each``; then each text is
    shuffled once, and the heads once more.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"))
    groups = stored(rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("n_chars")), "groups")
    ranges = groups.repartitionByRange(groups.count() // rows_each + 1, F.desc("none"), "key", "hash").withColumn("bucket", F.spark_partition_id())
    ranges = stored(ranges, "ranges")
    place = F.struct((~F.col("none")).alias("given"), *KEY)
    firsts = ranges.groupBy("bucket").agg(F.min(place).alias("first"))  # a row for each range
    in_order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("bucket", F.coalesce(F.lead("first").over(in_order), F.first("first").over(everything)).alias("after"))
    own = Window.partitionBy("bucket").orderBy(F.desc("none"), "key", "hash")
    led = ranges.withColumn("following", F.lead(place).over(own)).join(firsts, "bucket").withColumn("next", F.coalesce("following", "after"))
    order = stored(led.select(*KEY, "n", "n_chars", F.struct(*[F.col(f"next.{k}").alias(k) for k in KEY]).alias("next")), "order")
    asked = order.select(*_named("next"), F.struct(*KEY).alias("by"), F.floor(F.col("n_chars") / 4).cast("int").alias("wanted"))
    whole = rows.groupBy(*KEY).agg(F.any_value("text").alias("text"))
    heads = whole.join(asked, KEY).select(*_named("by"), F.substring(F.col("text"), F.lit(1), F.col("wanted")).alias("head"))
    return whole.join(order, KEY).join(heads, KEY).select(*KEY, "text", "n", F.col("n_chars").cast("long").alias("n_chars"), "next", "head")


def edited_likeness(docs: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last quarter of the code points (rounded down) replaced by the
    first as many (or all) of the next document. ``near_next`` compares with the next
    document's fingerprint. ``n_within`` counts, for documents whose id is divisible by
    ``every``, the other rows whose fingerprint is within the Hamming ``radius``; null for
    the rest. Null text: empty. A lone document follows itself; of rows equal in doc_id and text
    each but one is followed by its like.
    """
    texts = followed(docs)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    begun = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    versions = [F.col("text"), F.concat(begun, "head"), F.concat(begun, F.substring(F.col("text"), F.lit(1), quarter))]
    each = [F.struct(F.lit(k).alias("which"), v.alias("words")) for k, v in enumerate(versions)]
    each = F.when(F.col("n") > 1, F.array(*each)).otherwise(F.array(*each[:2]))
    keys = [*KEY, "n", "n_chars", "next"]
    rows = texts.select(*keys, F.explode(each).alias("v")).select(*keys, "v.which", F.col("v.words").alias("text"))
    rows = rows.withColumn("sha", F.when(F.col("which") > 0, F.sha2(F.encode("text", "UTF-8"), 256)))
    votes = fingerprints(rows, [*keys, "which", "sha"])
    pick = lambda k, name: F.max(F.when(F.col("which") == k, F.col(name)))
    own = votes.groupBy(*keys).agg(pick(0, "fingerprint").alias("f"), pick(1, "fingerprint").alias("e"), pick(1, "sha").alias("sha"), pick(2, "fingerprint").alias("own_e"), pick(2, "sha").alias("own_sha"))
    own = stored(own, "fingerprints")
    joined = own.join(own.select(F.struct(*KEY).alias("next"), F.col("f").alias("g")), "next", "left")
    asked = own.where(~F.col("none") & (F.col("key") % every == 0)).select(F.struct(*KEY).alias("id"), F.col("f").alias("fingerprint"))
    found = within_radius(asked, own.select(F.col("f").alias("fingerprint"), "n"), radius)
    counts = found.groupBy("id").agg((F.sum("n_rows") - 1).alias("n_within")).select(*_named("id"), "n_within")
    joined = joined.join(counts, KEY, "left")
    # equal rows come back in two steps, so that no array has all of them
    joined = joined.withColumn("many", F.explode(F.expr("sequence(0L, (n - 1) div 4096)")))
    joined = joined.withColumn("copy", F.explode(F.expr("sequence(many * 4096, least(n, (many + 1) * 4096) - 1)")))
    last = F.col("copy") == 0
    e, g = F.when(last, F.col("e")).otherwise(F.col("own_e")), F.when(last, F.col("g")).otherwise(F.col("f"))
    return joined.select(
        F.when(~F.col("none"), F.col("key")).alias("doc_id"), "n_chars", F.when(last, F.col("sha")).otherwise(F.col("own_sha")).alias("edited_sha256"),
        as_hex(F.col("f")).alias("fingerprint"), as_hex(e).alias("edited_fingerprint"),
        likeness(F.col("f"), e).alias("near_edited"), likeness(F.col("f"), g).alias("near_next"), "n_within",
    )
