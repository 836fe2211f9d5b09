"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A document's rule measures are taken inside its row. One half of the labelled documents
proposes, for each stratum, cutoffs from a fixed grid; they and their more lenient versions
are joint rules, each stricter than the one before. The other half, the holdout, decides by
exact binomial tests, corrected for all tests made, how strict a stratum's joint rule may be
while it rejects no more than a small part of good documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taleweave.llm.scratch import stored
from taleweave.llm.simhash import words_of

_EDGES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
#: Grid of cutoffs for each measure: a document is rejected when the measure is above it.
#: From strict to lenient, so that the cutoffs of a measure are nested.
GRID = {
    "symbol_share": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2],
    "dup_line_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeat_word_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "long_words": [9.0, 10.0, 12.0, 15.0, 20.0, 30.0],
}
#: Part of a stratum's good documents that its cutoffs may reject together, and the chance that
#: in any stratum they reject more.
MOST_REJECTED, ERROR = 0.02, 0.05
#: Joint rules of a stratum: the proposed cutoffs, and those 1, 2, ... steps of the grid above them.
LEVELS = 8
#: A cutoff is only used where it rejects so many times the part of bad documents that it
#: rejects of good ones.
WORTH = 4
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and its counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Words are runs outside 0x20 and 0x09-0x0D. Null text: no words, all counts 0. A line
    counts if it has a word; n_dup_lines are those equal to an earlier one. n_repeat_words are
    the words inside 3-word windows that occur twice or more in the text, the first included.
    Columns of ``docs`` with these names are replaced.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    solid = F.translate(t, _EDGES, "")
    words = F.when(F.length(solid) > 0, words_of(t)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, _EDGES, "")) > 0)
    rows = docs.withColumns({
        "__words": words, "__lines": lines, "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long"),
    })
    windows = F.expr("transform(slice(__words, 1, greatest(size(__words) - 2, 0)), (w, i) -> xxhash64(w, __words[i + 1], __words[i + 2]))")
    rows = rows.withColumns({
        "n_words": F.size("__words").cast("long"), "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__windows": windows,
    })
    # only texts with a repeated window sort theirs; neighbours in order of (window, place) are then compared
    placed = F.expr("transform(__windows, (h, i) -> named_struct('h', h, 'at', i))")
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    rows = rows.withColumn("__sorted", F.when(repeats, F.sort_array(placed)))
    twice = "transform(filter(transform(__sorted, (x, i) -> named_struct('at', x.at, 'same', x.h <=> get(__sorted, i - 1).h or x.h <=> get(__sorted, i + 1).h)), y -> y.same), y -> y.at)"
    rows = rows.withColumn("__at", F.sort_array(F.expr(twice)))
    covered = "aggregate(__at, named_struct('n', 0L, 'end', 0), (s, p) -> named_struct('n', s.n + p + 3 - greatest(p, s.end), 'end', p + 3), s -> s.n)"
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long"))
    return rows.drop("__words", "__lines", "__windows", "__sorted", "__at")


def shares(rows: DataFrame) -> DataFrame:
    """The measures that have cutoffs, as doubles; 0 where there is nothing to divide by."""
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return rows.withColumns({
        "symbol_share": part("n_symbols", "word_chars"), "dup_line_share": part("n_dup_lines", "n_lines"),
        "repeat_word_share": part("n_repeat_words", "n_words"), "long_words": part("word_chars", "n_words"),
    })


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    """Short, middle and long documents have strata of their own."""
    return F.when(F.col("n_words") < 200, "short").when(F.col("n_words") < 1000, "middle").otherwise("long")


def binomial_tail(rejected: str, n: str, rate: float) -> Column:
    """P(X <= rejected) for X ~ Binomial(n, rate), exactly: its terms are summed as logarithms."""
    odds, none = f"ln({rate!r}D / (1 - {rate!r}D))", f"{n} * ln(1 - {rate!r}D)"
    step = f"a.term + ln(cast({n} - k + 1 as double) / k) + {odds}"
    summed = f"greatest(a.total, {step}) + ln(1 + exp(least(a.total, {step}) - greatest(a.total, {step})))"
    return F.expr(
        f"aggregate(sequence(1L, greatest({rejected}, 1L)), named_struct('term', {none}, 'total', {none}), "
        f"(a, k) -> if(k > {rejected}, a, named_struct('term', {step}, 'total', {summed})), a -> least(exp(a.total), 1D))"
    )


def cutoffs(measured: DataFrame, labels: DataFrame, most_rejected: float = MOST_REJECTED, error: float = ERROR, strata: int = 3) -> DataFrame:
    """``measured(doc_id, stratum, shares...)``, ``labels(doc_id, quality)`` -> ``(stratum, measure, cutoff)``.

    Labelled documents that pass the base rules count, good being quality 1, bad 0; they are
    dealt to two halves by a hash of doc_id. In the first half the strictest cutoff of each
    stratum and measure is proposed that rejects at most an even share of ``most_rejected`` of
    the good ones and is worth that by the bad ones. Level k of a stratum rejects what is above
    any proposed cutoff moved k steps up the grid; a cutoff moved beyond its end rejects nothing.

    In the second half the levels are tested in a fixed order, from lenient to strict. The
    hypothesis "this joint rule rejects more than ``most_rejected`` of the good documents" is
    refuted if its exact binomial p-value times ``strata`` is at most ``error``; the first level
    where it isn't ends the order, so no level needs a further correction. The strictest level
    refuted gives the stratum's cutoffs. So with probability 1 - ``error`` every stratum's rule
    as a whole rejects at most ``most_rejected`` of good documents. A stratum without a proposal,
    or with too few labels, has no row: nothing is rejected. Repeated labels of a document count
    once; a null or other quality doesn't count.
    """
    label = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).select(F.col("doc_id").alias("labelled_id"), "quality")
    held = measured.join(label, F.col("doc_id") == F.col("labelled_id")).where("quality in (0, 1)").select("stratum", "quality", *GRID, F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(2)).alias("half"))
    held = stored(held, "labelled")
    grid = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(i).alias("rank"), F.lit(float(c)).alias("cutoff"), F.col(m).alias("value")) for m, cs in GRID.items() for i, c in enumerate(cs)])
    tried = held.where("half = 0").select("stratum", "quality", F.explode(grid).alias("g")).select("stratum", "quality", "g.*")
    good, above = F.col("quality") == 1, F.col("value") > F.col("cutoff")
    counted = tried.groupBy("stratum", "measure", "rank").agg(
        F.count_if(good).alias("n"), F.count_if(good & above).alias("rejected"), F.count_if(~good).alias("n_bad"), F.count_if(~good & above).alias("bad_rejected"),
    )
    fair = F.col("rejected") * len(GRID) <= most_rejected * F.col("n")
    worth = F.col("bad_rejected") * F.col("n") > WORTH * F.col("rejected") * F.col("n_bad")
    proposed = counted.where(fair & worth).groupBy("stratum", "measure").agg(F.min("rank").alias("rank"))
    steps = F.create_map(*[F.lit(x) for m, cs in GRID.items() for x in (m, [float(c) for c in cs])])
    moved = proposed.select("stratum", "measure", "rank", F.explode(F.lit(list(range(LEVELS)))).alias("level"))
    moved = moved.select("stratum", "measure", "level", F.get(steps[F.col("measure")], F.col("rank") + F.col("level")).alias("cutoff")).where("cutoff is not null")
    moved = stored(moved, "levels")  # at most LEVELS cutoffs for each stratum and measure
    rules = moved.groupBy("stratum", "level").agg(*[F.max(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"cut_{m}") for m in GRID])
    judged_rows = held.where("half = 1 and quality = 1").join(F.broadcast(rules), "stratum").withColumn("gone", _above())
    tests = judged_rows.groupBy("stratum", "level").agg(F.count("*").alias("n"), F.count_if("gone").alias("rejected"))
    refuted = tests.withColumn("ok", binomial_tail("rejected", "n", most_rejected) * strata <= error)
    lenient_first = Window.partitionBy("stratum").orderBy(F.desc("level"))
    chosen = refuted.withColumn("all_ok", F.min("ok").over(lenient_first)).where("all_ok").groupBy("stratum").agg(F.min("level").alias("level"))
    return moved.join(F.broadcast(chosen), ["stratum", "level"]).select("stratum", "measure", "cutoff")


def _above() -> Column:
    """Whether any measure is above its cutoff ``cut_<measure>``; a null one rejects nothing."""
    above = F.lit(False)
    for m in GRID:
        above = above | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    return above


def judged(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, its counts, ``base_failed``, ``kept`` and the ``carry`` columns.

    A row for each row. ``kept`` is false if the base rules fail (fewer than 50 words, or more
    than half of the words repeated), else whether no measure is above its stratum's cutoff.
    No rows: none. The measures are stored once; cutoffs and verdicts both read them there.
    """
    rows = base_measures(docs).select("doc_id", *COUNTS, *(carry or []))
    rows = shares(stored(rows, "measures")).withColumn("base_failed", base_failed()).withColumn("stratum", stratum())
    limits = cutoffs(rows.where(~F.col("base_failed")).select("doc_id", "stratum", *GRID), labels)
    # at most three rows, one for each stratum
    wide = limits.groupBy(F.col("stratum").alias("s")).agg(*[F.max(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"cut_{m}") for m in GRID])
    joined = rows.join(F.broadcast(wide), F.col("stratum") == F.col("s"), "left").withColumn("kept", ~F.col("base_failed") & ~_above())
    return joined.drop("s", *[f"cut_{m}" for m in GRID])


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns, whatever their names."""
    mine = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id"), F.col("text"))
    return judged(mine, labels, ["__row"]).where("kept").select("__row.*")
