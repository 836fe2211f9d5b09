"""Call ledger, agent runs and reply stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Budget of an agent run: turns, input tokens of the last turn, cost in USD (fixed values).
MOST_TURNS, MOST_INPUT, MOST_COST = 10, 60_000, 0.05
#: Tool results longer than this, before the last turns kept, are folded to a note (fixed value).
LONG_RESULT = 200


def usage(calls: DataFrame) -> DataFrame:
    """``calls(purpose, model, cache_hit, tokens_in, tokens_out, cost)`` summed by purpose and model, with the total.

    The total is the rollup's own row (purpose and model null), not a second pass.
    """
    sums = [F.count("*").alias("calls"), F.count_if("cache_hit").alias("cache_hits"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").cast("decimal(20,6)").alias("cost")]
    rows = calls.rollup("purpose", "model").agg(*sums, F.grouping_id().alias("level"))
    return rows.where("level <> 1").drop("level").orderBy(F.col("purpose").asc_nulls_last(), F.col("model").asc_nulls_last())


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call from its tokens; ``prices`` in USD per million. Cached input has its own price; unknown models cost 0."""
    # by one hash of a few models, calls would gather in as few tasks
    rows = calls.join(F.broadcast(prices), "model", "left")
    part = lambda n, price: F.col(n) * F.coalesce(F.col(price), F.lit(0.0)) / F.lit(1e6)
    fresh = (F.col("tokens_in") - F.col("tokens_cached")) * F.coalesce(F.col("price_in"), F.lit(0.0)) / F.lit(1e6)
    return rows.withColumn("cost", F.round(fresh + part("tokens_cached", "price_cached") + part("tokens_out", "price_out"), 6)).drop("price_in", "price_cached", "price_out")


def folded(messages: DataFrame, keep_turns: int = 2, long: int = LONG_RESULT) -> DataFrame:
    """``messages(run, seq, role, size)`` -> with ``folded``: long tool results before the last turns kept."""
    after = Window.partitionBy("run").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("role") == "assistant").cast("int")).over(after), F.lit(0))
    return messages.withColumn("turns_after", turns).withColumn("folded", (F.col("role") == "tool") & (F.col("size") > long) & (F.col("turns_after") >= keep_turns))


def budget_stops(steps: DataFrame, turns: int = MOST_TURNS, tokens: int = MOST_INPUT, cost: float = MOST_COST) -> DataFrame:
    """``steps(run, seq, tokens_in, cost)`` -> the step at which each run went over a limit, and which."""
    w = Window.partitionBy("run").orderBy("seq")
    rows = steps.withColumns({"turn": F.row_number().over(w), "spent": F.sum("cost").over(w)})
    reason = F.when(F.col("turn") >= turns, "turns").when(F.col("tokens_in") >= tokens, "tokens").when(F.col("spent") >= cost, "cost")
    over = rows.withColumn("reason", reason).where("reason is not null")
    return over.groupBy("run").agg(F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason"))


def run_summary(steps: DataFrame) -> DataFrame:
    """Per run: steps by kind and the text handled."""
    return steps.groupBy("run").agg(F.count("*").alias("steps"), F.count_if(F.col("role") == "assistant").alias("turns"), F.count_if(F.col("role") == "tool").alias("tool_calls"), F.sum("size").alias("chars"))


def cached(calls: DataFrame) -> DataFrame:
    """``calls(hash, ok, created, reply)`` -> the reply that serves each request: its first good one."""
    return calls.where("ok").groupBy("hash").agg(F.min_by("reply", "created").alias("reply"))


def replayed(replies: DataFrame, samples: list[int]) -> DataFrame:
    """``replies(request, created, reply)`` -> the i-th recorded reply for each sample i, from the start again."""
    w = Window.partitionBy("request")
    n = replies.withColumn("place", F.row_number().over(w.orderBy("created")) - 1).withColumn("of", F.count("*").over(w))
    wanted = F.filter(F.array(*map(F.lit, samples)), lambda s: F.pmod(s, F.col("of")) == F.col("place"))
    return n.select("request", F.explode(wanted).alias("sample"), "reply")


def verdict_problems(verdicts: DataFrame, quotes: DataFrame) -> DataFrame:
    """``verdicts(run, verdict, reason, read)``, ``quotes(run, located)`` -> what the guard refuses, with why.

    A contradiction must be the reason of a genuine verdict and of no other, a dismissal needs something
    read, and there must be quotes, all found in the text.
    """
    q = quotes.groupBy("run").agg(F.count("*").alias("n"), F.count_if(~F.col("located")).alias("lost"))
    rows = verdicts.join(q, "run", "left")
    genuine, contradiction = F.col("verdict") == "genuine", F.col("reason") == "contradiction"
    problem = F.when(genuine != contradiction, "reason").when((F.col("verdict") == "false_alarm") & ~F.col("read"), "unread").when(F.coalesce("n", F.lit(0)) == 0, "no_quote").when(F.col("lost") > 0, "quote_lost")
    return rows.withColumn("problem", problem).where("problem is not null").select("run", "problem")


def error_kind(column: str = "message") -> Column:
    """A provider error's class from its text (content_filter, rate_limit, auth, server, network, else bad_request)."""
    text = F.lower(F.col(column))
    return (
        F.when(text.rlike("content.?filter|sensitive"), "content_filter").when(text.rlike(r"\b429\b|rate.?limit"), "rate_limit")
        .when(text.rlike(r"\b40[123]\b|unauthorized|api key|insufficient balance"), "auth")  # 402: no balance left
        .when(text.rlike("timeout|connection"), "network").when(text.rlike(r"\b5\d\d\b"), "server").otherwise("bad_request")
    )
