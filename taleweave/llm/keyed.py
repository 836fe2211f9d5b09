"""Filters by a table of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys (longs) that are broadcast at most: some 100 MB in an executor.
MOST_KEYS = 4_000_000


def filtered(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """``rows`` joined ``left_semi`` or ``left_anti`` with ``keys(on)``, a stored table of longs.

    The keys are counted first: up to ``MOST_KEYS`` are broadcast, so the wide rows aren't
    shuffled; more are left to a shuffled join.
    """
    keys = keys.select(on)
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, on, how)
