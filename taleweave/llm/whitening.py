"""Whitening of embeddings along their leading components.

Vectors become whole numbers, each distinct one counts once. Sums and the centred covariance are
taken in tasks and added up by Spark; only a matrix of the dimension squared comes to the driver,
where its leading eigenpairs are found. They are broadcast, and every vector is projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm.eigen import EPS, leading
from taleweave.llm.scratch import stored

#: An eigenvalue within so many roundings of the trace a dimension counts as none.
ROUNDING = 16


def quantised(rows: DataFrame, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``rows(key, vector)`` -> ``(key, x array<long>)`` with x = floor(scale * entry), the entry as double.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry go. So do rows of another
    length than the commonest (of two, the shorter), as they have no covariance with the rest.
    """
    own = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    own = own.where(F.col("v").isNotNull()).where(~bad & (F.size("v") > 0))
    sizes = own.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    return own.where(F.size("v") == size).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of each dimension and the count, of a task."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            # halves of 32 bits can't overflow in a batch
            part = [(int(h) << 32) + int(l) for h, l in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
            total = part if total is None else [a + b for a, b in zip(total, part)]
            n += len(x)
    total = [n, *(total or [])] if n else []
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total) - 1), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["i", "total"])


def _products(centred):
    """Sums of the products of two centred columns, i <= j, of a task. ``centred`` makes rows from an array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                c = centred(batch.column(0))
                total = c.T @ c + (0 if total is None else total)
        i, j = np.triu_indices(0 if total is None else len(total))
        values = np.zeros(0) if total is None else total[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values)], names=["i", "j", "total"])

    return run


def _covariance(rows: DataFrame, centred, n: int, size: int) -> np.ndarray:
    found = rows.mapInArrow(_products(centred), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()  # size * (size + 1) / 2 rows
    out = np.zeros((size, size))
    i, j, total = (found[c].to_numpy() for c in ("i", "j", "total"))
    out[i, j] = out[j, i] = total / n
    return out


def learn(x: DataFrame, components: int = 4) -> dict | None:
    """``x(x array<long>, ...)``, all of one length -> the model, or None without rows.

    ``n`` distinct vectors with exact ``sums``; ``mean``; ``values`` and ``vectors``, the leading
    eigenpairs of their covariance (divisor n), at most ``components`` and only those whose
    eigenvalue is above rounding, so vectors that don't vary have none; ``trace``; and
    ``identity_error``, how far the whitened vectors' covariance is from the identity.

    The driver holds a matrix of the vectors' length squared, whatever the number of rows.
    """
    fit = stored(x.select("x").distinct(), "distinct-vectors")
    found = {r["i"]: int(r["total"]) for r in fit.mapInArrow(_sums, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()}
    if not found:
        return None
    n, sums = found.pop(-1), [found[i] for i in sorted(found)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    covariance = _covariance(fit, lambda lists: _matrix(lists) - mean, n, len(mean))
    values, vectors = leading(covariance, components)
    trace = float(np.trace(covariance))
    real = values > ROUNDING * len(mean) * EPS * trace
    model = {"n": n, "sums": sums, "mean": mean, "values": values[real], "vectors": vectors[real], "trace": trace, "identity_error": 0.0}
    k = int(real.sum())
    if k:
        axes = (vectors[real] / np.sqrt(values[real])[:, None]).T

        def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for batch in batches:
                if batch.num_rows:
                    total += ((_matrix(batch.column(0)) - mean) @ axes).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["i", "total"])

        middle = np.zeros(k)
        for r in fit.mapInArrow(means, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).collect():
            middle[r["i"]] = r["total"] / n
        white = _covariance(fit, lambda lists: (_matrix(lists) - mean) @ axes - middle, n, k)
        model["identity_error"] = float(np.abs(white - np.eye(k)).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n*x - S)**2 of each row; None where a long can't hold it."""
    most = n * int(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
    if most**2 * max(1, len(sums)) < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(x: DataFrame, model: dict) -> DataFrame:
    """``x(vec_id, x)`` -> ``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for each row and component.

    ``deviation`` is null where a long can't hold it. Repeated rows and null ids are kept as they are.
    """
    kind = x.schema["vec_id"].dataType.simpleString()
    shipped = x.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        k = len(m["values"])
        axes = (m["vectors"] / np.sqrt(m["values"])[:, None]).T
        for batch in batches:
            rows = batch.num_rows
            if not rows or not k:
                continue
            own = _matrix(batch.column(1))
            each = np.repeat(np.arange(rows), k)
            columns = [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m["n"])),
                pa.array(deviations(own, m["n"], m["sums"]), pa.int64()).take(pa.array(each)), pa.array(((own - m["mean"]) @ axes).ravel()),
                pa.array(np.tile(m["values"] / m["trace"], rows)), pa.array(np.full(rows * k, m["identity_error"])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(rows: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """``rows(vec_id, embedding)`` -> ``whiten`` of all rows that ``quantised`` keeps, learned from them.

    No row left, or no variance in any direction: an empty result. Other columns are not read.
    """
    x = quantised(rows, scale)
    empty = {"n": 0, "sums": [], "mean": np.zeros(0), "values": np.zeros(0), "vectors": np.zeros((0, 0)), "trace": 0.0, "identity_error": 0.0}
    return whiten(x, learn(x, components) or empty)
