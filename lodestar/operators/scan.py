"""Recurrences along series of any length, as a parallel scan.

A step that is linear in its state is a matrix, and steps one after the other are the
matrices' product.  Rows are range-partitioned by key and time, so that a long series
lies in as many tasks as it fills; each task multiplies the matrices of its part of a
series, and the parts' products, a few for each series, are multiplied in order.  No
task ever holds a whole series.

Steps that divide, as a filter's variance does, are linear in numerator and
denominator: there only ratios of the state count (projective), and products are scaled
as they grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables

FIRST = "first double, head array<double>, rest array<double>, n long"


def scaled(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=(-2, -1), keepdims=True)
    return m / np.where(top > 0, top, 1.0)


def product(m: np.ndarray, projective: bool) -> np.ndarray:
    """The product of (n, d, d) matrices, the last one leftmost, by halving their number; of none, the identity."""
    if not len(m):
        return np.eye(m.shape[1])
    m = scaled(m) if projective else m
    while len(m) > 1:
        even = len(m) // 2 * 2
        pairs = m[1:even:2] @ m[0:even:2]
        m = np.concatenate([scaled(pairs) if projective else pairs, m[even:]])
    return m[0]


def prefixes(m: np.ndarray, projective: bool) -> np.ndarray:
    """All products of the first 1, 2, ... of (n, d, d) matrices, by doubling."""
    m, step = scaled(m) if projective else m.copy(), 1
    while step < len(m):
        m[step:] = m[step:] @ m[:-step]
        m = scaled(m) if projective else m
        step *= 2
    return m


def _ordered(rows: DataFrame, key: str, order: Sequence[str], value: str, matrix: Column) -> DataFrame:
    """Rows with a value, in order of key and time over all parts."""
    kept = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("value"), matrix.alias("m"))
    by = ["key", *[f"o{i}" for i in range(len(order))], "value"]
    return kept.repartitionByRange(*by).sortWithinPartitions(*by)


def _parts(size: int, projective: bool):
    """Maps a part's (key, value, m) to a row for each key: its first value and matrix, the product of the rest, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held = TaskContext.get().partitionId(), None, None

        def row(keys: pa.DataType) -> pa.RecordBatch:
            first, head, rest, n = held
            columns = [pa.array([key], keys), pa.array([part], pa.int32()), pa.array([first]), pa.array([head.ravel().tolist()]), pa.array([rest.ravel().tolist()]), pa.array([n])]
            return pa.RecordBatch.from_arrays(columns, names=["key", "part", "first", "head", "rest", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            keys, kind = b.column(0).to_pylist(), b.column(0).type
            values = b.column(1).to_numpy()
            m = b.column(2).flatten().to_numpy().reshape(-1, size, size)
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if held is None or keys[a] != key:
                    if held is not None:
                        yield row(kind)
                    key, held = keys[a], (float(values[a]), m[a], product(m[a + 1 : z], projective), z - a)
                else:
                    held = (held[0], held[1], product(np.stack([held[2], product(m[a:z], projective)]), projective), held[3] + z - a)
        if held is not None:
            yield row(kind)

    return run


def last(rows: DataFrame, matrix: Column, size: int, *, key: str = "ticker", order: Sequence[str] = ("ts",), value: str = "close", from_second: bool = True, projective: bool = False) -> DataFrame:
    """(key, n, first, product): of each key's steps in order; from_second: without the first one.

    matrix: a step as an array of size * size numbers, row by row; the state is a
    column.  Rows without a value are left out, equal times are ordered by value.
    """
    tables.ship_code(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    parts = _ordered(rows, key, order, value, matrix).select("key", "value", "m").mapInArrow(_parts(size, projective), f"key {kind}, part int, {FIRST}")

    def folded(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        head, rest = (np.array(t[c].to_pylist()).reshape(-1, size, size) for c in ("head", "rest"))
        steps = np.stack([head, rest], 1).reshape(-1, size, size)
        whole = product(steps[1:] if from_second else steps, projective)
        return pa.table({"key": t["key"].slice(0, 1), "n": pa.array([sum(t["n"].to_pylist())]), "first": t["first"].slice(0, 1), "product": pa.array([whole.ravel().tolist()])})

    # a row for each part that a series touches
    return parts.groupBy("key").applyInArrow(folded, f"key {kind}, n long, first double, product array<double>").withColumnRenamed("key", key)


def running(
    rows: DataFrame, matrix: Column, size: int, start: Callable[[float], Sequence[float]], *, key: str = "ticker", order: Sequence[str] = ("ts",), value: str = "close", projective: bool = False,
) -> DataFrame:
    """(key, order..., value, state): the state behind each row, which is ``start`` of the first value at the first one.

    The parts are written once; then each gets the product of all before it.  Nulls and
    ties as in last().
    """
    tables.ship_code(rows.sparkSession)
    schema = rows.schema
    kind = schema[key].dataType.simpleString()
    ordered = tables.save(_ordered(rows, key, order, value, matrix).withColumn("part", F.spark_partition_id()))

    def summed(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in [*by, "value"]])
        m = np.array(t["m"].combine_chunks().flatten()).reshape(-1, size, size)
        return pa.table({"key": t["key"].slice(0, 1), "part": t["part"].slice(0, 1), "first": t["value"].slice(0, 1), "head": pa.array([m[0].ravel().tolist()]), "rest": pa.array([product(m[1:], projective).ravel().tolist()]), "n": pa.array([len(t)])})

    by = [f"o{i}" for i in range(len(order))]
    parts = ordered.groupBy("key", "part").applyInArrow(summed, f"key {kind}, part int, {FIRST}")

    def before(t: pa.Table) -> pa.Table:
        """For each part of a key: the state behind the last row before it."""
        t = t.sort_by("part")
        state = np.array(start(t["first"][0].as_py()), float)
        out = []
        for i, (head, rest) in enumerate(zip(t["head"].to_pylist(), t["rest"].to_pylist(), strict=True)):
            out.append(state.tolist())
            if i:
                state = np.reshape(head, (size, size)) @ state
            state = np.reshape(rest, (size, size)) @ state
            state = state / np.abs(state).max() if projective and np.abs(state).max() > 0 else state
        return pa.table({"key": t["key"], "part": t["part"], "state": pa.array(out), "opens": pa.array([i == 0 for i in range(len(out))])})

    ahead = parts.groupBy("key").applyInArrow(before, f"key {kind}, part int, state array<double>, opens boolean")
    names = ["key", *by, "value"]
    out_schema = ", ".join(f"{n} {ordered.schema[n].dataType.simpleString()}" for n in names) + ", state array<double>"

    def applied(t: pa.Table, ahead_: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in [*by, "value"]])
        m = np.array(t["m"].combine_chunks().flatten()).reshape(-1, size, size).copy()
        if ahead_["opens"][0].as_py():
            m[0] = np.eye(size)
        states = prefixes(m, projective) @ np.array(ahead_["state"][0].as_py(), float)
        return t.select(names).append_column("state", pa.array(states.tolist()))

    out = ordered.groupBy("key", "part").cogroup(ahead.groupBy("key", "part")).applyInArrow(applied, out_schema)
    return out.withColumnsRenamed({"key": key, "value": value, **{f"o{i}": c for i, c in enumerate(order)}})


def element(product_: str, row: int, column: int, size: int) -> Column:
    return F.get(F.col(product_), F.lit(row * size + column))


def numbers(*values: Column | float) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in values])
