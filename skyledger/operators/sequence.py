"""Ordered operators: sessions, islands, carrying, rollover, alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(df: DataFrame, keys: list[str], order: list[str], opens: Column, name: str = "session") -> DataFrame:
    """Rows numbered by the opening rows before them; 0 stands before the first."""
    running = F.sum(opens.cast("int")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, running.cast("long"))


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "island") -> DataFrame:
    """Runs of rows with one value in a row."""
    w = W.partitionBy(*keys).orderBy(*order)
    return sessions(df.withColumn("__new", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)), keys, order, F.col("__new"), name).drop("__new")


def carried(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The last value that is not null, up to the row."""
    return df.withColumn(name, F.last(column, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def filled_from_next(df: DataFrame, keys: list[str], order: list[str], column: str, source: str) -> DataFrame:
    """Where column is null, the next row's source."""
    return df.withColumn(column, F.coalesce(column, F.lead(source).over(W.partitionBy(*keys).orderBy(*order))))


def rollovers(df: DataFrame, keys: list[str], order: list[str], day: str, name: str) -> DataFrame:
    """How often the day number has gone back before the row: months passed."""
    w = W.partitionBy(*keys).orderBy(*order)
    return sessions(df.withColumn("__back", F.coalesce(F.col(day) < F.lag(day).over(w), F.lit(False))), keys, order, F.col("__back"), name).drop("__back")


def nth_key(df: DataFrame, keys: list[str], order: list[str], name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))


def every_nth(df: DataFrame, keys: list[str], order: list[str], step: int) -> DataFrame:
    """Evenly spaced rows of each key, the first included."""
    return df.withColumn("__at", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).filter(F.col("__at") % step == 0).drop("__at")


def align(a: list[tuple], b: list[tuple], gap: int) -> list[tuple[int | None, int | None]]:
    """Least-cost global alignment of two row sequences: a pair costs its differing fields, a gap costs ``gap``.

    Equal ends are matched first; of equal costs a pair comes before a gap in b, and that before a gap in a.
    Two bits are kept for each pair of rows between the equal ends, so 10,000 unlike rows take 25 MB.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(x), len(y)
    codes: dict = {}
    width = max((len(r) for r in [*x, *y]), default=0)
    numbered = lambda rows: np.array([[codes.setdefault(v, len(codes)) for v in [*r, *[None] * (width - len(r))]] for r in rows], np.int64).reshape(len(rows), width)
    fx, fy = numbered(x), numbered(y)
    # of every cell only whether a pair, or a gap in b, leads to it at least cost: two bits
    paired, up = np.zeros((n + 1, m // 8 + 1), np.uint8), np.zeros((n + 1, m // 8 + 1), np.uint8)
    steps = np.arange(m + 1) * gap
    before = steps.copy()
    for i in range(1, n + 1):
        pair = np.concatenate([[np.iinfo(np.int64).max // 2], before[:-1] + (fy != fx[i - 1]).sum(axis=1)])
        row = np.minimum(pair, before + gap)
        row = np.minimum.accumulate(row - steps) + steps  # gaps along the row
        paired[i, : (m + 8) // 8], up[i, : (m + 8) // 8] = np.packbits(row == pair), np.packbits(row == before + gap)
        before = row
    bit = lambda table, i, j: table[i, j >> 3] >> (7 - (j & 7)) & 1
    out, i, j = [], n, m
    while i or j:
        if i and j and bit(paired, i, j):
            i, j = i - 1, j - 1
            out.append((head + i, head + j))
        elif i and (not j or bit(up, i, j)):
            i -= 1
            out.append((head + i, None))
        else:
            j -= 1
            out.append((None, head + j))
    ends = [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    return [(k, k) for k in range(head)] + out[::-1] + ends


def aligned(predicted: DataFrame, expected: DataFrame, key: str, order: str, fields: list[str], gap: int | None = None) -> DataFrame:
    """(key, step, predicted_at, expected_at, differing) by aligning each key's rows; one key is one document."""
    cost = len(fields) if gap is None else gap

    def run(k: tuple, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p, e = p.sort_values(order), e.sort_values(order)
        a, b = (list(map(tuple, d[fields].astype(object).where(d[fields].notna(), None).to_numpy().tolist())) for d in (p, e))
        pairs = align(a, b, cost)
        differing = [cost if i is None or j is None else sum(x != y for x, y in zip(a[i], b[j])) for i, j in pairs]
        return pd.DataFrame({key: [k[0]] * len(pairs), "step": range(len(pairs)), "predicted_at": pd.array([i for i, _ in pairs], "Int64"), "expected_at": pd.array([j for _, j in pairs], "Int64"), "differing": differing})

    kind = expected.schema[key].dataType.simpleString()
    return predicted.groupBy(key).cogroup(expected.groupBy(key)).applyInPandas(run, f"{key} {kind}, step long, predicted_at long, expected_at long, differing long")


def spend(df: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """Calls that a quota of ``limit`` per key admits, in order: rejected calls do not count, so the first ones pass."""
    return nth_key(df, keys, [order], "used").withColumn("admitted", F.col("used") <= limit)
