"""Exact quantiles of many columns by narrowing histograms.

A double maps to a 64-bit integer of the same order. For every wanted rank an
interval of these integers is known to hold it, and one pass over the columns
counts the values of all intervals in equal bins, with numpy per Arrow batch:
a task keeps a fixed number of bins per interval, and only bins are shuffled,
never values. The bin that holds the rank, cut to the least and the greatest
value in it, is the next interval; a rank is settled when both are the same.
A pass narrows an interval by its number of bins, so six passes are the most
that any data can need with 2,048 of them, and two or three are usual.

NaN counts as missing, like NULL.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.operators.profile import c_

#: Bins that a task holds over all intervals (24 bytes each), and the bounds of an interval's share.
TASK_BINS = 1 << 22
BIN_BOUNDS = (64, 4096)


def _key_functions():
    """(integer of the same order for each double, keys of a batch's column without NULL and NaN, the double of a key).

    Made here, so that they travel to the workers by value.
    """
    import numpy as np

    def keys(values):
        bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)  # -0.0 becomes 0.0
        return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)

    def column_keys(column):
        values = column.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        return keys(values[~np.isnan(values)])

    def value(key):
        bits = key ^ 0x7FFFFFFFFFFFFFFF if key < 0 else key
        return float(np.array(bits, np.int64).view(np.float64))
    return keys, column_keys, value


def value_ranges(rows: DataFrame) -> DataFrame:
    """(i, n, low, high): count, least and greatest key of each column."""
    width = len(rows.columns)
    _, column_keys, _ = _key_functions()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        n, low, high = np.zeros(width, np.int64), np.full(width, 2**63 - 1), np.full(width, -2**63)
        for batch in batches:
            for i in range(width):
                k = column_keys(batch.column(i))
                if len(k):
                    n[i] += len(k)
                    low[i], high[i] = min(low[i], k.min()), max(high[i], k.max())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, n[some], low[some], high[some])],
                                         ["i", "n", "low", "high"])
    return rows.mapInArrow(run, "i long, n long, low long, high long").groupBy("i").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def interval_histogram(rows: DataFrame, intervals: list[tuple[int, int, int]]) -> DataFrame:
    """(interval, bin, n, low, high, before): counts, least and greatest key of every bin of every interval (column,
    low, high), and the values of the interval in the bins before."""
    bins = max(BIN_BOUNDS[0], min(BIN_BOUNDS[1], TASK_BINS // len(intervals)))
    _, column_keys, _ = _key_functions()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        n = np.zeros((len(intervals), bins), np.int64)
        least, most = np.full(n.shape, 2**63 - 1), np.full(n.shape, -2**63)
        by_column = {}
        for t, (i, low, high) in enumerate(intervals):
            by_column.setdefault(i, []).append((t, low, high, (high - low) // bins + 1))
        for batch in batches:
            for i, own in by_column.items():
                k = column_keys(batch.column(i))
                for t, low, high, width in own:
                    inside = k[(k >= low) & (k <= high)]
                    # the difference may pass 63 bits: it is taken modulo 2^64, where it is exact
                    bin_ = ((inside.view(np.uint64) - np.uint64(low % 2**64)) // np.uint64(width)).astype(np.int64)
                    n[t] += np.bincount(bin_, minlength=bins)
                    np.minimum.at(least[t], bin_, inside)
                    np.maximum.at(most[t], bin_, inside)
        t, b = np.nonzero(n)
        columns = [t, b, n[t, b], least[t, b], most[t, b]]
        for at in range(0, len(t), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at:at + (1 << 16)]) for x in columns],
                                             ["interval", "bin", "n", "low", "high"])
    counted = rows.mapInArrow(run, "interval long, bin long, n long, low long, high long").groupBy("interval", "bin").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    before = Window.partitionBy("interval").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows
    return counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _narrowed(rows: DataFrame, wanted: dict[tuple[int, int, int], set[int]]) -> dict:
    """The interval, and the rank in it, of each wanted (interval, rank)."""
    intervals = list(wanted)
    asked = rows.sparkSession.createDataFrame(
        [(t, r) for t, x in enumerate(intervals) for r in sorted(wanted[x])], "interval long, rank long")
    found = (interval_histogram(rows, intervals).join(F.broadcast(asked), "interval")  # a row per quantile asked for
             .where("rank >= before and rank < before + n").select("interval", "rank", "low", "high", "before"))
    return {(intervals[r["interval"]], r["rank"]): ((intervals[r["interval"]][0], r["low"], r["high"]), r["rank"] - r["before"])
            for r in found.collect()}


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list]:
    """Exact quantiles (linear between neighbours) of several columns; ``None`` for a column without values.

    NULL and NaN are left out. The columns are read once into a persisted projection, which the passes scan.
    """
    if not cols:
        return {}
    rows = df.select(*[c_(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ranges = {r["i"]: r for r in value_ranges(rows).collect()}  # a row per column
        at = {i: [p * (r["n"] - 1) for p in probs] for i, r in ranges.items()}
        ends = {(i, rank) for i, own in at.items() for x in own for rank in (math.floor(x), math.ceil(x))}
        place = {(i, rank): ((i, ranges[i]["low"], ranges[i]["high"]), rank) for i, rank in ends}
        while wide := {x for x in place.values() if x[0][1] < x[0][2]}:
            wanted: dict[tuple[int, int, int], set[int]] = {}
            for interval, rank in wide:
                wanted.setdefault(interval, set()).add(rank)
            step = _narrowed(rows, wanted)
            place = {k: step.get(x, x) for k, x in place.items()}
    finally:
        rows.unpersist()
    _, _, value = _key_functions()

    def quantile(i, x):
        low, high = (value(place[i, r][0][1]) for r in (math.floor(x), math.ceil(x)))
        share = x - math.floor(x)
        return low if not share else (1 - share) * low + share * high
    return {c: [quantile(i, x) for x in at[i]] if i in at else [None] * len(probs) for i, c in enumerate(cols)}
