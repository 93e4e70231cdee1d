"""Statistics of column pairs in one pass, without a row per pair.

Every task keeps one small array of sums per statistic (a number per pair) and
updates it with numpy over Arrow batches; tasks hand on one row per pair, which
a ``groupBy(pair)`` adds up. The plan is the same for any number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pair_sums(df: DataFrame, exprs: list[Column], pairs: list[tuple[int, int]], names: list[str], kernel) -> DataFrame:
    """(k, names...): sums over all rows of the arrays that ``kernel(values, masks)`` returns per batch."""
    width = len(exprs)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        total = None
        for batch in batches:
            masks = [np.asarray(batch.column(i).is_valid()) for i in range(width)]
            values = [batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(width)]
            got = kernel(values, masks)
            total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int32())] + [
                pa.array(np.asarray(t, float)) for t in total], ["k", *names])
    rows = df.select(*[e.alias(f"v{i}") for i, e in enumerate(exprs)]).mapInArrow(
        run, "k int, " + ", ".join(f"{n} double" for n in names))
    return rows.groupBy("k").agg(*[F.sum(n).alias(n) for n in names])


def _named(df: DataFrame, sums: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    names = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(labels)],
                                            "k int, left string, right string")  # one row per pair
    return names.join(sums, "k", "left")


def equality_counts(df: DataFrame, texts: dict[str, Column], pairs: list[tuple[str, str]]) -> DataFrame:
    """(left, right, mismatches, comparable) of normalised texts, compared by 64-bit hash; two empty texts are equal
    but not comparable."""
    place = {c: i for i, c in enumerate(texts)}
    at = [(place[a], place[b]) for a, b in pairs]
    empty = df.sparkSession.range(1).select(F.xxhash64(F.lit(""))).first()[0]

    def kernel(values, masks):
        blank = [v == empty for v in values]
        return ([int((values[i] != values[j]).sum()) for i, j in at],
                [int(len(values[i]) - (blank[i] & blank[j]).sum()) for i, j in at])

    def add(values, masks):
        import numpy as np
        return [np.array(x, float) for x in kernel(values, masks)]
    sums = _pair_sums(df, [F.xxhash64(e) for e in texts.values()], at, ["mismatches", "comparable"], add)
    return _named(df, sums, pairs).select("left", "right", *[F.coalesce(F.col(c), F.lit(0.0)).cast("bigint").alias(c)
                                                            for c in ("mismatches", "comparable")])


# ------------------------------------------------ duplicate columns by bound
GROUPS, BUCKETS = 8, 16  # row groups x value buckets of a column's sketch
SKETCH_ROW = "c int, slot int, n bigint, x bigint"


def column_sketches(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """(c, slot, n, x) per column: rows of every (row group, value bucket), and in slot -1 a fingerprint of the column.

    Row group and row weight come from the row's own values, so the result depends neither on the order of rows nor
    on a task's repetition. Equal columns have equal sketches. A row that differs between two columns moves one row
    of each, so half the distance of two sketches never exceeds the unequal rows. Blank texts have a bucket of
    their own (0). Tasks hand on at most ``GROUPS * BUCKETS + 1`` rows a column.
    """
    width, slots = len(texts), GROUPS * BUCKETS
    blank = df.sparkSession.range(1).select(F.xxhash64(F.lit(""))).first()[0]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        counts = np.zeros((width, slots), np.int64)
        prints = np.zeros(width, np.uint64)
        scale = np.random.default_rng(5).integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(width)]
            row = np.zeros(batch.num_rows, np.uint64)
            for v, k in zip(values, scale):
                row += v * k
            row ^= row >> np.uint64(31)
            row *= np.uint64(0x9E3779B97F4A7C15)
            row ^= row >> np.uint64(29)
            group = (row % np.uint64(GROUPS)).astype(np.int64) * BUCKETS
            for i, v in enumerate(values):
                bucket = np.where(v == np.uint64(blank % (1 << 64)), 0, 1 + (v % np.uint64(BUCKETS - 1)).astype(np.int64))
                counts[i] += np.bincount(group + bucket, minlength=slots)
                prints[i] += (v * (row | np.uint64(1))).sum(dtype=np.uint64)
        c, slot = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([c, np.arange(width)]), pa.int32()),
             pa.array(np.concatenate([slot, np.full(width, -1)]), pa.int32()),
             pa.array(np.concatenate([counts[c, slot], np.zeros(width, np.int64)]), pa.int64()),
             pa.array(np.concatenate([np.zeros(len(c), np.int64), prints.view(np.int64)]), pa.int64())],
            ["c", "slot", "n", "x"])
    hashes = df.select(*[F.xxhash64(e).alias(f"v{i}") for i, e in enumerate(texts.values())])
    return hashes.mapInArrow(run, SKETCH_ROW).groupBy("c", "slot").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"))


def value_counts_of_pairs(df: DataFrame, texts: dict[str, Column], pairs: list[tuple[str, str]]) -> DataFrame:
    """(left, right, mismatches, comparable) like ``equality_counts``, on the texts themselves instead of hashes."""
    names = list(dict.fromkeys(c for p in pairs for c in p))
    place = {c: i for i, c in enumerate(names)}
    at = [(place[a], place[b]) for a, b in pairs]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        unequal, both = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for batch in batches:
            filled = [pc.not_equal(batch.column(i), "").to_numpy(zero_copy_only=False) for i in range(len(names))]
            for k, (i, j) in enumerate(at):
                unequal[k] += pc.sum(pc.not_equal(batch.column(i), batch.column(j)), min_count=0).as_py()
                both[k] += int((filled[i] | filled[j]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array(unequal), pa.array(both)],
                                         ["k", "mismatches", "comparable"])
    rows = df.select(*[texts[c].alias(f"v{i}") for i, c in enumerate(names)])
    sums = (rows.mapInArrow(run, "k int, mismatches bigint, comparable bigint").groupBy("k")
            .agg(F.sum("mismatches").alias("mismatches"), F.sum("comparable").alias("comparable")))
    return _named(df, sums, pairs).select("left", "right", *[F.coalesce(F.col(c), F.lit(0)).alias(c)
                                                            for c in ("mismatches", "comparable")])


def _pairs_within_bound(hist, rows: int, threshold: float, among: list[int]) -> list[tuple[int, int]]:
    """Pairs (i < j) of the columns ``among`` whose sketches allow a similarity of ``threshold``."""
    import numpy as np
    blanks = hist[:, ::BUCKETS].sum(axis=1)
    out = []
    for a, i in enumerate(among[:-1]):
        rest = np.array(among[a + 1:])
        least = np.abs(hist[rest] - hist[i]).sum(axis=1) / 2
        most = np.minimum(rows, 2 * rows - blanks[i] - blanks[rest])  # no more rows can be comparable
        out += [(i, int(j)) for j in rest[least <= (1 - threshold) * most + 1e-9 * rows + 1e-9]]
    return out


def similar_pairs(df: DataFrame, texts: dict[str, Column], threshold: float) -> list[tuple[str, str, int, int]]:
    """(left, right, mismatches, comparable) of all column pairs that are equal in every row or whose share of equal
    among comparable rows may reach ``threshold``; every other pair is below it.

    One pass sketches the columns; columns of one sketch and fingerprint form a class. A second pass compares, value
    by value, each class member with the first of its class and the classes' first columns with each other where the
    distance of their sketches allows the threshold. What the driver holds depends on the number of columns alone.
    Columns that agree by sketch but not by value are compared with every other column in a third pass.
    """
    import numpy as np
    names = list(texts)
    hist, prints = np.zeros((len(names), GROUPS * BUCKETS), np.int64), [0] * len(names)
    for r in column_sketches(df, texts).collect():  # rows bounded by columns x sketch size
        if r["slot"] < 0:
            prints[r["c"]] = r["x"]
        else:
            hist[r["c"], r["slot"]] = r["n"]
    rows = int(hist[0].sum()) if names else 0
    classes: dict[tuple, list[int]] = {}
    for i in range(len(names)):
        classes.setdefault((prints[i], hist[i].tobytes()), []).append(i)
    groups = {m[0]: m for m in classes.values()}
    inner = [(m[0], i) for m in groups.values() for i in m[1:]]

    def counted(at):
        if not at:
            return {}
        got = value_counts_of_pairs(df, texts, [(names[i], names[j]) for i, j in at]).collect()
        place = {c: i for i, c in enumerate(names)}
        return {(place[r["left"]], place[r["right"]]): (r["mismatches"], r["comparable"]) for r in got}
    found = counted(inner + _pairs_within_bound(hist, rows, threshold, sorted(groups)))
    odd = [i for first, i in inner if found[first, i][0]]
    if odd:
        for i in odd:
            groups = {first: [x for x in m if x != i] for first, m in groups.items()}
        extra = {(min(i, j), max(i, j)) for i in odd for j in range(len(names)) if i != j}
        found |= counted(sorted(extra - set(found)))
        groups |= {i: [i] for i in odd}
    out = []
    for (i, j), (unequal, both) in found.items():
        if i in groups and j in groups:
            out += [(min(a, b), max(a, b), unequal, both) for a in groups[i] for b in groups[j]]
    for first, members in groups.items():
        filled = rows - int(hist[first, ::BUCKETS].sum())
        out += [(a, b, 0, filled) for k, a in enumerate(members) for b in members[k + 1:]]
    return [(names[i], names[j], n, both) for i, j, n, both in sorted(set(out))]


def moment_sums(df: DataFrame, numbers: dict[str, Column], pairs: list[tuple[str, str]]) -> DataFrame:
    """(left, right, n, sx, sy, sxx, syy, sxy) over rows where both numbers exist: products of value and mask
    matrices per batch."""
    place = {c: i for i, c in enumerate(numbers)}
    at = [(place[a], place[b]) for a, b in pairs]

    def kernel(values, masks):
        import numpy as np
        x = np.stack([v.astype(float) for v in values], axis=1)
        m = np.stack(masks, axis=1) & ~np.isnan(x)
        x = np.where(m, x, 0.0)
        m = m.astype(float)
        left, right = np.array([i for i, _ in at]), np.array([j for _, j in at])
        n, s, q, xy = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
        return [n[left, right], s[left, right], s[right, left], q[left, right], q[right, left], xy[left, right]]
    sums = _pair_sums(df, list(numbers.values()), at, ["n", "sx", "sy", "sxx", "syy", "sxy"], kernel)
    return _named(df, sums, pairs)


def order_counts(df: DataFrame, times: dict[str, Column], pairs: list[tuple[str, str]]) -> DataFrame:
    """(left, right, n, le, lt, eq): rows where both exist, and where left is at most, before, equal to right."""
    place = {c: i for i, c in enumerate(times)}
    at = [(place[a], place[b]) for a, b in pairs]

    def kernel(values, masks):
        import numpy as np
        out = []
        for i, j in at:
            both = masks[i] & masks[j]
            lt, eq = both & (values[i] < values[j]), both & (values[i] == values[j])
            out.append((both.sum(), (lt | eq).sum(), lt.sum(), eq.sum()))
        return [np.array(c, float) for c in zip(*out)]
    sums = _pair_sums(df, list(times.values()), at, ["n", "le", "lt", "eq"], kernel)
    return _named(df, sums, pairs)
