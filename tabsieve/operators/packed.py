"""Ordered target statistics in hash order over packed rows, for trees that read bins.

``hashed_target_encode`` shuffles and stores whole rows, once per category. Trees read a bin per feature, and the hash
that orders a row for its second category is that of its first, gone on over the first statistic. So a row is a record of
hash, bins, level codes and label here (15 bytes for four numbers and two categories), records travel in blocks by the
leading bits of their hash, and a block is sorted and summed with numpy. The statistics are those of
``hashed_target_encode``, in the order of the same hashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.operators import boosting
from tabsieve.operators.joins import drop_stored, scratch_path, stored
from tabsieve.operators.ordered import _parts

#: Most records that a worker holds at once; equal rows have equal hashes, so they share a part.
PART_ROWS = 1 << 21
#: Most sums per part and level that travel with a pass.
CARRIED = 1 << 20
#: Most bytes of level names that travel with a pass.
LEVEL_BYTES = 1 << 24


@dataclass
class Packed:
    """Records of all rows (see ``pack``), of which a fit takes the hash, numbers and categories that it reads."""

    blocks: DataFrame
    nums: list[str]
    cats: list[str]
    levels: dict[str, int]
    orders: dict[tuple, int]
    thresholds: list[list[float]]
    rows: int
    weight: float
    weighted: bool
    parts: int
    prior: float
    key: tuple
    crowded: set = field(default_factory=set)

    def holds(self, columns: list[str], key: tuple) -> bool:
        """Whether fits that read ``columns`` and bin by ``key`` can use these records."""
        return key == self.key and tuple(columns) in self.orders and self.orders[tuple(columns)] not in self.crowded


def _record(nums: int, cats: int, weighted: bool, hashed: bool = True, values: int = 0) -> list:
    """Fields of a record: hash, bins, level codes, label, whether it is held for validation, weight, statistics."""
    return ([("h", "<i8")] if hashed else []) + [("x", "u1", (nums,)), ("c", "<u2", (cats,)), ("y", "i1"), ("held", "?")] + (
        [("w", "<f8")] if weighted else []) + ([("t", "<f8", (values,))] if values else [])


def pack(src: DataFrame, filled: dict[str, Column], cats: list[str], levels: dict, orders: list[list[str]], label: str, weight: str | None,
         val: str | None, prior: float, bins: int, seed: int, path: str) -> Packed | None:
    """``src`` as records, stored in ``path``, with a hash for each list of columns in ``orders``; ``None`` if the levels
    are too many to travel.

    ``filled`` gives the numbers without NULL, ``levels`` the ``LevelTable`` of each category. The rest is as in ``bin_rows``.
    """
    nums, spark = list(filled), src.sparkSession
    column = lambda name: F.col("`" + name.replace("`", "``") + "`")
    held = column(val).cast("boolean") if val else F.lit(False)
    rows = src.select(held.alias("held"), boosting._label(column(label)).alias("y"),
                      (boosting._weight(column(weight)) if weight else F.lit(1.0)).alias("w"),
                      *[e.cast("double").alias(f"x{i}") for i, e in enumerate(filled.values())],
                      *[column(c).cast("string").alias(f"c{i}") for i, c in enumerate(cats)],
                      *[F.xxhash64(*[column(c) for c in own]).alias(f"h{i}") for i, own in enumerate(orders)]).where("held is not null")
    names = [[r["_lvl"] for r in levels[c].table.select("_lvl").orderBy("_lvl").collect()] for c in cats]  # few: see prepared
    n, total, thresholds = boosting.sampled_points(rows, [f"x{i}" for i in range(len(nums))], weight is not None, val is not None, bins, seed)
    parts = max(_parts(src, None), n // (PART_ROWS // 4))
    if (any(len(own) * parts > CARRIED for own in names) or any(len(own) >= 1 << 16 for own in names)
            or sum(len(v or "") for own in names for v in own) > LEVEL_BYTES):
        return None
    blocks = stored(_packed(rows, names, thresholds, len(orders), weight is not None), path)
    out = Packed(blocks, nums, list(cats), {c: len(own) for c, own in zip(cats, names)}, {tuple(o): i for i, o in enumerate(orders)},
                 thresholds, n, total, weight is not None, parts, prior, (bins, seed, val))
    out.crowded = {i for i in range(len(orders)) if _largest_part(blocks, i, parts) > PART_ROWS}
    return out


def _packed(rows: DataFrame, names: list, thresholds: list, orders: int, weighted: bool) -> DataFrame:
    """Blocks (rec, h0, h1, ..): records without a hash, and their hashes in each order."""
    size, fields = boosting.BLOCK_ROWS, _record(len(thresholds), len(names), weighted, hashed=False)
    hashes = [f"h{i}" for i in range(orders)]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        points = [np.array(t, np.float64) for t in thresholds]
        known = [{v: i for i, v in enumerate(own)} for own in names]
        kept, count = [], 0

        def block():
            rec, *own = (np.concatenate(p) for p in zip(*kept))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (rec, *own)], ["rec", *hashes])
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            rec = np.zeros(batch.num_rows, fields)
            for f, p in enumerate(points):
                v = column(f"x{f}").astype(np.float64)
                if not np.isfinite(v).all():
                    raise ValueError("Vector values MUST NOT be NaN or Infinity")
                rec["x"][:, f] = np.searchsorted(p, v)
            for i, own in enumerate(known):
                encoded = batch.column(f"c{i}").dictionary_encode()
                codes = np.array([*(own[v] for v in encoded.dictionary.to_pylist()), own.get(None, 0)], np.uint16)
                rec["c"][:, i] = codes[encoded.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]
            rec["y"], rec["held"] = column("y"), column("held")
            if weighted:
                rec["w"] = column("w")
            kept.append((rec, *(column(h) for h in hashes)))
            count += len(rec)
            if count >= size:
                yield block()
                count = 0
        if count:
            yield block()
    return rows.mapInArrow(run, "rec binary, " + ", ".join(f"{h} binary" for h in hashes))


def _part_function():
    """The part of a hash: its leading bits, as a number below ``parts`` (made here, so that it travels by value)."""
    def part(h, parts):
        import numpy as np
        return (((h >> 32) + (1 << 31)) * parts >> 32).astype(np.int64)
    return part


def _largest_part(blocks: DataFrame, order: int, parts: int) -> int:
    part = _part_function()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        found = np.zeros(parts, np.int64)
        for batch in batches:
            for v in batch.column(0):
                found += np.bincount(part(np.frombuffer(v.as_buffer(), np.int64), parts), minlength=parts)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], ["pid", "n"])
    counts = blocks.select(f"h{order}").mapInArrow(run, "pid long, n long").groupBy("pid").agg(F.sum("n").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def _steps(fields: list, parts: int, prior: float):
    """Functions that workers share: ``deal`` (records to a batch of a chunk per part), ``valued`` (records in hash order,
    with the statistic of a category) and ``gone_on`` (hashes gone on over a number, as ``xxhash64`` does)."""
    part = _part_function()

    def deal(rec):
        import numpy as np
        import pyarrow as pa
        pid = part(rec["h"], parts)
        order = np.argsort(pid.astype(np.min_scalar_type(parts)), kind="stable")  # short integers sort faster
        counts = np.bincount(pid, minlength=parts)
        some = np.flatnonzero(counts)
        data = pa.py_buffer(rec[order].tobytes())
        ends = np.concatenate([[0], np.cumsum(counts[some])]) * rec.itemsize
        chunks = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), data])
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), chunks], ["pid", "rec"])

    def valued(rec, i, starts):
        import numpy as np
        code = rec["c"][:, i]
        order = np.argsort(code, kind="stable")
        own = code[order]
        use = ~rec["held"][order]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        group = np.cumsum(first) - 1
        value = np.empty(len(rec))
        sums = []
        for of, start in zip((rec["y"][order] * use, use), starts):
            before = np.cumsum(of, dtype=np.int64) - of
            sums.append(before - before[first][group] + start[own[first]][group])
        value[order] = (sums[0] + prior) / (sums[1] + 1.0)
        rec["t"][:, i] = value
        return rec

    def gone_on(h, values):
        import numpy as np
        p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                     0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
        turn = lambda v, bits: (v << np.uint64(bits)) | (v >> np.uint64(64 - bits))
        with np.errstate(over="ignore"):
            out = h.view(np.uint64) + p5 + np.uint64(8)
            out = out ^ (turn((values + 0.0).view(np.uint64) * p2, 31) * p1)
            out = turn(out, 27) * p1 + p4
            out = (out ^ (out >> np.uint64(33))) * p2
            out = (out ^ (out >> np.uint64(29))) * p3
            return (out ^ (out >> np.uint64(32))).view(np.int64)
    return deal, valued, gone_on


def encoded_bins(data: Packed, columns: list[str], nums: list[str], cats: list[str], seed: int, path: str) -> boosting.Binned:
    """Bins of ``nums`` and of the statistics of ``cats``, in the hash order of ``columns``, stored in ``path``."""
    spark, weighted, parts = data.blocks.sparkSession, data.weighted, data.parts
    hashed, bins = f"h{data.orders[tuple(columns)]}", min(data.key[0], data.rows)
    fields = _record(len(nums), len(cats), weighted, values=len(cats))
    base = _record(len(data.nums), len(data.cats), weighted, hashed=False)
    own_x, own_c = [data.nums.index(c) for c in nums], [data.cats.index(c) for c in cats]
    widths = [data.levels[c] for c in cats]
    deal, valued, gone_on = _steps(fields, parts, data.prior)

    def first(batches):
        import numpy as np
        for batch in batches:
            for r, h in zip(batch.column(0), batch.column(1)):
                old = np.frombuffer(r.as_buffer(), base)
                rec = np.zeros(len(old), fields)
                rec["h"], rec["x"], rec["c"] = np.frombuffer(h.as_buffer(), np.int64), old["x"][:, own_x], old["c"][:, own_c]
                for f in ("y", "held", *(["w"] if weighted else [])):
                    rec[f] = old[f]
                yield deal(rec)

    def ordered(i):
        def run(batches):
            import numpy as np
            import pyarrow as pa
            chunks = {}
            for batch in batches:
                for pid, r in zip(batch.column(0).to_pylist(), batch.column(1)):
                    chunks.setdefault(pid, []).append(r.as_py())
            for pid in sorted(chunks):
                rec = np.frombuffer(b"".join(chunks.pop(pid)), fields)
                rec = rec[np.argsort(rec["h"])]
                use, code = ~rec["held"], rec["c"][:, i]
                totals = np.stack([np.bincount(code[use & (rec["y"] == 1)], minlength=widths[i]), np.bincount(code[use], minlength=widths[i])])
                yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([rec.tobytes()], pa.binary()),
                                                  pa.array([totals.astype(np.int64).tobytes()], pa.binary())], ["pid", "rec", "totals"])
        return run

    def starts_of(blocks, i):
        import numpy as np
        at = np.zeros((parts, 2, widths[i]), np.int64)
        for r in blocks.select("pid", "totals").toLocalIterator():  # a row per part, CARRIED sums at most
            at[r["pid"]] = np.frombuffer(r["totals"], np.int64).reshape(2, -1)
        return np.cumsum(at, axis=0) - at

    def records(i, starts):
        def run(batch):
            import numpy as np
            for pid, r in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pid, valued(np.frombuffer(r.as_buffer(), fields).copy(), i, starts[pid])
        return run

    def dealt_again(i, read):
        def run(batches):
            for batch in batches:
                for _, rec in read(batch):
                    rec["h"] = gone_on(rec["h"], rec["t"][:, i].copy())
                    yield deal(rec)
        return run

    def drawn(read, share):
        def run(batches):
            import numpy as np
            import pyarrow as pa
            for batch in batches:
                for pid, rec in read(batch):
                    rec = rec[~rec["held"]]
                    rec = rec if share == 1.0 else rec[np.random.default_rng([seed & 0xFFFFFFFF, pid]).random(len(rec)) < share]
                    w = rec["w"].copy() if weighted else np.ones(len(rec))
                    yield pa.RecordBatch.from_arrays([pa.array(w), *(pa.array(rec["t"][:, i].copy()) for i in range(len(cats)))],
                                                     ["w", *(f"t{i}" for i in range(len(cats)))])
        return run

    def binned(read, points, shift, width):
        def run(batches):
            import numpy as np
            import pyarrow as pa
            for batch in batches:
                for _, rec in read(batch):
                    for held in (False, True):
                        own = rec[rec["held"] == held]
                        if not len(own):
                            continue
                        x = np.zeros(((width + 1) // 2, len(own)), np.uint16)
                        for f in range(width):
                            v = own["x"][:, f] if f < len(nums) else np.searchsorted(points[f - len(nums)], own["t"][:, f - len(nums)])
                            x[f // 2] |= v.astype(np.uint16) << (0 if f % 2 else shift)
                        y, w = (2 * own["y"] - 1).astype(np.int8), own["w"].copy() if weighted else np.empty(0)
                        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([len(y)], pa.int32()), *(
                            pa.array([v.tobytes()], pa.binary()) for v in (x, y, w))], ["held", "n", "x", "y", "w"])
        return run
    chunk, paths = "pid int, rec binary", []
    chunks = data.blocks.select("rec", hashed).mapInArrow(first, chunk)
    try:
        for i in range(len(cats)):
            paths.append(scratch_path(spark))
            blocks = stored(chunks.repartitionById(parts, F.col("pid")).mapInArrow(ordered(i), f"{chunk}, totals binary"), paths[-1])
            read = records(i, starts_of(blocks, i))
            if i + 1 < len(cats):
                chunks = blocks.mapInArrow(dealt_again(i, read), chunk)
            for old in paths[:-1]:
                drop_stored(spark, old)
            del paths[:-1]
        share = min(1.0, boosting._sample_rows(bins) / data.rows)
        sample = blocks.mapInArrow(drawn(read, share), "w double, " + ", ".join(f"t{i} double" for i in range(len(cats)))).toArrow()
        points = [boosting.split_points(sample.column(f"t{i}").to_numpy(), sample.column("w").to_numpy(), bins) for i in range(len(cats))]
        thresholds = [*(data.thresholds[i] for i in own_x), *points]
        out = boosting.Binned(blocks, thresholds, data.rows, data.weight, weighted, 0)
        made = stored(blocks.mapInArrow(binned(read, points, out.shift, len(thresholds)),
                                        "held boolean, n int, x binary, y binary, w binary"), path)
    finally:
        for old in paths:
            drop_stored(spark, old)
    return boosting.Binned(made, thresholds, data.rows, data.weight, weighted, len(made.inputFiles()))
