"""Boosted trees by Spark ML's own method, over rows that are held as bins.

Spark's trainer keeps an object per row and walks it for every level of every tree, and what the executors cannot hold
is read back object by object. Here a row is one byte per feature in blocks of ``BLOCK_ROWS`` rows, and a level is one
pass that sums label, residual and its square per node and bin with numpy per block; nothing is kept per row between
passes, since the trees found so far give a row's residual from its bins (after ``REFRESH`` trees their sum is stored).
Bins, split rule, stopping, leaf values and validation are those of ``GBTClassifier``, and the result is its model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.joins import drop_stored, scratch_path, stored

#: Rows of a block.
BLOCK_ROWS = 1 << 17
#: Trees whose sum is worked out anew in each pass.
REFRESH = 8
#: Most cells of one sum over nodes and pairs of bins; with more, features are summed one by one.
PAIR_CELLS = 1 << 17
#: Bytes of sums that come to the driver at once; nodes beyond that wait for the next pass, tasks' sums are added by a shuffle.
DRIVER_BYTES = 1 << 26
#: ``Utils.EPSILON`` of Spark: a node of less variance is a leaf.
EPSILON = 2.0 ** -52


@dataclass
class Binned:
    """Rows as bins: blocks (held, n, x, y, w), the thresholds of each slot and the training rows' number and weight."""

    blocks: DataFrame
    thresholds: list[list[float]]
    rows: int
    weight: float
    weighted: bool
    files: int

    @property
    def shift(self) -> int:
        """Bits of a bin; two features share a 16-bit number."""
        return max(1, max(len(t) for t in self.thresholds).bit_length())


@dataclass
class Node:
    """A node of a growing tree: (weight, sum, sum of squares, rows) of its residuals, and its split."""

    stats: tuple
    depth: int
    impurity: float
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: list = field(default_factory=list)

    @property
    def value(self) -> float:
        return self.stats[1] / self.stats[0] if self.stats[0] else 0.0


def trains(estimator: GBTClassifier, slots: int) -> bool:
    """Whether ``boost`` does what this estimator is asked to; the rest stays with Spark's trainer."""
    p = lambda name: estimator.getOrDefault(name)
    return (slots > 0 and p("maxIter") >= 1 and p("subsamplingRate") == 1.0 and p("featureSubsetStrategy") in ("all", "auto")
            and p("maxBins") <= 256 and p("maxDepth") <= 12 and slots * _sample_rows(p("maxBins")) * 8 <= DRIVER_BYTES)


def _sample_rows(bins: int) -> int:
    return max(bins * bins, 10_000)


def _label(name: Column) -> Column:
    y = name.cast("double")
    return (F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit("Labels MUST NOT be Null or NaN")).cast("double"))
            .when(~y.isin(0.0, 1.0), F.raise_error(F.lit("Labels MUST be 0 or 1")).cast("double")).otherwise(y))


def _weight(name: Column) -> Column:
    w = name.cast("double")
    return (F.when(w.isNull() | F.isnan(w), F.raise_error(F.lit("Weights MUST NOT be Null or NaN")).cast("double"))
            .when((w < 0) | (w == float("inf")), F.raise_error(F.lit("Weights MUST NOT be Negative or Infinity")).cast("double")).otherwise(w))


def bin_rows(rows: DataFrame, slots: list[Column], label: Column, weight: Column | None, val: Column | None, bins: int,
             seed: int, path: str) -> Binned:
    """``rows`` as blocks of bins, stored in ``path``. Where ``val`` is true a row is held for validation, where it is
    NULL it is left out. Thresholds come from a sample of training rows as large as Spark takes it (all of few rows)."""
    held = val.cast("boolean") if val is not None else F.lit(False)
    rows = rows.select(held.alias("held"), _label(label).alias("y"), (_weight(weight) if weight is not None else F.lit(1.0)).alias("w"),
                       *[s.cast("double").alias(f"x{i}") for i, s in enumerate(slots)]).where("held is not null")
    n, total, thresholds = sampled_points(rows, [f"x{i}" for i in range(len(slots))], weight is not None, val is not None, bins, seed)
    blocks = stored(_blocks(rows, thresholds, weight is not None), path)
    return Binned(blocks, thresholds, n, total, weight is not None, len(blocks.inputFiles()))


def sampled_points(rows: DataFrame, cols: list[str], weighted: bool, validates: bool, bins: int, seed: int) -> tuple:
    """(number, weight, thresholds of each of ``cols``) of the rows that are not held; ``rows`` has held, w and ``cols``."""
    train = rows.where("not held") if validates else rows
    n, total = train.agg(F.count(F.lit(1)), F.sum("w") if weighted else F.count(F.lit(1)).cast("double")).first()
    if not n:
        raise ValueError("no rows to train on")
    bins = min(bins, n)
    share = min(1.0, _sample_rows(bins) / n)
    sample = train.select("w", *cols)
    sample = (sample if share == 1.0 else sample.sample(False, share, seed)).toArrow()  # about the rows of _sample_rows
    w = sample.column("w").to_numpy()
    return n, float(total), [split_points(sample.column(c).to_numpy(), w, bins) for c in cols]


def split_points(values, weights, bins: int) -> list[float]:
    """Thresholds between the sampled values, as Spark places them: all, or where the weight is next to a multiple of
    an equal share."""
    import numpy as np
    if np.isnan(values).any() or np.isinf(values).any():
        raise ValueError("Vector values MUST NOT be NaN or Infinity")
    found, at = np.unique(values + 0.0, return_inverse=True)
    counts = np.bincount(at, weights=weights, minlength=len(found))
    if len(found) <= bins:
        return ((found[:-1] + found[1:]) / 2.0).tolist()
    stride = float(counts.sum()) / bins
    found, counts = found.tolist(), counts.tolist()
    points, current, target = [], counts[0], stride
    for i in range(1, len(found)):
        previous, current = current, current + counts[i]
        if abs(previous - target) < abs(current - target):
            points.append((found[i - 1] + found[i]) / 2.0)
            target += stride
    return points


def _blocks(rows: DataFrame, thresholds: list[list[float]], weighted: bool) -> DataFrame:
    """Blocks (held, n, x, y, w): x holds bins of two features at a time in 16 bits, pair by pair; y is -1 or 1."""
    width, size = len(thresholds), BLOCK_ROWS
    shift = max(1, max(len(t) for t in thresholds).bit_length())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        points = [np.array(t, np.float64) for t in thresholds]
        kept = {False: [], True: []}

        def block(held):
            x, y, w = (np.concatenate(p, axis=-1) for p in zip(*kept[held]))
            kept[held] = []
            for at in range(0, len(y), size):
                s = slice(at, at + size)
                yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([len(y[s])], pa.int32()), *(
                    pa.array([v.tobytes()], pa.binary()) for v in (x[:, s], y[s], w[s] if weighted else np.empty(0)))],
                    ["held", "n", "x", "y", "w"])

        for batch in batches:
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            held, y, w = (column(c) for c in ("held", "y", "w"))
            x = np.zeros(((width + 1) // 2, len(y)), np.uint16)
            for f in range(width):
                v = column(f"x{f}").astype(np.float64)
                if not np.isfinite(v).all():
                    raise ValueError("Vector values MUST NOT be NaN or Infinity")
                x[f // 2] |= (np.searchsorted(points[f], v) << (0 if f % 2 else shift)).astype(np.uint16)
            y = (2 * y - 1).astype(np.int8)
            held = held.astype(bool)
            for part in (False, True):
                own = held if part else ~held
                if own.all():
                    kept[part].append((x, y, w))
                elif own.any():
                    kept[part].append((x[:, own], y[own], w[own]))
                if sum(len(p[1]) for p in kept[part]) >= size:
                    yield from block(part)
        for part in (False, True):
            if kept[part]:
                yield from block(part)
    return rows.mapInArrow(run, "held boolean, n int, x binary, y binary, w binary")


def _readers(width: int, shift: int):
    """The function that makes, of a tree, the function that gives the values of a block's rows (made here, so that it
    travels to the workers by value).

    A tree is (value,) or (feature, last bin that goes left, left, right). Of up to 16 leaves, a row's is the lowest bit
    left when each split that sends it right takes away the leaves on its left; that is one look-up per pair of features.
    """
    def reader(tree):
        import numpy as np
        values, splits = [], []

        def walk(t):
            if len(t) == 1:
                values.append(t[0])
                return 0
            start = len(values)
            left = walk(t[2])
            splits.append((t[0], t[1], start, len(values)))
            return 1 + max(left, walk(t[3]))
        depth = walk(tree)
        if not splits:
            return lambda x: np.full(x.shape[1], values[0])
        if len(values) <= 16:
            code = np.arange(1 << (2 * shift))
            tables = {}
            for f, b, start, end in splits:
                own = tables.setdefault(f // 2, np.full(len(code), 0xFFFF, np.uint16))
                own[(code & ((1 << shift) - 1) if f % 2 else code >> shift) > b] &= np.uint16(0xFFFF ^ ((1 << end) - (1 << start)))
            held = np.arange(1 << 16)
            lowest = np.zeros(1 << 16, np.intp)
            for bit in range(15, -1, -1):
                lowest[held >> bit & 1 == 1] = bit
            of = np.array([*values, *[values[-1]] * (16 - len(values))])[lowest]

            def value(x):
                bits = None
                for p, table in tables.items():
                    bits = table[x[p]] if bits is None else bits & table[x[p]]
                return of[bits]
            return value
        nodes = []

        def number(t):
            at = len(nodes)
            nodes.append([0, 1 << 16, at, at, t[0] if len(t) == 1 else 0])
            if len(t) > 1:
                nodes[at][:4] = t[0], t[1], number(t[2]), number(t[3])
            return at
        number(tree)
        feature, last, left, right = (np.array([n[i] for n in nodes], np.intp) for i in range(4))
        of = np.array([n[4] for n in nodes])

        def value(x):
            at, row = np.zeros(x.shape[1], np.intp), np.arange(x.shape[1])
            for _ in range(depth):
                f = feature[at]
                pair = x[f >> 1, row]
                x_f = np.where(f & 1, pair & ((1 << shift) - 1), pair >> shift)
                at = np.where(x_f > last[at], right[at], left[at])
            return of[at]
        return value
    return reader


def _rows_of(width: int, shift: int, trees: list[tuple], weighted: bool):
    """The function that gives (x, y, weights or None, margins or None) of the blocks of a batch; ``trees`` are (tree, weight)
    and come on top of margins that are stored."""
    reader = _readers(width, shift)

    def rows_of(batch, known=[]):
        import numpy as np
        if not known:
            known.extend((reader(t), s) for t, s in trees)
        at = {name: i for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            get = lambda c, kind: np.frombuffer(batch.column(at[c])[i].as_buffer(), kind)
            y = get("y", np.int8)
            x = get("x", np.uint16).reshape((width + 1) // 2, len(y))
            margin = get("m", np.float64) if "m" in at else None
            for value, scale in known:
                margin = value(x) * scale if margin is None else margin + value(x) * scale
            yield x, y.astype(np.float64), get("w", np.float64) if weighted else None, margin
    return rows_of


def _sums(data: Binned, blocks: DataFrame, trees: list[tuple], current: tuple, slots: int):
    """Sums (feature, stat, node, bin) over the training rows: weight, sum and square sum of residuals, and rows, for the
    nodes 0.. of ``current``, whose other leaves are ``slots``."""
    import numpy as np
    width, shift, weighted = len(data.thresholds), data.shift, data.weighted
    rows_of, reader = _rows_of(width, shift, trees, weighted), _readers(width, shift)
    pairs = (slots + 1) << (2 * shift) <= PAIR_CELLS
    shape = (4 if weighted else 3, slots, 1 << shift)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        slot_of = reader(current)
        cells = (slots + 1) << (2 * shift if pairs else shift)
        found = np.zeros(((width + 1) // 2 if pairs else width, shape[0], cells))
        for batch in batches:
            for x, y, w, margin in rows_of(batch):
                if margin is None:
                    g = y
                else:
                    with np.errstate(over="ignore"):
                        g = 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
                wg = g if w is None else w * g
                parts = [w, wg, wg * g] + ([None] if weighted else [])
                slot = slot_of(x).astype(np.intp) << (2 * shift if pairs else shift)
                for j, own in enumerate(found):
                    bins = x[j] if pairs else x[j // 2] & ((1 << shift) - 1) if j % 2 else x[j // 2] >> shift
                    cell = slot + bins
                    for total, part in zip(own, parts):
                        total += np.bincount(cell, part, cells)
        for f in range(width):
            if pairs:
                own = found[f // 2].reshape(shape[0], slots + 1, 1 << shift, 1 << shift)[:, :slots].sum(axis=2 if f % 2 else 3)
            else:
                own = found[f].reshape(shape[0], slots + 1, 1 << shift)[:, :slots]
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["f", "sums"])

    def added(table):
        import numpy as np
        import pyarrow as pa
        total = sum(np.frombuffer(v.as_buffer()) for v in table.column("sums"))
        return pa.table({"f": table.column("f").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})
    out = blocks.where("not held").mapInArrow(run, "f int, sums binary")
    if data.files * width * 8 * math.prod(shape) > DRIVER_BYTES:
        out = out.groupBy("f").applyInArrow(added, "f int, sums binary")
    sums = np.zeros((width, *shape))
    for r in out.toArrow().to_pylist():
        sums[r["f"]] += np.frombuffer(r["sums"]).reshape(shape)
    return sums if weighted else np.concatenate([sums, sums[:, :1]], axis=1)


def _variance(weight, total, squares):
    import numpy as np
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight == 0, 0.0, (squares - total * total / weight) / weight)


def _best_split(node: Node, sums, data: Binned, params: dict) -> tuple | None:
    """(gain, feature, bin, children) of the first split of the greatest gain, if one gains."""
    import numpy as np
    best = None
    for f, points in enumerate(data.thresholds):
        if not points or node.depth >= params["maxDepth"]:
            continue
        below = np.cumsum(sums[f][:, :len(points) + 1], axis=1)
        left, right = below[:, :-1], below[:, -1:] - below[:, :-1]
        weight = left[0] + right[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = node.impurity - left[0] / weight * _variance(*left[:3]) - right[0] / weight * _variance(*right[:3])
        least = params["minWeightFractionPerNode"] * data.weight
        bad = ((np.minimum(left[3], right[3]) < params["minInstancesPerNode"]) | (np.minimum(left[0], right[0]) < least)
               | (gain < params["minInfoGain"]) | np.isnan(gain))
        gain = np.where(bad, -np.inf, gain)
        at = int(gain.argmax())
        if gain[at] > 0 and (best is None or gain[at] > best[0]):
            best = float(gain[at]), f, at, left[:, at], right[:, at]
    return best and (*best[:3], [_node(s, node.depth + 1) for s in best[3:]])


def _node(stats, depth: int) -> Node:
    return Node(tuple(stats.tolist()), depth, float(_variance(*stats[:3])))


def _as_tuple(node: Node, leaf) -> tuple:
    if not node.children:
        return (leaf(node),)
    return node.feature, node.bin, *(_as_tuple(c, leaf) for c in node.children)


def _grow(data: Binned, blocks: DataFrame, trees: list[tuple], params: dict) -> Node:
    """The next tree, level by level."""
    sums = _sums(data, blocks, trees, (0,), 1)[:, :, 0]
    root = _node(sums[0].sum(axis=1), 0)
    level, splits = [root], [_best_split(root, sums, data, params)]
    most = max(1, DRIVER_BYTES // (len(data.thresholds) * 4 * 8 << data.shift))  # nodes of one pass: their sums fit the driver
    while True:
        for n, split in zip(level, splits):
            if split:
                n.gain, n.feature, n.bin, n.children = split
        level = [c for n in level for c in n.children if c.depth < params["maxDepth"] and abs(c.impurity) >= EPSILON]
        if not level:
            return root
        splits = []
        for at in range(0, len(level), most):
            own = {id(n): i for i, n in enumerate(level[at:at + most])}
            sums = _sums(data, blocks, trees, _as_tuple(root, lambda n: own.get(id(n), len(own))), len(own))
            splits += [_best_split(n, sums[:, :, i], data, params) for i, n in enumerate(level[at:at + most])]


def _validation_error(data: Binned, blocks: DataFrame, trees: list[tuple]) -> float:
    """Mean weighted log loss of the rows held for validation; NaN without any."""
    rows_of = _rows_of(len(data.thresholds), data.shift, trees, data.weighted)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        loss = weight = 0.0
        for batch in batches:
            for _, y, w, margin in rows_of(batch):
                own = 2.0 * np.logaddexp(0.0, -2.0 * y * margin)
                loss += float((own if w is None else own * w).sum())
                weight += float(len(y) if w is None else w.sum())
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([weight])], ["loss", "weight"])
    loss, weight = blocks.where("held").mapInArrow(run, "loss double, weight double").agg(F.sum("loss"), F.sum("weight")).first()
    return loss / weight if weight else math.nan


def _with_margins(data: Binned, blocks: DataFrame, trees: list[tuple]) -> DataFrame:
    """The blocks with the sum of ``trees`` (and of what was stored before) of each row."""
    rows_of = _rows_of(len(data.thresholds), data.shift, trees, data.weighted)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            margins = pa.array([m.tobytes() for *_, m in rows_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), margins], ["held", "n", "x", "y", "w", "m"])
    return blocks.mapInArrow(run, "held boolean, n int, x binary, y binary, w binary, m binary")


def boost(data: Binned, estimator: GBTClassifier) -> GBTClassificationModel:
    """The model that ``estimator`` is to fit; with a validation column it ends at the best validation error, and stops
    when that does not fall by ``validationTol`` of itself."""
    spark = data.blocks.sparkSession
    params = {p.name: v for p, v in estimator.extractParamMap().items()}
    validate = estimator.isSet("validationIndicatorCol")
    roots, trees, blocks, path = [], [], data.blocks, None
    best, least = 1, 0.0
    try:
        for m in range(params["maxIter"]):
            roots.append(_grow(data, blocks, trees, params))
            trees.append((_as_tuple(roots[-1], lambda n: n.value), params["stepSize"] if m else 1.0))
            if validate:
                error = _validation_error(data, blocks, trees)
                if not m:
                    least = error
                elif least - error < params["validationTol"] * max(error, 0.01):
                    break
                elif error < least:
                    least, best = error, m + 1
            if len(trees) == REFRESH and m + 1 < params["maxIter"]:
                old, path = path, scratch_path(spark)
                blocks, trees = stored(_with_margins(data, blocks, trees), path), []
                if old:
                    drop_stored(spark, old)
    finally:
        if path:
            drop_stored(spark, path)
    roots = roots[:best] if validate else roots
    return _as_model(data, estimator, roots, [params["stepSize"] if m else 1.0 for m in range(len(roots))])


def _as_model(data: Binned, estimator: GBTClassifier, roots: list[Node], weights: list[float]) -> GBTClassificationModel:
    """Spark's own model of these trees, with the parameters of the estimator."""
    sc = data.blocks.sparkSession.sparkContext
    jvm, gateway = sc._jvm, sc._gateway
    tree, impurity = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.mllib.tree.impurity

    def doubles(values):
        out = gateway.new_array(gateway.jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def made(node):
        stats = impurity.VarianceCalculator(doubles(node.stats[:3]), int(node.stats[3]))
        if node.children:
            (left, l), (right, r) = (made(c) for c in node.children)
            if l is None or l != r:  # two leaves of one value are one
                split = tree.ContinuousSplit(node.feature, float(data.thresholds[node.feature][node.bin]))
                return tree.InternalNode(float(node.value), float(node.impurity), float(node.gain), left, right, split, stats), None
        return tree.LeafNode(float(node.value), float(node.impurity), stats), float(node.value)
    estimator._transfer_params_to_java()
    java, width = estimator._java_obj, len(data.thresholds)
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    models = gateway.new_array(kind, len(roots))
    for i, root in enumerate(roots):
        models[i] = kind(made(root)[0], width)
        java.copyValues(models[i], java.extractParamMap())
    model = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), models, doubles(weights), width)
    java.copyValues(model, java.extractParamMap())
    return estimator._copyValues(GBTClassificationModel(model.setParent(java)))
