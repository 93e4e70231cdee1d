"""SimHash near-duplicates within a Hamming distance, by the general pigeonhole principle.

Fingerprints are computed once per text and settled; everything after works on
distinct fingerprints, so exact copies collapse first. From the counts of set
bits and of bit pairs over all fingerprints, correlated bits are grouped into
partitions, and dynamic programming gives each partition its own threshold
(-1: not probed) so that the thresholds sum to ``distance - parts + 1`` at the
least estimated number of candidates. Two fingerprints within the distance
must then agree up to its threshold in some partition; agreeing up to t bits
means sharing a signature with some t bits masked out.

A signature shared by many fingerprints is never paired out: its rows are
split again by exact parts of the remaining bits (distance + 1 of them, so no
link is lost) until every bucket is small; candidates are verified by their
bit distance.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm.common import forget, fresh, settle, table
from tabsieve.llm.components import components

WORDS = 3
DISTANCE = 2
SEED = 42
BITS = 64
BUCKET = 64
PARTS = (2, 3, 4)


# ------------------------------------------------------------------ fingerprints
def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles (repeats included) of an ASCII-lowered text; 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    size = min(words, len(found))
    starts = np.concatenate([[0], ends[:len(found) - size]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())], "<u8")
    set_in = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp): 64-bit fingerprint per document. Null and empty texts have fingerprint 0."""
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(key)),
                 pa.array([fingerprint(v.as_py(), words) for v in column], pa.int64())], ["k", "fp"])
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("fp", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("k", key)


# ------------------------------------------------------------------ partitions and thresholds
def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Count of fingerprints and, for each bit pair, how many have both set; one small sum per task."""
    def run(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(raw)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(both[i, j], n))], ["pair", "n"])
    rows = fps.select("fp").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["pair"] < 0:
            n = r["n"]
        else:
            i, j = divmod(r["pair"], BITS)
            both[i, j] = both[j, i] = r["n"]
    return n, both


def agreement(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that two fingerprints agree in a bit, and in both bits of a pair."""
    if n == 0:
        return np.full(BITS, 0.5), np.full((BITS, BITS), 0.25)
    p11 = both / n
    one = np.diag(p11)
    p10 = one[:, None] - p11
    p01 = one[None, :] - p11
    pair = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01)**2
    return one**2 + (1 - one)**2, pair


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width; a partition grows by the bit most correlated with it."""
    one = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(one, one)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        own = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: corr[b, own].sum()))
            left.remove(own[-1])
        groups.append(own)
    return groups


def estimated_costs(group: list[int], n: int, single: np.ndarray, pair: np.ndarray, distance: int) -> list[float]:
    """Estimated signatures plus candidate pairs of a partition for each threshold 0..distance.

    The chance of agreeing in the whole partition chains each bit to the earlier bit it depends on most.
    """
    agree = single[group[0]]
    for k, b in enumerate(group[1:], 1):
        agree *= max(pair[b, a] / single[a] for a in group[:k])
    odds = [(1 - single[b]) / single[b] for b in group]
    costs = []
    for t in range(distance + 1):
        chance = agree * sum(np.prod(c) for s in range(t + 1) for c in itertools.combinations(odds, s))
        masks = len(list(itertools.combinations(group, t)))
        costs.append(n * masks + min(1.0, chance) * n * n / 2)
    return costs


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) that sum to ``total`` at the least cost, by dynamic programming over partitions."""
    best = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(own)):
                c = cost + (own[t] if t >= 0 else 0.0)
                if used + t not in step or c < step[used + t][0]:
                    step[used + t] = (c, [*chosen, t])
        best = step
    return best[total]


def probe_masks(n: int, both: np.ndarray, distance: int) -> list[int]:
    """Signature masks of the cheapest partitioning: a partition's bits with each choice of t bits left out."""
    single, pair = agreement(n, both)
    plans = []
    for parts in PARTS:
        groups = group_bits(n, both, parts)
        costs = [estimated_costs(g, n, single, pair, distance) for g in groups]
        cost, chosen = allocate(costs, distance - parts + 1)
        plans.append((cost, groups, chosen))
    _, groups, chosen = min(plans, key=lambda p: p[0])
    return [sum(1 << b for b in group if b not in out) for group, t in zip(groups, chosen) if t >= 0
            for out in itertools.combinations(group, t)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split_mask(mask: int, parts: int) -> list[int]:
    """``mask`` widened by each of ``parts`` nearly equal parts of the remaining bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k::parts]) for k in range(parts)]


# ------------------------------------------------------------------ links
def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints at most ``distance`` bits apart; ``fps`` has distinct fp.

    Large buckets are split again, never capped; a bucket over 64 rows always leaves enough bits to split.
    """
    n, both = bit_statistics(fps)
    masks = probe_masks(n, both, distance)
    rows, found = fps.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp"), []
    while True:
        level = settle(rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))))
        sizes = level.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = level.join(sizes, ["mask", "value"])
        small = sized.where(F.col("n") <= bucket)
        pairs = (small.select("mask", "value", F.col("fp").alias("a"))
                 .join(small.select("mask", "value", F.col("fp").alias("b")), ["mask", "value"])
                 .where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        found.append(settle(pairs.select("a", "b").distinct()))
        large = settle(sized.where(F.col("n") > bucket).select("mask", "fp"))
        wide = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most 3 per mask and level
        forget(level)
        if not wide:
            break
        finer = F.create_map(*[x for m in wide for x in (
            F.lit(m), F.array(*[F.lit(_signed(f)) for f in _split_mask(m % (1 << 64), distance + 1)]))])
        rows = large.select(F.explode(finer[F.col("mask")]).alias("mask"), "fp")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def labelled(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, label): label is the smallest fingerprint reachable over links, the own one without any."""
    joined = components(links(fps, distance)).withColumnRenamed("node", "fp")
    return settle(joined.union(fps.join(joined, "fp", "left_anti").select("fp", F.col("fp").alias("label"))))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links, the row's own included.

    Null keys belong to their component but never name it unless it has no other; repeated rows are copies.
    """
    marks = settle(fingerprints(docs, key, text, words))
    classes = settle(marks.groupBy("fp").agg(F.min(key).alias("least")))
    joined = components(links(classes, distance)).withColumnRenamed("node", "fp")
    named = (joined.join(classes, "fp").groupBy("label").agg(F.min("least").alias("component_id"))
             .join(joined, "label").select("fp", "component_id"))
    alone = classes.join(joined, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    # one row per fingerprint on the right, so a fingerprint of a third of all rows can be split on the left
    return marks.join(settle(named.union(alone)), "fp").select(key, "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, null ids last, then the smallest digest.

    The digest covers all columns, so rows that share it are equal and any one of them stands for the others. Rows
    without an id and rows that share one are told apart by it; they are copies only where their texts are.
    """
    own = fresh(docs, "digest")
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    body = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    marked = docs.withColumn(own, F.sha2(F.concat(body, F.col("text").isNull().cast("string"), rest), 256))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", own)
    marks = settle(fingerprints(marked.withColumn("doc_id", rank), "doc_id").select("doc_id.*", "fp"))
    rows = marks.groupBy("fp", "last", "doc_id", own).agg(F.count(F.lit(1)).alias("n"))
    # the least row of each fingerprint first, so a fingerprint of a third of all rows is one row in the join
    least = settle(rows.groupBy("fp").agg(F.min(F.struct("last", "doc_id", own, "n")).alias("least")))
    kept = settle(least.join(labelled(least.select("fp")), "fp").groupBy("label")
                  .agg(F.min("least").alias("least")).select(F.col(f"least.{own}").alias(own), "least.n"))
    out = marked.join(kept.select(own), own, "left_semi").select(*marked.columns)
    out = out.dropDuplicates([own]) if kept.where("n > 1").limit(1).count() else out
    return out.drop(own)
