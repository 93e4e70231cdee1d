"""Shards of nearly equal bytes by Karmarkar-Karp differencing, distributed.

Rows with equal texts form one indivisible group. A partial partition is k
sums; differencing takes the two with the largest spread and adds them in
opposite order until one is left. Up to ``FAN_IN`` groups are differenced as
they are. More are first packed: tasks put about ``FAN_IN`` hashed groups at a
time into bundles, which stay in one shard, and pack the bundles again while
that still shrinks them. A bundle never exceeds a fixed share of a shard; a
group above that share is a bundle of its own, so all large groups and all
bundles meet in the last differencing, and bundles make room for large groups.

Bundles of one size would leave shards a bundle apart. Groups are therefore
dealt by hash to rungs: each has an eighth of the bytes of the rung before, in
bundles an eighth as large, and the last has about as many bundles as groups,
so each rung levels what the one before left. The number of bundles is bounded
by rungs times shards, whatever the number of groups. The bundle that each
member went to is kept and followed from the top down to give a group its shard.

Only (id, digest, size, checksum) is shuffled, never text. A text that a third
of all rows share is one row after map-side aggregation; its rows meet the
group's shard in a join that can split them.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsieve.llm.common import forget, settle, table, text_bytes

SHARDS = 8
FAN_IN = 4096
BUNDLES = 32  # full bundles a shard in the first rung
FINER = 8  # ratio of bytes and of bundle size between rungs
SLOT_ROWS = 20_000


def difference(items: list[tuple]) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over items (tie-break key, sums of k bins).

    Returns the bin sums of the one partition left, in descending order, and for each item the new bin of each of
    its bins.
    """
    k = len(items[0][1])
    reverse = list(range(k - 1, -1, -1))
    heap, first, built = [], [], []
    for n, (tie, sums) in enumerate(items):
        order = sorted(range(k), key=lambda i: -sums[i])
        own = [sums[i] for i in order]
        first.append(order)
        heap.append((own[-1] - own[0], tie, n, own))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        raw = [x[i] + y[j] for i, j in enumerate(reverse)]
        order = sorted(range(k), key=lambda i: -raw[i])
        place = [0] * k
        for j, i in enumerate(order):
            place[i] = j
        built.append((a, b, place))
        own = [raw[i] for i in order]
        heapq.heappush(heap, (own[-1] - own[0], tie, len(items) + len(built) - 1, own))
    final: list = [None] * (len(items) + len(built))
    final[-1] = list(range(k))
    for n in range(len(built) - 1, -1, -1):
        a, b, place = built[n]
        up = final[len(items) + n]
        final[a] = [up[place[i]] for i in range(k)]
        final[b] = [up[place[reverse[i]]] for i in range(k)]
    maps = []
    for n, order in enumerate(first):
        own = [0] * k
        for j, i in enumerate(order):
            own[i] = final[n][j]
        maps.append(own)
    return heap[0][3], maps


def _difference_group(shards: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["id"].to_pylist(), group["size"].to_pylist()))
        _, maps = difference([(i, [size] + [0] * (shards - 1)) for i, size in rows])
        return pa.table({"id": pa.array([i for i, _ in rows], pa.string()),
                         "shard": pa.array([m[0] for m in maps], pa.int32())})
    return run


def _pack(limits: list[int], name: str):
    """Bundles of at most ``limits[rung]`` bytes from one part; a larger member is a bundle of its own."""
    def run(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        rows = sorted(zip(group["rung"].to_pylist(), [-s for s in group["size"].to_pylist()], group["id"].to_pylist()))
        place, sums, last = [], [], None
        for rung, less, _ in rows:
            if rung != last or sums[-1] - less > limits[rung]:
                sums.append(0)
                last = rung
            sums[-1] -= less
            place.append(len(sums) - 1)
        # a bundle's size stands at its first member only
        sizes = [sums[p] if n == 0 or place[n - 1] != p else None for n, p in enumerate(place)]
        return pa.table({"id": pa.array([i for _, _, i in rows], pa.string()),
                         "parent": pa.array([f"{name}:{part}:{p}" for p in place], pa.string()),
                         "rung": pa.array([r for r, _, _ in rows], pa.int32()),
                         "size": pa.array(sizes, pa.int64())})
    return run


def assign_groups(groups: DataFrame, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """(id, shard) for groups (id string, size long) with distinct ids; sums of the shards nearly equal."""
    level = settle(groups.select("id", "size"))
    left, total = level.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    top = 0
    while left > shards * BUNDLES * FINER ** top:
        top += 1
    limits = [total // (shards * BUNDLES * FINER ** r) for r in range(top + 1)]
    dealt = F.xxhash64("id", F.lit("rung"))
    rung = sum((F.when(F.pmod(dealt, F.lit(FINER ** r)) == 0, 1).otherwise(0) for r in range(1, top + 1)), F.lit(0))
    rows, packed = level.withColumn("rung", rung.cast("int")), []
    while left > fan_in:
        parted = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(-(-left // fan_in))))
        done = settle(parted.groupBy("part").applyInArrow(
            _pack(limits, str(len(packed))), "id string, parent string, rung int, size long"))
        packed.append(done)
        forget(level)
        rows = level = settle(done.where("size is not null").select(F.col("parent").alias("id"), "rung", "size"))
        before, left = left, level.count()
        if 2 * left > before:  # bundles are full
            break
    whole = level.withColumn("part", F.lit(0)).groupBy("part")
    shard = settle(whole.applyInArrow(_difference_group(shards), "id string, shard int"))
    forget(level)
    for below in reversed(packed):
        up = shard.withColumnRenamed("id", "parent")
        shard = below.join(up, "parent").select("id", "shard")
    return shard


def with_slots(rows: DataFrame, order: list[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """A gapless ``slot`` from 0 within each shard.

    Rows that agree in all columns are one counted row until the end. Counted rows are ordered inside hashed parts of
    a shard, each part starts where the parts before it end, and a counted row takes as many slots as it has copies.
    Copies are written out in blocks of ``slot_rows``, which spread over tasks, so no task holds all copies of a row.
    """
    parts = max(1, -(-rows.count() // slot_rows))
    counted = (rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts))))
    before = (counted.groupBy("shard", "_part").agg(F.sum("_n").alias("_sum"))
              .select("shard", "_part", (F.sum("_sum").over(Window.partitionBy("shard").orderBy("_part"))
                                         - F.col("_sum")).alias("_before")))
    within = F.sum("_n").over(Window.partitionBy("shard", "_part").orderBy(*order)
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = settle(counted.withColumn("_end", within).join(before, ["shard", "_part"])
                    .withColumn("_first", F.col("_before") + F.col("_end") - F.col("_n"))
                    .select(*rows.columns, "_first", (F.col("_first") + F.col("_n") - 1).alias("_last")))
    single = placed.where("_first = _last").select(*rows.columns, F.col("_first").alias("slot"))
    blocks = (placed.where("_first < _last")
              .withColumn("_block", F.explode(F.sequence("_first", "_last", F.lit(slot_rows).cast("long"))))
              .repartition(*rows.columns, "_block"))
    copies = blocks.select(*rows.columns, F.explode(F.sequence(
        "_block", F.least("_last", F.col("_block") + F.lit(slot_rows - 1).cast("long")))).alias("slot"))
    return single.unionByName(copies)


def digest(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def byte_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): law ``bytes``; size is the text's bytes plus 1.

    Null and empty texts are equal (size 1). Rows with equal texts share a shard, repeated rows included; slots
    follow a hash of the id, so no row depends on how the input was split; rows equal in id and text take slots in a
    row and spread over tasks.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = settle(docs.select(F.col(key).alias("key"), digest(F.col(text)).alias("id"),
                              (text_bytes(body) + 1).alias("size"), F.crc32(body).alias("text_crc32")))
    groups = rows.groupBy("id").agg(F.sum("size").alias("size"))
    placed = settle(rows.join(assign_groups(groups, shards), "id"))
    out = with_slots(placed, ["key", "id"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, text: str = "text", shards: int = SHARDS) -> None:
    """All columns of ``docs`` as one Parquet folder per shard (``shard=0`` ...), groups kept whole."""
    own = docs.withColumn("_digest", digest(F.col(text)))
    groups = own.groupBy("_digest").agg(F.sum(text_bytes(F.col(text)) + 1).alias("size"))
    placed = assign_groups(groups.select(F.col("_digest").alias("id"), "size"), shards)
    joined = own.join(placed.withColumnRenamed("id", "_digest"), "_digest").drop("_digest")
    joined.write.partitionBy("shard").parquet(path)


def op8_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))
