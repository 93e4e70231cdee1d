"""Differencing against a plain version, and the sharding laws."""

import random
import zlib

from pyspark.sql import functions as F

from tabsieve.llm import shards
from tabsieve.llm.common import prepare, table


def plain(sizes, k):
    """Textbook differencing that carries the members of every bin."""
    parts = [(max(s) - min(s), n, sorted(((x, [(n, i)]) for i, x in enumerate(s)), key=lambda b: -b[0]))
             for n, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        (_, n, a), (_, _, b), *parts = parts
        bins = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda z: -z[0])
        parts.append((bins[0][0] - bins[-1][0], n, bins))
    return [b[0] for b in parts[0][2]]


def test_differencing_is_textbook():
    rng = random.Random(3)
    for k in (2, 3, 8):
        for n in (1, 2, 7, 40):
            items = [(i, [rng.randint(0, 1000) if j == 0 or rng.random() < 0.5 else 0 for j in range(k)]) for i in range(n)]
            sums, maps = shards.difference(items)
            again = [0] * k
            for (_, own), to in zip(items, maps):
                assert sorted(to) == list(range(k))
                for x, b in zip(own, to):
                    again[b] += x
            assert again == sums and sorted(sums) == sorted(plain([s for _, s in items], k))
    assert shards.difference([(i, [x, 0]) for i, x in enumerate([8, 7, 6, 5, 4])])[0] == [16, 14]


def check(rows, docs):
    rows, texts = rows.collect(), {}
    assert sorted((r.doc_id is None, r.doc_id, r.text_crc32, r.size) for r in rows) == sorted(
        (i is None, i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in docs)
    for r in rows:
        texts.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        assert r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
    assert all(len(s) == 1 for s in texts.values())
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    return [sum(r.size for r in rows if r.shard == s) for s in range(8)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    bins = check(shards.op8_karmarkar_karp(spark, sf), docs)
    assert max(bins) - min(bins) <= 0.001 * sum(bins)


def test_many_levels(spark):
    prepare(spark)
    rng = random.Random(1)
    sizes = {f"g{i}": rng.randint(1, 5000) for i in range(700)}
    groups = spark.createDataFrame(list(sizes.items()), "id string, size long")
    got = {r.id: r.shard for r in shards.assign_groups(groups, 8, fan_in=16).collect()}
    bins = [sum(v for g, v in sizes.items() if got[g] == s) for s in range(8)]
    assert got.keys() == sizes.keys() and max(bins) - min(bins) < 0.01 * sum(bins)


def test_large_groups_among_many(spark):
    """Small groups make room for a group of 10 % of the bytes, however many parts they are packed in."""
    prepare(spark)
    rng = random.Random(5)
    small = {f"g{i}": rng.randint(1, 5000) for i in range(9000)}
    rest = sum(small.values())
    for shares in ([0.1], [0.1, 0.1, 0.05, 0.02], [0.4]):
        sizes = small | {f"large{i}": round(x / (1 - sum(shares)) * rest) for i, x in enumerate(shares)}
        groups = spark.createDataFrame(list(sizes.items()), "id string, size long")
        got = {r.id: r.shard for r in shards.assign_groups(groups, 8, fan_in=256).collect()}
        bins = sorted(sum(v for g, v in sizes.items() if got[g] == s) for s in range(8))
        if shares == [0.4]:  # more than a shard: alone, and the other seven are level
            assert bins.pop() == sizes["large0"]
        assert got.keys() == sizes.keys() and bins[-1] - bins[0] <= 0.001 * sum(bins)


def test_slots_of_many_equal_rows(spark):
    """Rows equal in all columns are numbered as one counted row and written out in blocks."""
    prepare(spark)
    data = [(1, "a", 0)] * 5003 + [(None, "b", 1)] * 250 + [(i, "c", i % 3) for i in range(400)] + [(7, "d", 2)] * 2
    rows = spark.createDataFrame(data, "key long, id string, shard int").repartition(5)
    out = shards.with_slots(rows, ["key", "id"], slot_rows=100)
    got = out.collect()
    assert sorted((r.id, r.key or -1, r.shard) for r in got) == sorted((d, k or -1, s) for k, d, s in data)
    for s in range(3):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    again = shards.with_slots(rows.orderBy("id", ascending=False), ["key", "id"], slot_rows=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.where("id = 'a'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 5003 / 2


def test_edges(spark, make_docs, tmp_path):
    rows = [(None, None), (1, ""), (2, "same"), (2, "same"), (3, "same"), (4, "Ü" * 50000), *((i, f"t{i}") for i in range(5, 60))]
    docs = make_docs(rows, shard="x", size=1)
    check(shards.byte_shards(docs), rows)
    assert shards.byte_shards(make_docs([])).count() == 0
    shards.write_shards(make_docs(rows), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and back.where("text = 'same'").select("shard").distinct().count() == 1
    assert back.agg(F.max("shard")).first()[0] <= 7
