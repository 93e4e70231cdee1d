"""Simple-8b round trips, and the token files against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabsieve.llm import simple8b
from tabsieve.llm.common import table
from tests.llm.test_bpe import fuzzed


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 5000])
@pytest.mark.parametrize("high", [2, 100, 50000, 1 << 40, (1 << 64) - 1])
def test_round_trip(n, high):
    rng = np.random.default_rng(n)
    values = rng.integers(0, high, n, dtype=np.uint64)
    if n > 10:
        values[:7], values[8] = 0, np.uint64(1 << 63)
    words, offsets, exceptions = simple8b.pack(values)
    assert (simple8b.unpack(words, exceptions) == values).all()
    for b in range(len(offsets) - 1):
        block = simple8b.unpack(words[int(offsets[b]):int(offsets[b + 1])], exceptions)
        assert (block == values[b * simple8b.BLOCK:(b + 1) * simple8b.BLOCK]).all()


def expect(docs):
    t, start, out = Tokenizer.from_file(simple8b.vocabulary()), 0, []
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()]
    got = simple8b.op9_simple8b(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expect(docs)


def test_edges(spark, make_docs, tmp_path):
    texts = [*fuzzed(200), "a<|endoftext|>b  <|endoftext|>"]
    random.Random(1).shuffle(texts)
    rows = [(None, "no id"), (-5, None), (-4, ""), *enumerate(texts)]
    simple8b.write_tokens(make_docs(rows[::-1], start=1), str(tmp_path / "t"), simple8b.vocabulary())
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32)
                 for r in simple8b.read_tokens(spark, str(tmp_path / "t")).collect())
    assert [(d, s, n, c) for s, d, n, c in got] == expect(rows)


def test_rows_of_one_key_spread_over_files(spark, make_docs, tmp_path):
    rows = [(None, f"text {i} of no id") for i in range(300)] + [(7, f"text {i} of seven") for i in range(300)]
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        simple8b.write_tokens(make_docs(rows), str(tmp_path / "h"), simple8b.vocabulary())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    files = spark.read.format("binaryFile").load(str(tmp_path / "h")).where("length > 0").collect()
    held = [[i for ids, _, _ in simple8b.frames(memoryview(bytes(f.content))) for i in ids] for f in files]
    assert sum(map(len, held)) == len(rows)
    assert all(sum(key in own for own in held) > 1 for key in (None, 7))
    got = sorted(simple8b.read_tokens(spark, str(tmp_path / "h")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    own = lambda r: (r[0] is not None, r[2], r[3])
    assert sorted(own((r.doc_id, 0, r.n_tokens, r.ids_crc32)) for r in got) == sorted(own(x) for x in expect(rows))


def test_empty_table_and_damage(spark, make_docs, tmp_path):
    simple8b.write_tokens(make_docs([]), str(tmp_path / "e"), simple8b.vocabulary())
    assert simple8b.read_tokens(spark, str(tmp_path / "e")).count() == 0
    good = simple8b.frame([1], np.array([2]), np.array([5, 6], np.uint64)) + b"\n"
    assert len(list(simple8b.frames(memoryview(good)))) == 1
    with pytest.raises(ValueError):
        list(simple8b.frames(memoryview(good[:-9] + b"\x07" + good[-8:])))
