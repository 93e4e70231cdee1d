"""Archives: round trip, revisits against a plain grouping, damage, and odd payloads."""

import glob
import gzip
import hashlib
import io
import random

import duckdb
import pytest

from tabsieve.llm import warc
from tabsieve.llm.common import prepare, table

PAGES = "page_id long, url string, html string, record string"


def brute(pages):
    first = {}
    for i, h in pages:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, h in pages:
        raw = (h or "").encode()
        origin = first.get(raw)
        revisit = origin is not None and origin != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
                    origin if revisit else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()),
                  key=str)


def test_whole_table(spark):
    pages = [(r.page_id, r.html) for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    assert rows(warc.op3_revisits(spark, "/root/testdata/sf0.01")) == brute(pages)


def test_edges(spark, tmp_path):
    prepare(spark)
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "ü🎉\x00\r\n" * 30
    pages = [(4, tricky), (2, tricky), (9, tricky), (2, tricky), (None, tricky), (1, None), (3, ""), (5, "x" * 99),
             (6, "x" * 99), (7, "y" * 100), (8, "y" * 100), (10, "z" * 300000), (11, "only once " * 20), (None, None)]
    df = spark.createDataFrame([(i, None if i == 3 else f"http://e.com/{i}\r\nX: y", h, "clash") for i, h in pages], PAGES)
    warc.write_archives(df, str(tmp_path / "a"))
    back = warc.read_archives(spark, str(tmp_path / "a"))
    assert rows(warc.resolve(back)) == brute(pages)
    kept = {r.page_id: r.payload for r in back.collect() if r.type == "response"}
    assert kept[2] == tricky and kept[1] == "" and kept[10] == "z" * 300000
    raw = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "a" / "part-*")))
    assert raw.count(tricky.encode()) == 2  # page 2 twice, its copies stored without payload
    assert len(list(warc.parse(io.BytesIO(raw)))) == len(pages)


def test_missing_and_repeated_ids(spark, tmp_path):
    """A third of the ids is null, the rest repeats with unlike payloads: every row comes back once, no payload is lost."""
    prepare(spark)
    rng = random.Random(8)
    bodies = [f"<p>{i}</p>" * 20 for i in range(60)] + ["short", None]
    pages = [(None if rng.random() < 0.33 else rng.randint(0, 40), rng.choice(bodies)) for _ in range(900)]
    pages += [(7, "seven one " * 15), (7, "seven two " * 15), (7, "seven three " * 15)] + [(None, f"alone {i} " * 20) for i in range(4)]
    df = spark.createDataFrame([(i, "http://e.com", h, "r") for i, h in pages], PAGES)
    warc.write_archives(df, str(tmp_path / "a"))
    back = warc.read_archives(spark, str(tmp_path / "a"))
    got = rows(warc.resolve(back))
    assert got == brute(pages)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    sql = "SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM"
    assert got == sorted(con.sql(f"{sql} ({warc.OP3_SQL})").fetchall(), key=str)
    held = {hashlib.sha256(r.payload.encode()).hexdigest() for r in back.collect() if r.type == "response"}
    assert held == {hashlib.sha256((h or "").encode()).hexdigest() for _, h in pages}


def test_empty_and_damaged(spark, tmp_path):
    prepare(spark)
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert warc.resolve(warc.read_archives(spark, str(tmp_path / "e"))).count() == 0
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert list(warc.parse(io.BytesIO(record)))[0][1] == b"hello"
    for bad in (record[:-6], record[1:], record.replace(b"Type:", b"Type")):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))
