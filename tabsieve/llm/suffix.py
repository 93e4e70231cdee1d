"""Removal of repeated byte passages by suffix order.

A byte goes when a ``length``-byte string that covers it also starts earlier
(smaller doc_id, or the same document further left).

Every ``length``-byte window belongs to one segment: consecutive windows that
share their anchor, the ``anchor``-byte string of least hash inside the window.
Equal windows have equal anchors, so windows need comparing only under the same
anchor hash. Map tasks drop segments whose whole bytes they have already seen
(their windows all start earlier elsewhere), and one aggregation by anchor
finds, per distinct segment, the first place it occurs: every other place is
covered. Anchors with two or more distinct segments need their bytes: these
segments are cut from the texts, sent to shards by anchor, and each shard is
put in suffix order by external induced sorting (``induced``). Neighbours in
that order with a common prefix of ``length`` bytes are the same window; all
but the first place are covered.

A first pass counts distinct segments per anchor. Crowded anchors (a common
phrase in ever new surroundings) are dealt window by window: each window is a
segment of its own under the hash of all its bytes, so no bucket depends on a
single anchor; all tasks know the same list, so equal windows still meet.
Segments travel packed, one row per task
and bucket; covered places are united per document and cut out of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm import induced
from tabsieve.llm.common import (buffer_of, cut_hashes, fresh, partitions_for, prefix_hashes, release, settle, table,
                                 text_bytes)
from tabsieve.llm.winnow import _slide

LENGTH = 100
ANCHOR = 24
SECOND_CODES = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text per anchor bucket, bytes of segments per suffix shard, and segments that a map task gathers at once.
BUCKET_BYTES = 12 << 20
SHARD_BYTES = 3 << 20
FLUSH_SEGMENTS = 200_000
#: An anchor with more distinct segments than this, and than one in ``ANCHOR_SHARE`` bytes of text, is crowded; so at
#: most some 100,000 anchors are. Only anchors with ``LOCAL`` distinct segments in a task's batch are counted.
CROWDED = 20_000
ANCHOR_SHARE = 3_500_000
LOCAL = 4

#: A segment: anchor hash, content hash, document (id and tie-break), first window, number of windows.
SEGMENT = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("n", "<u2")])
#: Covered windows of a document.
SPAN = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("n", "<u4")])
PACKED = "kind int, bucket int, size long, blob binary"
SEGMENTS, SPANS, WANTED, CUT = range(4)
NO_ID = -(1 << 63)


# ------------------------------------------------------------------ packing
def _pack(kind: int, buckets: np.ndarray, rows: np.ndarray, size: int | None = None) -> pa.RecordBatch:
    """One row per bucket; fields are stored one after the other, which compresses better than row by row."""
    order = np.argsort(buckets, kind="stable")
    buckets, rows = buckets[order], rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(rows) else np.zeros(0, np.int64)
    blobs, sizes = [], []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
        part = rows[a:b]
        blobs.append(b"".join(np.ascontiguousarray(part[f]).tobytes() for f in rows.dtype.names))
        sizes.append(len(part) if size is None else int(part["n"].sum()) + size * len(part))
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(cuts), pa.int32()), pa.array(buckets[cuts], pa.int32()), pa.array(sizes, pa.int64()),
         pa.array(blobs, pa.binary())], ["kind", "bucket", "size", "blob"])


def _unpack(blobs, dtype: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        raw = memoryview(blob.as_buffer())
        out, at = np.empty(len(raw) // dtype.itemsize, dtype), 0
        for f in dtype.names:
            out[f] = np.frombuffer(raw, dtype[f], len(out), at)
            at += dtype[f].itemsize * len(out)
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _doc_buckets(rows: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each row's document, by id and tie-break, so rows without an id (or of one id) spread."""
    mixed = (rows["doc"].astype(np.uint64) + rows["tie"].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(
        0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _merge(rows: np.ndarray) -> np.ndarray:
    """Union of the covered windows of each document."""
    rows = rows[np.lexsort((rows["start"], rows["tie"], rows["doc"]))]
    if not len(rows):
        return rows
    same = (rows["doc"][1:] == rows["doc"][:-1]) & (rows["tie"][1:] == rows["tie"][:-1])
    document = np.concatenate([[0], np.cumsum(~same)]).astype(np.int64)
    shift = document << 33
    start = rows["start"] + shift
    end = np.maximum.accumulate(start + rows["n"])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    out = rows[at].copy()
    out["n"] = np.append(end[at[1:] - 1], end[-1]) - start[at]
    return out


# ------------------------------------------------------------------ segments of a text
def text_segments(data: np.ndarray, length: int, anchor: int) -> tuple:
    """(anchor hash, content hash, start, windows) of the segments that the windows of one text fall into."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    total = prefix_hashes(data)
    at = np.arange(len(data) - anchor + 1)
    h = cut_hashes(total, at, at + anchor)
    w = length - anchor + 1
    low = _slide(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), w, np.maximum) == h)
    # the leftmost minimum of each window: the first chosen place from its start that has the window's least hash
    k = np.searchsorted(chosen, np.arange(n))
    late = np.flatnonzero(h[chosen[k]] != low)
    while len(late):
        k[late] += 1
        late = late[h[chosen[k[late]]] != low[late]]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    windows = np.append(start[1:], n) - start
    return low[start], cut_hashes(total, start, start + windows + length - 1), start, windows


def _first_places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of every distinct segment, all later places). The same place given twice counts once."""
    rows = rows[np.lexsort((rows["start"], rows["tie"], rows["doc"], rows["c"], rows["h"]))]
    if not len(rows):
        return rows, rows
    same = (rows["c"][1:] == rows["c"][:-1]) & (rows["h"][1:] == rows["h"][:-1])
    place = (rows["doc"][1:] == rows["doc"][:-1]) & (rows["tie"][1:] == rows["tie"][:-1]) & (
        rows["start"][1:] == rows["start"][:-1])
    again = np.concatenate([[False], same & place])
    later = np.concatenate([[False], same]) & ~again
    return rows[~np.concatenate([[False], same])], rows[later]


def _spans(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), SPAN)
    for f in SPAN.names:
        out[f] = rows[f]
    return out


def _segments(batches, length: int, anchor: int, crowded: np.ndarray):
    """Segments of all texts, about ``FLUSH_SEGMENTS`` at a time; those of crowded anchors as single windows."""
    held, size = [], 0
    for batch in batches:
        docs = batch.column(0).to_pylist()
        ties = batch.column(1).to_pylist()
        data, offsets = buffer_of(batch.column(2))
        for i in range(len(docs)):
            own = data[offsets[i]:offsets[i + 1]]
            h, c, start, n = text_segments(own, length, anchor)
            if not len(h):
                continue
            rows = np.empty(len(h), SEGMENT)
            rows["h"], rows["c"], rows["start"], rows["n"] = h, c, start, n
            rows["doc"], rows["tie"] = NO_ID if docs[i] is None else docs[i], ties[i]
            if len(crowded):
                at = np.minimum(np.searchsorted(crowded, rows["h"]), len(crowded) - 1)
                many = crowded[at] == rows["h"]
                if many.any():
                    rows = np.concatenate([rows[~many], _single_windows(own, rows[many], length)])
            held.append(rows)
            size += len(rows)
            if size >= FLUSH_SEGMENTS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _crowds(length: int, anchor: int):
    least = LOCAL

    def run(batches):
        for rows in _segments(batches, length, anchor, np.zeros(0, np.uint64)):
            h, n = np.unique(_first_places(rows)[0]["h"], return_counts=True)
            some = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some])], ["h", "n"])
    return run


def crowded_anchors(source: DataFrame, total: int, length: int, anchor: int) -> np.ndarray:
    """Hashes of the crowded anchors, sorted; their number is bounded by the threshold's share of the text."""
    counts = source.mapInArrow(_crowds(length, anchor), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > max(CROWDED, total // ANCHOR_SHARE)).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def _scan(buckets: int, doc_buckets: int, length: int, anchor: int, held):
    def run(batches):
        for rows in _segments(batches, length, anchor, held.value):
            first, later = _first_places(rows)
            yield _pack(SEGMENTS, (first["h"] % np.uint64(buckets)).astype(np.int64), first)
            spans = _merge(_spans(later))
            if len(spans):
                yield _pack(SPANS, _doc_buckets(spans, doc_buckets), spans)
    return run


# ------------------------------------------------------------------ one anchor bucket
def _bucket(doc_buckets: int, length: int):
    """First places per distinct segment; later places are covered, segments that share an anchor are wanted."""
    def run(key, group):
        first, later = _first_places(_unpack(group["blob"], SEGMENT))
        out = []
        spans = _merge(_spans(later))
        if len(spans):
            out.append(_pack(SPANS, _doc_buckets(spans, doc_buckets), spans))
        count = np.unique(first["h"], return_counts=True)
        kinds = np.repeat(count[1], count[1])  # ``first`` is sorted by anchor
        wanted = first[kinds > 1]
        if len(wanted):
            wanted["c"] = 0  # the content hash has served; zeros compress away
            out.append(_pack(WANTED, _doc_buckets(wanted, doc_buckets), wanted, length - 1))
        release()
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("size", pa.int64()), ("blob", pa.binary())])
        return pa.Table.from_batches(out, schema)
    return run


def _per_document(key, group):
    """Wanted segments of a document bucket, one row per document."""
    rows = _unpack(group["blob"], SEGMENT)
    return _by_document(rows[np.lexsort((rows["start"], rows["tie"], rows["doc"]))])


def _united(key, group):
    """Covered windows of a document bucket, united, one row per document."""
    return _by_document(_merge(_unpack(group["blob"], SPAN)))


def _by_document(rows: np.ndarray) -> pa.Table:
    cuts = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1])
                                          | (rows["tie"][1:] != rows["tie"][:-1])])) if len(rows) else np.zeros(0, int)
    blobs = [rows[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(rows)])]
    docs = [None if d == NO_ID else d for d in rows["doc"][cuts].tolist()]
    return pa.table({"span_doc": pa.array(docs, pa.int64()), "span_tie": pa.array(rows["tie"][cuts], pa.int64()),
                     "spans": pa.array(blobs, pa.binary())})


# ------------------------------------------------------------------ suffix shards
def _cut(shards: int, length: int):
    """Bytes of the wanted segments, packed per shard: rows with the windows' bytes behind them."""
    def run(batches):
        for batch in batches:
            held: dict[int, list] = {}
            docs, ties, blobs = (batch.column(i) for i in range(3))
            data, offsets = buffer_of(batch.column(3))
            for i in range(batch.num_rows):
                rows = np.frombuffer(blobs[i].as_buffer(), SEGMENT)
                own = data[offsets[i]:offsets[i + 1]]
                shard = (rows["h"] % np.uint64(1 << 61) >> np.uint64(20)) % np.uint64(shards)
                for s in np.unique(shard).tolist():
                    mine = rows[shard == s]
                    texts = [own[a:a + n + length - 1].tobytes()
                             for a, n in zip(mine["start"].tolist(), mine["n"].tolist())]
                    held.setdefault(s, []).append((mine, b"".join(texts)))
            for s, parts in held.items():
                rows = np.concatenate([p[0] for p in parts])
                blob = len(rows).to_bytes(8, "little") + rows.tobytes() + b"".join(p[1] for p in parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([CUT], pa.int32()), pa.array([s], pa.int32()), pa.array([len(rows)], pa.int64()),
                     pa.array([blob], pa.binary())], ["kind", "bucket", "size", "blob"])
    return run


def _single_windows(data: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """The windows of crowded segments as segments of their own, under two independent hashes of the whole window."""
    total, second = prefix_hashes(data), prefix_hashes(data, SECOND_CODES)
    start = np.concatenate([np.arange(a, a + n) for a, n in zip(rows["start"].tolist(), rows["n"].tolist())])
    out = np.empty(len(start), SEGMENT)
    out["h"], out["c"] = cut_hashes(total, start, start + length), cut_hashes(second, start, start + length)
    out["doc"], out["tie"], out["start"], out["n"] = rows["doc"][0], rows["tie"][0], start, 1
    return out


def covered_windows(rows: np.ndarray, text: bytes, length: int) -> np.ndarray:
    """Places whose window also starts at an earlier place, by suffix order of the segments' bytes."""
    sizes = rows["n"].astype(np.int64) + length - 1
    raw = np.frombuffer(text, np.uint8)
    ends = np.cumsum(sizes)
    joined = np.zeros(len(raw) + len(rows), np.int16)
    joined[np.arange(len(raw)) + np.repeat(np.arange(len(rows)), sizes)] = raw.astype(np.int16) + 1
    base = ends - sizes + np.arange(len(rows))
    # the order of places is the order of (document, tie-break, start of the window)
    rank = np.empty(len(rows), np.int64)
    rank[np.lexsort((rows["start"], rows["tie"], rows["doc"]))] = np.arange(len(rows))
    order = np.argsort(rank)
    document = np.cumsum(np.concatenate([[0], (rows["doc"][order][1:] != rows["doc"][order][:-1])
                                         | (rows["tie"][order][1:] != rows["tie"][order][:-1])]))
    number = np.empty(len(rows), np.int64)
    number[order] = document
    found, carried = [], (np.zeros(0, np.int64),) * 3

    def settle_groups(segment, offset, group):
        """Of the windows of finished groups, all places but the first."""
        key = (number[segment] << 33) + rows["start"][segment] + offset
        by = np.lexsort((key, group))
        group, key, segment, offset = group[by], key[by], segment[by], offset[by]
        new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        least = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
        covered = key != key[least]
        found.append((segment[covered], offset[covered]))

    serial = 0
    for at, lcp in induced.suffixes(joined, length):
        segment = np.searchsorted(base, at, "right") - 1
        offset = at - base[segment]
        group = serial + np.cumsum(lcp < length)
        serial = int(group[-1])
        window = offset < rows["n"][segment]
        segment, offset, group = (np.concatenate([old, new[window]])
                                  for old, new in zip(carried, (segment, offset, group)))
        open_ = group == serial
        carried = segment[open_], offset[open_], group[open_]
        settle_groups(segment[~open_], offset[~open_], group[~open_])
    settle_groups(*carried)
    segment = np.concatenate([f[0] for f in found])
    offset = np.concatenate([f[1] for f in found])
    out = np.empty(len(segment), SPAN)
    out["doc"], out["tie"], out["n"] = rows["doc"][segment], rows["tie"][segment], 1
    out["start"] = rows["start"][segment] + offset
    return _merge(out)


def _shard(doc_buckets: int, length: int):
    def run(key, group):
        rows, texts = [], []
        for blob in group["blob"]:
            raw = memoryview(blob.as_buffer())
            n = int.from_bytes(raw[:8], "little")
            rows.append(np.frombuffer(raw, SEGMENT, n, 8))
            texts.append(raw[8 + n * SEGMENT.itemsize:])
        spans = covered_windows(np.concatenate(rows), b"".join(texts), length)
        del rows, texts
        release()
        batch = _pack(SPANS, _doc_buckets(spans, doc_buckets), spans)
        return pa.Table.from_batches([batch])
    return run


# ------------------------------------------------------------------ the whole
def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                   anchor: int = ANCHOR) -> tuple[DataFrame, bool]:
    """(span_doc, span_tie, spans): united covered windows per document that has some; and whether ids repeat.

    Rows without an id come before all others. Rows that share an id are ordered by a hash of their text; rows equal
    in both are one document given more than once, and each of them gets the same spans.
    """
    repeats = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    tie = (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if repeats else F.lit(0)).cast("long")
    source = docs.select(F.col(key).cast("long").alias("span_doc"), tie.alias("span_tie"), F.col(text).alias("span_text"))
    total = source.agg(F.sum(text_bytes(F.col("span_text")))).first()[0] or 0
    buckets = partitions_for(total, BUCKET_BYTES, 4)
    crowded = source.sparkSession.sparkContext.broadcast(crowded_anchors(source, total, length, anchor))
    packed = source.mapInArrow(_scan(buckets, buckets, length, anchor, crowded), PACKED)
    is_spans = F.col("kind") == SPANS
    # a group of spans is only passed on by its bucket; united below
    grouped = packed.groupBy("kind", "bucket").applyInArrow(_either(buckets, length), PACKED)
    first = settle(grouped)
    wanted = first.where(F.col("kind") == WANTED)
    size = wanted.agg(F.sum("size")).first()[0] or 0
    shards = partitions_for(size, SHARD_BYTES, 4)
    by_doc = wanted.groupBy("bucket").applyInArrow(_per_document, "span_doc long, span_tie long, spans binary")
    cut = (by_doc.join(source.withColumnsRenamed({"span_doc": "d", "span_tie": "t"}),
                       F.col("span_doc").eqNullSafe(F.col("d")) & (F.col("span_tie") == F.col("t")))
           .select("span_doc", "span_tie", "spans", "span_text").mapInArrow(_cut(shards, length), PACKED))
    second = settle(cut.groupBy("bucket").applyInArrow(_shard(buckets, length), PACKED))
    spans = first.where(is_spans).union(second)
    return settle(spans.groupBy("bucket").applyInArrow(
        _united, "span_doc long, span_tie long, spans binary")), repeats


def _either(doc_buckets: int, length: int):
    bucket = _bucket(doc_buckets, length)

    def run(key, group):
        if key[0].as_py() == SEGMENTS:
            return bucket(key, group)
        spans = _merge(_unpack(group["blob"], SPAN))
        return pa.Table.from_batches([_pack(SPANS, np.full(len(spans), key[1].as_py()), spans)])
    return run


def _removed(data: np.ndarray, blob, length: int) -> tuple[np.ndarray, int]:
    """(mask of kept bytes, number of removed runs)."""
    keep = np.ones(len(data), bool)
    if blob is None:
        return keep, 0
    rows = np.frombuffer(blob, SPAN)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, rows["start"], 1)
    np.add.at(edge, rows["start"].astype(np.int64) + rows["n"] + length - 1, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return keep, int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())


def _with_spans(docs: DataFrame, spans: DataFrame, repeats: bool, key: str, text: str) -> tuple[DataFrame, str]:
    name = fresh(docs, "spans")
    side = spans.select(F.col("span_doc").alias("_span_doc_"), F.col("span_tie").alias("_span_tie_"), F.col("spans").alias(name))
    same = docs[key].cast("long").eqNullSafe(F.col("_span_doc_"))
    if repeats:
        same = same & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_span_tie_"))
    return docs.join(side, same, "left").drop("_span_doc_", "_span_tie_"), name


def removal_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per document; a null text has no bytes."""
    spans, repeats = repeated_spans(docs, key, text, length)
    joined, name = _with_spans(docs.select(key, text), spans, repeats, key, text)

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            out = []
            for i, blob in enumerate(batch.column(2)):
                own = data[offsets[i]:offsets[i + 1]]
                keep, runs = _removed(own, blob.as_buffer() if blob.is_valid else None, length)
                out.append((len(own), len(own) - int(keep.sum()), runs, hashlib.sha256(own[keep].tobytes()).hexdigest()))
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), *(
        T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return joined.select(key, text, name).mapInArrow(run, schema).withColumnRenamed("k", key)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut out of the text. A character that loses some of its bytes goes whole.

    Null texts stay null; an integer column ``n_chars`` follows the new text.
    """
    spans, repeats = repeated_spans(docs, key, text, length)
    joined, name = _with_spans(docs, spans, repeats, key, text)
    at = joined.columns.index(text)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            data, offsets = buffer_of(column)
            blobs = batch.column(batch.num_columns - 1)
            texts = []
            for i in range(batch.num_rows):
                own = data[offsets[i]:offsets[i + 1]]
                if blobs[i].is_valid:
                    keep, _ = _removed(own, blobs[i].as_buffer(), length)
                    texts.append(own[keep].tobytes().decode("utf-8", "ignore"))
                else:
                    texts.append(column[i].as_py())
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)])
    out = joined.select(*docs.columns, name).mapInArrow(run, schema).toDF(*docs.columns)
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)):
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length(text).cast(kind)))
    return out


def op6_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))
