"""Quality selection by importance resampling.

Texts become hashed word and word-pair counts. Two bag models over the same
buckets are counted: the target from a bounded sample of rows labelled good,
the raw model from every document. A document's log importance is the sum of
log(target / raw) over its n-grams; adding Gumbel noise and keeping the k
largest keys samples k documents without replacement in proportion to their
importance.

Counting sends one row per bucket and task; scoring is one scan; the k-th key
is found by narrowing histograms of the keys, so no sort gathers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm.common import buffer_of, class_table, cut_hashes, doc_chunks, forget, fresh, mix, prefix_hashes, settle, table

BUCKETS = 1 << 14
#: Rows labelled good that the target model reads, at most about this many (chosen by a hash of the id).
TARGET_ROWS = 20_000
SMOOTHING = 1.0
SEED = 7
#: Share of documents to keep when no labels say otherwise.
KEEP_SHARE = 0.85
BINS = 1024
SMALL = 10_000

_KIND = (class_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80).astype(np.int8)
         + 2 * class_table(lambda b: 0x21 <= b < 0x80 and not chr(b).isalnum()).astype(np.int8))
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and punctuation run and of every pair of neighbours, and each one's text index."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _FOLD[data]
    kind = _KIND[data]
    edge = np.empty(len(kind), bool)
    edge[0] = True
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(kind)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(kind))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    h = cut_hashes(prefix_hashes(low), starts, ends)
    text = np.searchsorted(offsets, starts, "right") - 1
    both = np.flatnonzero(text[:-1] == text[1:])
    pairs = mix(h[both] * np.uint64(0xD6E8FEB86659FD93) + h[both + 1])
    grams = np.concatenate([h, pairs]) & np.uint64(BUCKETS - 1)
    return grams.astype(np.int64), np.concatenate([text, text[both]])


def _counted(text: str, flag: str):
    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = buffer_of(batch.column(batch.schema.names.index(text)))
            good = batch.column(batch.schema.names.index(flag)).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in doc_chunks(offsets):
                grams, own = gram_buckets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                raw += np.bincount(grams, minlength=BUCKETS)
                target += np.bincount(grams[good[i:j][own]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])],
                                         ["bucket", "raw", "target"])
    return run


def good_sample(labels: DataFrame, rows: int = TARGET_ROWS) -> tuple[DataFrame, float | None]:
    """(ids of about ``rows`` rows labelled good, share of good labels). Null ids and labels are left out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    n, good = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("q") > 0, 1).otherwise(0))).first()
    share = min(1.0, rows / max(1, good or 0))
    ids = known.where("q > 0").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return ids.select(F.col("doc_id").alias("good_id")), (good / n if n else None)


def log_ratios(docs: DataFrame, good_ids: DataFrame, text: str = "text") -> np.ndarray:
    """log(target / raw) per bucket, both models smoothed; zeros when there is no target text."""
    flag = fresh(docs, "is_good")
    marked = (docs.select("doc_id", text).join(F.broadcast(good_ids), F.col("doc_id") == F.col("good_id"), "left")
              .select(text, F.col("good_id").isNotNull().alias(flag)))  # bounded by TARGET_ROWS ids
    rows = (marked.mapInArrow(_counted(text, flag), "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    smooth = lambda c: (c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS)
    return np.log(smooth(target)) - np.log(smooth(raw))


def importance(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """(doc_id, mark, n_grams, log_weight) per document; ``mark`` is a hash of the text. Texts without n-grams weigh 0."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j in doc_chunks(offsets):
                grams, own = gram_buckets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                n[i:j] = np.bincount(own, minlength=j - i)
                total[i:j] = np.bincount(own, held.value[grams], minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(np.round(total, 6))],
                                             ["doc_id", "mark", "n_grams", "log_weight"])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, n_grams long, log_weight double"
    return docs.select("doc_id", text, F.xxhash64(text)).mapInArrow(run, schema)


def gumbel(*key, seed: int = SEED):
    """Gumbel noise from a hash of the key columns, so a retried task draws the same."""
    u = (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value (k >= 1): histograms narrow the range until few values are left."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        inside = rows.where(F.col(column).between(low, high))
        if low == high:
            return high
        width = (high - low) / BINS
        if low + width == low:  # neighbours in floating point: few values can be left between them
            distinct = inside.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(column)).collect()
            for value, n in distinct:
                if k <= n:
                    return value
                k -= n
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(bin_.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            n, lo, hi = counts[b]
            if k <= n:
                break
            k -= n
        low, high = lo, hi
        if n <= SMALL:
            values = sorted((r[0] for r in rows.where(F.col(column).between(low, high)).select(column).collect()),
                            reverse=True)
            return values[k - 1]


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept): exactly the k = round(share * rows) largest keys are kept.

    ``share`` defaults to the share of good labels. Every row draws for itself, by its id, a hash of its text and a
    row number that is settled first, so null ids and repeated rows are sampled like any others; equal keys at the
    cut are taken by row number. Null and empty texts weigh 0.
    """
    ids, good_share = good_sample(labels)
    if share is None:
        share = KEEP_SHARE if good_share is None else good_share
    scored = settle(importance(docs, log_ratios(docs, ids)).withColumn("row", F.monotonically_increasing_id()))
    rows = settle(scored.withColumn("gumbel_key", F.round(F.col("log_weight") + gumbel("doc_id", "mark", "row"), 9)))
    forget(scored)
    k = round(share * rows.count())
    kept = F.lit(False)
    if k:
        cut = kth_largest(rows, "gumbel_key", k)
        above = rows.where(F.col("gumbel_key") > cut).count()
        # rows with the very key of the cut: a few of equal hashes
        last = rows.where(F.col("gumbel_key") == cut).select("row").orderBy("row").limit(k - above).agg(F.max("row")).first()[0]
        kept = (F.col("gumbel_key") > cut) | ((F.col("gumbel_key") == cut) & (F.col("row") <= last))
    return rows.select("doc_id", "n_grams", "log_weight", "gumbel_key", kept.alias("kept"))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
