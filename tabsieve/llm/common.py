"""Shared helpers: tables, session settings, checkpoints and vectorised byte scanning of texts.

Texts travel to Python in Arrow batches of bounded bytes; words are found and
hashed over the whole batch buffer with numpy, never word by word.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.session import checkpoint_dir

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package: by path in local mode, else as a py-file of the
    application (Spark copies it from the driver to every executor)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        paths = [os.path.dirname(package), *filter(None, [sc.environment.get("PYTHONPATH")])]
        sc.environment["PYTHONPATH"] = os.pathsep.join(paths)
    else:
        archive = os.path.join(tempfile.mkdtemp(prefix="tabsieve-"), "tabsieve.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for top, _, names in os.walk(package):
                for full in (os.path.join(top, name) for name in names if name.endswith(".py")):
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> None:
    """Bounded Arrow batches (long texts must not pile up in one batch), UTC, a checkpoint folder."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with underscores in front until no column of ``df`` has it (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(col):
    """UTF-8 size of a text column, null counting as empty."""
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def partitions_for(n_bytes: int, target: int = 16 << 20, least: int = 1) -> int:
    """Partition count in proportion to the bytes, so one partition stays near ``target`` bytes."""
    return max(least, -(-int(n_bytes) // target))


def add_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(list(df.schema.fields) + [T.StructField(n, t) for n, t in fields])


# ------------------------------------------------------------------- Arrow -> bytes
def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. No copy of the text when offsets allow."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges [i, j) of at most ``limit`` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def class_table(predicate) -> np.ndarray:
    return np.array([bool(predicate(b)) for b in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends of maximal runs of word bytes that do not cross texts, and each text's first word index."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    mask = is_word[data]
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have)), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer (public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray, codes: np.ndarray = _BYTE_CODES) -> np.ndarray:
    """Prefix sums of code[byte] * base^i; ``cut_hashes`` turns two of them into a span's hash."""
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes[data] * _power("up", len(data))[:len(data)], out=total[1:])
    return total


def cut_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * _power("down", len(total))[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte span: a difference of prefix sums, shifted back by base^-start."""
    return cut_hashes(prefix_hashes(data), starts, ends)


def release() -> None:
    """Give memory that finished arrays leave behind back to the system, so idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ------------------------------------------------------------------- settled tables
def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts lineage, survives lost executors,
    and gives the planner the true size."""
    path = f"{checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            if path.getName().startswith("settled-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
