"""Token ids in binary files: Simple-8b words, exceptions, and per-block offsets for vectorised decoding.

A 64-bit word is a 4-bit selector and 60 bits of payload. Selector s in 1..14
packs ``COUNTS[s]`` ids of ``BITS[s]`` bits each; selector 0 stands for one
value over 60 bits, kept in the frame's exception list (the payload is its
index there). Ids are coded in blocks of ``BLOCK``: every block starts a new
word and its word offset is stored, so blocks decode independently and all
words of one selector unpack in one numpy operation.

A file is a sequence of frames, each followed by a line feed. A frame holds
whole documents: header, document ids, their token counts, block offsets,
exceptions, words and a checksum. Documents are range-partitioned by doc_id and
a hash of the text (one shuffle of the texts), sorted, encoded and written by
Spark's own writer, whose commit protocol drops files of lost or repeated tasks;
part numbers ascend with doc_id.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm.bpe import BYTE_SYMBOLS
from tabsieve.llm.common import buffer_of, class_table, doc_chunks, table
from tabsieve.session import checkpoint_dir

#: Simple-8b's fixed packings by selector (0: exception).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 512
FRAME_IDS = 1 << 20
END_ID = 2
CALL_BYTES = 8 << 20
MAGIC = b"TS8B"
_HEAD = struct.Struct("<4sIQQQQ")
_LIMITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_WIDTHS = np.maximum(np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right"), 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block, exceptions) of unsigned 64-bit values."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rows = -(-n // BLOCK)
    need = np.full(rows * BLOCK, 255, np.uint8)
    small = values < np.uint64(len(_WIDTHS))
    need[:n][small] = _WIDTHS[values[small].astype(np.int64)]
    need[:n][~small] = np.searchsorted(_LIMITS, values[~small], "right")
    need = need.reshape(rows, BLOCK)
    widest, spans = {1: need}, 1
    while spans * 2 <= COUNTS.max():
        last = widest[spans]
        wide = np.full_like(need, 255)
        np.maximum(last[:, :-spans], last[:, spans:], out=wide[:, :-spans])
        widest[spans * 2] = wide
        spans *= 2
    chosen = np.zeros(need.shape, np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        count = int(COUNTS[s])
        p = 1 << (count.bit_length() - 1)
        fits = widest[p] <= BITS[s]
        if count > p:
            fits[:, :-(count - p)] &= widest[p][:, count - p:] <= BITS[s]
            fits[:, -(count - p):] = False
        chosen[fits] = s
    size = np.full(rows, BLOCK)
    size[-1] = n - (rows - 1) * BLOCK
    cursor, row, steps = np.zeros(rows, np.int64), np.arange(rows), []
    flat = chosen.reshape(-1)
    while len(row):
        at = np.full(rows, -1)
        at[row] = row * BLOCK + cursor[row]
        steps.append(at)
        cursor[row] += COUNTS[flat[at[row]]]
        row = row[cursor[row] < size[row]]
    grid = np.stack(steps, axis=1)
    used = grid >= 0
    per_block = used.sum(axis=1)
    at = grid[used]
    selector = flat[at]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(COUNTS)):
        where = np.flatnonzero(selector == s)
        if len(where):
            k = np.arange(COUNTS[s])
            parts = values[at[where][:, None] + k] << (k * BITS[s]).astype(np.uint64)
            words[where] |= np.bitwise_or.reduce(parts, axis=1)
    odd = np.flatnonzero(selector == 0)
    words[odd] |= np.arange(len(odd), dtype=np.uint64)
    return words, np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype(np.uint64), values[at[odd]]


def unpack(words: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """Values of consecutive words (a whole frame, or the words of some blocks)."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    start = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(start[-1]), np.uint64)
    for s in range(1, len(COUNTS)):
        where = np.flatnonzero(selector == s)
        if len(where):
            k = np.arange(COUNTS[s])
            mask = np.uint64((1 << int(BITS[s])) - 1)
            out[start[where][:, None] + k] = (words[where][:, None] >> (k * BITS[s]).astype(np.uint64)) & mask
    odd = np.flatnonzero(selector == 0)
    out[start[odd]] = exceptions[(words[odd] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def frame(doc_ids: list[int | None], sizes: np.ndarray, values: np.ndarray) -> bytes:
    words, offsets, exceptions = pack(values)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    body = b"".join([known.tobytes(), ids.tobytes(), sizes.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(),
                     exceptions.astype("<u8").tobytes(), words.astype("<u8").tobytes()])
    head = _HEAD.pack(MAGIC, zlib.crc32(body), len(doc_ids), len(offsets), len(exceptions), len(words))
    return head + body


def frames(content: memoryview):
    """(doc ids, token counts, values) of every frame of a file; a damaged frame raises."""
    at = 0
    while at < len(content):
        magic, crc, docs, blocks, odd, n_words = _HEAD.unpack_from(content, at)
        at += _HEAD.size
        size = 9 * docs + 8 * (docs + blocks + odd + n_words)
        body = content[at:at + size]
        if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc or content[at + size:at + size + 1] != b"\n":
            raise ValueError("damaged token frame")
        at += size + 1
        known = np.frombuffer(body, np.uint8, docs)
        ids = np.frombuffer(body, "<i8", docs, docs)
        sizes, _, exceptions, words = np.split(np.frombuffer(body[9 * docs:], "<u8"),
                                               np.cumsum([docs, blocks, odd]))
        values = unpack(words, exceptions)
        yield [int(i) if k else None for k, i in zip(known, ids)], sizes.astype(np.int64), values


# ------------------------------------------------------------------ tokenizing
#: Beyond U+0500 (and in the bytes that start its letters) character classes differ between Unicode versions.
_BEYOND = 0xD4
_IS_SPACE = class_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: UTF-8 of white space beyond ASCII, as numbers of its last two or three bytes.
_WIDE_SPACES = np.array([int.from_bytes(chr(c).encode(), "big") for c in
                         [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]])


def chunk_starts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where chunks of the texts start: at the texts, and where ASCII white space follows other text.

    A token never starts before white space and ends after the text that precedes it, so texts may be cut there.
    Texts marked in ``whole`` are one chunk.
    """
    space = _IS_SPACE[data]
    cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    wide = np.flatnonzero(data[cut - 1] >= 0x80)  # the character before may be white space beyond ASCII
    if len(wide):
        cut = np.delete(cut, wide[ends_with_wide_space(data, cut[wide])])
    if whole.any():
        cut = cut[~whole[np.searchsorted(offsets, cut, "right") - 1]]
    at = np.zeros(len(data), bool)
    at[cut] = True
    at[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(at)


def ends_with_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space beyond ASCII."""
    two = data[np.maximum(at - 2, 0)] * np.int64(256) + data[at - 1]
    three = data[np.maximum(at - 3, 0)] * np.int64(65536) + two
    return np.isin(two, _WIDE_SPACES) | np.isin(three, _WIDE_SPACES)


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all units of the spans (begin, size), span after span."""
    stop = np.cumsum(size)
    return np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


class ChunkTokenizer:
    """Ids of the library's tokenizer file, each distinct white-space separated chunk of a buffer encoded once.

    Chunks are told apart by dictionary encoding. Those of common alphabets are encoded together by a faster encoder
    of the same vocabulary (ranks taken from the file); all others, and texts with special tokens, go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or b"(?!)")
        as_byte = {c: b for b, c in BYTE_SYMBOLS.items()}
        ranks = {bytes(map(as_byte.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(False).items()}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = list(map(len, ranks))

    def distinct(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and how many each has.

        Chunks that start with white space and end with text keep their borders when joined, so one call encodes all
        of them; token byte lengths give back the borders.
        """
        end = begin + size
        plain = np.isin(data[begin], (0x20, 0x0A)) & ~_IS_SPACE[data[end - 1]] & ~ends_with_wide_space(data, end)
        plain &= np.maximum.reduceat(data, begin) < _BEYOND
        for found in self.special.finditer(data.tobytes()):
            plain[np.searchsorted(begin, found.start(), "right") - 1] = False
        joined = data[gathered(begin[plain], size[plain])].tobytes().decode()
        parts = [np.array(self.fast.encode_ordinary(joined), np.uint32)]
        cuts = np.searchsorted(np.cumsum(self.bytes_of[parts[0]]), np.cumsum(size[plain])) + 1
        count, at = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        count[plain] = np.diff(cuts, prepend=0)
        other = [data[a:b].tobytes().decode() for a, b in zip(begin[~plain], end[~plain])]
        found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False) if other else []
        count[~plain] = list(map(len, found))
        parts += [np.array(e.ids, np.uint32) for e in found]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        at[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(parts)[gathered(at, count)], count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer in a row, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        whole = np.zeros(len(offsets) - 1, bool)
        for found in self.special.finditer(data.tobytes()):
            whole[np.searchsorted(offsets, found.start(), "right") - 1] = True
        starts = chunk_starts(data, offsets, whole)
        bounds = np.append(starts, len(data))
        spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = spans.dictionary_encode()
        chunks, of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        raw, cuts = buffer_of(chunks)
        ids, count = self.distinct(raw, cuts[:-1], np.diff(cuts))
        n = count[of]
        upto = np.append(0, np.cumsum(n))[np.searchsorted(starts, offsets)]
        return ids[gathered((np.cumsum(count) - count)[of], n)], np.diff(upto)


_tokenizers: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def _encode(path: str, key: str, text: str, end_id: int):
    def flush(ids, sizes, values):
        return pa.RecordBatch.from_arrays(
            [pa.array([frame(ids, np.concatenate(sizes), np.concatenate(values).astype(np.uint64))], pa.binary())], ["frame"])

    def run(batches):
        ids, sizes, values, held = [], [], [], 0
        tokenizer = _tokenizer(path)
        for batch in batches:
            keys = batch.column(batch.schema.names.index(key)).to_pylist()
            data, offsets = buffer_of(batch.column(batch.schema.names.index(text)))
            for i, j in doc_chunks(offsets, CALL_BYTES):
                own, n = tokenizer.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ids += keys[i:j]
                sizes.append(n + 1)
                values.append(np.insert(own, np.cumsum(n), end_id))
                held += len(values[-1])
                if held >= FRAME_IDS:
                    yield flush(ids, sizes, values)
                    ids, sizes, values, held = [], [], [], 0
        if ids:
            yield flush(ids, sizes, values)
    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text",
                 end_id: int = END_ID) -> None:
    """Token files of all documents in ascending key order under ``path`` (any store that Spark writes).

    A null text is the empty text: only the end id. Null keys come first; equal keys are ordered by the text's hash,
    so the rows of one key spread over files unless their texts are equal too.
    """
    mark = F.xxhash64(F.col(text))
    ordered = docs.select(key, text).repartitionByRange(F.col(key), mark).sortWithinPartitions(F.col(key), mark, text)
    rows = ordered.mapInArrow(_encode(vocabulary, key, text, end_id), "frame binary")
    rows.select(F.col("frame").cast("string").alias("value")).write.text(path, lineSep="\n")


_READ = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()),
                      T.StructField("key", T.LongType()), T.StructField("first", T.LongType()),
                      T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _decode(batches):
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = int(re.search(r"part-(\d+)", name).group(1))
            place, first = 0, 0
            for ids, sizes, values in frames(memoryview(content.as_buffer())):
                raw = memoryview(values.astype("<u4")).cast("B")
                stops = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(stops.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(place, place + len(ids))),
                     pa.array(ids, pa.int64()), pa.array(first + stops - sizes), pa.array(sizes),
                     pa.array(crc, pa.int64())], schema=pa.schema(
                        [("part", pa.int32()), ("place", pa.int64()), ("key", pa.int64()), ("first", pa.int64()),
                         ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))
                place, first = place + len(ids), first + int(stops[-1])


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    docs = files.mapInArrow(_decode, _READ).checkpoint()
    # one row per file: the running total fits one small window, and its join side is bounded by the file count
    totals = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return (docs.join(F.broadcast(before), "part")
            .select(F.col("key").alias(key), (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def vocabulary() -> str:
    """The public byte-level BPE file of the installed tokenizer package."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary())
    return read_tokens(spark, path)
