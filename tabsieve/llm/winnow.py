"""Benchmark decontamination by winnowing.

Both sides turn their words into 64-bit hashes, hash every ``k`` consecutive
words and keep the minimum hash of each sliding window (winnowing): any span
of ``n`` shared words holds a whole window, so both sides keep the same
fingerprint in it. Where a document fingerprint is also a benchmark's, the hit is
extended to both sides within the words that a window around it can reach, and
runs of at least ``n`` equal words count. Places with the same words around them
are compared once, so repetitive texts cost no more than their different
surroundings.

The benchmark is the stated query set: it travels in blocks of at most
``block_bytes`` bytes, each broadcast within that proven bound, and one narrow
pass over the documents is chained per block (usually one). Documents are
never shuffled, so a hot source or a passage in a third of all documents costs
nothing extra, and a lost executor only repeats its own scan tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm.common import add_fields, buffer_of, class_table, doc_chunks, fresh, mix, span_hashes, word_spans

NGRAM = 13
GRAM = 6
BLOCK_BYTES = 16 << 20
SLICE = 1 << 15  # places or pairs of places whose surroundings are compared at once

#: Word bytes: digits, letters and every byte of a non-ASCII character. Upper case is folded first.
_IS_WORD = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the index of each text's first word."""
    low = _FOLD[data]
    starts, ends, first = word_spans(low, offsets, _IS_WORD)
    return span_hashes(low, starts, ends), first


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words (order matters)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
    return mix(h)


def _slide(values: np.ndarray, w: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``w`` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= w:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the minimum of some window of ``w`` grams (all of them on ties)."""
    if len(grams) < w:
        return np.zeros(0, np.int64)
    if w == 1:
        return np.arange(len(grams))
    low = _slide(grams, w, np.minimum)
    top = np.uint64(0)
    padded = np.concatenate([np.full(w - 1, top), low, np.full(w - 1, top)])
    return np.flatnonzero(_slide(padded, w, np.maximum) == grams)


def _surroundings(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, before: int, after: int,
                  beyond: int) -> np.ndarray:
    """Words from ``before`` in front of each place up to ``after`` behind it, ``beyond`` outside [low, high)."""
    spot = at[:, None] + np.arange(-before, after)
    inside = (spot >= low[:, None]) & (spot < high[:, None])
    return np.where(inside, words[np.clip(spot, 0, max(0, len(words) - 1))], np.uint64(beyond))


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = h * np.uint64(0xD6E8FEB86659FD93) + column
    return mix(h)


def _fan(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, member) of every member of the ranges [start, start + count)."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + start[which]


class Marks:
    """Fingerprints of the items that need ``length`` shared words, each with the words around it.

    A shared window of ``length`` words holds a fingerprint of both sides, so it lies within the words around that
    fingerprint. Places with the same words around them give the same answer: they are one entry with many owners.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, chosen: np.ndarray, length: int, gram: int):
        self.length, self.k = length, min(gram, length)
        self.w, self.before = length - self.k + 1, length - self.k
        marks, at, item = [], [], []
        for i in chosen:
            grams = gram_hashes(words[first[i]:first[i + 1]], self.k)
            pos = winnow(grams, self.w)
            marks.append(grams[pos])
            at.append(pos + first[i])
            item.append(np.full(len(pos), i))
        marks, at, item = map(np.concatenate, (marks, at, item))
        around = np.concatenate([_row_hashes(self.of_items(words, first, at[c:c + SLICE], item[c:c + SLICE]))
                                 for c in range(0, len(at), SLICE)])
        order = np.lexsort((item, around, marks))
        marks, at, item, around = marks[order], at[order], item[order], around[order]
        new = np.concatenate([[True], (marks[1:] != marks[:-1]) | (around[1:] != around[:-1])])
        entry = np.cumsum(new) - 1
        lead = np.flatnonzero(new)
        for c in range(0, len(at), SLICE):  # a hash may collide: places that differ from their entry's stand alone
            own = self.of_items(words, first, at[c:c + SLICE], item[c:c + SLICE])
            led = lead[entry[c:c + SLICE]]
            new[c:c + SLICE] |= (own != self.of_items(words, first, at[led], item[led])).any(axis=1)
        entry, lead = np.cumsum(new) - 1, np.flatnonzero(new)
        self.marks, self.at, self.item = marks[lead], at[lead], item[lead]
        pairs = np.unique(np.stack([entry, item], axis=1), axis=0)
        self.owners = pairs[:, 1]
        self.owned = np.searchsorted(pairs[:, 0], np.arange(len(lead) + 1))
        self.sieve = np.zeros(1 << max(16, int(len(self.marks) * 16).bit_length()), bool)
        self.sieve[(self.marks & np.uint64(len(self.sieve) - 1)).astype(np.int64)] = True

    def of_items(self, words, first, at, item):
        return _surroundings(words, at, first[item], first[item + 1], self.before, self.length, 1)

    def hits(self, words: np.ndarray, first: np.ndarray, item_words: np.ndarray, item_first: np.ndarray):
        """(text, start, end, items' text, item) arrays of hit words and of the items that hit, slice by slice."""
        grams = gram_hashes(words, self.k)
        pos = winnow(grams, self.w)
        value = grams[pos]
        near = self.sieve[(value & np.uint64(len(self.sieve) - 1)).astype(np.int64)]
        pos, value = pos[near], value[near]
        lo, hi = np.searchsorted(self.marks, value, "left"), np.searchsorted(self.marks, value, "right")
        pos, lo, hi = pos[hi > lo], lo[hi > lo], hi[hi > lo]
        for c in range(0, len(pos), SLICE):
            yield self._slice(words, first, pos[c:c + SLICE], lo[c:c + SLICE], hi[c:c + SLICE], item_words, item_first)

    def _slice(self, words, first, pos, lo, hi, item_words, item_first):
        text = np.searchsorted(first, pos, "right") - 1
        around = _surroundings(words, pos, first[text], first[text + 1], self.before, self.length, 0)
        _, lead, kind = np.unique(_row_hashes(around), return_index=True, return_inverse=True)
        if (around != around[lead[kind]]).any():  # a collision: every place by itself
            lead = kind = np.arange(len(pos))
        left, right = np.full(len(lead), -1), np.full(len(lead), -1)
        kinds, entries = [], []
        count = hi[lead] - lo[lead]
        ends = np.cumsum(count)
        for c in range(0, int(ends[-1]), SLICE):
            flat = np.arange(c, min(c + SLICE, int(ends[-1])))
            one = np.searchsorted(ends, flat, "right")
            entry = lo[lead[one]] + flat - (ends[one] - count[one])
            equal = around[lead[one]] == self.of_items(item_words, item_first, self.at[entry], self.item[entry])
            to_left = np.minimum.accumulate(equal[:, :self.before][:, ::-1], axis=1).sum(axis=1)
            to_right = np.minimum.accumulate(equal[:, self.length:], axis=1).sum(axis=1)
            good = equal[:, self.before:self.length].all(axis=1) & (to_left + self.k + to_right >= self.length)
            np.maximum.at(left, one[good], to_left[good])
            np.maximum.at(right, one[good], to_right[good])
            kinds.append(one[good])
            entries.append(entry[good])
        kinds, entries = np.concatenate(kinds), np.concatenate(entries)
        hit = left[kind] >= 0
        text, kind, pos = text[hit], kind[hit], pos[hit]
        seen = np.unique(np.stack([text, kind], axis=1), axis=0)
        a = np.searchsorted(kinds, seen[:, 1], "left")
        which, k = _fan(a, np.searchsorted(kinds, seen[:, 1], "right") - a)
        whose, found = seen[which, 0], entries[k]
        which, k = _fan(self.owned[found], self.owned[found + 1] - self.owned[found])
        owners = np.unique(np.stack([whose[which], self.owners[k]], axis=1), axis=0)
        return text, pos - left[kind], pos + self.k + right[kind], owners[:, 0], owners[:, 1]


class Block:
    """Word hashes of some items and, per window length, the winnowed fingerprints that lead back to them."""

    def __init__(self, ids: list[int], texts: list[bytes], n: int, gram: int):
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.ids = ids
        self.words, self.first = text_words(data, offsets)
        need = np.minimum(np.diff(self.first), n)
        self.classes = [Marks(self.words, self.first, np.flatnonzero(need == length), length, gram)
                        for length in sorted({int(x) for x in need if x})]

    def runs(self, words: np.ndarray, first: np.ndarray):
        """Per text that shares a window: (text index, disjoint hit word ranges, item indexes)."""
        parts = [p for m in self.classes for p in m.hits(words, first, self.words, self.first)]
        if not parts:
            return
        text, start, end, whose, item = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, text))
        text, start, end = text[order], start[order], end[order]
        owners = np.unique(np.stack([whose, item], axis=1), axis=0)
        for t in np.unique(text):
            a, b = np.searchsorted(text, t, "left"), np.searchsorted(text, t, "right")
            low, reach = start[a:b], np.maximum.accumulate(end[a:b])
            cut = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
            ranges = zip(low[cut] - first[t], np.append(reach[cut[1:] - 1], reach[-1]) - first[t])
            own = owners[np.searchsorted(owners[:, 0], t, "left"):np.searchsorted(owners[:, 0], t, "right"), 1]
            yield int(t), [(int(x), int(y)) for x, y in ranges], own.tolist()


def benchmark_blocks(spark: SparkSession, benchmark: DataFrame, n: int, gram: int, block_bytes: int) -> list:
    """Broadcast blocks of at most ``block_bytes`` of item text (one longer item is a block of its own)."""
    rows = (benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
            .where("text != ''").toLocalIterator())
    blocks, ids, texts, size = [], [], [], 0
    for r in rows:
        raw = r["text"].encode()
        if texts and size + len(raw) > block_bytes:
            blocks.append(spark.sparkContext.broadcast(Block(ids, texts, n, gram)))
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(raw)
        size += len(raw)
    blocks.append(spark.sparkContext.broadcast(Block(ids, texts, n, gram)))
    return blocks


def _pass(held, text: str, columns: list[str], count: str, ranges: str, items: str):
    def scan(batches):
        block = held.value
        for batch in batches:
            names = batch.schema.names
            data, offsets = buffer_of(batch.column(names.index(text)))
            n_words = np.zeros(batch.num_rows, np.int64)
            if count in names:
                hit = batch.column(names.index(ranges)).to_pylist()
                found = batch.column(names.index(items)).to_pylist()
            else:
                hit = [[] for _ in range(batch.num_rows)]
                found = [[] for _ in range(batch.num_rows)]
            for i, j in doc_chunks(offsets):
                words, first = text_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                n_words[i:j] = np.diff(first)
                for t, spans, own in block.runs(words, first):
                    hit[i + t] += [x for span in spans for x in span]
                    found[i + t] += [block.ids[x] for x in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in columns]
                + [pa.array(n_words), pa.array(hit, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))],
                columns + [count, ranges, items])
    return scan


def shared_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
                 n: int = NGRAM, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str, str, str]:
    """Columns ``keep`` (all by default) of ``docs`` with the word count, the flattened [start, end) word ranges shared with items, and the item ids.

    Null or empty texts have no words. Items without a word are ignored; repeated items count once.
    An item without an id makes ranges, but its id in the list is null.
    Ranges may overlap. Returns the frame and the names of the three new columns (chosen not to clash).
    """
    count, ranges, items = (fresh(docs, c) for c in ("n_words", "hit_ranges", "hit_items"))
    keep = list(docs.columns if keep is None else keep)
    made = ((count, T.LongType()), (ranges, T.ArrayType(T.LongType())), (items, T.ArrayType(T.LongType())))
    out = docs.select(*dict.fromkeys([*keep, text]))
    blocks = benchmark_blocks(docs.sparkSession, benchmark, n, gram, block_bytes)
    for i, block in enumerate(blocks):
        base = docs.select(*(keep if i == len(blocks) - 1 else dict.fromkeys([*keep, text])))
        out = out.mapInArrow(_pass(block, text, base.columns, count, ranges, items), add_fields(base, *made))
    return out, count, ranges, items


def covered(ranges) -> int:
    """Words inside the union of flattened [start, end) ranges."""
    spans = sorted(zip(ranges[::2], ranges[1::2]))
    total, reach = 0, 0
    for a, b in spans:
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _digest(count: str, ranges: str, items: str, columns: list[str]):
    def summarise(batches):
        for batch in batches:
            take = lambda c: batch.column(batch.schema.names.index(c))
            hits = [covered(r) for r in take(ranges).to_pylist()]
            ids = [sorted({str(x) for x in own if x is not None}) for own in take(items).to_pylist()]
            words = take(count).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [take(c) for c in columns]
                + [pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                   pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]),
                   pa.array([h > 0 and 20 * h >= w for h, w in zip(hits, words)])],
                [f"c{i}" for i in range(len(columns) + 5)])
    return summarise


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text",
                  **options) -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated per document.

    A kept column that has one of these names is replaced by the operator's result. Items without an id count in
    n_hit and contaminated; n_items and items_sha256 are over ids.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    spans, count, ranges, items = shared_spans(docs, benchmark, text, keep, **options)
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()]
    fields = [docs.schema[c] for c in keep] + [T.StructField(a, t) for a, t in zip(made, kinds)]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return spans.mapInArrow(_digest(count, ranges, items, keep), schema).toDF(*[f.name for f in fields])


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsieve.llm.common import table
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                         table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns only."""
    spans, count, ranges, items = shared_spans(docs, benchmark)
    hit = fresh(spans, "n_hit")
    flat = F.expr(
        f"aggregate(array_sort(transform(sequence(0, int(size({ranges}) / 2) - 1), "
        f"i -> named_struct('a', {ranges}[2 * i], 'b', {ranges}[2 * i + 1]))), "
        "named_struct('n', 0L, 'r', 0L), "
        "(s, x) -> named_struct('n', s.n + greatest(0L, x.b - greatest(x.a, s.r)), 'r', greatest(s.r, x.b)), s -> s.n)")
    n_hit = F.when(F.size(ranges) > 0, flat).otherwise(F.lit(0))
    return spans.withColumn(hit, n_hit).where(~((F.col(hit) > 0) & (F.col(hit) * 20 >= F.col(count)))).select(*docs.columns)
