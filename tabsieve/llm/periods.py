"""Periodic runs of words, found on a grammar of the text.

The words of a batch of texts become ids (exact, by dictionary encoding) and the
id sequences are compressed by Re-Pair: frequent neighbours are replaced by a
nonterminal until no pair occurs twice. Pairs are taken by frequency class
(powers of two, ties by hash), and in a round all pairs that no better
neighbour overlaps are replaced at once, so a round is a few numpy passes.

A run lies across the middle of exactly one smallest node of the derivation, so
runs across the middle of a nonterminal are computed once, on one occurrence,
and translated to all its derivation positions; what Re-Pair leaves of a text is
joined by a balanced tree whose nodes occur once. At a node only stretches of
exponent 4 are wanted, so for each period it is enough to compare the two
blocks of that period right of the middle and the two left of it. Translated
intervals of one period that overlap are merged to the maximal one.

Blocks are compared by prefix hashes; every run is then checked against the
words, and a text with a false one is searched again by comparing words only.
The scan is narrow: nothing is shuffled, and a text's work is near linear in its
words whatever it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm.common import buffer_of, class_table, doc_chunks, fresh, mix, release, table, word_spans
from tabsieve.llm.line_rules import let, words_of

#: A run repeats its period at least this often, and has at least this many words.
EXPONENT = 4
LEAST_WORDS = 6
#: Comparisons held at once while a level of nodes is tested.
TESTS = 1 << 20

_IS_WORD = class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal ids for equal words of one buffer."""
    where = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=where[1:])
    body = np.ascontiguousarray(data[_IS_WORD[data]])  # word bytes are exactly those of the spans, in order
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(body)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 0..count-1) for every unit of ``counts``."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


# ------------------------------------------------------------------------------ grammar
class Grammar:
    """Re-Pair of id sequences: nodes of the nonterminals, their derivation positions, and what is left.

    ``node[x]`` is (start, middle, end) of one occurrence of nonterminal x in the words; ``event_of`` and
    ``event_at`` list nonterminal and start of every occurrence; ``start`` holds the word positions of the symbols
    left and ``own`` their texts.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        self.own = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.start = np.arange(len(ids))
        self.total = len(ids)
        self.symbol = ids.copy()
        self.terminals = int(ids.max()) + 1 if len(ids) else 0
        self.pairs = np.zeros(0, np.int64)  # sorted (left << 32 | right) of the rules so far, and their nonterminals
        self.names = np.zeros(0, np.int64)
        nodes, events_of, events_at, n_rules = [], [], [], 0
        while (chosen := self._chosen()) is not None:
            at, pair = chosen
            unique, one, inverse, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            known = np.searchsorted(self.pairs, unique)
            old = known < len(self.pairs)
            old[old] = self.pairs[known[old]] == unique[old]
            fit = old | (count > 1)
            new = fit & ~old
            name = np.full(len(unique), -1)
            name[old] = self.names[known[old]]
            name[new] = n_rules + np.arange(new.sum())
            n_rules += int(new.sum())
            begin, after = self.start[at[one[new]]], at[one[new]] + 2
            nodes.append(np.stack([begin, self.start[at[one[new]] + 1], self._end(after)], 1))
            order = np.argsort(np.concatenate([self.pairs, unique[new]]), kind="stable")
            self.pairs = np.concatenate([self.pairs, unique[new]])[order]
            self.names = np.concatenate([self.names, name[new]])[order]
            take = fit[inverse]
            at, of = at[take], name[inverse[take]]
            events_of.append(of)
            events_at.append(self.start[at])
            self.symbol[at] = self.terminals + of
            stay = np.ones(len(self.symbol), bool)
            stay[at + 1] = False
            self.symbol, self.start, self.own = self.symbol[stay], self.start[stay], self.own[stay]
        self.node = np.concatenate(nodes) if nodes else np.zeros((0, 3), np.int64)
        self.event_of = np.concatenate(events_of) if nodes else np.zeros(0, np.int64)
        self.event_at = np.concatenate(events_at) if nodes else np.zeros(0, np.int64)

    def _end(self, index: np.ndarray) -> np.ndarray:
        return np.append(self.start, self.total)[index]

    def _chosen(self):
        """(positions, pairs) to replace in this round: pairs that occur twice, the best of overlapping ones."""
        if len(self.symbol) < 2:
            return None
        pair = (self.symbol[:-1] << 32) | self.symbol[1:]
        fit = self.own[1:] == self.own[:-1]
        again = np.zeros(len(pair), bool)  # the same pair one place before: every other one of such a row counts
        again[1:] = (pair[1:] == pair[:-1]) & fit[1:] & fit[:-1]
        if again.any():
            place = np.arange(len(pair))
            fit &= (place - np.maximum.accumulate(np.where(again, 0, place))) % 2 == 0
        bucket = (mix(pair.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        fit &= np.bincount(bucket[fit], minlength=1 << 20)[bucket] > 1
        at = np.flatnonzero(fit)
        unique, inverse, count = np.unique(pair[at], return_inverse=True, return_counts=True)
        if not len(unique) or count.max() < 2:
            return None
        size = np.frexp(count.astype(float))[1]
        rank = np.empty(len(unique), np.int64)
        rank[np.lexsort((mix(unique.astype(np.uint64)), size))] = np.arange(1, len(unique) + 1)
        rank[count < 2] = 0
        power = np.zeros(len(pair) + 2, np.int64)
        power[at + 1] = rank[inverse]
        best = at[(power[at + 1] > power[at]) & (power[at + 1] > power[at + 2])]
        return best, pair[best]

    def tree_levels(self):
        """(start, middle, end) of the nodes of balanced trees over the symbols left, level by level."""
        head = np.searchsorted(self.own, self.own, "left")
        tail = np.searchsorted(self.own, self.own, "right")
        place = np.arange(len(self.own)) - head
        step, widest = 1, int((tail - head).max()) if len(head) else 0
        while step < widest:
            at = np.flatnonzero(place % (2 * step) == step)
            yield np.stack([self.start[at - step], self.start[at], self._end(np.minimum(at + step, tail[at]))], 1)
            step *= 2


# ------------------------------------------------------------------------------ runs across a node's middle
class Prefixes:
    """Prefix hashes of the ids: equal stretches have equal hashes."""

    def __init__(self, ids: np.ndarray):
        codes = mix(ids.astype(np.uint64) + np.uint64(0x51ED2701)) | np.uint64(1)
        power = np.full(len(ids) + 1, _BASE)
        back = np.full(len(ids) + 1, _BACK)
        power[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * np.cumprod(power)[:-1])])

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``a`` and from ``b`` seem equal."""
        s, k = self.sums, self.back
        return (s[a + n] - s[a]) * k[a] == (s[b + n] - s[b]) * k[b]


def _reach(same, most: np.ndarray) -> np.ndarray:
    """Largest x <= most with same(x), a test that holds up to some x; by bisection of all rows at once."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        good = same(middle)
        low = np.where(open_ & good, middle, low)
        high = np.where(open_ & ~good, middle - 1, high)
    return low


def crossing_runs(ids: np.ndarray, hashes: Prefixes, nodes: np.ndarray) -> np.ndarray:
    """Rows (node, start, end, period) of stretches of exponent 4 or more that cross a node's middle, maximal within
    the node; of equal stretches the one with the smallest period."""
    found = []
    size = nodes[:, 2] - nodes[:, 0]
    for side in (1, -1):
        room = (nodes[:, 2] - nodes[:, 1]) if side > 0 else (nodes[:, 1] - nodes[:, 0])
        most = np.where(size >= LEAST_WORDS, np.minimum(room // 2, size // EXPONENT), 0)
        busy = np.flatnonzero(most)
        cuts = np.searchsorted(np.cumsum(most[busy]), np.arange(0, most.sum() + TESTS, TESTS))
        for a, b in zip(cuts[:-1], [*cuts[1:-1], len(busy)]):
            row, q = expand(most[busy[a:b]])
            row, q = busy[a:b][row], q + 1
            near = nodes[row, 1] if side > 0 else nodes[row, 1] - 1  # word next to the middle
            hit = ids[near] == ids[near + side * q]
            row, q = row[hit], q[hit]
            at = nodes[row, 1] if side > 0 else nodes[row, 1] - 2 * q  # two blocks of q words from here
            hit = hashes.equal(at, at + q, q)
            row, q, at = row[hit], q[hit], at[hit]
            if not len(row):
                continue
            after = _reach(lambda x: hashes.equal(at, at + q, x), nodes[row, 2] - at - q)  # noqa: B023
            before = _reach(lambda x: hashes.equal(at - x, at + q - x, x), at - nodes[row, 0])  # noqa: B023
            long = after + before + q >= np.maximum(EXPONENT * q, LEAST_WORDS)
            found.append(np.stack([row, at - before, at + q + after, q], 1)[long])
    return _smallest_period(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)


def _smallest_period(rows: np.ndarray) -> np.ndarray:
    """First row of each (node, start, end) by period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[first]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals of one period that overlap by a period or more; sorted by start, then period."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.append(0, period[1:] != period[:-1]))
    reach = np.maximum.accumulate(end + group * (int(end.max()) + 1)) - group * (int(end.max()) + 1)
    begins = np.ones(len(start), bool)
    begins[1:] = (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])
    at = np.flatnonzero(begins)
    rows = _smallest_period(np.stack([np.zeros(len(at), np.int64), start[at], np.maximum.reduceat(end, at), period[at]], 1))
    return rows[:, 1], rows[:, 2], rows[:, 3]


def plain_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of one text by comparing words only; the work grows with its square."""
    best: dict[tuple[int, int], int] = {}
    for q in range(1, len(ids) // EXPONENT + 1):
        same = np.zeros(len(ids) - q + 2, np.int8)
        same[1:-1] = ids[:-q] == ids[q:]
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q):
            if b - a >= max(EXPONENT * q, LEAST_WORDS):
                best.setdefault((int(a), int(b)), q)
    return [(a, b, q) for (a, b), q in best.items()]


def _true(ids: np.ndarray, first: np.ndarray, start, end, period) -> np.ndarray:
    """Whether each run holds word by word and cannot be extended within its text."""
    text = np.searchsorted(first, start, "right") - 1
    good = end <= first[text + 1]
    left = good & (start > first[text])
    good[left] &= ids[start[left] - 1] != ids[start[left] - 1 + period[left]]
    right = good & (end < first[text + 1])
    good[right] &= ids[end[right]] != ids[end[right] - period[right]]
    length = end - start - period
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(np.cumsum(length[i:]), TESTS)) + i)
        row, k = expand(length[i:j])
        p = start[i:j][row] + k
        good[i:j] &= np.bincount(row, ids[p] != ids[p + period[i:j][row]], j - i) == 0
        i = j
    return good


def find_runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of all texts, ordered by start, then period. ``first`` has the texts' bounds."""
    grammar = Grammar(ids, first)
    hashes = Prefixes(ids)
    rules = crossing_runs(ids, hashes, grammar.node)
    order = np.argsort(grammar.event_of, kind="stable")
    of, at = grammar.event_of[order], grammar.event_at[order]
    low, high = np.searchsorted(of, rules[:, 0], "left"), np.searchsorted(of, rules[:, 0], "right")
    row, k = expand(high - low)
    shift = at[low[row] + k] - grammar.node[rules[row, 0], 0]
    parts = [np.stack([rules[row, 1] + shift, rules[row, 2] + shift, rules[row, 3]], 1)]
    parts += [crossing_runs(ids, hashes, level)[:, 1:] for level in grammar.tree_levels()]
    found = np.concatenate(parts)
    if not len(found):
        return found[:, 0], found[:, 1], found[:, 2]
    start, end, period = merged(*found.T)
    good = _true(ids, first, start, end, period)
    if not good.all():  # a hash collision: those texts are searched by their words
        texts = np.unique(np.searchsorted(first, start[~good], "right") - 1)
        keep = ~np.isin(np.searchsorted(first, start, "right") - 1, texts)
        again = [(a + first[t], b + first[t], q) for t in texts for a, b, q in plain_runs(ids[first[t]:first[t + 1]])]
        rows = np.concatenate([np.stack([start, end, period], 1)[keep], np.array(again, np.int64).reshape(-1, 3)])
        start, end, period = rows[np.lexsort((rows[:, 2], rows[:, 0]))].T
    return start, end, period


# ------------------------------------------------------------------------------ operator
def _collapsed(data, starts, ends, first, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts made of the words marked in ``keep``, joined by one space."""
    word = np.flatnonzero(keep)
    text = np.searchsorted(first, word, "right") - 1
    gap = np.ones(len(word), np.int64)  # a space before each word that is not a text's first
    gap[:1] = 0
    gap[1:] = text[1:] == text[:-1]
    size = ends[word] - starts[word]
    stop = np.cumsum(size + gap)
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    from_, to = np.repeat(starts[word] - (stop - size), size), np.flatnonzero(_marks(stop - size, stop, len(out)))
    out[to] = data[to + from_]
    kept = np.bincount(text, minlength=len(first) - 1)
    return out, np.append(0, np.append(0, stop)[np.cumsum(kept)])


def _marks(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in [begin, end) of any interval."""
    step = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def _scan(keep: list[str], text: str):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            data, offsets = buffer_of(batch.column(names.index(text)))
            for i, j in doc_chunks(offsets):
                part, cuts = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                starts, ends, first = word_spans(part, cuts, _IS_WORD)
                ids = word_ids(part, starts, ends)
                a, b, q = find_runs(ids, first)
                stay = ~_marks(a + q, b, len(ids))
                raw, bounds = _collapsed(part, starts, ends, first, stay)
                own = np.searchsorted(first, a, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(x) for x in (a - first[own], b - a, q)], RUN.names)
                per_text = np.append(0, np.cumsum(np.bincount(own, minlength=j - i))).astype(np.int32)
                texts = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(bounds.astype(np.int64)),
                                                                         pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index(c)).slice(i, j - i) for c in keep]
                    + [pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(per_text), spans), texts.cast(pa.string())],
                    [f"c{k}" for k in range(len(keep) + 3)])
            release()
    return run


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` (all but the results' by default) with n_words, runs and collapsed per document.

    ``runs`` has (start, length, period) in words, by start, then period: every stretch of at least 6 words and 4
    periods that cannot be extended. ``collapsed`` has the words joined by one space, without those that a run
    holds after its first period. Null and empty texts have no words. A kept column that has the name of a result
    gives way to the result; rows are never merged, so repeated rows give repeated results.
    """
    made = ["n_words", "runs", "collapsed"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    types = [docs.schema[c].dataType for c in keep] + [T.LongType(), T.ArrayType(RUN), T.StringType()]
    schema = T.StructType([T.StructField(f"c{k}", t) for k, t in enumerate(types)])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_scan(keep, text), schema).toDF(*keep, *made)


# ------------------------------------------------------------------------------ query
def planted(doc_id: Column, text: Column) -> Column:
    """The contract's text: of every tenth document (by crc32 of its id) words repeat with a period from a point on.

    A row without an id keeps its text.
    """
    def from_(words: Column, a: Column, n: Column, g: Column) -> Column:
        p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
        return let(p, lambda p: F.array_join(F.transform(
            words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " "))

    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    again = let(words_of(F.coalesce(text, F.lit(""))), lambda w: let(F.size(w), lambda n: F.when(n > 0, let(
        (g % F.greatest(n, F.lit(1))).cast("int"), lambda a: from_(w, a, n, g))).otherwise(text)))
    return F.when(h % 10 == 0, again).otherwise(text)


def run_digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the digest columns of a ``periodic_runs`` result."""
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda b, x: F.when(
        b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"]), x).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    b = fresh(found, "best")
    rows = found.select(*keep, "runs", "collapsed", best.alias(b))
    return rows.select(
        *keep, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"{b}.{c}").alias(c) for c in RUN.names],
        F.expr(f"(1000 * {b}.length) div {b}.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    return run_digests(periodic_runs(docs, ["doc_id"]), ["doc_id"])
