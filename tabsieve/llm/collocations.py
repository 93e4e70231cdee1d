"""Frequent phrases and their association, by Rabin-Karp fingerprints.

Words of a piece, joined by one space, lie in one byte buffer, and two prefix
polynomials over it (modulo 2^64 and modulo a 32-bit prime) give fingerprint and
check of every n-gram by a difference of two entries. Tasks sort and count the
fingerprints of a few megabytes, and the shuffle sums them with the least check,
the greatest check and an occurrence pointer (33 bits of a hash of the document
row, 31 bits of the place in its text). Fingerprints whose checks differ are
collisions: their n-grams are counted again by their text. Only frequent phrases
become text, read at their pointers in every row with that hash, where both
hashes must be the stored ones.

Lengths are counted one after the other, since an n-gram is frequent only if its
parts are: a bitmap of the frequent fingerprints of the length before, at most
``FILTER_BITS`` bits whatever the corpus, keeps most rare n-grams out of the
shuffle. A full bitmap keeps fewer out; counts are exact with any.

The rest is joins on phrases: an exact score per cut, containment in longer
phrases, and a ranking whose groups stay bounded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsieve.llm.common import (
    buffer_of, class_table, cut_hashes, doc_chunks, mix, prefix_hashes, release, settle, table, word_spans,
)

LEAST = 100
WIDEST = 5
TOP = 2000
UNKNOWN = "und"
#: Bits of the broadcast filter: 16 per frequent n-gram of the length before, within these bounds (16 MB).
FILTER_BITS = (1 << 16, 1 << 27)
#: N-grams that a task sorts at once.
HELD = 1 << 21
OUT_ROWS = 1 << 16
#: Rows that one ranking group may hold.
GROUP_ROWS = 50_000

_POINTER = ["mark", "check", "n", "at", "low", "high"]

PRIME = np.uint64(4294967291)  # the largest prime below 2^32
_ROOT = 2654435761
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IS_BREAK = class_table(lambda b: chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D)
_IS_WORD = class_table(lambda b: not (chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D or b in (0x20, 0x09)))
_CODES = np.random.default_rng(20250301).integers(1, int(PRIME), 256, dtype=np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime, by doubling."""
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % PRIME])
        step = step * step % int(PRIME)
    return out[:n]


class Words:
    """The words of some texts in one buffer, joined by one space, with what fingerprints need."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _FOLD[data]
        self.begin, self.end, self.first = word_spans(low, offsets, _IS_WORD)
        breaks = np.append(0, np.cumsum(_IS_BREAK[low]))[self.begin] if len(low) else self.begin
        own = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.own = own
        self.piece = np.cumsum(np.append(0, (np.diff(breaks) > 0) | (np.diff(own) > 0))) if len(own) else own
        size = self.end - self.begin
        self.start = np.append(0, np.cumsum(size + 1))[:-1]
        self.stop = self.start + size
        self.buffer = np.full(int(self.stop[-1]) if len(size) else 0, 0x20, np.uint8)
        body = np.flatnonzero(_IS_WORD[low])
        self.buffer[np.repeat(self.start - self.begin, size) + body] = low[body]
        self.origin = offsets[own]

    def prints(self) -> Prints:
        return Prints(self.buffer)

    def grams(self, k: int) -> np.ndarray:
        """First words of the n-grams of ``k`` words that stay within a piece."""
        n = len(self.piece) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1:]) if n > 0 else np.zeros(0, np.int64)


class Prints:
    """Prefix polynomials of a buffer; ``of`` gives (fingerprint, check) of spans."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.sums = prefix_hashes(buffer)
        self.checks = np.append(np.uint64(0), np.cumsum(_CODES[buffer] * _powers(n, _ROOT) % PRIME)) if n else None
        self.back = _powers(n, pow(_ROOT, -1, int(PRIME)))

    def of(self, start: np.ndarray, stop: np.ndarray, seed, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
        mark = mix(cut_hashes(self.sums, start, stop) ^ seed) >> np.uint64(64 - bits)
        if not len(start):
            return mark, mark
        return mark, (self.checks[stop] - self.checks[start]) % PRIME * self.back[start] % PRIME


def language_seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _seeds(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    known = np.array([language_seed(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return known[coded.indices.to_numpy(zero_copy_only=False)]


# ------------------------------------------------------------------------------ filter
class Sieve:
    """Bitmap of fingerprints: no member is missing, others pass by chance."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.shift = words, np.uint64(64 - (bits.bit_length() - 1))

    def holds(self, marks: np.ndarray) -> np.ndarray:
        place = mix(marks) >> self.shift
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _places(bits: int):
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def run(batches):
        for batch in batches:
            place = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> shift
            word = (place >> np.uint64(6)).astype(np.int64)
            bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], ["word", "bit"])
    return run


def sieve_of(frequent: DataFrame) -> Sieve:
    """Sieve of the column ``mark`` of a settled table; its words come to the driver, 16 MB at most."""
    low, high = FILTER_BITS
    bits = min(high, max(low, 1 << (16 * max(1, frequent.count()) - 1).bit_length()))
    rows = (frequent.select("mark").mapInArrow(_places(bits), "word long, bit long")
            .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow())
    words = np.zeros(bits >> 6, np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return Sieve(words, bits)


# ------------------------------------------------------------------------------ counting
class _Counter:
    """Fingerprints held until there are many, then given out counted."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, *columns: np.ndarray):
        if len(columns[0]):
            self.parts.append(columns)
            self.size += len(columns[0])

    def out(self):
        if self.parts:
            mark, check, at = (np.concatenate(c) for c in zip(*self.parts))
            self.parts, self.size = [], 0
            order = np.argsort(mark, kind="stable")
            mark, check = mark[order], check[order]
            head = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (check[1:] != check[:-1])))
            count = np.diff(np.append(head, len(mark)))
            both = (check[head].view(np.int64) << 31) | count  # one word in the shuffle: 32 bits of check, 31 of count
            columns = [mark[head].view(np.int64), both, at[order[head]]]
            for i in range(0, len(head), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + OUT_ROWS]) for c in columns],
                                                 ["mark", "both", "at"])


def _fitting(words: Words, prints: Prints, seed: np.ndarray, k: int, sieve: Sieve | None, width: int, bits: int):
    """First words of the n-grams whose parts of ``width`` words all pass the sieve."""
    first = words.grams(k)
    if sieve is None or not len(first):
        return first
    part = words.grams(width)
    good = np.zeros(len(words.piece), bool)
    good[part] = sieve.holds(prints.of(words.start[part], words.stop[part + width - 1], seed[part], bits)[0])
    for j in range(k - width + 1):
        first = first[good[first + j]]
    return first


def _count(lengths: list[int], held, width: int, bits: int):
    def run(batches):
        sieve, counter = held.value if held else None, _Counter()
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            seeds = _seeds(batch.column(1))
            data, offsets = buffer_of(batch.column(2))
            for i, j in doc_chunks(offsets):
                words = Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                prints, seed = words.prints(), seeds[i:j][words.own]
                for k in lengths:
                    a = _fitting(words, prints, seed, k, sieve, width, bits)
                    b = a + k - 1
                    at = (docs[i:j][words.own[a]] << 31) | (words.begin[a] - words.origin[a])
                    counter.add(*prints.of(words.start[a], words.stop[b], seed[a], bits), at)
                    if counter.size > HELD:
                        yield from counter.out()
        yield from counter.out()
        release()
    return run


def frequent_marks(rows: DataFrame, lengths: list[int], sieve: Sieve | None, width: int, least: int,
                   bits: int) -> DataFrame:
    """(mark, check, n, mixed, at, low, high) of fingerprints with ``least`` occurrences or more.

    ``mixed`` tells a collision; ``low`` and ``high`` are the least and greatest length counted here.

    Tasks have counted before the exchange, so a phrase that a third of all texts hold is a row per task and
    megabytes read.
    """
    held = rows.sparkSession.sparkContext.broadcast(sieve) if sieve else None
    counted = rows.mapInArrow(_count(lengths, held, width, bits), "mark long, both long, at long")
    n, check = F.expr(f"both & {(1 << 31) - 1}L"), F.shiftright("both", 31)
    sums = counted.repartition("mark").groupBy("mark").agg(
        F.sum(n).alias("n"), F.min(check).alias("check"), F.max(check).alias("other"), F.min("at").alias("at"))
    return settle(sums.where(F.col("n") >= least).select(
        "mark", "check", "n", (F.col("check") != F.col("other")).alias("mixed"), "at",
        F.lit(lengths[0]).alias("low"), F.lit(lengths[-1]).alias("high")))


def recounted(rows: DataFrame, marks: list[int], widest: int, least: int, bits: int) -> DataFrame:
    """(lang, phrase, k, a) of the n-grams with one of ``marks``, told apart by their text."""
    wanted = np.sort(np.array(marks, np.int64).view(np.uint64))

    def run(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            seeds = _seeds(batch.column(1))
            data, offsets = buffer_of(batch.column(2))
            for i, j in doc_chunks(offsets):
                words = Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                prints, seed = words.prints(), seeds[i:j][words.own]
                raw = words.buffer.tobytes()
                for k in range(1, widest + 1):
                    a = words.grams(k)
                    a = a[np.isin(prints.of(words.start[a], words.stop[a + k - 1], seed[a], bits)[0], wanted)]
                    out = [(langs[i + words.own[x]], raw[words.start[x]:words.stop[x + k - 1]].decode()) for x in a]
                    for c in range(0, len(out), OUT_ROWS):
                        part = out[c:c + OUT_ROWS]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x[0] for x in part]), pa.array([x[1] for x in part]), pa.array([k] * len(part))],
                            ["lang", "phrase", "k"])
    return (rows.mapInArrow(run, "lang string, phrase string, k long").groupBy("lang", "phrase", "k")
            .agg(F.count(F.lit(1)).alias("a")).where(F.col("a") >= least))


def _read(bits: int):
    """Phrases at the pointers of each row, where fingerprint and check are the stored ones."""
    def run(batches):
        for batch in batches:
            langs, seeds = batch.column(0).to_pylist(), _seeds(batch.column(0))
            data, offsets = buffer_of(batch.column(1))
            points = batch.column(2)
            owner = points.value_parent_indices().to_numpy(zero_copy_only=False)
            field = {x: points.flatten().field(x).to_numpy(zero_copy_only=False) for x in _POINTER}
            for i, j in doc_chunks(offsets):
                words = Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                prints, raw = words.prints(), words.buffer.tobytes()
                mine = np.flatnonzero((owner >= i) & (owner < j))
                at = (field["at"][mine] & ((1 << 31) - 1)) + offsets[owner[mine]] - offsets[i]
                first = np.minimum(np.searchsorted(words.begin, at), max(0, len(words.begin) - 1))
                for k in range(1, int(field["high"].max(initial=0)) + 1):
                    fit = (field["low"][mine] <= k) & (field["high"][mine] >= k) & (first + k <= len(words.begin))
                    fit[fit] = words.begin[first[fit]] == at[fit]
                    a, own = first[fit], mine[fit]
                    mark, check = prints.of(words.start[a], words.stop[a + k - 1], seeds[owner[own]], bits)
                    good = (mark.view(np.int64) == field["mark"][own]) & (check.view(np.int64) == field["check"][own])
                    good &= words.piece[a] == words.piece[a + k - 1]
                    a, own = a[good], own[good]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([langs[x] for x in owner[own]], pa.string()),
                         pa.array([raw[b:e].decode() for b, e in zip(words.start[a], words.stop[a + k - 1])], pa.string()),
                         pa.array(np.full(len(a), k)), pa.array(field["n"][own])], ["lang", "phrase", "k", "a"])
    return run


def materialised(rows: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """(lang, phrase, k, a) read at the pointers. ``rows`` has doc, lang and text.

    The pointers into one row, at most ``WIDEST`` for each of its words, travel as one list, so a text is joined once.
    """
    points = marks.groupBy(F.shiftrightunsigned("at", 31).alias("doc")).agg(
        F.collect_list(F.struct(*_POINTER)).alias("points"))
    read = rows.join(points, "doc").select("lang", "text", "points").mapInArrow(
        _read(bits), "lang string, phrase string, k long, a long")
    return read.distinct()


def words_per_language(rows: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences."""
    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(2))
            n = np.zeros(batch.num_rows, np.int64)
            for i, j in doc_chunks(offsets):
                n[i:j] = np.diff(word_spans(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], _IS_WORD)[2])
            sums = pa.table([batch.column(1), pa.array(n)], ["lang", "n"]).group_by("lang").aggregate([("n", "sum")])
            yield from pa.table([sums["lang"], sums["n_sum"]], ["lang", "n"]).to_batches()
    return rows.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, widest: int = WIDEST, bits: int = 64) -> DataFrame:
    """(lang, phrase, k, a): every phrase of 1 to ``widest`` words with ``least`` occurrences in its language.

    ``bits`` shortens the fingerprints (tests use it to make them collide).
    """
    rows = pointed(docs)
    levels, sieve, width, k = [], None, 1, 1
    while k <= widest:
        lengths = [k, k + 1] if k >= 4 and k < widest else [k]  # from four words on, parts of three filter well enough
        found = frequent_marks(rows, lengths, sieve, width, least, bits)
        levels.append(found)
        width, k = k, lengths[-1] + 1
        if k <= widest:
            sieve = sieve_of(found)
    marks = levels[0]
    for level in levels[1:]:
        marks = marks.unionByName(level)
    phrases = materialised(rows, marks.where("not mixed"), bits)
    mixed = [r["mark"] for r in marks.where("mixed").select("mark").collect()]  # some of 2^64: a handful at any size
    if mixed:
        phrases = phrases.unionByName(recounted(rows, mixed, widest, least, bits))
    return settle(phrases)


def pointed(docs: DataFrame) -> DataFrame:
    """(doc, lang, text): the pointer's hash of the row; a null language is ``UNKNOWN``, a null text empty."""
    lang, text = F.coalesce(F.col("lang"), F.lit(UNKNOWN)), F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.shiftrightunsigned(F.xxhash64(text, lang), 31).alias("doc"), lang.alias("lang"), text.alias("text"))


# ------------------------------------------------------------------------------ scores
def _parts(words, low: int, size) -> F.Column:
    """Structs (phrase) of all contiguous parts of ``low`` words or more that are shorter than the whole."""
    return F.flatten(F.transform(F.sequence(F.lit(low), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer one explains.

    The score is floor(1000 * a * n / (l * r)) at the cut where it is least (the first of equal ones), in decimals.
    A phrase goes if a longer frequent phrase that contains it is as frequent.
    """
    words = F.split("phrase", " ")
    size = F.col("k").cast("int")
    wide = phrases.where("k > 1")
    longer = (wide.where("k > 2").select("lang", "a", F.explode(_parts(words, 2, size)).alias("phrase")).distinct())
    kept = wide.join(longer, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"), "k").select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k").cast("int")), " ").alias("right"))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    rows = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    lang_n = totals.select("lang", F.col("n"))
    rows = rows.join(lang_n, "lang").withColumn("score", F.expr(
        "(1000 * cast(a as decimal(18)) * cast(n as decimal(18))) div (cast(l as decimal(18)) * cast(r as decimal(18)))"))
    best = rows.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def top_ranked(rows: DataFrame, k: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """First ``k`` rows of each language by score, frequency and phrase, with their rank.

    Languages are ranked in groups by a hash of the phrase first, whose winners meet in fewer groups, so no task
    sorts a whole language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = -(-rows.count() // group_rows)
    while groups > 1:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank")
        groups = -(-groups * k // max(group_rows, 2 * k))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def collocations(docs: DataFrame, least: int = LEAST, widest: int = WIDEST, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    ``docs`` needs ``lang`` and ``text``; other columns are not read, whatever their names. A null language is
    ``und``, null and empty texts have no words, repeated rows count as often as they stand there, and an empty
    table has no phrases. Ties are settled by frequency, then by the phrase's bytes.
    """
    rows = pointed(docs)
    scores = settle(scored(frequent_phrases(docs, least, widest, bits), words_per_language(rows)))
    return top_ranked(scores, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM
    (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
nn AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM
    (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 6) AS x(k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inside AS (SELECT DISTINCT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM
    (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
kept AS (SELECT * FROM c ANTI JOIN inside USING (lang, phrase, a)),
cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp FROM
    (SELECT *, unnest(range(1, k)) AS j FROM kept)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, fl.a AS l, fr.a AS r, n,
    ((1000::HUGEINT * cuts.a * n) // (fl.a::HUGEINT * fr.a))::BIGINT AS score
    FROM cuts JOIN nn USING (lang) JOIN f AS fl ON fl.lang = cuts.lang AND fl.phrase = lp
    JOIN f AS fr ON fr.lang = cuts.lang AND fr.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""
