"""BPE encoding by speculation and verification, and decoding.

The vocabulary file is read, never trained. For every distinct word:

* speculate: greedy longest match over the vocabulary proposes tokens;
* verify: all adjacent token pairs of all new words are tested at once. A pair
  (a, b) is compatible when no merge across the boundary would have run before
  the merges inside ``a`` and ``b``: walking both merge trees down from the
  latest merge, the rank of the pair of symbols that face each other must never
  come before the merge that consumes one of them. A sequence whose neighbours
  are all compatible is the BPE result;
* merge exactly: only words with a failing pair run the merge loop.

Words repeat, so each worker keeps a bounded table of finished words; a text is
then one pass of splitting and table lookups. Tasks hold one Arrow batch and
the table, keep no state between runs and shuffle nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tabsieve.llm.common import buffer_of, cut_hashes, doc_chunks, fresh, prefix_hashes, span_hashes, table

CACHE_WORDS = 100_000
NEVER = np.int64(1 << 40)
SIEVE = 1 << 18
LONG_WORD = 64
MARK = b"\xff"
#: From here on character classes differ between Unicode versions, so the library's own tables decide.
RARE = "\u0500"

#: Unicode white space; the file's pattern never joins characters across it.
_SPACES = "\t-\r \x85\xa0  -     　"
_PIECES = re.compile(f"[^{_SPACES}]+")
_BEYOND = re.compile(f"[{RARE}-\U0010ffff]")


def _common_pattern(split: str) -> str:
    """The file's split pattern with its Unicode classes written out for the characters below ``RARE``."""
    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(ord(RARE)) if unicodedata.category(chr(c))[0] == kind)
    return (split.replace(r"[\p{N}]", f"[{members('N')}]").replace(r"[\p{L}]", f"[{members('L')}]")
            .replace(r"\p{L}", members("L")).replace(r"\p{N}", members("N")).replace(r"\s", _SPACES))


#: The base alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow at 256.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SYMBOLS = {b: chr(b) for b in _PLAIN} | {
    b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PLAIN))}


class WordBpe:
    """Vocabulary, merge ranks and merge trees of a word-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.common = re.compile(_common_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]))
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        size = max(self.names) + 1
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[(x, y)] = (r, made)
            self.left[made], self.right[made], self.rank[made] = x, y, r
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys = size, keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.as_byte = {c: b for b, c in BYTE_SYMBOLS.items()}
        self.library = Tokenizer.from_file(path)
        self.made = np.array([made for _, made in self.merges.values()], np.int64)
        self.name_bytes = {i: t.encode() for i, t in self.names.items()}
        self.id_bytes = {i: b"%d" % i for i in self.names}
        self.special_printed = {("special", t): b"%d" % i for t, i in self.special.items()}
        self.special_decoded = {("special", t): t.encode() for t in self.special}
        self._prepare_matching()
        if (self.base < 0).any():
            raise ValueError("the vocabulary must hold every byte symbol, plain and closing a word")

    def _prepare_matching(self) -> None:
        """Hashes of all token byte strings; the end-of-word mark is one byte that UTF-8 never has."""
        as_byte = self.as_byte
        raw, ids = [], []
        for name, token in self.vocab.items():
            ends = bool(self.suffix) and name.endswith(self.suffix)
            symbols = name[:-len(self.suffix)] if ends else name
            if symbols and all(c in as_byte for c in symbols) and (self.rank[token] >= 0 or len(symbols) == 1):
                raw.append(bytes(as_byte[c] for c in symbols) + (MARK if ends else b""))
                ids.append(token)
        ends = np.cumsum([len(r) for r in raw])
        starts = ends - np.array([len(r) for r in raw])
        hashes = span_hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
        order = np.argsort(hashes)
        self.token_hashes, self.token_ids = hashes[order], np.array(ids, np.int64)[order]
        self.lengths = sorted({len(r) for r in raw}, reverse=True)
        self.sieves = {}
        for n in self.lengths:
            own = hashes[np.array([len(r) for r in raw]) == n]
            sieve = np.zeros(SIEVE, bool)
            sieve[(own & np.uint64(SIEVE - 1)).astype(np.int64)] = True
            self.sieves[n] = sieve
        self.base = np.full((2, 256), -1, np.int64)
        for b, c in BYTE_SYMBOLS.items():
            self.base[0, b] = self.vocab.get(c, -1)
            self.base[1, b] = self.vocab.get(c + self.suffix, -1)

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: token per match and its word; -1 marks a symbol without a token.

        ``data`` holds the words' bytes, each word closed by the mark when the vocabulary has word ends.
        """
        n = len(data)
        total = prefix_hashes(data)
        closing = np.zeros(n + 1, bool)
        if self.suffix:
            closing[ends - 1] = True
        limit = np.repeat(ends, ends - starts)
        token, span = np.full(n, -1, np.int64), np.ones(n, np.int64)
        open_at = np.arange(n)
        for length in self.lengths:
            at = open_at[open_at + length <= limit[open_at]]
            if not len(at):
                continue
            h = cut_hashes(total, at, at + length)
            near = self.sieves[length][(h & np.uint64(SIEVE - 1)).astype(np.int64)] & ~closing[at + length]
            at, h = at[near], h[near]
            where = np.minimum(np.searchsorted(self.token_hashes, h), len(self.token_hashes) - 1)
            found = self.token_hashes[where] == h
            at = at[found]
            token[at], span[at] = self.token_ids[where[found]], length
            open_at = open_at[token[open_at] < 0]
        tokens, words = [], []
        cursor, word = starts.copy(), np.arange(len(starts))
        while len(word):
            tokens.append(token[cursor])
            words.append(word)
            cursor = cursor + span[cursor]
            on = cursor < ends[word]
            cursor, word = cursor[on], word[on]
        words = np.concatenate(words) if words else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        return (np.concatenate(tokens) if tokens else words)[order], words[order]

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each adjacent token pair survives merging, for all pairs at once."""
        x, y = a.copy(), b.copy()
        eats_x, eats_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            across = self.pair_rank(x[live], y[live])
            bad = (across < eats_x[live]) & (across <= eats_y[live]) & (across < NEVER)
            ok[live[bad]] = False
            live = live[~bad]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            going = (rx >= 0) | (ry >= 0)
            live, rx, ry = live[going], rx[going], ry[going]
            undo_y = ry >= rx
            iy, ix = live[undo_y], live[~undo_y]
            eats_y[iy] = ry[undo_y]
            y[iy] = self.left[y[iy]]
            eats_x[ix] = rx[~undo_y]
            x[ix] = self.right[x[ix]]
        return ok

    def merge_all(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words in step: in each word the lowest rank merges, leftmost on ties."""
        done_ids, done_words = [], []
        rank = np.full(len(symbols), NEVER)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.pair_rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(word)))
            least_here = np.repeat(least, sizes)
            over = least_here == NEVER
            if over.any():
                done_ids.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank, least_here = symbols[~over], word[~over], rank[~over], least_here[~over]
                if not len(symbols):
                    break
            best = np.flatnonzero(rank == least_here)
            best = best[np.concatenate([[True], word[best[1:]] != word[best[:-1]]])]
            symbols[best] = self.made[rank[best]]
            keep = np.ones(len(symbols), bool)
            keep[best + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            at = best - np.arange(len(best))
            for i in (at, at[at > 0] - 1):
                rank[i] = NEVER
                inner = i[i + 1 < len(word)]
                inner = inner[word[inner] == word[inner + 1]]
                rank[inner] = self.pair_rank(symbols[inner], symbols[inner + 1])
        ids = np.concatenate(done_ids) if done_ids else symbols
        words = np.concatenate(done_words) if done_words else word
        order = np.argsort(words, kind="stable")
        return ids[order], words[order]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging of one long word with a heap over a linked list."""
        import heapq
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i] = self.merges[pair][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (ids[a], ids[b]) in self.merges:
                    heapq.heappush(heap, (self.merges[(ids[a], ids[b])][0], a, (ids[a], ids[b])))
        return [t for t, ok in zip(ids, alive) if ok]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words and where each word's ids end: speculate, verify all pairs, merge what fails.

        Symbols outside the vocabulary have no id and are dropped.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tail = MARK if self.suffix else b""
        data = np.frombuffer(tail.join(words) + tail, np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(tail)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        tokens, word = self.propose(data, starts, ends)
        failing = np.zeros(len(words), bool)
        failing[word[tokens < 0]] = True
        inner = np.flatnonzero((word[:-1] == word[1:]) & ~failing[word[:-1]])
        pairs, back = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        failing[word[inner[~self.compatible(pairs // self.size, pairs % self.size)[back]]]] = True
        good = ~failing[word]
        parts = [(tokens[good], word[good])]
        bad = np.flatnonzero(failing)
        if len(bad):
            kind = np.zeros(len(data), np.int64)
            if tail:
                kind[ends - 2] = 1
            symbol = self.base[kind, data]
            if tail:
                symbol[ends - 1] = -1
            owner = np.repeat(np.arange(len(words)), sizes)
            usable = failing[owner] & (symbol >= 0)
            symbol, owner = symbol[usable], owner[usable]
            lengthy = sizes > LONG_WORD
            short = ~lengthy[owner]
            parts.append(self.merge_all(symbol[short], owner[short]))
            for w in bad[lengthy[bad]]:
                ids = self.merge(symbol[np.searchsorted(owner, w):np.searchsorted(owner, w, "right")].tolist())
                parts.append((np.array(ids, np.int64), np.full(len(ids), w)))
        ids = np.concatenate([p[0] for p in parts])
        word = np.concatenate([p[1] for p in parts])
        order = np.argsort(word, kind="stable")
        return ids[order], np.cumsum(np.bincount(word, minlength=len(words)))

    def words(self, text: str) -> list[str | bytes]:
        """Words of a text after NFC and lower case; special tokens in it stay whole (as their id's key)."""
        if "<|" in text and self.special_split.search(text):
            parts = self.special_split.split(text)
            return [w for k, part in enumerate(parts) for w in ([("special", part)] if k % 2 else self.words(part))]
        if text.isascii():
            return self.common.findall(text.lower())
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not _BEYOND.search(low):
            return self.common.findall(low)
        out = []
        for piece in _PIECES.findall(text):
            composed = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()  # may leave the common alphabets
            if _BEYOND.search(piece) or _BEYOND.search(composed):
                out += self.rare(piece)
            else:
                out += self.common.findall(composed)
        return out

    def rare(self, piece: str) -> list[bytes]:
        """Words of a piece with letters beyond the common alphabets, by the library's own character tables."""
        marks = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(map(self.as_byte.__getitem__, word)) for word, _ in marks]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space (the file has no decoder); special tokens stay."""
        return " ".join(self.names[i] for i in ids)


class WordCache:
    """Finished words of a worker: their printed ids and their decoded form, in tables of bounded size."""

    def __init__(self, bpe: WordBpe, limit: int = CACHE_WORDS):
        self.bpe, self.limit = bpe, limit
        self.printed = dict(bpe.special_printed)
        self.decoded = dict(bpe.special_decoded)

    def add(self, words: list[str | bytes]) -> None:
        ids, ends = self.bpe.encode_words([w if isinstance(w, bytes) else w.encode() for w in words])
        ids = ids.tolist()
        printed = list(map(self.bpe.id_bytes.__getitem__, ids))
        decoded = list(map(self.bpe.name_bytes.__getitem__, ids))
        a = 0
        for word, b in zip(words, ends.tolist()):
            self.printed[word] = b" ".join(printed[a:b])
            self.decoded[word] = b" ".join(decoded[a:b])
            a = b

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Per text the ids and the decoded tokens, each joined by spaces."""
        words = list(map(self.bpe.words, texts))
        wanted = set().union(*words)
        missing = [w for w in wanted if w not in self.printed]
        if len(self.printed) + len(missing) > self.limit:
            self.printed = dict(self.bpe.special_printed)
            self.decoded = dict(self.bpe.special_decoded)
            missing = [w for w in wanted if w not in self.printed]
        if missing:
            self.add(missing)
        printed, decoded = self.printed.__getitem__, self.decoded.__getitem__
        return [(b" ".join(map(printed, own)), b" ".join(map(decoded, own))) for own in words]


_caches: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(WordBpe(path))
    return _caches[path]


def encoded(path: str, batch: pa.RecordBatch, text: str):
    """Per text of a batch its encoded pieces; texts are taken together up to a bounded size."""
    column = batch.column(batch.schema.names.index(text))
    _, offsets = buffer_of(column)
    cache = _cache(path)
    for i, j in doc_chunks(offsets):
        yield from cache.encode([v or "" for v in column.slice(i, j - i).to_pylist()])


def _digests(path: str, text: str, columns: list[str]):
    def run(batches):
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            for printed, decoded in encoded(path, batch, text):
                counts.append(printed.count(b" ") + 1 if printed else 0)
                id_sums.append(hashlib.sha256(printed).hexdigest())
                text_sums.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(c)) for c in columns]
                + [pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())],
                [f"c{i}" for i in range(len(columns) + 3)])
    return run


def token_digests(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Per document: n_tokens, ids_sha256 and decoded_sha256. A null text is the empty text (no tokens).

    A kept column with the name of a result column gives way to the result.
    """
    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    keep = [c for c in keep if c.lower() not in made]
    fields = [docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in made.items()]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    rows = docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_digests(path, text, keep), schema)
    return rows.toDF(*[f.name for f in fields])


def _ids(path: str, text: str):
    def run(batches):
        for batch in batches:
            ids = [[int(i) for i in printed.split()] for printed, _ in encoded(path, batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))],
                                             [f"c{i}" for i in range(batch.num_columns + 1)])
    return run


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns and the token ids as an array column (named so that it does not clash)."""
    out = fresh(docs, out)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
                          + [T.StructField(f"c{len(docs.columns)}", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_ids(path, text), schema).toDF(*docs.columns, out)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the decoded text of an id array column; a null array decodes to the empty text."""
    out = fresh(rows, out)

    def run(batches):
        bpe = _cache(path).bpe
        for batch in batches:
            texts = [bpe.decode(v or []) for v in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [f"c{i}" for i in range(batch.num_columns + 1)])
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields)]
                          + [T.StructField(f"c{len(rows.columns)}", T.StringType())])
    return rows.mapInArrow(run, schema).toDF(*rows.columns, out)


def vocabulary() -> str:
    """The public word-level BPE file of the installed tokenizer package."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op2_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary(), ["doc_id"])
