"""Licence notices by a positional index of rare words.

Templates are short notices (and, for the base labels, bare phrases). Weights
come from the corpus: one narrow pass counts, for the few hundred words that
templates use, the documents that hold them, and a word weighs the more the
fewer they are (inverse document frequency). Each template is indexed under the
heaviest words of its mandatory key phrases, as (word -> template, position).

A scan looks up every place of an indexed word in a text; a posting gives the
template and the place where the notice would begin. Places given by all
indexed words of a template survive the intersection; there the mandatory
phrases are compared word by word, and the rest of the notice gives the weighted
share of its words that stand where they should. No place is lost: a notice
whose mandatory phrases are all there holds all its indexed words.

Both passes are narrow; what the driver sees is one row per template word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm.common import buffer_of, class_table, doc_chunks, fresh, release, table, word_spans
from tabsieve.llm.line_rules import let

#: A notice counts if this percentage of its weight stands in place (its mandatory phrases must stand whole).
LEAST_SHARE = 60
#: Mandatory words that index a template.
INDEXED = 3

# Phrases of the base labels.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Public licence notices; mandatory key phrases stand in brackets.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files [the software to deal in the software without restriction]"),
    ("apache-2", "licensed under the [apache license version 2 0] the license you may not use this file except in "
                 "compliance with the license"),
    ("apache-2", "licensed under the [apache license version 2]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided "
            "that the following conditions are met"),
    ("isc", "permission to use copy modify and or [distribute this software for any purpose with or without fee] is "
            "hereby granted"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the [gnu general "
              "public license] as published by the free software foundation either [version 2 of the license] or at "
              "your option any later version"),
    ("gpl-2", "[licensed under the gnu general public license version 2]"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the [gnu general "
              "public license] as published by the free software foundation either [version 3 of the license] or at "
              "your option any later version"),
    ("gpl-3", "this work is licensed under the [gnu general public license version 3]"),
    ("lgpl", "licensed under the [gnu lesser general public license]"),
    ("agpl-3", "licensed under the [gnu affero general public license] version 3"),
    ("mpl-2", "this source code form is subject to the terms of the [mozilla public license] v 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the [eclipse public "
              "license] 2 0"),
    ("unlicense", "this is free and unencumbered [software released into the public domain]"),
    ("cc0", "to the extent possible under law the author has [waived all copyright and related or neighboring rights] "
            "to this work"),
    ("cc-by", "this work is licensed under a [creative commons attribution 4 0] international license"),
    ("cc-by", "[licensed under cc by 4 0]"),
    ("cc-by-sa", "this work is licensed under a [creative commons attribution sharealike] 4 0 international license"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc-by-nc", "this work is licensed under a [creative commons attribution noncommercial] 4 0 international license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the [authors be "
             "held liable for any damages arising from the use of this software]"),
    ("boost-1", "distributed under the [boost software license version 1 0]"),
    ("artistic-2", "under the terms of the [artistic license 2 0]"),
]

_IS_WORD = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()),
                      T.StructField("start", T.LongType()), T.StructField("words", T.LongType()),
                      T.StructField("share", T.DoubleType())])


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    mandatory: tuple[int, ...]
    base: bool


def parse_notice(label: str, notice: str) -> Template:
    words, must, inside = [], [], False
    for token in notice.split():
        inside |= token.startswith("[")
        if inside:
            must.append(len(words))
        words.append(token.strip("[]"))
        inside &= not token.endswith("]")
    return Template(label, tuple(words), tuple(must), False)


def parse_phrase(label: str, phrase: str) -> Template:
    words = tuple(phrase.split())
    return Template(label, words, tuple(range(len(words))), True)


TEMPLATES = [*(parse_phrase(*x) for x in BASE_PHRASES), *(parse_notice(*x) for x in NOTICES)]


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def text_ids(data: np.ndarray, offsets: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index in ``words`` of every word of the texts (-1 for others), and each text's first word."""
    low = _FOLD[data]
    starts, ends, first = word_spans(low, offsets, _IS_WORD)
    where = np.append(0, np.cumsum(ends - starts))
    body = np.ascontiguousarray(low[_IS_WORD[low]])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(body)])
    coded = found.dictionary_encode()
    place = pc.fill_null(pc.index_in(coded.dictionary, value_set=words.cast(pa.large_binary())), -1)
    place = place.to_numpy(zero_copy_only=False).astype(np.int64)
    return place[coded.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.int64), first


# ------------------------------------------------------------------------------ weights
def document_counts(docs: DataFrame, words: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """(documents, documents that hold each word), over all rows; one row per word comes back."""
    def run(batches):
        known, total, rows = pa.array(words), np.zeros(len(words), np.int64), 0
        for batch in batches:
            data, offsets = buffer_of(batch.column(0))
            rows += batch.num_rows
            for i, j in doc_chunks(offsets):
                ids, first = text_ids(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], known)
                own = np.repeat(np.arange(j - i), np.diff(first))
                hit = ids >= 0
                pairs = np.unique(own[hit] * len(words) + ids[hit])
                total += np.bincount(pairs % len(words), minlength=len(words))
            release()
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(words))]), pa.array([rows, *total.tolist()])],
                                         ["word", "n"])
    sums = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"]: r["n"] for r in sums.collect()}  # one row per template word
    return got.get(-1, 0), {w: got.get(k, 0) for k, w in enumerate(words)}


def weights(n_docs: int, counts: dict[str, int]) -> dict[str, int]:
    """Thousandths of 1 + ln((1 + documents) / (1 + documents with the word)), at least 1000."""
    return {w: int(np.floor(1000 * (1 + np.log((1 + n_docs) / (1 + c))))) for w, c in counts.items()}


# ------------------------------------------------------------------------------ index and scan
class Index:
    """Postings of the heaviest mandatory words, and the templates as arrays of word indexes."""

    def __init__(self, templates: list[Template], weight: dict[str, int], indexed: int = INDEXED):
        self.templates = templates
        self.words = pa.array(vocabulary(templates))
        number = {w: k for k, w in enumerate(self.words.to_pylist())}
        self.ids = [np.array([number[w] for w in t.words]) for t in templates]
        self.must = [np.array(t.mandatory) for t in templates]
        self.weight = [np.array([weight[w] for w in t.words]) for t in templates]
        postings: list[list[tuple[int, int]]] = [[] for _ in number]
        self.needed = np.zeros(len(templates), np.int64)
        for k, t in enumerate(templates):
            rare = sorted(t.mandatory, key=lambda p: (-weight[t.words[p]], p))[:indexed]
            self.needed[k] = len(rare)
            for p in rare:
                postings[number[t.words[p]]].append((k, p))
        self.count = np.array([len(x) for x in postings])
        self.from_ = np.cumsum(self.count) - self.count
        self.of = np.array([k for x in postings for k, _ in x], np.int64)
        self.at = np.array([p for x in postings for _, p in x], np.int64)
        self.longest = max(len(t.words) for t in templates)

    def matches(self, ids: np.ndarray, first: np.ndarray):
        """(text, template, start in the text's words, share in place) of every notice, by text, start and template."""
        place = np.flatnonzero(ids >= 0)
        place = place[self.count[ids[place]] > 0]
        n = self.count[ids[place]]
        row = np.repeat(np.arange(len(place)), n)
        posting = self.from_[ids[place]][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        text = np.searchsorted(first, place, "right") - 1
        start = place[row] - self.at[posting] - first[text[row]]  # may be negative: the notice is cut off
        spread = int(np.diff(first).max(initial=0)) + self.longest + 1
        key = (text[row] * len(self.templates) + self.of[posting]) * spread + start + self.longest
        key, count = np.unique(key, return_counts=True)
        at, kind = key % spread - self.longest, key // spread % len(self.templates)
        own = key // spread // len(self.templates)
        both = count == self.needed[kind]
        found = []
        for k in np.unique(kind[both]):
            mine = both & (kind == k)
            begin, texts = at[mine], own[mine]
            places = begin[:, None] + np.arange(len(self.ids[k]))
            inside = (places >= 0) & (places < np.diff(first)[texts][:, None])
            places = np.clip(places + first[texts][:, None], 0, len(ids) - 1)
            equal = inside & (ids[places] == self.ids[k])
            share = equal @ self.weight[k]
            whole = equal[:, self.must[k]].all(1) & (100 * share >= LEAST_SHARE * self.weight[k].sum())
            found.append(np.stack([texts[whole], np.full(whole.sum(), k), begin[whole], share[whole]]))
        rows = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
        return rows[:, np.lexsort((rows[1], rows[2], rows[0]))]


def _scan(held, keep: list[str], text: str):
    def run(batches):
        index = held.value
        labels = np.array([t.label for t in index.templates], object)
        base = np.array([t.base for t in index.templates])
        words = np.array([len(t.words) for t in index.templates])
        total = np.array([w.sum() for w in index.weight])
        for batch in batches:
            names = batch.schema.names
            data, offsets = buffer_of(batch.column(names.index(text)))
            for i, j in doc_chunks(offsets):
                ids, first = text_ids(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], index.words)
                own, kind, start, share = index.matches(ids, first)
                spans = pa.StructArray.from_arrays(
                    [pa.array(labels[kind], pa.string()), pa.array(base[kind]), pa.array(start), pa.array(words[kind]),
                     pa.array(np.round(share / total[kind], 6))], MATCH.names)
                per_text = np.append(0, np.cumsum(np.bincount(own, minlength=j - i))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index(c)).slice(i, j - i) for c in keep]
                    + [pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(per_text), spans)],
                    [f"c{k}" for k in range(len(keep) + 2)])
            release()
    return run


def licence_notices(docs: DataFrame, keep: list[str] | None = None, text: str = "text",
                    templates: list[Template] = TEMPLATES) -> DataFrame:
    """Columns ``keep`` (all by default) with n_words and notices (label, base, start, words, share) per document.

    ``start`` is the word where the notice begins; it is negative where a text begins inside one. A base phrase
    has to stand whole. Null and empty texts have no words and no notice; an empty table gives an empty result.
    A kept column that has the name of a result gives way to the result. Repeated rows give repeated results.
    """
    made = ["n_words", "notices"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    n, counts = document_counts(docs, vocabulary(templates), text)
    held = docs.sparkSession.sparkContext.broadcast(Index(templates, weights(n, counts)))
    types = [docs.schema[c].dataType for c in keep] + [T.LongType(), T.ArrayType(MATCH)]
    schema = T.StructType([T.StructField(f"c{k}", t) for k, t in enumerate(types)])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_scan(held, keep, text), schema).toDF(*keep, *made)


# ------------------------------------------------------------------------------ query
def label_columns(found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the contract's columns of a ``licence_notices`` result."""
    def joined(rows):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")

    b, out = fresh(found, "base_notices"), []
    rows = found.select(*keep, "n_words", "notices", F.filter("notices", lambda x: x["base"]).alias(b))
    out += [F.size(b).cast("long").alias("n_base"),
            F.array_min(F.transform(b, lambda x: x["start"])).alias("first_word"),
            F.array_max(F.transform(b, lambda x: x["start"])).alias("last_word"),
            joined(F.col(b)).alias("base_labels"), joined(F.col("notices")).alias("labels"),
            let(F.array_max(F.transform("notices", lambda x: x["share"])), lambda s: F.coalesce(s, F.lit(0.0))).alias("score")]
    return rows.select(*keep, "n_words", *out)


def op12_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return label_columns(licence_notices(docs, ["doc_id"]), ["doc_id"])


def oracle(templates: list[Template] = TEMPLATES) -> str:
    """Every alignment of every template by a join on words; no index."""
    words = ",\n    ".join(
        f"({k}, '{t.label}', {str(t.base).lower()}, {p}, '{w}', {str(p in t.mandatory).lower()})"
        for k, t in enumerate(templates) for p, w in enumerate(t.words))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH tw(t, label, base, p, w, must) AS (VALUES
    {words}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
    FROM documents),
v AS (SELECT DISTINCT w FROM tw),
dw AS (SELECT r, i, w FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d) SEMI JOIN v USING (w)),
df AS (SELECT v.w, count(DISTINCT r) AS c FROM v LEFT JOIN dw USING (w) GROUP BY v.w),
wt AS (SELECT w, floor(1000 * (1 + ln((1 + (SELECT count(*) FROM d)) / (1 + c))))::BIGINT AS wt FROM df),
tt AS (SELECT t, label, base, sum(wt) AS total, count(*) FILTER (must) AS musts FROM tw JOIN wt USING (w) GROUP BY ALL),
a AS (SELECT r, t, i - p AS s, sum(wt) AS got, count(*) FILTER (must) AS n FROM dw JOIN tw USING (w) JOIN wt USING (w)
    GROUP BY ALL),
m AS (SELECT r, label, base, s, got / total AS share FROM a JOIN tt USING (t)
    WHERE n = musts AND 100 * got >= {LEAST_SHARE} * total),
s AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(round(share, 6)) AS score FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
    last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (r)
"""


OP12_SQL = oracle()
