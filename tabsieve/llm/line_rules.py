"""Quality rules, lines first, in DataFrame functions only.

Every line is tested for punctuation, symbols, navigation and boilerplate;
failing lines are removed, and a document that loses more than ``LOST_SHARE``
of its words with them is rejected. Base rules on the whole text (too few
words, too many repeated 8-word windows) reject first. All of it is one
projection per row: no shuffle, no Python, and no group that could be hot.

Values that a formula uses more than once are bound with ``let`` (a one-element
``transform``), because the optimizer may otherwise copy the expression into
every place, and into every step of a lambda.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm.common import fresh, table

LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
#: Percent of a document's words that may go with removed lines.
LOST_SHARE = 50
#: A line with fewer words must end in terminal punctuation.
SHORT_LINE = 5
#: Symbols (and separators for navigation) per 100 words that a line may have.
LINE_SYMBOLS = 30
LINE_SEPARATORS = 20
BOILERPLATE_WORDS = 20

SPACE = r"[\x09-\x0D ]+"
SYMBOLS = r"[#*$%&|<>]"
ENDS_WELL = r"[.!?:;…\"”»)][\x09-\x0D ]*$"
BOILERPLATE = (r"(?i)(cookie|javascript|all rights reserved|copyright|terms of (use|service)|privacy policy|lorem ipsum|"
               r"sign (in|up)|log in|click here|subscribe|(released|licensed) under)")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that occur at least twice (windows compared by 64-bit hash).

    Only texts with a repeated window sort (hash, position) pairs; the union of the windows is the sum of the gaps
    between repeated positions, at most ``window`` each.
    """
    hashes = F.when(F.size(words) >= window, F.transform(
        F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    ).otherwise(F.array().cast("array<bigint>"))

    def positions(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twice = F.filter(F.sequence(F.lit(0), last), lambda j: (
            (j > 0) & (pairs[F.greatest(j - 1, F.lit(0))]["h"] == pairs[j]["h"])
            | (j < last) & (pairs[F.least(j + 1, last)]["h"] == pairs[j]["h"])) & (F.size(pairs) > 1))
        # at j = 0 and j = last the clamped neighbour is j itself, which the first part of each test rules out
        return F.array_sort(F.transform(twice, lambda j: pairs[j]["p"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(at)), F.lit(0).cast("bigint"), lambda total, k: total + F.when(
            k < F.size(at), F.least(F.lit(window), at[F.least(k, F.size(at) - 1)] - at[k - 1])).otherwise(window))

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(pairs, positions), covered)).otherwise(
            F.lit(0).cast("bigint"))
    return let(hashes, count)


def line_words(line: Column, has_symbols: Column) -> Column:
    """(words, passes) of a line: symbols, navigation, punctuation and boilerplate rules."""
    def judge(n: Column) -> Column:
        symbols = F.when(has_symbols, F.length(line) - F.length(without(line, SYMBOLS))).otherwise(0)
        bars = F.when(has_symbols, F.length(line) - F.length(without(line, "[|>]"))).otherwise(0)
        fails = ((symbols * 100 > n * LINE_SYMBOLS) | ((bars >= 2) & (bars * 100 >= n * LINE_SEPARATORS))
                 | ((n < SHORT_LINE) & ~line.rlike(ENDS_WELL)) | ((n < BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)))
        return F.struct(n.alias("n"), (~fails).alias("ok"))
    return let(F.size(words_of(line)), judge)


def measures(text: Column) -> Column:
    """All counts of a text in one struct; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column, symbols: Column) -> Column:
        return F.aggregate(F.transform(lines, lambda x: line_words(x, symbols > 0)), F.lit(0).cast("bigint"),
                           lambda total, x: total + F.when(x["ok"], x["n"]).otherwise(0))

    def combine(words: Column, symbols: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.concat_ws("", words)).cast("bigint").alias("word_chars"),
            symbols.cast("bigint").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            of_lines(lines, symbols).alias("clean_words"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x09-\x0D ]"))
    symbols = F.length(text) - F.length(without(text, SYMBOLS))
    return let(words_of(text), lambda w: let(symbols, lambda s: let(lines, lambda x: combine(w, s, x))))


def judge(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, the counts, base_failed and kept per document.

    Null and empty texts have no words and fail the base rules. A kept column that has the name of a result gives
    way to the result.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    keep = [c for c in keep if c.lower() not in made]
    m = fresh(docs, "measures")
    failed = (F.col(f"{m}.n_words") < LEAST_WORDS) | (
        F.col(f"{m}.n_repeat_words") * 100 > F.col(f"{m}.n_words") * MOST_REPEATED)
    lost = F.col(f"{m}.n_words") - F.col(f"{m}.clean_words")
    rows = docs.select(*keep, measures(F.col(text)).alias(m))
    return rows.select(*keep, *[F.col(f"{m}.{c}") for c in made[:5]], failed.alias("base_failed"),
                       (~failed & (lost * 100 <= F.col(f"{m}.n_words") * LOST_SHARE)).alias("kept"))


def clean_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with failing lines removed from the text; a null text becomes empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    has_symbols = value.rlike(SYMBOLS)
    lines = F.filter(F.split(value, "\n"), lambda x: line_words(x, has_symbols)["ok"])
    return docs.withColumn(text, F.array_join(lines, "\n"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"])


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM
    (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
l AS (SELECT r, l FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x09-\x0D ]')),
lw AS (SELECT r, l, len(list_filter(regexp_split_to_array(l, '[\x09-\x0D ]+'), lambda x: x <> '')) AS n,
    length(l) - length(regexp_replace(l, '{SYMBOLS}', '', 'g')) AS s,
    length(l) - length(regexp_replace(l, '[|>]', '', 'g')) AS b FROM l),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS dup,
    sum(CASE WHEN s * 100 > n * {LINE_SYMBOLS} OR (b >= 2 AND b * 100 >= n * {LINE_SEPARATORS})
        OR (n < {SHORT_LINE} AND NOT regexp_matches(l, '{ENDS_WELL}'))
        OR (n < {BOILERPLATE_WORDS} AND regexp_matches(l, '{BOILERPLATE}')) THEN 0 ELSE n END) AS clean
    FROM lw GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(clean, 0) AS clean
    FROM w LEFT JOIN cov USING (r) LEFT JOIN ln USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
        AND (n_words - clean) * 100 <= n_words * {LOST_SHARE} AS kept
FROM m
"""
