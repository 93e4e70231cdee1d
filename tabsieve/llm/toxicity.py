"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: insult (weighted), threat, target, negation, report,
clause end or other. Five small weighted transducers read a clause one after
the other, each reading what the one before wrote:

* insult: an insult term is written as a plain match;
* threat: a threat verb is written as a threat if a target follows within ``REACH`` words, else as other;
* target: a plain match near a target (``REACH`` words after, one more before) becomes aimed;
* negation: a match with a negation just before becomes negated;
* report: a match after a reporting verb of the clause becomes reported.

What follows a word is guessed: the threat and target transducers branch and
remember which guess is due, and a branch dies when its guess fails, so of all
paths of a clause exactly one is accepted. ``compose`` builds the product of
two transducers (weights multiply) and drops states that cannot be accepted;
the five become one machine by four compositions. Every clause that holds a
match is run through it and yields weights per kind of match; a document's
score is a logistic function of the five sums. Insult weights and the logistic
coefficients are learned from labelled rows outside the held-out fold:
word and word-stem log-odds, counted over distinct contexts so that copies of
one text do not look like evidence.

The fit reads a sample of about ``FIT_ROWS`` labelled rows (a documented
bound, chosen by a hash of the id); scoring is one scan of all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import Callable, Hashable, Iterable, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm.common import forget, fresh, settle, table

FIT_ROWS = 20_000
THRESHOLD = 0.3
REACH = 3
STEMS = (4, 5, 6)
#: A learned term needs this many distinct contexts in toxic rows, or this share of the toxic rows if that is more.
LEAST_CONTEXTS = 3
LEAST_SHARE = 0.003
LEAST_ODDS = {"word": 3.0, "stem": 3.5}
CACHE_WORDS = 100_000
KINDS = ("plain", "aimed", "negated", "reported", "threat")

OTHER, END, TARGET, NEGATION, REPORT, THREAT, INSULT = range(7)
PLAIN, AIMED, NEGATED, REPORTED, THREATENED = MATCHES = range(7, 7 + len(KINDS))

#: Starting vocabulary of each class; insult weights are refitted from the labels.
TERMS = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers clown clowns pathetic worthless disgusting "
            "imbecile filth vermin bastard bitch asshole jerk creep freak cretin dumbass retard "
            "dumm dummkopf abschaum arschloch versager idiota imbécil estúpido basura connard crétin débile ordure",
    THREAT: "kill hurt destroy beat attack shoot stab burn punish smash crush "
            "töten schlagen umbringen matar golpear tuer frapper",
    TARGET: "you your yours yourself u ur he she they them him her his their this these those people everyone "
            "du dich dir euch ihr sie tú te vosotros ustedes usted tu toi vous",
    NEGATION: "not no never nor neither cannot isn aren wasn don doesn didn won nicht kein keine nie jamás nunca "
              "ne pas jamais",
    REPORT: "said says say called calls wrote writes quoted quotes claimed claims reported accused alleged "
            "sagte nannte schrieb dijo llamó escribió dit appelé écrit",
}
_TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]+")
#: Prior of the logistic fit: (mean, precision) of the intercept and of the five sums.
PRIOR = np.array([-3.0, 2.5, 3.0, 0.5, 1.0, 3.0]), np.array([0.05, 0.5, 0.5, 0.5, 0.5, 0.5])


# ------------------------------------------------------------------ weighted transducers
class Transducer(NamedTuple):
    """``arcs[state][symbol read]`` holds (symbol written, weight, next state) for every way to go on."""
    start: Hashable
    arcs: dict
    final: frozenset


def transducer(start: Hashable, step: Callable, reads: Iterable[int], final: Callable = lambda s: True) -> Transducer:
    """All states that ``step(state, symbol)`` reaches from ``start``, without those that reach no final state."""
    arcs, todo = {}, [start]
    while todo:
        state = todo.pop()
        if state not in arcs:
            arcs[state] = {c: tuple(step(state, c)) for c in reads}
            todo += [after for ways in arcs[state].values() for _, _, after in ways]
    before: dict = {}
    for state, ways in arcs.items():
        for _, _, after in (w for ws in ways.values() for w in ws):
            before.setdefault(after, []).append(state)
    todo = [s for s in arcs if final(s)]
    ends, alive = frozenset(todo), set(todo)
    while todo:
        for state in before.get(todo.pop(), ()):
            if state not in alive:
                alive.add(state)
                todo.append(state)
    kept = {s: {c: tuple(w for w in ws if w[2] in alive) for c, ws in ways.items()}
            for s, ways in arcs.items() if s in alive}
    return Transducer(start, kept, ends)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What ``b`` writes when it reads what ``a`` writes; the weights of the two arcs are multiplied."""
    def step(state, c):
        for middle, w, p in a.arcs[state[0]].get(c, ()):
            for written, v, q in b.arcs[state[1]].get(middle, ()):
                yield written, w * v, (p, q)
    return transducer((a.start, b.start), step, list(a.arcs[a.start]), lambda s: s[0] in a.final and s[1] in b.final)


def _wait(due: int, barred: int, target: bool):
    """Guesses after one more word: words in which a target is due, words in which it is barred (0: none);
    None if a guess failed."""
    if target:
        return None if barred else (0, 0)
    return None if due == 1 else (max(due - 1, 0), max(barred - 1, 0))


def _insult(state, c):
    yield PLAIN if c == INSULT else c, 1.0, state


def _threat(state, c):
    wait = _wait(*state, c == TARGET)
    if wait and c == THREAT:
        yield THREATENED, 1.0, (wait[0] or REACH, wait[1])
        yield OTHER, 1.0, (wait[0], REACH)
    elif wait:
        yield c, 1.0, wait


def _target(state, c):
    since, wait = state[0], _wait(*state[1:], c == TARGET)
    now = 0 if c == TARGET else min(since + 1, REACH + 1)
    if wait and c == PLAIN and since > REACH:
        yield AIMED, 1.0, (now, wait[0] or REACH, wait[1])
        yield PLAIN, 1.0, (now, wait[0], REACH)
    elif wait:
        yield AIMED if c == PLAIN else c, 1.0, (now, *wait)


def _negation(since, c):
    yield NEGATED if c in MATCHES and since <= REACH else c, 1.0, 0 if c == NEGATION else min(since + 1, REACH + 1)


def _report(reported, c):
    yield REPORTED if c in MATCHES and reported else c, 1.0, reported or c == REPORT


def parts() -> list[Transducer]:
    """The five transducers in the order in which they read."""
    words = [OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT]
    found = words + list(MATCHES)
    settled = lambda s: s[-2] == 0  # noqa: E731  no target is due
    return [transducer(0, _insult, words), transducer((0, 0), _threat, found, settled),
            transducer((REACH + 1, 0, 0), _target, found, settled),
            transducer(REACH + 1, _negation, found), transducer(False, _report, found)]


@lru_cache(1)
def machine() -> tuple[list[list[tuple]], int, frozenset]:
    """The composition of the five with numbered states: (arcs by state and class, start, final states); an arc is
    (kind of match or -1, weight, next state)."""
    whole, *others = parts()
    for other in others:
        whole = compose(whole, other)
    number = {s: i for i, s in enumerate(whole.arcs)}
    arcs = [[tuple((m - PLAIN if m in MATCHES else -1, w, number[after]) for m, w, after in ways.get(c, ()))
             for c in range(len(TERMS) + 2)] for ways in whole.arcs.values()]
    return arcs, number[whole.start], frozenset(number[s] for s in whole.final)


def matches(classes: Iterable[int]) -> list[tuple[int, int, float]]:
    """(place, kind, weight) of every match on the one accepted path of a clause."""
    arcs, start, final = machine()
    live = {start: None}  # one open path a state, as a chain of its matches
    for i, c in enumerate(classes):
        after = {}
        for state, path in live.items():
            for kind, weight, to in arcs[state][c]:
                after[to] = path if kind < 0 else (path, i, kind, weight)
        live = after
    path = next(p for s, p in live.items() if s in final)
    found = []
    while path:
        path, *match = path
        found.append(tuple(match))
    return found[::-1]


_short = lru_cache(20_000)(matches)
SHORT = 48


def run_clause(classes: list[int], weights: list[float]) -> list[float]:
    """Weight per kind of match in one clause: the weight of the path's arc times that of the term."""
    out = [0.0] * len(KINDS)
    for i, kind, weight in _short(tuple(classes)) if len(classes) <= SHORT else matches(classes):
        out[kind] += weight * weights[i]
    return out


class Grammar:
    """Word classes and weights; words are looked up once and remembered in a bounded table."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.fixed = {w: c for c, ws in TERMS.items() if c != INSULT for w in ws.split()}
        self.known: dict[str, tuple[int, float]] = {}

    def classify(self, word: str) -> tuple[int, float]:
        if word[0] in ".!?;:\n":
            return END, 0.0
        weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k)])
        if weight > 0:
            return INSULT, weight
        c = self.fixed.get(word, OTHER)
        return c, 1.0 if c == THREAT else 0.0

    def features(self, text: str | None) -> np.ndarray:
        """log(1 + weight) per kind over all clauses of the text; zeros for null and empty texts."""
        tokens = _TOKENS.findall((text or "").lower())
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for w in set(tokens).difference(self.known):
            self.known[w] = self.classify(w)
        found = list(map(self.known.__getitem__, tokens))
        hits = [i for i, (c, _) in enumerate(found) if c >= THREAT]
        total, done = np.zeros(len(KINDS)), -1
        for i in hits:
            if i <= done:
                continue
            a = i
            while a > 0 and found[a - 1][0] != END:
                a -= 1
            done = i
            while done + 1 < len(found) and found[done + 1][0] != END:
                done += 1
            clause = found[a:done + 1]
            total += run_clause([c for c, _ in clause], [w for _, w in clause])
        return np.log1p(total)


# ------------------------------------------------------------------ learning
def held_out(key):
    """Fold of an id: crc32 of its text form, modulo 4, is 2. A row without an id is in no fold."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of about ``fit_rows`` labelled ids outside the held-out fold, chosen by a hash of the id.

    An id that several rows have gives one text, the one of least digest, so the sample's rows are bounded as well.
    """
    known = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = chosen.select(F.col("doc_id").alias("label_id"), "label")
    texts = docs.select("doc_id", "text")
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # fit_rows rows of 12 bytes
    text = F.coalesce("text", F.lit(""))
    one = joined.groupBy("label_id", "label").agg(F.min(F.struct(F.xxhash64(text).alias("digest"), text.alias("text"))).alias("least"))
    return settle(one.select("least.text", (F.col("label") > 0).cast("int").alias("toxic")))


def _terms(word: str):
    yield "w" + word
    for k in STEMS:
        if len(word) >= k:
            yield f"{k}" + word[:k]


def _contexts(batches):
    for batch in batches:
        rows = Counter()
        for text in batch.column(0).to_pylist():
            words, before = _TOKENS.findall(text.lower()), ""
            for w in words:
                if w[0] not in ".!?;:\n":
                    for term in _terms(w):
                        rows[(term, before[:4])] += 0
                before = w
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()),
                                          pa.array([c for _, c in rows], pa.string())], ["term", "context"])


def _presence(held):
    def run(batches):
        wanted = held.value
        for batch in batches:
            count: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {t for w in set(_TOKENS.findall(text.lower())) for t in _terms(w)} & wanted
                count.update((t, toxic) for t in own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in count], pa.string()), pa.array([y for _, y in count], pa.int32()),
                 pa.array(list(count.values()), pa.int64())], ["term", "toxic", "n"])
    return run


def learn_terms(sample: DataFrame) -> Grammar:
    """Insult words and stems with their smoothed log-odds; vocabulary on the driver is bounded by the sample."""
    spark = sample.sparkSession
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    spread = (sample.where("toxic = 1").mapInArrow(_contexts, "term string, context string").distinct()
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(LEAST_CONTEXTS, LEAST_SHARE * bad)))
    seeds = {"w" + w for w in TERMS[INSULT].split()}
    wanted = seeds | {r["term"] for r in spread.select("term").collect()}
    held = spark.sparkContext.broadcast(frozenset(wanted))
    rows = (sample.mapInArrow(_presence(held), "term string, toxic int, n long")
            .groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
                                 F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")).collect())
    odds = {r["term"]: float(np.log((r["bad"] + 0.5) / (bad + 1)) - np.log((r["good"] + 0.5) / (good + 1))) for r in rows}
    words = {w: 2.0 for w in TERMS[INSULT].split()}
    words |= {t[1:]: min(o, 8.0) for t, o in odds.items() if t[0] == "w" and (o >= LEAST_ODDS["word"])}
    for w in TERMS[INSULT].split():
        if odds.get("w" + w, 1.0) <= 0:  # the labels say that this word is harmless here
            del words[w]
    stems = {t[1:]: min(o, 8.0) for t, o in odds.items() if t[0] != "w" and o >= LEAST_ODDS["stem"]}
    return Grammar(words, stems)


def fit_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Maximum a posteriori weights under ``PRIOR`` by Newton steps, a row counting ``times`` times; the prior alone
    without rows."""
    mean, precision = PRIOR
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = mean.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (times * (y - p)) - precision * (beta - mean)
        hess = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(precision)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Grammar, np.ndarray]:
    sample = training_sample(docs, labels, fit_rows)
    grammar = learn_terms(sample)
    held = sample.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        for batch in batches:
            x = np.array([held.value.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, x.T)], ["toxic", *KINDS])
    schema = "toxic int, " + ", ".join(f"{k} double" for k in KINDS)
    rows = sample.mapInArrow(run, schema).groupBy("toxic", *KINDS).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(rows, key=lambda r: tuple(r))
    x = np.array([[r[k] for k in KINDS] for r in rows]).reshape(-1, len(KINDS))
    y, times = (np.array([r[c] for r in rows], float) for c in ("toxic", "n"))
    forget(sample)
    return grammar, fit_logistic(x, y, times)


# ------------------------------------------------------------------ scoring
def score(docs: DataFrame, model: tuple[Grammar, np.ndarray], keep: list[str], text: str = "text",
          out: str = "score") -> DataFrame:
    """Columns ``keep`` and the score in 0..1. Null and empty texts get the score of a text without matches."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            grammar, beta = held.value
            x = np.array([grammar.features(t.as_py()) for t in batch.column(batch.schema.names.index(text))])
            p = 1 / (1 + np.exp(-(beta[0] + x.reshape(-1, len(KINDS)) @ beta[1:])))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep),
                                              pa.array(np.round(p, 9))], [f"c{i}" for i in range(len(keep) + 1)])
    fields = [docs.schema[c].dataType for c in keep] + [T.DoubleType()]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(fields)])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema).toDF(*keep, out)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; a repeated row is scored again."""
    rows = score(docs, fit(docs, labels, fit_rows), ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the grammar does not reject, with their own columns."""
    name = fresh(docs, "score")
    scored = score(docs, fit(docs, labels), docs.columns, out=name)
    return scored.where(F.col(name) < THRESHOLD).select(*docs.columns)
