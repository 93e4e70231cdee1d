"""The grammar against a direct reading of its rules, and held-out accuracy of the learned scores."""

import itertools
import random
import re
import zlib

import numpy as np

from tabsieve.llm import toxicity as tox
from tabsieve.llm.common import table


def direct(classes, weights):
    """Same rules, read off the clause without a state machine."""
    out = [0.0] * 5
    for i, c in enumerate(classes):
        aimed_after = tox.TARGET in classes[i + 1:i + 1 + tox.REACH]
        if c == tox.INSULT or c == tox.THREAT and aimed_after:
            before = classes[max(0, i - 1 - tox.REACH):i]
            if tox.REPORT in classes[:i]:
                kind = 3
            elif tox.NEGATION in before:
                kind = 2
            elif c == tox.THREAT:
                kind = 4
            else:
                kind = 1 if tox.TARGET in before or aimed_after else 0
            out[kind] += weights[i]
    return out


def test_machine_equals_rules():
    rng = random.Random(1)
    for _ in range(3000):
        classes = [rng.choice([0, 0, 0, 2, 3, 4, 5, 6]) for _ in range(rng.randint(0, 12))]
        weights = [rng.random() for _ in classes]
        assert np.allclose(tox.run_clause(classes, weights), direct(classes, weights))


def test_one_path_for_every_clause():
    arcs, start, final = tox.machine()
    for classes in itertools.product([0, 2, 3, 4, 5, 6], repeat=6):
        live = [start]
        for c in classes:
            live = [to for s in live for _, _, to in arcs[s][c]]
            assert len(set(live)) == len(live)
        assert sum(s in final for s in live) == 1
        assert np.allclose(tox.run_clause(list(classes), [1.0] * 6), direct(classes, [1.0] * 6))


def paths(t, symbols):
    """Every accepted (written symbols, weight) of one transducer."""
    live = [((), 1.0, t.start)]
    for c in symbols:
        live = [((*out, m), w * v, to) for out, w, s in live for m, v, to in t.arcs[s].get(c, ())]
    return sorted((out, round(w, 9)) for out, w, s in live if s in t.final)


def test_composition_is_one_transducer_after_the_other():
    rng = random.Random(8)
    weighed = [tox.Transducer(t.start, {s: {c: tuple((m, rng.choice([0.5, 1.0, 3.0]), to) for m, _, to in ws)
                                            for c, ws in ways.items()} for s, ways in t.arcs.items()}, t.final)
               for t in tox.parts()]
    whole = weighed[0]
    for t in weighed[1:]:
        whole = tox.compose(whole, t)
    for _ in range(300):
        clause = [rng.choice([0, 0, 2, 3, 4, 5, 6]) for _ in range(rng.randint(0, 10))]
        stepwise = [(tuple(clause), 1.0)]
        for t in weighed:
            stepwise = [(out, w * v) for read, w in stepwise for out, v in paths(t, read)]
        assert paths(whole, clause) == sorted((out, round(w, 9)) for out, w in stepwise)


def test_long_clauses_equal_rules():
    rng = random.Random(2)
    classes = [rng.choice([0] * 9 + [2, 3, 5, 6]) for _ in range(30_000)]
    weights = [rng.random() for _ in classes]
    assert np.allclose(tox.run_clause(classes, weights), direct(classes, weights))


def plain_scores(docs, labels):
    """The whole operator in plain Python: sample, terms, features and coefficients."""
    token, ends = re.compile(r"[^\W\d_]+|[.!?;:\n]+"), set(".!?;:\n")
    terms = lambda w: ["w" + w, *(f"{k}{w[:k]}" for k in tox.STEMS if len(w) >= k)]
    label = {i: max(y for j, y in labels if j == i) for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    sample = [(token.findall(t.lower()), label[i]) for i, t in docs if i in label]
    bad = sum(y for _, y in sample)
    contexts, have = {}, {}
    for words, y in sample:
        for before, w in zip(["", *words], words):
            for t in terms(w) if y and w[0] not in ends else []:
                contexts.setdefault(t, set()).add(before[:4])
        for t in {t for w in words for t in terms(w)}:
            have.setdefault(t, [0, 0])[y] += 1
    seeds = tox.TERMS[tox.INSULT].split()
    odds = {t: np.log((b + .5) / (bad + 1)) - np.log((g + .5) / (len(sample) - bad + 1)) for t, (g, b) in have.items()
            if t in ["w" + s for s in seeds] or len(contexts.get(t, ())) >= max(tox.LEAST_CONTEXTS, tox.LEAST_SHARE * bad)}
    weight = {"w" + s: 2.0 for s in seeds}
    for t, o in odds.items():
        if o >= tox.LEAST_ODDS["word" if t[0] == "w" else "stem"]:
            weight[t] = min(o, 8.0)
        elif o <= 0:
            weight.pop(t, None)
    fixed = {w: c for c, ws in tox.TERMS.items() if c != tox.INSULT for w in ws.split()}

    def features(text):
        sums = np.zeros(5)
        for clause in re.split(r"[.!?;:\n]+", text.lower()):
            words = token.findall(clause)
            own = [max(weight.get(t, 0.0) for t in terms(w)) for w in words]
            classes = [tox.INSULT if o > 0 else fixed.get(w, 0) for w, o in zip(words, own)]
            sums += direct(classes, [1.0 if c == tox.THREAT else o for c, o in zip(classes, own)])
        return np.array([1, *np.log1p(sums)])
    x, y = np.array([features(t) for i, t in docs if i in label]), np.array([label[i] for i, _ in docs if i in label])
    mean, precision = tox.PRIOR
    beta = mean.copy()
    for _ in range(40_000):  # plain ascent of the posterior
        beta += 0.02 * (x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - precision * (beta - mean))
    return {i: float(1 / (1 + np.exp(-features(t) @ beta))) for i, t in docs}


def test_whole_score_against_plain_python(spark, make_docs):
    rng = random.Random(5)
    common = "the a house you they no never said kill hurt idiot moron river and walks table loud".split()
    docs, labels = [], []
    for i in range(160):
        toxic = int(rng.random() < 0.4)
        words = [rng.choice(common[:5] + common[12:] if not toxic and rng.random() < .7 else common) for _ in range(12)]
        words[rng.randint(0, 11)] = rng.choice(["zorgling", "zorglings"]) if toxic else "garden"
        docs.append((i, " ".join(w + rng.choice(["", "", "", ".", ";", "\n"]) for w in words)))
        if i % 5:
            labels.append((i, toxic))
    expected = plain_scores(docs, labels)
    rows = tox.toxicity(make_docs(docs), spark.createDataFrame([(i, 0, y) for i, y in labels],
                                                               "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(docs) and all(abs(r.score - expected[r.doc_id]) < 1e-6 for r in rows)


def test_clauses_and_kinds():
    g = tox.Grammar({"idiot": 1.0}, {"lowei": 2.0})
    kind = lambda t: [k for k, v in zip(tox.KINDS, g.features(t)) if v > 0]
    assert kind("An idiot.") == ["plain"] and kind("You idiot!") == ["aimed"] and kind("the loweitum") == ["plain"]
    assert kind("He said: x. She called him an idiot") == ["reported"]
    assert kind("You are no idiot") == ["negated"] and kind("not here. idiot") == ["plain"]
    assert kind("I will hurt you") == ["threat"] and kind("will hurt") == [] and kind(None) == [] and kind("") == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = tox.op10_pattern_grammar(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad = [p for _, p, y in held if y]
    good = [p for _, p, y in held if not y]
    assert sum(bad) / len(bad) > 0.8 and sum(good) / len(good) < 0.02


def test_edges(spark, make_docs):
    texts = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "idiot"), (5, "word " * 30000)]
    docs = make_docs(texts, score="x", predicted=3, label=1, label_id=2, toxic=0)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {(r.doc_id, r.score, r.predicted) for r in tox.toxicity(docs, empty).collect()}
    assert {i for i, s, p in rows if p} == {3, None} and len({s for i, s, _ in rows if i in (1, 2, 5)}) == 1
    labels = spark.createDataFrame([(1, 0, 0), (3, 0, 1), (3, 0, None), (None, 0, 1), (9, 1, 1)], empty.schema)
    assert tox.toxicity(docs, labels).count() == 6
    kept = tox.keep_civil(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5}
    assert tox.toxicity(make_docs([]), labels).count() == 0


def test_sample_is_bounded_when_ids_repeat(spark, make_docs):
    docs = make_docs([(3, f"text {i}") for i in range(3000)] + [(5, "you idiot"), (9, None)])
    labels = spark.createDataFrame([(3, 0, 0), (5, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    rows = tox.training_sample(docs, labels).collect()
    kept = {i for i in (3, 5, 9) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(rows) == len(kept)
    again = tox.training_sample(docs.orderBy("text", ascending=False), labels).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_counts_weigh_as_rows():
    rng = np.random.default_rng(4)
    x, y, n = rng.random((6, len(tox.KINDS))), np.array([0, 1, 0, 1, 1, 0.0]), np.array([3, 1, 7, 2, 5, 4])
    assert np.allclose(tox.fit_logistic(x, y, n), tox.fit_logistic(np.repeat(x, n, 0), np.repeat(y, n), np.ones(n.sum())))
