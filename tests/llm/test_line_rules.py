"""Line rules against a plain reading in Python; the plan has no Python and no exchange."""

import random
import re

from tabsieve.llm import line_rules as rules
from tabsieve.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_ok(line):
    n = len(WORD.findall(line))
    symbols, bars = len(re.findall(r"[#*$%&|<>]", line)), len(re.findall(r"[|>]", line))
    ends = re.search(r"[.!?:;…\"”»)][\x09-\x0D ]*$", line)
    boiler = re.search(rules.BOILERPLATE, line)
    return not (100 * symbols > 30 * n or bars >= 2 and 100 * bars >= 20 * n or n < 5 and not ends or n < 20 and boiler)


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    repeated = {k for ps in at.values() if len(ps) > 1 for p in ps for k in range(p, p + 8)}
    base = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    clean = sum(len(WORD.findall(x)) for x in lines if line_ok(x))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated), base, not base and 2 * (len(w) - clean) <= len(w))


def rows(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
            for r in df.collect()}


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").collect()
    assert rows(rules.op5_line_rules(spark, "/root/testdata/sf0.01")) == {r.doc_id: brute(r.text) for r in docs}


def test_edges(spark, make_docs):
    rng = random.Random(6)
    pieces = ["a", "bb", "Ü🎉", "x|y", "<p>", "End.", "\n", "\n\n", "\t", "\x0b", "cookie", " ", " "]
    texts = [None, "", " \n\t", "one", "\n".join(["same line here."] * 9), "a b c d e f g h " * 3, "w " * 40000,
             "\x0blead trail\x0c"]
    texts += [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 90))) for _ in range(400)]
    docs = make_docs([*enumerate(texts), (0, None)], n_words="x", KEPT="y")
    got = rules.judge(docs, docs.columns)
    assert got.columns.count("kept") == 1 and "KEPT" not in got.columns
    assert rows(got) == {i: brute(t) for i, t in enumerate(texts)}
    assert rules.judge(make_docs([]), ["doc_id"]).count() == 0
    cleaned = {r.doc_id: r.text for r in rules.clean_text(docs).collect()}
    assert all(cleaned[i] == "\n".join(x for x in (t or "").split("\n") if line_ok(x)) for i, t in enumerate(texts) if i)


def test_plan_is_native(spark):
    plan = rules.op5_line_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
