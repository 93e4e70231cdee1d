"""BPE against the tokenizers library on whole tables and on fuzzed texts."""

import hashlib
import random

from tokenizers import Tokenizer

from tabsieve.llm import bpe
from tabsieve.llm.common import table

ODD = ("aàÉéßÑΣσİ ıΑ'sdtvllre1²½५!?<|>\n\t\x1c\x85　́中文日本🎉ABCxyz.,--")


def library():
    return Tokenizer.from_file(bpe.vocabulary())


def expect(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def fuzzed(n=800):
    rng = random.Random(5)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    pick = lambda: rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])
    out += ["".join(chr(pick()) for _ in range(40)) for _ in range(n)]
    marks = "".join(map(chr, range(0x300, 0x345))) + "\u0483\u05b0\u064b\u093c\u0e31\u1100\u1161\u11a8\u200d\ufe0f"
    out += ["".join(rng.choice("eEsScCaAoO uieEnN" + "ẹṡệαгアa'l1") + rng.choice(["", *rng.choices(marks, k=2)])
                    + rng.choice(["", "", *rng.choices(marks, k=1)]) for _ in range(rng.randint(1, 25))) for _ in range(n)]
    out += ["e\u0323", "s\u0307", "Vie\u0323\u0302t", "a e\u0323 b 中 s\u0307", "\u0323", "Vi\u1ec7t e\u0323\u0302"]
    return out + ["", " ", "x" * 5000, "aaab" * 300, "it's we'LL a<|endoftext|>b <|startoftext|><|endoftext|>"]


def test_whole_table(spark):
    t = library()
    docs = table(spark, "/root/testdata/sf0.01", "documents").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in bpe.op2_speculative_bpe(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: expect(t, r.text) for r in docs}


def test_fuzz_edges_and_clashes(spark, make_docs):
    t = library()
    texts = [None, *fuzzed(), "same", "same"]
    docs = make_docs(list(enumerate(texts)), n_tokens="x")
    got = bpe.token_digests(docs, bpe.vocabulary(), docs.columns)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == {
        i: expect(t, x) for i, x in enumerate(texts)}
    assert bpe.token_digests(make_docs([]), bpe.vocabulary(), ["doc_id"]).count() == 0


def test_encode_then_decode(spark, make_docs):
    t = library()
    texts = ["Hello, world's END", None, "", "naïve ΣΑΣ 42"]
    ids = bpe.encode(make_docs(list(enumerate(texts)), ids=1), bpe.vocabulary())
    assert ids.columns[-1] == "_ids"
    for r in bpe.decode(ids, bpe.vocabulary(), ids="_ids").collect():
        own = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r["_ids"] == own and r.decoded == t.decode(own, skip_special_tokens=False)


def test_compatibility_is_exact():
    """The pair test accepts exactly the proposals that merging gives."""
    b = bpe.WordBpe(bpe.vocabulary())
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    ids, ends = b.encode_words([w.encode() for w in words])
    t = library()
    for w, a, z in zip(words, [0, *ends.tolist()], ends.tolist()):
        assert ids[a:z].tolist() == t.encode(w, add_special_tokens=False).ids
    long = "".join(rng.choice("abcdeinorst") for _ in range(500))
    assert b.encode_words([long.encode()])[0].tolist() == t.encode(long, add_special_tokens=False).ids
