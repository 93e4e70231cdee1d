"""The pipeline, stage by stage, against brute force on what the stage was given."""

import corpus_pipeline as cp
from tabsieve.llm import bpe
from tabsieve.llm.common import prepare, settle, table
from tests.llm import test_bpe, test_simhash, test_suffix, test_winnow


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    schema, given, kept = docs.schema, docs, {}
    for name, stage in cp.STAGES[:-1]:
        out = settle(stage(spark, given, sf))
        assert out.columns == schema.names and [f.dataType for f in out.schema] == [f.dataType for f in schema]
        kept[name] = {r.doc_id: r for r in out.collect()}
        rows = {r.doc_id: r for r in given.collect()}
        texts = sorted((i, r.text) for i, r in rows.items())
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
            gone = [labels.get(i) for i in rows if i not in kept[name]]
            clean = [i for i, y in labels.items() if y == 0]
            assert gone.count(1) > 0.6 * list(labels.values()).count(1)
            assert sum(i in kept[name] for i in clean) > 0.98 * len(clean)
        elif name == "simhash_near_dedup":
            assert set(kept[name]) == {c for _, c in test_simhash.brute(texts).values()}
        elif name == "suffix_array_dedup":
            for (i, t), (n, gone, _, _) in zip(texts, test_suffix.brute(texts)):
                new = kept[name][i]
                assert len(new.text.encode()) <= n - gone and (gone or new.text == t)
                assert len(new.text.encode()) >= n - gone - 8 and new.n_chars == len(new.text)
        else:
            items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
            assert set(kept[name]) == {i for i, v in test_winnow.brute(texts, items).items() if not v[4]}
        given = out
    final = cp.STAGES[-1][1](spark, given, sf).collect()
    t = test_bpe.library()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in final} == {
        i: test_bpe.expect(t, r.text) for i, r in kept["benchmark_decontamination"].items()}
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, final))


def test_stages_take_any_rows(spark, make_docs):
    prepare(spark)
    sf = "/root/testdata/sf0.001"
    rows = [(None, None), (1, ""), (2, "you idiot scum"), (3, "plain words here"), (3, "plain words here"),
            (4, "w " * 20000)]
    docs = make_docs(rows, spans=1, score="x", component_id=2)
    for _, stage in cp.STAGES[:-1]:
        docs = settle(stage(spark, docs, sf))
        assert docs.columns[-3:] == ["spans", "score", "component_id"]
    assert {r.doc_id for r in docs.collect()} <= {None, 1, 3, 4}
    empty = make_docs([])
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0
    assert bpe.token_digests(empty, bpe.vocabulary(), ["doc_id"]).columns[0] == "doc_id"
