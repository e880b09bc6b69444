import corpus_pipeline as P
from locusgrid.llm import packing, pii, positional, simhash, toxicity
from locusgrid.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, docs.count()
    toxic = {x.doc_id for x in toxicity.score(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    for name, stage in P.STAGES:
        before = docs
        docs = P.stored(stage(spark, docs, SF), "test-stage")
        ids = {x.doc_id for x in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == {x.doc_id for x in before.select("doc_id").collect()} - toxic
        if name == "simhash_near_dedup":
            assert ids == {x.doc_id for x in simhash.near_duplicates(before).filter("doc_id = component_id").collect()}
        if name == "benchmark_decontamination":
            judged = positional.decontaminate(before, table(spark, SF, "benchmark"))
            assert ids == {x.doc_id for x in judged.filter("not contaminated").collect()}
        if name == "pii":
            assert pii.find(docs).agg({"n_email": "sum"}).first()[0] == 0
            assert docs.filter("text like '%[EMAIL]%'").count() > 0
            assert docs.filter("n_chars != length(text)").count() == 0
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert 0 < len(ids) < rows
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0
    assert ids == {x.doc_id for x in before.select("doc_id").collect()}


def test_run_returns_the_last_stage(spark):
    got = P.run(spark, SF)
    assert got.columns == packing.pack(table(spark, SF, "documents"), P.tokenizer("word_bpe_49k.json")).columns
    assert [n for n, _ in P.STAGES][0] == "toxicity" and got.count() > 0
