"""The stages on planted cases."""

import pytest

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*C.COLUMNS)
    texts = {r.doc_id: r for r in real.filter("doc_id IN (0, 2, 4)").collect()}
    words = texts[2].text.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    rows = [(5000, texts[0].text, "fr", "s", 1), (5001, near, "en", "s", 1), (5002, None, "en", "s", 0), (5003, "12 34", None, "s", 5), (5004, texts[4].text + " mail me at some.body@example.org", None, None, None)]
    return real.union(spark.createDataFrame(rows, SCHEMA))


def test_stages(spark, docs):
    steps = dict(C.STAGES)
    told = steps["language"](spark, docs, "")
    assert told.columns == list(C.COLUMNS)
    assert {r.doc_id for r in docs.select("doc_id").exceptAll(told.select("doc_id")).collect()} == {5002, 5003}
    once = steps["near-duplicates"](spark, told, "")
    left = {r.doc_id for r in once.select("doc_id").collect()}
    assert not left & {5000, 5001} and {2, 4} <= left and once.columns == list(C.COLUMNS)
    clean = {r.doc_id: r for r in steps["personal-data"](spark, told, "").collect()}
    assert "[EMAIL]" in clean[5004].text and "example.org" not in clean[5004].text and clean[5004].n_chars == len(clean[5004].text)
    mixed = steps["mixture"](spark, told, "")
    assert 0.7 * told.count() < mixed.count() < told.count() and mixed.columns == list(C.COLUMNS)
    packed = steps["packing"](spark, mixed, "")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in mixed.select("doc_id").collect()}


def test_nothing_in_nothing_out(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    assert C.STAGES[-1][1](spark, docs, "").count() == 0
