"""The stages one by one on the awkward corpus, the run on small tables, and the check of SQL-free queries."""

import re

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from meshlark.llm import pii
from tests.llm.fixture import documents, empty, values

SMALL = "/root/testdata/sf0.001"


def test_stage_columns_on_awkward_and_empty_tables(spark, tmp_path):
    for tag, docs in (("odd", documents(spark, clash=True)), ("none", empty(spark))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == list(corpus_pipeline.COLUMNS), name
            out.write.parquet(path := str(tmp_path / f"{tag}{k}"))
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (tag == "odd")


def test_stages_take_effect(spark):
    docs = documents(spark)
    kept = corpus_pipeline.identify_language(spark, docs, SMALL)
    assert kept.where("text is null or trim(text) = ''").count() == 0
    assert corpus_pipeline.near_dedup(spark, docs, SMALL).where("doc_id in (4, 5)").count() <= 1
    clean = corpus_pipeline.redact_personal_data(spark, docs, SMALL).collect()
    assert not any(s[2] == "email" for r in clean for s in pii.find(r.text)) and all(r.n_chars == len(r.text) for r in clean)
    left = corpus_pipeline.repeat_removal(spark, docs, SMALL)
    assert left.count() == docs.count()


def test_run_equals_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert values(corpus_pipeline.run(spark, SMALL), *columns) == values(docs, *columns)


@pytest.mark.parametrize("number", range(1, 11))
def test_registered_queries_return_the_contract(spark, number):
    columns = {
        1: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], 2: ["doc_id", "fingerprint", "component_id"], 3: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        4: ["doc_id", "held_out", "score", "predicted"], 5: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], 6: ["doc_id", "n_words", "n_removed", "kept_sha256"], 7: ["doc_id", "held_out", "lang_pred", "score"],
        8: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], 9: ["vec_id", "n_links", "component_id", "kept"], 10: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    }[number]
    (name,) = [n for n in __spark_entry__.queries() if re.match(rf"op{number}_", n)]
    got = __spark_entry__.queries()[name](spark, SMALL)
    assert got.columns[: len(columns)] == columns
    table = spark.read.parquet(f"{SMALL}/{'embeddings' if number == 9 else 'documents'}.parquet")
    rows = got.toPandas()
    assert len(rows) == table.count() if number != 1 else set(rows["doc_id"]) == {r.doc_id for r in table.select("doc_id").collect()}
    if number == 1:
        assert (np.bitwise_and(rows["length"], rows["length"] - 1) == 0).all() and rows.groupby("sequence_id").size().max() == 1
