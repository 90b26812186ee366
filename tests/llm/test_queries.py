"""The registered queries: the SQL twins, and the contract's columns."""

import pytest

from plyweave.llm import queries as Q

from ..compare import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, name):
    assert spark_rows(Q.queries()[name](spark, SF)) == duck(Q.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_columns(spark, name):
    got = Q.queries()[name](spark, SF)
    want = {
        "op1": "doc_id size text_crc32 law shard slot grown_shard", "op2": "doc_id fingerprint component_id", "op3": "doc_id n_words log_likelihood mean_log_likelihood", "op4": "vec_id n_links component_id kept",
        "op5": "doc_id start n_tokens ids_crc32", "op6": "query_id rank vec_id score", "op7": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op8": "doc_id tokens weight probability kept",
        "op9": "doc_id piece start length ids_crc32 sequence_id offset", "op10": "doc_id held_out lang_pred score",
    }[name.split("_")[0]].split()
    assert set(want) <= set(got.columns)
