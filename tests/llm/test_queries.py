"""Every query of the subpackage over the test tables: against SQL where there is some, else by its laws."""

import pytest

from freightlens.llm import catalogue
from oracle import compare

QUERIES, SQL = catalogue()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_per_document(spark, sf, name):
    if name in {"op1_topk", "op5_token_counts", "op6_best_fit_packing", "op8_chat_formatting", "op12_whitening", "op13_prefix_trie"}:
        pytest.skip("rows are not documents")
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
