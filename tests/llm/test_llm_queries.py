"""Registered queries of the subpackage run on the smallest data with the stated columns."""

import pytest

pytest.importorskip("tidewright.llm")

from tidewright.llm.queries import catalogue  # noqa: E402

COLUMNS = {
    "p2_found": ["news_id", "price_id"], "p4_found": ["book", "period", "ticker"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(catalogue.queries))
def test_runs(spark, data, name):
    df = catalogue.queries[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() == df.distinct().count() if name.endswith("_found") else df.count() >= 0
