"""The queries of the subpackage against their SQL, or that they run with a stable schema."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, same  # noqa: E402

from millrace.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    same(spark, connect(folder), folder, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, folder, name):
    found = QUERIES[name](spark, folder)
    assert found.columns and found.count() >= 0


WANTED = {
    "p1_found": ["rank"], "p2_found": ["source", "topic", "vigintile"], "p3_found": ["source", "topic", "measure"], "p4_found": ["train_rank", "eval_rank"],
    "p6_found": ["doc_id"], "p7_found": ["source"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(WANTED))
def test_columns(spark, folder, name):
    assert QUERIES[name](spark, folder).columns == WANTED[name]
