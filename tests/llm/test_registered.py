"""The registered queries on repeats and near copies, at their production parameters, against brute force on whole documents."""

import pytest
from brute import groups, substring, suffix

from lattiq.llm import queries
from lattiq.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, plain", [("op2_substring_dedup", lambda d: substring(d, 50)), ("op7_suffix_array", lambda d: suffix(d, 200)), ("op8_jaccard_join", lambda d: groups(d, 4, 85))])
def test_registered_query(spark, name, plain):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).collect()) == sorted(plain(docs))
