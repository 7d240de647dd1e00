import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck
from tickforge.llm.oracle import oracle_sql

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = E.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, name):
    r = compare(E.queries()[name](spark, SF), E.oracle_sql()[name], duck(SF))
    assert r["rows"][0] == r["rows"][1] and r["cols_match"] and r["hash_match"], r
