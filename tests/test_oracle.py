import pytest
from compare import oracle, same

from quillspark.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), *oracle(sf, ORACLE_SQL[name]))


def test_every_query_has_an_oracle_or_a_test():
    assert set(QUERIES) - set(ORACLE_SQL) == {"gate_verdict", "gate_verdict_counted"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
