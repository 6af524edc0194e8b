import __spark_entry__


def test_contract(spark):
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 70
    assert __spark_entry__.entry(spark).count() > 50
