"""Driver contract: entry() and every registered query run at sf0.001 with a stable schema."""

import __spark_entry__ as E
from conftest import SF


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


def test_every_query_has_sql_or_is_known(spark):
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 40


def test_all_queries_run_small(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SF)
        schema = df.schema.simpleString()
        df.write.format("noop").mode("overwrite").save()
        assert fn(spark, SF).schema.simpleString() == schema, name
