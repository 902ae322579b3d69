"""Every opN query runs over its whole table; those with a SQL twin give the twin's rows."""

import pytest

from sumfold.llm import queries
from sumfold.sources.tables import table
from tests.test_queries import SF, duck, rows_of  # noqa: F401

KEY = {"op8_html_text": ("pages", "page_id"), "op9_maxscore_topk": ("embeddings", None)}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.queries()[name](spark, SF)
    got = df.collect()
    sql = queries.oracle_sql().get(name)
    if sql is not None:
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(got, df.columns) == rows_of(want.fetchall(), want.columns)
    source, key = KEY.get(name, ("documents", "doc_id"))
    if key:
        ids = sorted(r[0] for r in table(spark, SF, source).select(key).collect())
        assert sorted({r[key] for r in got}) == ids and (len(got) == len(ids) or name == "op6_best_fit_packing")
