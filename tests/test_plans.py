"""Every query of the core against its SQL on the smallest tables."""

import pytest
from oracle import duck, spark_rows

from looseleaf.plans import checks, corpus, feeds, graph, memory, pages

FOLDER = "/root/testdata/sf0.001"
MODULES = [feeds, memory, corpus, graph, checks, pages]
CASES = [(m, name) for m in MODULES for name in m.QUERIES]


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, module, name):
    got = spark_rows(module.QUERIES[name](spark, FOLDER))
    if name in module.SQL:
        assert got == duck(FOLDER, module.SQL[name])
    else:
        assert got[0]


def test_sql_names_exist():
    for m in MODULES:
        assert set(m.SQL) <= set(m.QUERIES)
