import importlib

import pytest

import __spark_entry__ as entry
from tests import oracle

PAIRS = [(m, n) for m in entry.MODULES for n in importlib.import_module(m).QUERIES]


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("module,name", PAIRS, ids=[n for _, n in PAIRS])
def test_query(spark, con, sf_dir, module, name):
    m = importlib.import_module(module)
    if name in m.ORACLE_SQL:
        oracle.check(spark, con, sf_dir, m.QUERIES[name], m.ORACLE_SQL[name])
    else:
        assert m.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
