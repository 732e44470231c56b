"""Every registered query of the reference operators against its oracle, or for rows only."""

import pytest

from gneiss import catalog, registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        compare(df, con, catalog.ORACLES[name])
    else:
        assert df.collect()


def test_names_are_not_taken_twice():
    with pytest.raises(ValueError):
        registry.query("bm25_topk")(lambda s, d: None)
    with pytest.raises(ValueError):
        registry.choose("collator", "none such")
