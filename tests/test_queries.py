"""Every registered query against its SQL. Queries run side by side, since small ones leave most cores idle."""

from concurrent.futures import Future, ThreadPoolExecutor

import pytest

from tessera import catalog
from tests.oracle import SMALL, differences

SIDE_BY_SIDE = 6


@pytest.fixture(scope="module")
def found(spark, request) -> dict[str, Future]:
    """What each chosen query's comparison gives, or its rows where it has no SQL."""
    chosen = [i.callspec.params["name"] for i in request.session.items if i.module is request.module]
    pool = ThreadPoolExecutor(SIDE_BY_SIDE)

    def run(name):
        if name in catalog.ORACLES:
            return differences(spark, name, catalog.QUERIES[name], catalog.ORACLES[name])
        return catalog.QUERIES[name](spark, SMALL).count()

    yield {name: pool.submit(run, name) for name in chosen}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_equal_the_sql(found, name):
    assert found[name].result() == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_give_rows(found, name):
    assert found[name].result() > 0
