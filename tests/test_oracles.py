"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from siftmill.plans import catalog

LARGER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return "-"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number)):
        return repr(float(v))
    return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)


def tables(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def db(sf):
    """Each folder's tables; what has no rows in the smallest is compared in the next."""
    return {folder: tables(folder) for folder in (sf, LARGER)}


def both(name, spark, db, folder):
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), db[folder].sql(catalog.ORACLES[name]).df()
    assert set(got.columns) == set(want.columns)
    columns = sorted(got.columns)
    return [sorted(map(tuple, f[columns].map(plain).to_numpy().tolist())) for f in (got, want)]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, db):
    got, want = both(name, spark, db, sf)
    assert got == want
    if not got:
        got, want = both(name, spark, db, LARGER)
        assert got == want and got


# fixtures differ with their size: these are compared on the next size too
@pytest.mark.parametrize("name", ["meta1_paper_meta", "snk8_numeric_regions", "flt9_valid_p", "cmp4_tests", "jn15_mentions", "lay3_column_labels"])
def test_query_on_more_rows(name, spark, db):
    got, want = both(name, spark, db, LARGER)
    assert got == want and got


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
