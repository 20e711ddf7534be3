"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_small, name):
    df = catalog.QUERIES[name](spark, sf_small)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in out.description]
    want = sorted((tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in out.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


@pytest.fixture(scope="module")
def signed_zero(spark, tmp_path_factory):
    """A folder whose customers hold both zeros, and its view."""
    folder = str(tmp_path_factory.mktemp("signed_zero"))
    rows = [(k, f"Customer#{k:09d}", k % 25, bal, "MACHINERY") for k, bal in enumerate([-0.0, 0.0, -0.01, 0.01, -5.0, 1234.5])]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{folder}/customer.parquet/*.parquet')")
    return con, folder


def test_estimate_of_minus_zero(spark, signed_zero):
    duck, folder = signed_zero
    got = catalog.QUERIES["estimate_row_bytes"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(catalog.ORACLES["estimate_row_bytes"]).fetchall())


def test_fingerprint_of_minus_zero(spark, signed_zero):
    duck, folder = signed_zero
    got = catalog.QUERIES["table_fingerprint"](spark, folder).collect()
    assert list(map(tuple, got)) == duck.execute(catalog.ORACLES["table_fingerprint"]).fetchall()


@pytest.mark.parametrize("amounts", [[0.00012279650462332371, -0.00043872094321195654, 0.0009376901531066295, 0.0001, -0.00025, 0.001], []])
def test_fingerprint_of_small_amounts_and_of_no_rows(spark, tmp_path, amounts):
    rows = [(k, f"Customer#{k:09d}", k % 25, bal, "MACHINERY") for k, bal in enumerate(amounts)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    got = catalog.QUERIES["table_fingerprint"](spark, str(tmp_path)).collect()
    assert list(map(tuple, got)) == con.execute(catalog.ORACLES["table_fingerprint"]).fetchall()
