"""The registered corpus queries against their SQL."""

import duckdb
import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_small)
    out = con.execute(queries.ORACLES[name])
    names = [d[0] for d in out.description]
    cols = sorted(df.columns)
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in out.fetchall())
    assert sorted(names) == cols and sorted(tuple(r[c] for c in cols) for r in df.collect()) == want
