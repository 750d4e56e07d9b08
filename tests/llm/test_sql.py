"""The operators that SQL expresses, against DuckDB on the given tables and on planted links."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkmeld.llm.registry import ORACLE_SQL, QUERIES

SOURCE = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    d = tmp_path_factory.mktemp("planted")
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 32))
    x[100:200] = x[:100] + 0.2 * rng.standard_normal((100, 32))
    x[200:260] = x[0] + 0.1 * rng.standard_normal((60, 32))
    rows = [v.tolist() for v in x] + [x[5].tolist(), None, [0.0] * 32, [float("inf")] + [1.0] * 31, [1.0, None] * 16]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float64()))}), d / "embeddings.parquet")
    for t in TABLES:
        if t != "embeddings":
            pq.write_table(pq.read_table(f"{SOURCE}/{t}.parquet"), d / f"{t}.parquet")
    return str(d)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(None if x != x else x for x in r) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("given", [True, False])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, planted, name, given):
    d = SOURCE if given else planted
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, want = QUERIES[name](spark, d).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert given or name != "op1_embedding_dedup" or got.n_links.sum() > 1000
