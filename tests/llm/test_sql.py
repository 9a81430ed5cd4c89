"""The registered SQL, and the SQL of parts, against the operators on the smallest tables."""

import glob
import os
from zlib import crc32

import duckdb
import pytest

from groupwise.llm import queries, sharding, sql, url_filter

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    cursor = duck.execute(sql.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted(cursor.fetchall())
    assert sorted(map(tuple, df.select(*columns).collect())) == theirs and theirs


def test_host_path_and_rule(spark, duck):
    rules = ", ".join("('{}', '/{}')".format(*r.split("/", 1)) for r, _ in url_filter.RULES)
    assert sorted(rules) == sorted("('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/')")
    found = queries.op1_url_filter(spark, DATA).select("page_id", "host", "path", "rule").collect()
    assert sorted(map(tuple, found)) == sorted(duck.execute(sql.SPLIT_SQL).fetchall())


def test_sizes_and_even_shards_of_all_documents(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    rows = sharding.shard(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len(t.encode()) + 1, crc32(t.encode())) for i, t in texts.items())
    held = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(held) - min(held) <= max(r["size"] for r in rows) and {r["law"] for r in rows} == {"bytes"}
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
