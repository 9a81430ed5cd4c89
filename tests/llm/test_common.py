import random

import pytest
from pyspark.sql import functions as F

from groupwise.llm import common, jaccard_join
from tests.llm import brute


@pytest.mark.parametrize(("hub", "hubs"), [(512, 50_000), (3, 50_000), (3, 2)])
def test_components_with_and_without_hubs(spark, monkeypatch, hub, hubs):
    monkeypatch.setattr(common, "HUB", hub)
    monkeypatch.setattr(common, "HUBS", hubs)
    r = random.Random(hub + hubs)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5), (None, 3), (3, None)]
    links += links[:20] + [(-7, 299), (2**62, -7)]
    found = common.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    known = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    expected = brute.component_ids({x for p in known for x in p}, known)
    assert sorted(map(tuple, found)) == sorted(expected.items())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_that_make_one_node_of_an_id(spark):
    rows = [(1, 10), (1, 12), (1, 11), (1, 12), (2, 20), (2, 20), (None, 5), (None, 6), (3, None)]
    found = common.one_by_id(spark.createDataFrame(rows, "id long, node long"), "id", "node").collect()
    assert sorted(map(tuple, found)) == [(10, 11), (10, 12)]


def test_columns_of_any_names_come_back(spark):
    df = spark.range(3).select(F.col("id").alias("a.b"), F.lit("x").alias("c0"), F.lit(2).alias("none"), F.lit("t").alias("text"))
    packed = df.select(common.columns_as_row(df, without="text").alias("row"), "text")
    assert packed.select(*common.row_as_columns(df.columns, "row", without="text")).collect() == df.collect()


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_rows_split_by_a_filter_of_ids(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "LEAST_BITS", bits)
    monkeypatch.setattr(common, "MOST_BITS", bits)
    df = spark.range(500).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.col("id").alias("word"), F.lit("x").alias("bits")).repartition(3)
    ids = spark.range(0, 500, 9).withColumnRenamed("id", "doc_id")
    possible, others, _ = common.split_by_ids(df, ids, "doc_id")
    assert possible.columns == others.columns == df.columns and possible.count() + others.count() == 500
    assert {r["doc_id"] for r in possible.collect()} >= set(range(0, 500, 9)) and (bits == 64 or others.count() > 430)
    kept = jaccard_join.without(df, ids)
    assert kept.columns == df.columns and sorted(r["word"] for r in kept.collect()) == [k for k in range(500) if k % 9]
    assert jaccard_join.without(df, ids.limit(0)).count() == 500
    plan = others._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
