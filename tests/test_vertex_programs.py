"""Vertex programs: how often they read and write, and that parts stay small."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from triloom.operators import gas


def _counted(spark, pairs):
    """Edges, and how many rows of them were read."""
    read = spark.sparkContext.accumulator(0)

    def same(x):
        read.add(1)
        return x

    rows = spark.createDataFrame(pairs, "src long, dst long")
    return rows.select(F.udf(same, "long")("src").alias("src"), "dst"), read


def test_vertex_programs_read_their_edges_once(spark):
    edges, read = _counted(spark, [(k, k + 1) for k in range(6)])
    assert {r.id: (r.depth, r.predecessor) for r in gas.bfs(edges, 0).collect()} == {k: (k, k - 1 if k else None) for k in range(7)}
    assert read.value == 6


def test_pagerank_ends_when_no_sender_changes(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(gas, "written", lambda df, write=gas.written: tables.append(df) or write(df))
    got = {r.id: r["rank"] for r in gas.pagerank(spark.createDataFrame([(1, 2), (1, 4), (3, 4)], "src long, dst long")).collect()}
    assert got == pytest.approx({1: 0.15, 3: 0.15, 2: 0.15 + 0.85 * 0.075, 4: 0.15 + 0.85 * 0.225})
    assert len(tables) <= 4
    edges, read = _counted(spark, [(1, 2), (2, 1), (2, 3), (3, 1)])
    rank = dict.fromkeys((1, 2, 3), 0.15)
    for _ in range(9):
        rank = {1: 0.15 + 0.85 * (rank[2] / 2 + rank[3]), 2: 0.15 + 0.85 * rank[1], 3: 0.15 + 0.85 * rank[2] / 2}
    assert {r.id: r["rank"] for r in gas.pagerank(edges, 9).collect()} == pytest.approx(rank)
    assert read.value == 4


def test_parts_grow_in_number_and_hot_vertices_are_spread(spark, monkeypatch):
    monkeypatch.setattr(gas, "ROWS", 8)
    pairs = [(0, k) for k in range(1, 60)] + [(k, k % 7 + 60) for k in range(1, 60)] + [(60, 0)]
    lines = spark.createDataFrame(pairs * 2, "src long, dst long").coalesce(1)
    edges = gas.distinct_edges(lines)
    sizes = edges.groupBy(F.spark_partition_id()).count().collect()
    assert edges.rdd.getNumPartitions() == 30 and sum(r["count"] for r in sizes) == len(pairs)
    dealt = []
    monkeypatch.setattr(gas, "_dealt", lambda *a, deal=gas._dealt: dealt.append(deal(*a)) or dealt[-1])
    assert {r.id: r.depth for r in gas.bfs(edges, 0).collect()} == {0: 0} | {k: 1 for k in range(1, 60)} | {k: 2 for k in range(60, 67)}
    assert max(r["count"] for r in dealt[-1].groupBy("src", "salt").count().collect()) < 24
    rank = dict.fromkeys(range(67), 0.15)
    out = Counter(a for a, _ in pairs)
    for _ in range(3):
        sums = Counter()
        for a, b in pairs:
            sums[b] += rank[a] / out[a]
        rank = {v: 0.15 + 0.85 * sums[v] for v in rank}
    assert {r.id: r["rank"] for r in gas.pagerank(edges, 3).collect()} == pytest.approx(rank)


def test_undirected_walks_write_their_edges_once(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(gas, "written", lambda df, write=gas.written: tables.append(write(df)) or tables[-1])
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (5, 6)], "src long, dst long")
    found = {r.id: (r.depth, r.predecessor) for r in gas.bfs(edges, 1, gas.ALL).collect()}
    assert found == {1: (0, None), 2: (1, 1), 3: (2, 2), 4: (3, 3), 5: (-1, None), 6: (-1, None)}
    assert tables[0].columns == ["src", "dst"] and tables[0].count() == 4
