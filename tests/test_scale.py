"""Searches over blocks of a network, in arrays, and sums over many vectors: equal to plain ones, in few steps."""

import random

import numpy as np
import pytest

from netquarry.operators import blocks as B
from netquarry.operators import distances as D
from netquarry.operators.ann import ann_concurrent, ann_filter_refine, ann_points, center, threshold_stats
from netquarry.operators.estimate import point_distances
from netquarry.operators.euclid import vector_group_nearest
from netquarry.operators.search import Layered, Overlay

from .graphs import group, network, place_distance, search
from .test_ann import brute, made, rows_of


def grid(n):
    """Edges and coordinates of an n x n grid with uneven weights."""
    coords = {r * n + c: (c * 10, r * 10) for r in range(n) for c in range(n)}
    edges = [(k, k + 1, 10.0 + k % 3) for k in coords if (k + 1) % n] + [(k, k + n, 11.0 + k % 2) for k in coords if k + n in coords]
    return coords, edges


def columns(edges):
    a = np.array([e[:2] for e in edges], np.int64)
    return a[:, 0], a[:, 1], np.array([e[2] for e in edges], float)


@pytest.mark.parametrize("local", [True, False])
def test_blocks_give_what_the_whole_graph_gives(spark, monkeypatch, local):
    monkeypatch.setattr(B, "BLOCK", 12)
    _, edges, points, rows, net, q = made(spark, 3)
    how = "local" if local else "frame"
    assert len(B.blocks_of(net).cuts) > 3
    got = {(r.qset, r.qi, r.pt_id): r.d for r in point_distances(net, q, strategy=how).collect()}
    assert got == {(r[0], r[1], i): place_distance(edges, r[2:5], p) for r in rows for i, p in enumerate(points)}
    want = brute(edges, points, rows, "sum", True, 4)
    for search_ in (ann_points, ann_filter_refine, ann_concurrent):
        assert rows_of(search_(net, q, 4, "sum", True, strategy=how)) == want
    if local:
        one = network(spark, edges, points)
        monkeypatch.setattr(B, "BLOCK", 10_000)
        for agg in ("sum", "max"):
            assert sorted(map(tuple, threshold_stats(net, q, 3, agg).collect())) == sorted(map(tuple, threshold_stats(one, q, 3, agg).collect()))
            assert sorted(map(tuple, center(net, q, agg, True).collect())) == sorted(map(tuple, center(one, q, agg, True).collect()))


def test_a_long_path_takes_few_jobs(spark, monkeypatch):
    """Before, each edge of the path was a round of several jobs."""
    monkeypatch.setattr(B, "BLOCK", 60)
    net = network(spark, [(k, k + 1, 1.0) for k in range(150)])
    spark.sparkContext.setJobGroup("path", "")
    got = {r.node: r.d for r in D.distances(group(spark, [(0, 0, 0, 1, 0.0)]), net.edges, strategy="frame").collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("path"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {k: float(k) for k in range(151)}
    assert 0 < jobs < 100


def test_points_on_the_own_edge_count_though_its_ends_are_far(spark):
    net = network(spark, [(0, 1, 100.0), (1, 2, 5.0)], [(0, 1, 52.0), (0, 1, 70.0)])
    got = point_distances(net, group(spark, [(0, 0, 0, 1, 50.0)]), 5).collect()
    assert [(r.pt_id, r.d) for r in got] == [(0, 2.0)]


def test_matrices_by_halving(monkeypatch):
    rng = random.Random(1)
    graphs = [columns(grid(25)[1])] + [columns([(a, b, rng.randrange(1, 90) / 4) for a, b in {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}]) for n, m in ((40, 30), (300, 400), (300, 1500))]
    monkeypatch.setattr(D, "LEAF", 12)
    for ni, nj, w in graphs:
        keep = np.array(sorted(rng.sample(range(ni.max() + 4), 30)))
        assert np.array_equal(D.among(ni, nj, w, keep), D._searched_among(D.Csr(ni, nj, w), keep))


def test_two_level_searches_take_each_node_a_few_times():
    """Before, each target part had a search of its own over all shortcuts."""
    n = 24
    _, edges = grid(n)
    graph = D.Csr(*columns(edges))
    part = (graph.ids // n // 6) * 4 + graph.ids % n // 6
    short = []
    for p in range(16):
        inside = [e for e in edges if part[e[0]] == part[e[1]] == p]
        rim = np.array(sorted({x for a, b, _ in edges if part[a] != part[b] for x in (a, b) if part[x] == p}))
        m = D.among(*columns(inside), rim)
        short += [(rim[i], rim[j], m[i, j]) for i in range(len(rim)) for j in range(i + 1, len(rim))]
    found = Layered(Overlay.of(graph, part, columns(short)), [(0, 2.0), (1, 8.0)])
    far = found.to(np.arange(len(graph.ids)))
    assert dict(enumerate(far)) == search(edges, 0, 1, 2.0)
    assert found.popped < 6 * len(graph.ids)


def test_sums_over_vectors(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 5)), 3)
    v[40:80] = v[7]  # copies tie
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    total = np.sqrt(((v[:, None] - v[None, ::20]) ** 2).sum(2)).sum(1)
    want = sorted(range(300), key=lambda i: (round(total[i], 9), i))[:8]
    plan = vector_group_nearest(df, df.filter("vec_id % 20 = 0").select("v"), 8)
    got = plan.collect()
    assert [r.vec_id for r in got] == want and [r.total for r in got] == pytest.approx(total[want])
    nulls = df.union(spark.createDataFrame([(999, None)], df.schema))
    assert vector_group_nearest(nulls, df.filter("vec_id % 20 = 0").select("v"), 8).count() == 8
