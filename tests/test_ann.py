import pytest

from netquarry.operators.ann import ann_concurrent, ann_filter_refine, ann_points, center, threshold_stats
from netquarry.operators.distances import component, distances, nearest_seed, shortest_path
from netquarry.operators.prepare import shortcuts
from netquarry.operators.search import ann_search, center_search
from netquarry.plans import ann, choose

from .graphs import group, network, place_distance, random_network, search

QUERIES = [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)]


def made(spark, seed):
    coords, edges, points = random_network(seed)
    rows = [(s, q, *edges[(7 * q + seed) % len(edges)][:2], edges[(7 * q + seed) % len(edges)][2] * (q % 5) / 4, 1 + q / 2) for s, q in QUERIES]
    return coords, edges, points, rows, network(spark, edges, points, coords), group(spark, rows)


def brute(edges, points, rows, agg, weighted, k):
    out = {}
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        got = []
        for i, p in enumerate(points):
            ds = [place_distance(edges, r[2:5], p) for r in own]
            if None not in ds:
                ds = [d * (r[5] if weighted else 1) for d, r in zip(ds, own, strict=True)]
                got.append((sum(ds) if agg == "sum" else max(ds), *p, i))
        out[s] = sorted(got)[:k]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strategies_agree_with_plain_search(spark, seed):
    _, edges, _, rows, net, q = made(spark, seed)
    want = {(r[0], r[1], n): d for r in rows for n, d in search(edges, *r[2:5]).items()}
    for strategy in ("local", "frame"):
        assert {(r.qset, r.qi, r.node): r.d for r in distances(q, net.edges, strategy=strategy).collect()} == want
    near = {k: d for k, d in want.items() if d <= 150}
    for strategy in ("local", "frame"):
        assert {(r.qset, r.qi, r.node): r.d for r in distances(q, net.edges, 150, strategy).collect()} == near


@pytest.mark.parametrize("agg,weighted", [("sum", False), ("max", False), ("sum", True), ("max", True)])
def test_all_searches_agree_with_brute_force(spark, agg, weighted):
    _, edges, points, rows, net, q = made(spark, 3)
    want = brute(edges, points, rows, agg, weighted, 5)
    for how in (ann_points, ann_filter_refine, ann_concurrent):
        got = {}
        for r in how(net, q, 5, agg, weighted).orderBy("qset", "rank").collect():
            got.setdefault(r.qset, []).append((r.agg_dist, r.ni, r.nj, r.pos, r.pt_id))
        assert got == want, how.__name__


def rows_of(found):
    got = {}
    for r in found.orderBy("qset", "rank").collect():
        got.setdefault(r.qset, []).append((r.agg_dist, r.ni, r.nj, r.pos, r.pt_id))
    return got


@pytest.mark.parametrize("agg,weighted,seed", [("sum", False, 3), ("max", False, 8), ("sum", True, 8), ("max", True, 3)])
def test_searches_that_stop_early(spark, agg, weighted, seed):
    _, edges, points, rows, net, q = made(spark, seed)
    want = brute(edges, points, rows, agg, weighted, 5)
    parts = net.nodes.selectExpr("node_id", "node_id % 4 part")
    short = shortcuts(net.edges, parts)
    for method, straight in (("expand", True), ("refine", True), ("threshold", True), (("expand", "refine", "threshold")[seed % 3], False)):
        assert rows_of(ann_search(net, q, 5, agg, weighted, method, straight)) == want, (method, straight)
    assert rows_of(ann_search(net, q, 5, agg, weighted, "refine", parts=parts, short=short)) == want
    if agg == "sum" and not weighted:
        comps = {(r.qset, r.rank): r.comp for r in ann_points(net, q, 5).collect()}
        assert {(r.qset, r.rank): r.comp for r in ann_search(net, q, 5).collect()} == comps
    best = {r.qset: r.agg_dist for r in center(net, q, agg, weighted).collect()}
    assert {r.qset: r.agg_dist for r in center_search(net, q, agg, weighted, weighted).collect()} == pytest.approx(best)


def test_searches_settle_a_part_only(spark):
    n = 40
    coords = {r * n + c: (c * 10, r * 10) for r in range(n) for c in range(n)}
    edges = [(k, k + 1, 10.0) for k in coords if (k + 1) % n] + [(k, k + n, 11.0) for k in coords if k + n in coords]
    points = [(a, b, 2.0) for a, b, _ in edges[::3]]
    net, q = network(spark, edges, points, coords), group(spark, [(0, 0, 820, 821, 1.0), (0, 1, 825, 826, 2.0), (0, 2, 905, 906, 3.0)])
    want = rows_of(ann_points(net, q, 4))
    for method in ("expand", "refine", "threshold"):
        got = ann_search(net, q, 4, method=method)
        assert rows_of(got) == want and 0 < got.first().settled < 3 * len(coords) / 2 and got.first().popped >= got.first().settled
    assert center_search(net, q).first().settled < 3 * len(coords)


def test_unreachable_and_scarce_points(spark):
    edges = [(0, 1, 5.0), (1, 2, 5.0), (10, 11, 5.0)]
    coords = {0: (0, 0), 1: (5, 0), 2: (10, 0), 10: (50, 0), 11: (55, 0)}
    net = network(spark, edges, [(0, 1, 1.0), (10, 11, 2.0)], coords)
    q = group(spark, [(0, 0, 0, 1, 2.0), (0, 1, 1, 2, 3.0), (1, 2, 10, 11, 1.0), (1, 3, 0, 1, 1.0)])
    for method in ("expand", "refine", "threshold"):
        got = [(r.qset, r.pt_id, r.agg_dist) for r in ann_search(net, q, 3, method=method).collect()]
        assert got == [(0, 0, 8.0)], method
    assert [r.qset for r in center_search(net, q).collect()] == [0]
    assert ann_search(network(spark, edges, [], coords).__class__(net.nodes, net.edges, net.points.limit(0)), q).count() == 0


def test_weights_of_zero(spark):
    _, edges, points, rows, net, _ = made(spark, 5)
    rows = [(*r[:5], 0.0) for r in rows]
    q = group(spark, rows)
    for agg in ("sum", "max"):
        assert all(r.agg_dist == 0 for r in center(net, q, agg, True).collect())
        assert all(r.agg_dist == 0 for r in center_search(net, q, agg, True).collect())
    want = brute(edges, points, rows, "sum", True, 5)
    assert rows_of(ann_points(net, q, 5, "sum", True)) == want


def test_frame_path_is_a_shortest_path(spark):
    _, edges, *_, net, _ = made(spark, 6)
    for strategy in ("local", "frame"):
        path = shortest_path(net.edges, 0, 17, net.nodes, strategy).orderBy("step").collect()
        weight = {frozenset(e[:2]): e[2] for e in edges}
        assert (path[0].node, path[-1].node, [r.step for r in path]) == (0, 17, list(range(len(path))))
        assert all(b.d - a.d == weight[frozenset((a.node, b.node))] for a, b in zip(path, path[1:], strict=False))
        assert path[-1].d == min(search(edges, 0, next(e[1] for e in edges if e[0] == 0), 0)[17], path[-1].d)
    assert shortest_path(net.edges, 0, 999, strategy="frame").count() == 0


def test_center_is_no_worse_than_sampling(spark):
    _, edges, _, rows, net, q = made(spark, 4)
    for agg in ("sum", "max"):
        for weighted in (False, True):
            exact = {r.qset: r.agg_dist for r in center(net, q, agg, weighted).collect()}
            sampled = {r.qset: r.agg_dist for r in center(net, q, agg, weighted, "sampled", 100).collect()}
            assert all(exact[s] <= sampled[s] + 1e-9 and sampled[s] - exact[s] < 20 for s in exact)


def test_threshold_counts(spark):
    _, edges, points, rows, net, q = made(spark, 5)
    got = {r.qset: r for r in threshold_stats(net, q, 3, "max").collect()}
    want = brute(edges, points, rows, "max", False, 3)
    for s, r in got.items():
        assert r.kth == want[s][-1][0] == r.threshold
        assert r.settled == sum(d <= r.kth for x in rows if x[0] == s for d in search(edges, *x[2:5]).values())


def test_hand_cases(spark):
    edges = [(0, 1, 10.0), (1, 2, 10.0), (0, 2, 50.0), (5, 6, 3.0)]
    net = network(spark, edges, [(0, 1, 4.0), (0, 2, 25.0), (0, 2, 25.0), (5, 6, 1.0)])
    top = lambda rows, k=9, **o: [(r.pt_id, r.agg_dist) for r in ann_points(net, group(spark, rows), k, **o).orderBy("rank").collect()]
    assert top([(0, 0, 0, 1, 1.0)]) == [(0, 3.0), (1, 26.0), (2, 26.0)]  # same edge; ties by id; unreachable left out; k over the points
    assert top([(0, 0, 0, 2, 10.0), (0, 1, 0, 2, 10.0)], 1) == [(0, 28.0)]  # a repeated query counts twice
    assert top([(0, 0, 0, 1, 1.0), (0, 1, 5, 6, 1.0)]) == []  # no point is reached by both
    with pytest.raises(ValueError):
        top([(0, 0, 0, 5, 1.0)])
    with pytest.raises(ValueError):
        top([(0, 0, 0, 1, 11.0)])
    assert top([(0, 0, 1, 0, 9.0)], 1) == [(0, 3.0)]  # ends the other way round: pos counts from the other one
    with pytest.raises(ValueError):
        ann_points(net, group(spark, [(0, 0, 0, 1, 1.0)]), 1, "min")


def test_paths_components_and_plan(spark):
    coords, edges, points = random_network(6)
    net = network(spark, edges, points, coords)
    path = [(r.node, r.d) for r in shortest_path(net.edges, 0, 29, net.nodes).orderBy("step").collect()]
    lookup = {(a, b): w for a, b, w in edges} | {(b, a): w for a, b, w in edges}
    assert path[0] == (0, 0.0) and path[-1][0] == 29
    assert path[-1][1] == sum(lookup[a, b] for (a, _), (b, _) in zip(path, path[1:], strict=False)) == shortest_path(net.edges, 0, 29).orderBy("step").collect()[-1].d
    two = network(spark, [(0, 1, 1.0), (2, 3, 1.0)])
    assert shortest_path(two.edges, 0, 3).count() == 0
    assert {r.node for r in component(two.edges, 2).collect()} == {2, 3}
    seeds = spark.createDataFrame([(0,), (29,)], "node long")
    assert sorted(map(tuple, nearest_seed(net.edges, seeds, "local").collect())) == sorted(map(tuple, nearest_seed(net.edges, seeds, "frame").collect()))
    assert choose(net).distance == "local"
    q = group(spark, [(0, 0, *edges[0][:2], 0.0)])
    assert ann(net, q, 2).count() == 2 and ann(net, q, mode="center").first().agg_dist == 0
