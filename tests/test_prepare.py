import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.functions import geometry as G
from netquarry.functions import scalar as S
from netquarry.operators import estimate as E
from netquarry.operators import euclid as U
from netquarry.operators import generate as R
from netquarry.operators import prepare as P
from netquarry.operators.distances import distances
from netquarry.sources import network as N
from netquarry.sources import text as T

from .graphs import group, network, place_distance, random_network, search


@pytest.fixture(scope="module")
def net(spark):
    coords, edges, points = random_network(11)
    return network(spark, edges, points, coords)


def test_canonical_and_validate(spark, net):
    raw = spark.createDataFrame([(1, 0, 5.0), (0, 1, 3.0), (2, 2, 1.0)], "ni long, nj long, w double")
    assert [tuple(r) for r in N.canonical_edges(raw).collect()] == [(0, 1, 3.0)]
    assert set(N.validate(net).values()) == {0}
    broken = N.Network(net.nodes, raw, spark.createDataFrame([(0, 0, 1, 99.0)], "pt_id long, ni long, nj long, pos double"))
    got = N.validate(broken)
    assert got["unordered"] == 2 and got["off_edge"] == 1


def test_parts_shortcuts_and_overlay(spark, net):
    seeds = U.str_seeds(net.nodes, 2)
    parts = P.voronoi_parts(net, seeds).select("node_id", "part")
    sizes = P.part_sizes(net.edges, parts).collect()
    assert sum(r.nodes for r in sizes) == net.nodes.count()
    e = [tuple(r) for r in net.edges.collect()]
    q = group(spark, [(0, 0, *e[0][:2], 0.0), (0, 1, *e[9][:2], e[9][2])])
    whole = {(r.qi, r.node): r.d for r in distances(q, net.edges).collect()}
    for part in {r.part for r in parts.collect()}:
        own = {r.node_id for r in parts.filter(F.col("part") == part).collect()}
        got = {(r.qi, r.node): r.d for r in P.overlay_distances(net, q, parts, part).collect()}
        assert got == {k: d for k, d in whole.items() if k[1] in own}


def test_connected_relabel_and_segments(spark):
    two = network(spark, [(0, 5, 9.0), (5, 7, 9.0), (2, 3, 9.0)], [(5, 7, 4.0)], {0: (0, 0), 5: (3, 4), 7: (3, 0), 2: (9, 9), 3: (8, 8)})
    got = P.connected(two, 0)
    assert sorted((r.ni, r.nj, r.w) for r in got.edges.collect()) == [(0, 1, 5.0), (1, 2, 4.0)]
    kept = P.connected(two, 0, straight=False)
    assert [tuple(r) for r in kept.points.collect()] == [(0, 1, 2, 4.0)]
    assert sorted(tuple(r) for r in P.component_sizes(two.edges, two.nodes).collect()) == [(0, 3), (2, 2)]
    seg = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0), (3.0, 4.0, 0.0, 0.0), (3.0, 4.0, 3.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    g = P.from_segments(seg)
    assert g.nodes.count() == 3 and sorted(r.w for r in g.edges.collect()) == [4.0, 5.0]
    assert P.lengthened(g.edges, 1).filter("w < 4 or w >= 10").count() == 0


def test_euclid_against_brute_force(spark, net):
    nodes = {r.node_id: (r.x, r.y) for r in net.nodes.collect()}
    places = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate([(5, 5), (190, 3), (1000, 1000)])], "pid long, x double, y double")
    got = {}
    for r in U.nearest_each(places, net.nodes, 3, key="node_id").collect():
        got.setdefault(r.pid, []).append((round(r.dist, 9), r.node_id))
    for p in places.collect():
        want = sorted((round(math.dist(nodes[n], (p.x, p.y)), 9), n) for n in nodes)[:3]
        assert sorted(got[p.pid]) == want
    edges = {(r.ni, r.nj): r.w for r in net.edges.collect()}
    for r in P.snapped(places, net, 20).collect():
        p = places.filter(F.col("pid") == r.pid).first()
        gaps = []
        for (a, b) in edges:
            (x1, y1), (x2, y2) = nodes[a], nodes[b]
            l2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = 0 if l2 == 0 else max(0, min(1, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / l2))
            gaps.append(math.dist((p.x, p.y), (x1 + t * (x2 - x1), y1 + t * (y2 - y1))))
        assert abs(r.gap - min(gaps)) < 1e-9
    boxes = N.with_ends(net.edges, net.nodes).select(F.col("ni"), F.col("nj"), *G.Box.around(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).named())
    rows = boxes.collect()
    want = sum(a.xmin <= b.xmax and b.xmin <= a.xmax and a.ymin <= b.ymax and b.ymin <= a.ymax for a in rows for b in rows)
    assert U.box_join(boxes, boxes, 33).count() == want
    tiles = U.str_tiles(boxes.withColumn("id", F.col("ni") * 100 + F.col("nj")), 8).groupBy("slice", "tile").count().collect()
    assert sum(r["count"] for r in tiles) == len(rows) and max(r["count"] for r in tiles) <= 8


def test_range_counts_and_estimates(spark, net):
    e = [tuple(r) for r in net.edges.collect()]
    pts = [(r.ni, r.nj, r.pos) for r in net.points.orderBy("pt_id").collect()]
    q = [(0, k, *e[5 * k][:2], e[5 * k][2] / 2) for k in range(4)]
    for radius in (10, 80, 300):
        got = {r.qi: r.n for r in E.range_count(net, group(spark, q), radius).collect()}
        assert got == {r[1]: sum(place_distance(e, r[2:5], p) <= radius for p in pts) for r in q}
    found = E.estimate(net, E.random_nodes(net, 10), E.choose_anchors(net, 3), 100, 200)
    rows = found.collect()
    assert rows and all(r.poly >= 0 and r.lpl >= 0 for r in rows)
    for r in rows:
        first = min((a, b, 0.0 if a == r.node_id else w) for a, b, w in e if r.node_id in (a, b))
        assert search(e, *first)[r.node_id] == 0
        assert r.actual == sum(place_distance(e, first, p) <= 100 for p in pts)
    err = E.errors(found, "opt").first()
    assert err.total >= 0 and err.low <= err.high


def test_generators_are_seeded(spark, net):
    a, b = (sorted(map(tuple, R.queries_within(net, 5, 0.5, seed=3).collect())) for _ in range(2))
    assert a == b and len(a) == 5
    w = {(r.ni, r.nj): r.w for r in net.edges.collect()}
    for made in (R.spaced_points(net, 25), R.carried_points(net, 25), R.clusters(net, 3, 10, 5)):
        rows = made.collect()
        assert rows and all(0 <= r.pos <= w[r.ni, r.nj] for r in rows)
    got = R.clusters(net, 3, 10, 5).groupBy("cluster").count().collect()
    assert all(r["count"] == 10 for r in got)
    draws = spark.range(4000).select(S.poisson(3.0, 1).alias("p"), S.zipf(1.0, 10, 2).alias("z"), S.gaussian(2, 1, 3).alias("g")).agg(F.avg("p"), F.min("z"), F.max("z"), F.avg("g")).first()
    assert abs(draws[0] - 3) < 0.2 and draws[1] == 1 and draws[2] <= 10 and abs(draws[3] - 2) < 0.1


def test_formats(spark, net, tmp_path):
    T.write_network(net, f"{tmp_path}/n")
    back = T.read_network(spark, f"{tmp_path}/n")
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, net.edges.collect()))
    assert T.read_network(spark, f"{tmp_path}/n", first=10).edges.filter("ni >= 10 or nj >= 10").count() == 0
    q = group(spark, [(0, k, r.ni, r.nj, r.w / 4) for k, r in enumerate(net.edges.orderBy("ni", "nj").limit(3).collect())])
    T.write_queries(q, f"{tmp_path}/q")
    assert sorted(map(tuple, T.read_queries(spark, f"{tmp_path}/q").collect())) == sorted(map(tuple, q.collect()))
    T.write_storage(net, f"{tmp_path}/s")
    opened = T.open_storage(spark, f"{tmp_path}/s")
    assert opened.points.count() == net.points.count() and set(N.validate(opened).values()) == {0}
    import struct

    (tmp_path / "p_d").write_bytes(struct.pack("<iifi2f", 3, 4, 9.5, 2, 1.5, 2.5) + struct.pack("<iifif", 4, 8, 2.0, 1, 0.25))
    assert [tuple(r) for r in T.read_point_file(spark, f"{tmp_path}/p_d").collect()] == [(3, 4, 9.5, [1.5, 2.5]), (4, 8, 2.0, [0.25])]
    body = struct.pack("<ffi", 1.0, 2.0, 1) + struct.pack("<ifi", 7, 3.5, -1)
    (tmp_path / "al_d").write_bytes(struct.pack("<ii", 1, 8) + body)
    row = T.read_adjacency_file(spark, f"{tmp_path}/al_d").first()
    assert (row.x, row.y, row.adj[0].dst, row.adj[0].w, row.adj[0].pt_key) == (1.0, 2.0, 7, 3.5, -1)
    e00 = ["EXP  0 X.E00", "ARC  2", f"{1:10d}{1:10d}{1:10d}{2:10d}{0:10d}{0:10d}{3:10d}", "".join(f"{v:14.7E}" for v in (0, 0, 1, 1)), "".join(f"{v:14.7E}" for v in (2, 0)), f"{-1:10d}" + f"{0:10d}" * 6,
           "LAB  2", f"{1:10d}{0:10d}" + "".join(f"{v:14.7E}" for v in (5, 6)), "".join(f"{v:14.7E}" for v in (5, 6, 5, 6)), f"{-1:10d}{0:10d}", "EOS"]
    (tmp_path / "x.e00").write_text("\n".join(e00))
    assert [tuple(r) for r in T.read_e00(spark, f"{tmp_path}/x.e00", "lines").collect()] == [(1, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 2.0, 0.0)]
    assert [tuple(r) for r in T.read_e00(spark, f"{tmp_path}/x.e00").collect()] == [(1, 5.0, 6.0, 5.0, 6.0)]
    assert T.read_config("a = 1\n// b=2\nc=3 // d", ["-a", "9"]) == {"a": "9"}
    with pytest.raises(KeyError):
        T.read_config("", required=("a",))


def test_box_join_takes_every_box(spark):
    from netquarry.queries import QUERIES, _boxes, context

    folder = "/root/testdata/sf0.001"
    rows = _boxes(context(spark, folder)).collect()
    want = {(a.ni, a.nj, b.ni, b.nj) for a in rows for b in rows if a.xmin <= b.xmax and b.xmin <= a.xmax and a.ymin <= b.ymax and b.ymin <= a.ymax}
    got = [tuple(r) for r in QUERIES["box_join"](spark, folder).collect()]
    assert set(got) == want and len(got) == len(want)


def test_node_fields_lists_every_node(spark):
    from netquarry.queries import QUERIES, context

    folder = "/root/testdata/sf0.001"
    net, held = context(spark, folder).net, {}
    for r in net.points.collect():
        held[r.ni, r.nj] = held.get((r.ni, r.nj), 0) + 1
    want = sorted(x for r in net.edges.collect() for x in ((r.ni, r.nj, r.w, held.get((r.ni, r.nj), 0)), (r.nj, r.ni, r.w, held.get((r.ni, r.nj), 0))))
    assert sorted(tuple(r) for r in QUERIES["node_fields"](spark, folder).collect()) == want


def test_overlay_distances_all_reaches_every_part(spark, net):
    parts = P.voronoi_parts(net, U.str_seeds(net.nodes, 2)).select("node_id", "part").checkpoint()
    e = [tuple(r) for r in net.edges.collect()]
    q = group(spark, [(0, 0, *e[0][:2], 0.0), (1, 1, *e[9][:2], e[9][2])])
    want = sorted((r.qset, r.qi, r.node, r.d) for r in distances(q, net.edges).collect())
    assert sorted((r.qset, r.qi, r.node, r.d) for r in P.overlay_distances_all(net, q, parts).collect()) == want
    few = parts.withColumn("part", F.col("part") % 2)
    assert sorted((r.qset, r.qi, r.node, r.d) for r in P.overlay_distances_all(net, q, few, strategy="frame").collect()) == want


def test_malformed_lines_raise(spark, tmp_path):
    (tmp_path / "good").write_text("1  2.5 3\n\n \t\n 2 4 5  more\n")
    assert [tuple(r) for r in T.read_nodes(spark, f"{tmp_path}/good").collect()] == [(1, 2.5, 3.0), (2, 4.0, 5.0)]
    for k, bad in enumerate(("1 2.5 3\n2 4\n", "1 2 x\n")):
        (tmp_path / f"bad{k}").write_text(bad)
        with pytest.raises(Exception, match="not 3 fields|CAST_INVALID_INPUT"):
            T.read_nodes(spark, f"{tmp_path}/bad{k}").collect()


def test_oversized_and_cut_files_raise(spark, tmp_path, monkeypatch):
    import struct

    data = struct.pack("<iifi2f", 3, 4, 9.5, 2, 1.5, 2.5)
    (tmp_path / "p_d").write_bytes(data)
    monkeypatch.setattr(T, "MAX_FILE", len(data) - 1)
    with pytest.raises(Exception, match="that one row may hold"):
        T.read_point_file(spark, f"{tmp_path}/p_d").collect()
    monkeypatch.setattr(T, "MAX_FILE", 1000)
    assert T.read_point_file(spark, f"{tmp_path}/p_d").count() == 1
    (tmp_path / "cut").write_bytes(data + b"\1\2")
    with pytest.raises(Exception, match="ends within a group"):
        T.read_point_file(spark, f"{tmp_path}/cut").collect()


def test_two_level_file(spark, net, tmp_path):
    parts = net.nodes.selectExpr("node_id", "case when node_id < 3 then 3 else node_id % 3 end part")
    short, edge = P.shortcuts(net.edges, parts), P.boundary(net.edges, parts)
    T.write_two_level(parts, edge, short, f"{tmp_path}/g.hiti")
    got = T.read_two_level(spark, f"{tmp_path}/g.hiti")
    for found, want in zip(got, (parts, edge, short), strict=True):
        assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    n, count, *label = np.frombuffer((tmp_path / "g.hiti").read_bytes()[: 8 + 4 * 30], "<i4").tolist()
    assert (n, count) == (30, 4) and label == [3 if k < 3 else k % 3 for k in range(30)]
    with pytest.raises(ValueError, match="without gaps"):
        T.write_two_level(parts.filter("node_id <> 4"), edge, short, f"{tmp_path}/x")


def test_page_order(spark, net):
    e = [tuple(r) for r in net.edges.collect()]
    adj = {}
    for a, b, w in e:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    for of in (lambda n: 0, lambda n: n % 2):
        want, done, page = [], set(), 0
        for first in range(30):
            near, count = {first: 0.0}, 0
            if first in done:
                continue
            while near and count < 7:
                d, node = min((d, n) for n, d in near.items())
                del near[node]
                done.add(node)
                want.append((node, len(want), page))
                count += 1
                for m, w in adj[node]:
                    if m not in done and of(m) == of(first):
                        near[m] = min(near.get(m, 1e18), d + w)
            page += 1
        parts = None if of(1) == 0 else net.nodes.selectExpr("node_id", "node_id % 2 part")
        assert sorted(map(tuple, P.page_order(net, 7, parts).collect()), key=lambda r: r[1]) == want


def test_clusters_grow_and_raise(spark, net):
    with pytest.raises(Exception, match="has room for"):
        R.clusters(net, 1, 50, 1e5).collect()
    g = R.gathered(net.edges)
    rows = R._cluster(g, 0, 400, 1.0, 30.0, np.random.default_rng(1))
    steps = [b[2] - a[2] for a, b in zip(rows, rows[1:], strict=False) if a[:2] == b[:2]]
    assert len(rows) == 400 and np.mean(np.abs(steps[-40:])) > 4 * np.mean(np.abs(steps[1:40]))
    assert R.mean_step(net, 0.5) == pytest.approx(net.edges.agg(F.avg("w")).first()[0] / 2)


def test_thinned_and_fitted_against_numpy(spark, net):
    e = net.edges.first()
    cdf = E.cumulative(E.point_distances(net, group(spark, [(0, 0, e.ni, e.nj, e.w / 4), (0, 1, 0, net.edges.filter("ni = 0").first().nj, 0.0)]), 400)).checkpoint()
    got = {}
    for r in E.thinned(cdf).collect():
        got.setdefault(r.qi, []).append((r.x, r.ly))
    poly = {r.qi: r.poly for r in E.polynomial_fit(cdf, terms=4).collect()}
    for qi in (0, 1):
        rows = sorted((r.d, r.y) for r in cdf.filter(F.col("qi") == qi).collect())
        want, last = [], -1e18
        for d, y in rows:
            if d > 0 and math.log(d) >= last + 0.1:
                last = math.log(d)
                want.append((last, math.log(y)))
        assert np.array(sorted(got[qi])) == pytest.approx(np.array(want))
        x = np.array([d for d, _ in rows]) / 1000
        fit = np.polynomial.polynomial.polyfit(x, [y for _, y in rows], 3)
        assert np.polynomial.polynomial.polyval(x, poly[qi]) == pytest.approx(np.polynomial.polynomial.polyval(x, fit), abs=0.2)


def test_estimates_follow_their_anchors(spark, net):
    anchors = E.choose_anchors(net, 4)
    assert anchors.count() == 4 and anchors.join(net.points.select(F.explode(F.array("ni", "nj")).alias("node_id")), "node_id", "left_anti").isEmpty()
    built = {r.anchor: r for r in E.build_anchors(net, anchors, 250).collect()}
    nodes = {r.node_id: (r.x, r.y) for r in net.nodes.collect()}
    xy = {r.pt_id: (r.x, r.y) for r in N.with_xy(net.points, net).collect()}
    for a in built.values():
        near = [r.pt_id for r in E.point_distances(net, E.from_nodes(net, net.nodes.filter(F.col("node_id") == a.node_id).select("node_id")), 250).collect()]
        assert a.cnt == len(near) and a.eps == pytest.approx(max(math.dist(xy[p], nodes[a.node_id]) for p in near))
    rows = E.estimate(net, net.nodes.select("node_id").limit(8), anchors, 100, 250).collect()
    for r in rows:
        a = min(built.values(), key=lambda a: (math.dist(nodes[r.node_id], (a.x, a.y)), a.anchor))
        assert r.lpl == int(math.exp(a.a + a.b * math.log(100))) and r.poly == pytest.approx(max(0, sum(c * 0.1**k for k, c in enumerate(a.poly))))
    got = E.errors(E.estimate(net, net.nodes.select("node_id").limit(8), anchors, 100, 250), "lpl").first()
    assert got.total == pytest.approx(sum(abs(r.lpl - r.actual) for r in rows) / sum(r.actual for r in rows))
    ratios = [r.lpl / r.actual for r in rows if r.actual]
    assert (got.low, got.high) == pytest.approx((min(ratios), max(ratios))) and got.worst == pytest.approx(max(abs(x - 1) for x in ratios))


def test_double_precision_export(spark, tmp_path):
    wide = lambda *v: "".join(f"{x:21.14E}" for x in v)
    e00 = ["EXP  0 X.E00", "ARC  3", f"{1:10d}{1:10d}{1:10d}{2:10d}{0:10d}{0:10d}{2:10d}", wide(0.5, 1.25), wide(2, 3), f"{-1:10d}" + f"{0:10d}" * 6,
           "LAB  3", f"{7:10d}{0:10d}" + wide(5, 6), wide(5, 6), wide(5, 6), f"{-1:10d}{0:10d}", "EOS"]
    (tmp_path / "d.e00").write_text("\n".join(e00))
    lines = T.read_e00(spark, f"{tmp_path}/d.e00", "lines")
    assert [tuple(r) for r in lines.collect()] == [(1, 0.5, 1.25, 2.0, 3.0)]
    assert [tuple(r) for r in T.read_e00(spark, f"{tmp_path}/d.e00").collect()] == [(7, 5.0, 6.0, 5.0, 6.0)]
    T.write_segments(lines, f"{tmp_path}/segments")
    assert [tuple(r) for r in T.read_segments(spark, f"{tmp_path}/segments").collect()] == [(1, 0.5, 1.25, 2.0, 3.0)]


def test_clusters_are_split_by_folder(spark, tmp_path):
    points = spark.createDataFrame([(1.0, 2.0, 1), (3.0, 4.0, 2), (5.0, 6.0, None)], "x double, y double, cluster_id long")
    T.write_clusters(points, f"{tmp_path}/c")
    assert sorted(map(tuple, spark.read.text(f"{tmp_path}/c").collect()), key=str) == [("1.0 2.0", 1), ("3.0 4.0", 2), ("5.0 6.0", None)]
