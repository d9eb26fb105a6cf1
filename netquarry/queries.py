"""The registered queries over the derived network, and SQL for DuckDB that computes the same rows."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import scalar as S
from .operators import ann as A
from .operators import distances as D
from .operators import estimate as E
from .operators import euclid as U
from .operators import generate as R
from .operators import prepare as P
from .operators import search as X
from .plans import ann
from .sources import network as N
from .sources import text as T


class Context:
    """The derived network of one folder; what several queries share is checkpointed once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def _made(self):
        return N.derived(self.spark, self.sf_dir)

    @property
    def net(self) -> N.Network:
        return self._made[0]

    @property
    def queries(self) -> DataFrame:
        return self._made[1]

    @cached_property
    def dist(self) -> DataFrame:
        return D.distances(self.queries, self.net.edges).checkpoint()

    @cached_property
    def queries_xy(self) -> DataFrame:
        return N.with_xy(self.queries, self.net).checkpoint()

    @cached_property
    def seeds(self) -> DataFrame:
        return U.str_seeds(self.net.nodes).checkpoint()

    @cached_property
    def parts(self) -> DataFrame:
        return P.voronoi_parts(self.net, self.seeds).select("node_id", "part").checkpoint()

    @cached_property
    def short(self) -> DataFrame:
        return P.shortcuts(self.net.edges, self.parts).checkpoint()

    def scratch(self, what: str) -> str:
        """A new name below the folder that driver and executors share."""
        return f"{self.spark.sparkContext.getCheckpointDir() or self.spark.conf.get('spark.checkpoint.dir')}/{what}-{uuid.uuid4().hex}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


_CONTEXTS: dict = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir)
    return _CONTEXTS[key]


def forget() -> None:
    """Drop what queries share, so that the next one starts from the tables."""
    _CONTEXTS.clear()


QUERIES, ORACLE_SQL = {}, {}

NET = """WITH RECURSIVE cust AS (SELECT c_custkey::BIGINT AS id FROM customer),
sz AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS g FROM cust),
nodes AS MATERIALIZED (SELECT id AS node_id, ((id % g) * 100 + (id * 37) % 41)::DOUBLE AS x, ((id // g) * 100 + (id * 53) % 43)::DOUBLE AS y FROM cust, sz),
pairs AS (SELECT id AS ni, id + 1 AS nj FROM cust, sz WHERE (id + 1) % g <> 0 AND id + 1 < n UNION ALL SELECT id, id + g FROM cust, sz WHERE id + g < n),
ends AS (SELECT ni, nj, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pairs JOIN nodes a ON a.node_id = ni JOIN nodes b ON b.node_id = nj),
edges AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ni, nj) - 1 AS eidx, ni, nj, (abs(x1 - x2) + abs(y1 - y2) + (ni * 31 + nj * 17) % 23)::DOUBLE AS w, x1, y1, x2, y2 FROM ends),
ne AS (SELECT count(*) AS e FROM edges),
points AS MATERIALIZED (SELECT p_partkey::BIGINT AS pt_id, ni, nj, (((p_partkey::BIGINT * 104729) % (w::BIGINT * 4 + 1)) / 4.0)::DOUBLE AS pos, w, x1, y1, x2, y2 FROM part, ne JOIN edges ON eidx = (p_partkey::BIGINT * 7919) % e),
queries AS MATERIALIZED (SELECT n_regionkey::BIGINT AS qset, n_nationkey::BIGINT AS qi, ni, nj, (((n_nationkey::BIGINT * 15485863 + 7) % (w::BIGINT * 4 + 1)) / 4.0)::DOUBLE AS pos, (1.0 + (n_nationkey % 4) * 0.5)::DOUBLE AS weight, w, x1, y1, x2, y2 FROM nation, ne JOIN edges ON eidx = (n_nationkey::BIGINT * 6151 + 13) % e),
adj AS (SELECT ni AS src, nj AS dst, w FROM edges UNION ALL SELECT nj, ni, w FROM edges),
pxy AS (SELECT *, CASE WHEN w = 0 THEN x1 ELSE x1 + pos / w * (x2 - x1) END AS x, CASE WHEN w = 0 THEN y1 ELSE y1 + pos / w * (y2 - y1) END AS y FROM points),
qxy AS (SELECT *, CASE WHEN w = 0 THEN x1 ELSE x1 + pos / w * (x2 - x1) END AS x, CASE WHEN w = 0 THEN y1 ELSE y1 + pos / w * (y2 - y1) END AS y FROM queries),
boxes AS (SELECT ni, nj, least(x1, x2) AS xmin, greatest(x1, x2) AS xmax, least(y1, y2) AS ymin, greatest(y1, y2) AS ymax FROM edges)
"""

DIST = NET + """, d(qi, node, dist) USING KEY (qi, node) AS (
  SELECT qi, node, min(dd) FROM (SELECT qi, ni AS node, pos AS dd FROM queries UNION ALL SELECT qi, nj, w - pos FROM queries) GROUP BY qi, node
  UNION
  SELECT d.qi, a.dst, min(d.dist + a.w) FROM d JOIN adj a ON a.src = d.node LEFT JOIN recurring.d r ON r.qi = d.qi AND r.node = a.dst
  WHERE r.dist IS NULL OR d.dist + a.w < r.dist GROUP BY d.qi, a.dst),
dist AS MATERIALIZED (SELECT q.qset, d.qi, d.node, d.dist AS d, q.weight FROM d JOIN queries q USING (qi)),
sides AS MATERIALIZED (SELECT e.ni, e.nj, e.w, l.qset, l.qi, l.weight, l.d AS dl, r.d AS dr, q.pos AS qpos FROM edges e JOIN dist l ON l.node = e.ni JOIN dist r ON r.node = e.nj AND r.qi = l.qi
  LEFT JOIN queries q ON q.qi = l.qi AND q.ni = e.ni AND q.nj = e.nj),
pd AS MATERIALIZED (SELECT s.qset, s.qi, s.weight, p.pt_id, p.ni, p.nj, p.pos, least(s.dl + p.pos, s.dr + s.w - p.pos, coalesce(abs(s.qpos - p.pos), 1e300)) AS d FROM points p JOIN sides s ON s.ni = p.ni AND s.nj = p.nj)
"""


def query(name: str, sql: str | None = None):
    """Register a function of a Context, and its SQL."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(context(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def at(*names: str, digits: int = 6):
    """Rounded columns, for values that hold roots or quotients."""
    return [F.round(F.col(n), digits).alias(n) for n in names]


# -- model and scans


@query("net_nodes", NET + "SELECT node_id, x, y FROM nodes")
def _(c):
    return c.net.nodes


@query("net_edges", NET + "SELECT ni, nj, w FROM edges")
def _(c):
    return N.canonical_edges(c.net.edges)


@query("net_adjacency", NET + "SELECT src, dst, w FROM adj")
def _(c):
    return N.adjacency(c.net.edges)


@query("net_points", NET + "SELECT pt_id, ni, nj, pos FROM points")
def _(c):
    return c.net.points


@query("net_queries", NET + "SELECT qset, qi, ni, nj, pos, weight FROM queries")
def _(c):
    return N.placed(c.queries, c.net.edges).select("qset", "qi", "ni", "nj", "pos", "weight")


@query("point_ids", NET + "SELECT pt_id, row_number() OVER (ORDER BY ni, nj, pos, pt_id) - 1 AS dense_id FROM points")
def _(c):
    return N.numbered(c.net.points, "dense_id", "ni", "nj", "pos", "pt_id").select("pt_id", "dense_id")


@query("first_nodes_cut", NET + "SELECT ni, nj, w FROM edges WHERE ni < 100 AND nj < 100")
def _(c):
    return P.first_nodes(c.net, 100).edges


@query("populated_edges", NET + "SELECT ni, nj, w FROM edges SEMI JOIN points USING (ni, nj)")
def _(c):
    return c.net.edges.join(c.net.points.select("ni", "nj"), ["ni", "nj"], "left_semi")


@query("edge_boxes", NET + "SELECT * FROM boxes")
def _(c):
    ends = N.with_ends(c.net.edges, c.net.nodes)
    return ends.select("ni", "nj", *G.Box.around(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).named())


@query("populated_boxes", NET + "SELECT * FROM boxes SEMI JOIN points USING (ni, nj)")
def _(c):
    ends = N.with_ends(c.net.edges.join(c.net.points.select("ni", "nj"), ["ni", "nj"], "left_semi"), c.net.nodes)
    return ends.select("ni", "nj", *G.Box.around(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).named())


@query("nearest_end_counts", NET + "SELECT CASE WHEN pos < w / 2 THEN ni ELSE nj END AS node_id, count(*) AS n FROM points GROUP BY 1")
def _(c):
    return E.nearest_end_counts(c.net)


@query("point_xy", NET + "SELECT pt_id, round(x, 6) AS x, round(y, 6) AS y FROM pxy")
def _(c):
    return N.with_xy(c.net.points, c.net).select("pt_id", *at("x", "y"))


@query("query_xy", NET + "SELECT qset, qi, round(x, 6) AS x, round(y, 6) AS y FROM qxy")
def _(c):
    return c.queries_xy.select("qset", "qi", *at("x", "y"))


@query("node_fields", NET + ", held AS (SELECT ni, nj, count(*) AS points FROM points GROUP BY ni, nj) SELECT src AS node_id, dst, w, coalesce(points, 0) AS points FROM adj LEFT JOIN held ON held.ni = least(src, dst) AND held.nj = greatest(src, dst)")
def _(c):
    held = c.net.points.groupBy("ni", "nj").agg(F.count("*").alias("points"))
    adj = N.adjacency(c.net.edges).withColumn("ni", F.least("src", "dst")).withColumn("nj", F.greatest("src", "dst"))
    return adj.join(held, ["ni", "nj"], "left").select(F.col("src").alias("node_id"), "dst", "w", F.coalesce("points", F.lit(0)).alias("points"))


_GROUPS = ", grp AS (SELECT ni, nj, w, count(*) AS size, sum(count(*)) OVER (ORDER BY ni, nj)::BIGINT - count(*) AS first_id, list(pos ORDER BY pos) AS offsets FROM points GROUP BY ni, nj, w) "


@query("point_groups", NET + _GROUPS + "SELECT ni, nj, w, first_id, size, unnest(offsets) AS pos, generate_subscripts(offsets, 1) - 1 AS k FROM grp")
def _(c):
    return T.point_groups(c.net.points, c.net.edges).select("ni", "nj", "w", "first_id", "size", F.posexplode("offsets").alias("k", "pos"))


@query("floor_lookup", NET + _GROUPS + "SELECT k AS key, ni, nj, k - first_id AS place FROM (SELECT unnest(generate_series(0, (SELECT count(*) - 1 FROM points))) AS k) ASOF JOIN grp ON k >= first_id")
def _(c):
    groups = T.point_groups(c.net.points, c.net.edges).select("ni", "nj", "first_id", "size")
    # a group answers the keys from its first id on, so the floor lookup is an equi-join on the ids that it covers
    covered = groups.withColumn("key", F.explode(F.sequence("first_id", F.col("first_id") + F.col("size") - 1)))
    keys = c.spark.range(c.net.points.count()).withColumnRenamed("id", "key")
    return keys.join(covered, "key").select("key", "ni", "nj", (F.col("key") - F.col("first_id")).alias("place"))


@query("sampled_places", NET + ", m AS (SELECT greatest(1, count(*) // 200) AS n FROM points) SELECT pt_id, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT *, row_number() OVER (ORDER BY pt_id) - 1 AS i FROM pxy), m WHERE i % n = 0")
def _(c):
    return T.sampled_places(c.net, 200).select("pt_id", *at("x", "y"))


@query("plot_lines", NET + "SELECT printf('%.3f %.3f' || chr(10) || '%.3f %.3f' || chr(10), x1, y1, x2, y2) AS value FROM edges")
def _(c):
    return T.plot_lines(c.net)


@query("plot_segments", ORACLE_SQL["plot_lines"])
def _(c):
    return T.plot_segments(N.with_ends(c.net.edges, c.net.nodes).select(*[F.col(x).cast("double").alias(x) for x in ("x1", "y1", "x2", "y2")]))


@query("offset_lines", NET + _GROUPS + "SELECT ni || ' ' || nj || ' ' || printf('%.3f', w) || ' ' || size || ' ' || array_to_string(list_transform(offsets, lambda p: printf('%.3f', p)), ' ') AS value FROM grp")
def _(c):
    return T.offset_lines(c.net)


# -- scalar functions


@query("edge_lengths", NET + "SELECT ni, nj, round(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)), 6) AS w, abs(x1 - x2) + abs(y1 - y2) AS l1 FROM edges")
def _(c):
    straight = P.straight_weights(c.net).select("ni", "nj", *at("w"))
    ends = N.with_ends(c.net.edges, c.net.nodes)
    return straight.join(ends.select("ni", "nj", G.manhattan(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("l1")), ["ni", "nj"])


_WINDOW = (200.0, 700.0, 150.0, 600.0)


@query("box_measures", NET + """SELECT ni, nj, (xmax - xmin) * (ymax - ymin) AS area, (xmax - xmin) + (ymax - ymin) AS margin,
  greatest(least(xmax, 700) - greatest(xmin, 200), 0) * greatest(least(ymax, 600) - greatest(ymin, 150), 0) AS overlap,
  (greatest(xmax, 700) - least(xmin, 200)) * (greatest(ymax, 600) - least(ymin, 150)) - (xmax - xmin) * (ymax - ymin) AS enlargement,
  round(sqrt(greatest(200 - xmax, xmin - 700, 0) ** 2 + greatest(150 - ymax, ymin - 600, 0) ** 2), 6) AS gap,
  CASE WHEN xmin >= 200 AND xmax <= 700 AND ymin >= 150 AND ymax <= 600 THEN 'inside' WHEN xmin <= 700 AND xmax >= 200 AND ymin <= 600 AND ymax >= 150 THEN 'overlap' ELSE 'disjoint' END AS relation FROM boxes""")
def _(c):
    ends = N.with_ends(c.net.edges, c.net.nodes)
    b, w = G.Box.around(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), G.Box(*_WINDOW)
    return ends.select("ni", "nj", b.area().alias("area"), b.margin().alias("margin"), b.overlap(w).alias("overlap"), b.enlargement(w).alias("enlargement"), F.round(b.gap(w), 6).alias("gap"), G.relation(b, w).alias("relation"))


@query("normalised_nodes", NET + "SELECT node_id, round((x - (SELECT min(x) FROM nodes)) * 10000 / ((SELECT max(x) FROM nodes) - (SELECT min(x) FROM nodes)), 6) AS x, round((y - (SELECT min(y) FROM nodes)) * 10000 / ((SELECT max(y) FROM nodes) - (SELECT min(y) FROM nodes)), 6) AS y FROM nodes")
def _(c):
    return P.normalised(c.net.nodes).select("node_id", *at("x", "y"))


_GRID = ", ext AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nodes), grid AS (SELECT node_id, (least(floor((n.x - x0) / ((x1 - x0) / 8)), 7) * 8 + least(floor((n.y - y0) / ((y1 - y0) / 8)), 7))::BIGINT AS part FROM nodes n, ext) "


@query("grid_parts", NET + _GRID + "SELECT node_id, part FROM grid")
def _(c):
    return P.grid_parts(c.net.nodes, 8)


@query("query_weights_sum", NET + "SELECT qset, qi, round(pow(s, -0.8) / avg(pow(s, -0.8)) OVER (PARTITION BY qset), 9) AS weight FROM (SELECT qset, qi, row_number() OVER (PARTITION BY qset ORDER BY qi) AS s FROM queries)")
def _(c):
    return S.skew_weights(c.queries.select("qset", "qi"), 0.8).select("qset", "qi", *at("weight", digits=9))


@query("query_weights_max", NET + "SELECT qset, qi, round(pow(s, -0.8) / max(pow(s, -0.8)) OVER (PARTITION BY qset), 9) AS weight FROM (SELECT qset, qi, row_number() OVER (PARTITION BY qset ORDER BY qi) AS s FROM queries)")
def _(c):
    return S.skew_weights(c.queries.select("qset", "qi"), 0.8, "max").select("qset", "qi", *at("weight", digits=9))


@query("coded_values", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def _(c):
    return S.coded(c.table("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "code")


@query("bit_sets", "SELECT p_partkey, bit_count(p_size) AS n, array_to_string(list_filter(range(0, 32), lambda i: (p_size >> i) & 1 = 1), ',') AS members FROM part")
def _(c):
    return c.table("part").select("p_partkey", S.cardinality(F.col("p_size")).alias("n"), F.array_join(S.members(F.col("p_size")).cast("array<string>"), ",").alias("members"))


@query("trimmed_text", r"SELECT p_partkey, regexp_replace(p_name, '\s', '', 'g') AS name FROM part")
def _(c):
    return c.table("part").select("p_partkey", S.without_space(F.col("p_name")).alias("name"))


@query("variates")
def _(c):
    return c.spark.range(1000).select("id", S.gaussian(5, 2, 3).alias("normal"), S.zipf(0.8, 100, 4).alias("zipf"), S.poisson(3.5, 5).alias("poisson"))


# -- distances and aggregate nearest neighbours


@query("shortest_distances", DIST + "SELECT qset, qi, node, d FROM dist")
def _(c):
    return D.distances(c.queries, c.net.edges)


@query("bounded_distances", DIST + "SELECT qset, qi, node, d FROM dist WHERE d <= 600")
def _(c):
    return D.distances(c.queries, c.net.edges, bound=600)


@query("frame_distances", DIST + "SELECT qset, qi, node, d FROM dist WHERE d <= 300")
def _(c):
    return D.distances(c.queries, c.net.edges, bound=300, strategy="frame")


@query("point_distances", DIST + "SELECT qset, qi, pt_id, d FROM pd")
def _(c):
    return E.point_distances(c.net, c.queries)


def _topk(value: str, k: int = 10, more: str = "") -> str:
    return DIST + f", agg AS (SELECT qset, pt_id, ni, nj, pos, {value} AS agg_dist FROM pd GROUP BY qset, pt_id, ni, nj, pos HAVING count(*) = 5), top AS (SELECT *, row_number() OVER (PARTITION BY qset ORDER BY agg_dist, ni, nj, pos, pt_id) AS rank FROM agg QUALIFY rank <= {k}) " + (more or "SELECT qset, rank, pt_id, ni, nj, pos, agg_dist FROM top")


for _name, _agg, _weighted, _value in (("ann_point_sum", "sum", False, "sum(d)"), ("ann_point_max", "max", False, "max(d)"), ("ann_point_sum_weighted", "sum", True, "sum(weight * d)"), ("ann_point_max_weighted", "max", True, "max(weight * d)")):

    @query(_name, _topk(_value))
    def _(c, agg=_agg, weighted=_weighted):
        return ann(c.net, c.queries, 10, agg, weighted).drop("comp")


for _name, _agg, _weighted, _value, _way in (("ann_full", "sum", False, "sum(d)", "full"), ("ann_refine", "sum", False, "sum(d)", "refine"), ("ann_refine_max", "max", True, "max(weight * d)", "refine"), ("ann_threshold", "sum", False, "sum(d)", "threshold"), ("ann_threshold_max", "max", True, "max(weight * d)", "threshold")):

    @query(_name, _topk(_value))
    def _(c, agg=_agg, weighted=_weighted, way=_way):
        return ann(c.net, c.queries, 10, agg, weighted, search=way).drop("comp")


@query("ann_not_euclidean", _topk("max(d)"))
def _(c):
    return ann(c.net, c.queries, 10, "max", euclidean=False).drop("comp")


for _name, _agg, _value in (("ann_two_level", "sum", "sum(d)"), ("ann_two_level_max", "max", "max(d)")):

    @query(_name, _topk(_value))
    def _(c, agg=_agg):
        got = X.ann_search(c.net, c.queries, 10, agg, method="refine", parts=c.parts, short=c.short)
        return got.select("qset", "rank", "pt_id", "ni", "nj", "pos", "agg_dist")


@query("ann_costs")
def _(c):
    """What each way of search settles, pops, holds at most and tries for each group; how much is a matter of the order of ties, so there is no SQL."""
    each = [X.ann_search(c.net, c.queries, 10, method=m).select(F.lit(m).alias("method"), "qset", "settled", "popped", "heap", "tried").distinct() for m in ("expand", "refine", "threshold")]
    return each[0].union(each[1]).union(each[2])


@query("ann_components", _topk("sum(d)", 10, "SELECT top.qset, rank, qi, d FROM top JOIN pd USING (qset, pt_id)"))
def _(c):
    got = ann(c.net, c.queries, 10)
    order = A.groups(c.queries).withColumn("k", F.row_number().over(Window.partitionBy("qset").orderBy("qi")) - 1).select("qset", "qi", "k")
    return got.select("qset", "rank", F.posexplode("comp").alias("k", "d")).join(order, ["qset", "k"]).select("qset", "rank", "qi", "d")


@query("ann_best", _topk("sum(d)", 1, "SELECT qset, pt_id, agg_dist FROM top"))
def _(c):
    return ann(c.net, c.queries, 1).select("qset", "pt_id", "agg_dist")


@query("ann_filter_refine", _topk("sum(d)"))
def _(c):
    return A.ann_filter_refine(c.net, c.queries, 10).drop("comp")


@query("ann_filter_refine_max", _topk("max(weight * d)"))
def _(c):
    return A.ann_filter_refine(c.net, c.queries, 10, "max", True).drop("comp")


@query("ann_concurrent", _topk("sum(d)"))
def _(c):
    return A.ann_concurrent(c.net, c.queries, 10).drop("comp")


@query("ann_concurrent_max", _topk("max(d)"))
def _(c):
    return A.ann_concurrent(c.net, c.queries, 10, "max").drop("comp")


_TA = """, stop AS (SELECT qset, max(agg_dist) AS kth FROM top GROUP BY qset), inside AS (SELECT dist.qset, node, count(*) AS met FROM dist JOIN stop USING (qset) WHERE d <= {} GROUP BY dist.qset, node)
SELECT qset, kth, {} AS threshold, coalesce(sum(met), 0)::BIGINT AS settled, count(*) FILTER (WHERE met = 5) AS candidates FROM stop LEFT JOIN inside USING (qset) GROUP BY qset, kth"""


@query("threshold_sum", _topk("sum(d)", 10, _TA.format("kth / 5", "kth / 5")))
def _(c):
    return A.threshold_stats(c.net, c.queries, 10)


@query("threshold_max", _topk("max(d)", 10, _TA.format("kth", "kth")))
def _(c):
    return A.threshold_stats(c.net, c.queries, 10, "max")


@query("partial_aggregates", DIST + "SELECT qset, node, sum(d) AS total, max(d) AS most, count(*) AS met FROM dist WHERE d <= 900 GROUP BY qset, node")
def _(c):
    return c.dist.filter("d <= 900").groupBy("qset", "node").agg(F.sum("d").alias("total"), F.max("d").alias("most"), F.count("*").alias("met"))


@query("node_lower_bounds", DIST + """, who AS (SELECT qset, qi, x, y FROM qxy), lb AS (SELECT n.node_id AS node, who.qset, coalesce(t.d, greatest(600.0, sqrt((n.x - who.x) ** 2 + (n.y - who.y) ** 2))) AS d FROM nodes n JOIN who ON true LEFT JOIN dist t ON t.qi = who.qi AND t.node = n.node_id AND t.d <= 600)
SELECT qset, node, round(sum(d), 6) AS lb_sum, round(max(d), 6) AS lb_max FROM lb GROUP BY qset, node""")
def _(c):
    frontier = 600.0
    who = c.queries_xy.select("qset", "qi", F.col("x").alias("qx"), F.col("y").alias("qy"))  # five groups of five
    known = c.dist.filter(F.col("d") <= frontier).select("qset", "qi", "node", "d")
    pairs = c.net.nodes.select(F.col("node_id").alias("node"), "x", "y").crossJoin(F.broadcast(who)).join(known, ["qset", "qi", "node"], "left")
    d = F.coalesce("d", F.greatest(F.lit(frontier), G.euclid(F.col("x"), F.col("y"), F.col("qx"), F.col("qy"))))
    return pairs.groupBy("qset", "node").agg(F.round(F.sum(d), 6).alias("lb_sum"), F.round(F.max(d), 6).alias("lb_max"))


@query("edge_lower_bounds", DIST + "SELECT qset, ni, nj, sum(least(dl, dr, CASE WHEN qpos IS NOT NULL THEN 0 ELSE 1e300 END)) AS lb_sum, max(least(dl, dr, CASE WHEN qpos IS NOT NULL THEN 0 ELSE 1e300 END)) AS lb_max FROM sides GROUP BY qset, ni, nj")
def _(c):
    low = F.when(F.col("qpos").isNotNull(), F.lit(0.0)).otherwise(F.least("dl", "dr"))
    return A.edge_sides(c.net.edges, c.queries, c.dist).groupBy("qset", "ni", "nj").agg(F.sum(low).alias("lb_sum"), F.max(low).alias("lb_max"))


def _center(fold: str, weight: str, places: str) -> str:
    return DIST + f""", places AS ({places}),
    tried AS (SELECT s.qset, s.ni, s.nj, p.pos, {fold}({weight}least(s.dl + p.pos, s.dr + s.w - p.pos, coalesce(abs(s.qpos - p.pos), 1e300))) AS agg_dist FROM sides s JOIN places p ON p.qset = s.qset AND p.ni = s.ni AND p.nj = s.nj GROUP BY s.qset, s.ni, s.nj, p.pos)
    SELECT qset, ni, nj, round(pos, 6) AS pos, round(agg_dist, 6) AS agg_dist FROM (SELECT *, row_number() OVER (PARTITION BY qset ORDER BY round(agg_dist, 6), ni, nj, pos) AS r FROM tried) WHERE r = 1"""


_ENDS = "SELECT DISTINCT qset, ni, nj, unnest([0.0::DOUBLE, w, coalesce(qpos, 0)]) AS pos FROM sides"
_CROSS = _ENDS + """ UNION SELECT r.qset, r.ni, r.nj, (f.a - r.a) / (f.m + r.m) AS pos FROM
  (SELECT qset, ni, nj, w, {0} * dl AS a, {0} AS m FROM sides UNION ALL SELECT qset, ni, nj, w, -{0} * qpos, {0} FROM sides WHERE qpos IS NOT NULL) r JOIN
  (SELECT qset, ni, nj, {0} * (dr + w) AS a, {0} AS m FROM sides UNION ALL SELECT qset, ni, nj, {0} * qpos, {0} FROM sides WHERE qpos IS NOT NULL) f
  ON f.qset = r.qset AND f.ni = r.ni AND f.nj = r.nj WHERE (f.a - r.a) / (f.m + r.m) > 0 AND (f.a - r.a) / (f.m + r.m) < w"""
_SAMPLES = "SELECT DISTINCT qset, ni, nj, j * w / 99 AS pos FROM sides, (SELECT unnest(range(0, 100)) AS j)"

for _name, _agg, _weighted, _method, _sql in (
    ("center_sum", "sum", False, "exact", _center("sum", "", _ENDS)),
    ("center_sum_weighted", "sum", True, "exact", _center("sum", "s.weight * ", _ENDS)),
    ("center_max", "max", False, "exact", _center("max", "", _CROSS.format("1.0::DOUBLE"))),
    ("center_max_weighted", "max", True, "exact", _center("max", "s.weight * ", _CROSS.format("weight"))),
    ("center_max_sampled", "max", False, "sampled", _center("max", "", _SAMPLES)),
):

    @query(_name, _sql)
    def _(c, agg=_agg, weighted=_weighted, method=_method):
        if method == "sampled":
            return A.center(c.net, c.queries, agg, weighted, method).select("qset", "ni", "nj", *at("pos", "agg_dist"))
        return ann(c.net, c.queries, agg=agg, weights=weighted, mode="center").select("qset", "ni", "nj", *at("pos", "agg_dist"))


@query("center_by_joins", ORACLE_SQL["center_max_weighted"])
def _(c):
    return A.center(c.net, c.queries, "max", True).select("qset", "ni", "nj", *at("pos", "agg_dist"))


_PATH = ", {0}(node, d) USING KEY (node) AS (SELECT {1}::BIGINT, 0.0::DOUBLE UNION SELECT a.dst, min(p.d + a.w) FROM {0} p JOIN adj a ON a.src = p.node LEFT JOIN recurring.{0} r ON r.node = a.dst WHERE r.d IS NULL OR p.d + a.w < r.d GROUP BY a.dst)"
_PATH = NET + _PATH.format("there", 3) + _PATH.format("back", 140) + " SELECT row_number() OVER (ORDER BY there.d) - 1 AS step, node, there.d FROM there JOIN back USING (node) WHERE there.d + back.d = (SELECT d FROM there WHERE node = 140)"


@query("shortest_path", _PATH)  # between these nodes there is one
def _(c):
    return D.shortest_path(c.net.edges, 3, 140, c.net.nodes)


@query("shortest_path_by_joins", _PATH)
def _(c):
    return D.shortest_path(c.net.edges, 3, 140, strategy="frame")


# -- straight-line operators


@query("nearest_nodes", NET + "SELECT row_number() OVER (ORDER BY dist, node_id) AS rank, node_id, round(dist, 6) AS dist FROM (SELECT node_id, sqrt((x - 333) ** 2 + (y - 222) ** 2) AS dist FROM nodes ORDER BY dist, node_id LIMIT 10)")
def _(c):
    return U.nearest(c.net.nodes, 333, 222, 10, "node_id").select("rank", "node_id", *at("dist"))


@query("nearest_node_each", NET + "SELECT qi AS pid, arg_min(node_id, (g, node_id)) AS node_id, round(min(g), 6) AS dist FROM (SELECT qi, node_id, sqrt((n.x - q.x) ** 2 + (n.y - q.y) ** 2) AS g FROM nodes n, qxy q) GROUP BY qi")
def _(c):
    return U.nearest_each(c.queries_xy.select(F.col("qi").alias("pid"), "x", "y"), c.net.nodes, 1, key="node_id").select("pid", "node_id", *at("dist"))


for _name, _fold, _weighted, _sql in (("euclid_group_sum", "sum", False, "sum(d)"), ("euclid_group_max", "max", False, "max(d)"), ("euclid_group_sum_weighted", "sum", True, "sum(weight * d)")):

    @query(_name, NET + f", a AS (SELECT qset, pt_id, round({_sql}, 6) AS agg_dist FROM (SELECT q.qset, q.weight, p.pt_id, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM pxy p, qxy q) GROUP BY qset, pt_id) SELECT qset, row_number() OVER (PARTITION BY qset ORDER BY agg_dist, pt_id) AS rank, agg_dist FROM a QUALIFY rank <= 10")
    def _(c, agg=_fold, weighted=_weighted):
        places = N.with_xy(c.net.points, c.net).select(F.col("pt_id").alias("id"), "x", "y")
        return U.aggregate_nearest(places, c.queries_xy, 10, agg, weighted).select("qset", "rank", *at("agg_dist"))


@query("edge_group_bounds", NET + "SELECT qset, ni, nj, round(sum(d), 6) AS lb FROM (SELECT q.qset, b.ni, b.nj, sqrt(greatest(b.xmin - q.x, q.x - b.xmax, 0) ** 2 + greatest(b.ymin - q.y, q.y - b.ymax, 0) ** 2) AS d FROM (SELECT * FROM boxes SEMI JOIN points USING (ni, nj)) b, qxy q) GROUP BY qset, ni, nj")
def _(c):
    return A.euclid_bounds(c.net, c.queries).select("qset", "ni", "nj", *at("lb"))


def _boxes(c):
    ends = N.with_ends(c.net.edges, c.net.nodes)
    return ends.select("ni", "nj", *G.Box.around(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).named())


@query("window_query", NET + "SELECT ni, nj FROM boxes WHERE xmin <= 700 AND xmax >= 200 AND ymin <= 600 AND ymax >= 150")
def _(c):
    return U.window_query(_boxes(c), _WINDOW).select("ni", "nj")


@query("stab_query", NET + "SELECT ni, nj FROM boxes WHERE 310 BETWEEN xmin AND xmax AND 215 BETWEEN ymin AND ymax")
def _(c):
    return U.stab_query(_boxes(c), 310, 215).select("ni", "nj")


@query("disc_query", NET + "SELECT ni, nj FROM boxes WHERE greatest(xmin - 500, 500 - xmax, 0) ** 2 + greatest(ymin - 400, 400 - ymax, 0) ** 2 <= 250 * 250 + 1e-8")
def _(c):
    return U.disc_query(_boxes(c), 500, 400, 250).select("ni", "nj")


@query("points_in_window", NET + "SELECT pt_id FROM pxy WHERE x BETWEEN 200 AND 700 AND y BETWEEN 150 AND 600")
def _(c):
    return N.with_xy(c.net.points, c.net).filter(G.Box(*_WINDOW).holds(F.col("x"), F.col("y"))).select("pt_id")


@query("box_join", NET + "SELECT l.ni AS l_ni, l.nj AS l_nj, r.ni AS r_ni, r.nj AS r_nj FROM boxes l JOIN boxes r ON l.xmin <= r.xmax AND r.xmin <= l.xmax AND l.ymin <= r.ymax AND r.ymin <= l.ymax")
def _(c):
    return U.box_join(_boxes(c), _boxes(c), 150).select("l_ni", "l_nj", "r_ni", "r_nj")


@query("group_boxes", NET + "SELECT qset, round(min(x), 6) AS xmin, round(max(x), 6) AS xmax, round(min(y), 6) AS ymin, round(max(y), 6) AS ymax FROM qxy GROUP BY qset")
def _(c):
    return U.bounding_box(c.queries_xy, "qset").select("qset", *at("xmin", "xmax", "ymin", "ymax"))


@query("group_centroids", NET + "SELECT qset, round(sum(x * weight) / count(*), 6) AS x, round(sum(y * weight) / count(*), 6) AS y FROM qxy GROUP BY qset")
def _(c):
    return U.centroid(c.queries_xy, True).select("qset", *at("x", "y"))


@query("str_tiles", NET + """, n AS (SELECT ceil(count(*) / 50.0) AS pages FROM boxes), a AS (SELECT *, row_number() OVER (ORDER BY (xmin + xmax) / 2, (ymin + ymax) / 2, ni * 1000000 + nj) - 1 AS i FROM boxes),
b AS (SELECT ni, nj, i // (50 * ceil(sqrt(pages))::BIGINT) AS slice, (ymin + ymax) / 2 AS cy, (xmin + xmax) / 2 AS cx FROM a, n) SELECT ni, nj, slice, (row_number() OVER (PARTITION BY slice ORDER BY cy, cx, ni * 1000000 + nj) - 1) // 50 AS tile FROM b""")
def _(c):
    return U.str_tiles(_boxes(c).withColumn("id", F.col("ni") * 1000000 + F.col("nj")), 50).select("ni", "nj", "slice", "tile")


_SEEDS = """, s1 AS (SELECT *, ntile(5) OVER (ORDER BY x DESC, y DESC, node_id) AS cx FROM nodes), s2 AS (SELECT *, ntile(5) OVER (PARTITION BY cx ORDER BY y DESC, x DESC, node_id) AS cy FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY y DESC, x DESC, node_id) AS i, count(*) OVER (PARTITION BY cx, cy) AS m FROM s2), seeds AS MATERIALIZED (SELECT (cx - 1) * 5 + cy - 1 AS seed_no, node_id FROM s3 WHERE i = m // 2 + 1)"""


@query("str_seeds", NET + _SEEDS + "SELECT seed_no, node_id FROM seeds")
def _(c):
    return c.seeds


# -- graph preparation

_VORONOI = _SEEDS + """, v(seed, node, d) USING KEY (seed, node) AS (SELECT node_id, node_id, 0.0::DOUBLE FROM seeds UNION SELECT v.seed, a.dst, min(v.d + a.w) FROM v JOIN adj a ON a.src = v.node LEFT JOIN recurring.v r ON r.seed = v.seed AND r.node = a.dst WHERE r.d IS NULL OR v.d + a.w < r.d GROUP BY v.seed, a.dst),
parts AS MATERIALIZED (SELECT node AS node_id, seed AS part, d FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, seed) AS r FROM v) WHERE r = 1),
lab AS MATERIALIZED (SELECT e.ni, e.nj, e.w, a.part AS pi, b.part AS pj FROM edges e JOIN parts a ON a.node_id = e.ni JOIN parts b ON b.node_id = e.nj),
bound AS MATERIALIZED (SELECT ni AS node_id, pi AS part FROM lab WHERE pi <> pj UNION SELECT nj, pj FROM lab WHERE pi <> pj)"""


@query("voronoi_parts", NET + _VORONOI + "SELECT node_id, part, d FROM parts")
def _(c):
    return P.voronoi_parts(c.net, c.seeds)


@query("boundary_nodes", NET + _VORONOI + "SELECT node_id, part FROM bound")
def _(c):
    return P.boundary(c.net.edges, c.parts)


@query("part_sizes", NET + _VORONOI + ", b AS (SELECT part, count(*) AS bn FROM bound GROUP BY part) SELECT part, count(*) AS nodes, coalesce(any_value(bn), 0) AS boundary_nodes, (coalesce(any_value(bn), 0) * (coalesce(any_value(bn), 0) - 1) // 2)::BIGINT AS shortcuts FROM parts LEFT JOIN b USING (part) GROUP BY part")
def _(c):
    return P.part_sizes(c.net.edges, c.parts)


@query("shortcuts", NET + _VORONOI + """, inner_adj AS (SELECT pi AS part, ni AS src, nj AS dst, w FROM lab WHERE pi = pj UNION ALL SELECT pi, nj, ni, w FROM lab WHERE pi = pj),
h(b, node, part, d) USING KEY (b, node) AS (SELECT node_id, node_id, part, 0.0::DOUBLE FROM bound UNION SELECT h.b, a.dst, any_value(h.part), min(h.d + a.w) FROM h JOIN inner_adj a ON a.src = h.node AND a.part = h.part LEFT JOIN recurring.h r ON r.b = h.b AND r.node = a.dst WHERE r.d IS NULL OR h.d + a.w < r.d GROUP BY h.b, a.dst)
SELECT h.part, h.b AS bi, h.node AS bj, h.d FROM h JOIN bound ON bound.node_id = h.node WHERE h.b < h.node""")
def _(c):
    return P.shortcuts(c.net.edges, c.parts)


@query("overlay_distances", DIST + "SELECT qset, qi, node, d FROM dist")
def _(c):
    return P.overlay_distances_all(c.net, c.queries, c.parts)


_NUMBERED = ", no AS (SELECT part, dense_rank() OVER (ORDER BY part) - 1 AS k FROM (SELECT DISTINCT part FROM parts)) "


@query("two_level_file", ORACLE_SQL["shortcuts"].rsplit("SELECT h.part", 1)[0].rstrip() + _NUMBERED + "SELECT no.k AS part, h.b AS bi, h.node AS bj, h.d FROM h JOIN bound ON bound.node_id = h.node JOIN no ON no.part = h.part WHERE h.b < h.node")
def _(c):
    """The shortcuts, written to a packed two-level file and read back."""
    parts = S.coded(c.parts, "part", "k").checkpoint()
    renamed = parts.select("node_id", F.col("k").alias("part"))
    of = parts.select("part", "k").distinct()
    short = c.short.join(of, "part").select(F.col("k").alias("part"), "bi", "bj", "d")
    path = c.scratch("two-level")
    T.write_two_level(renamed, P.boundary(c.net.edges, renamed), short, path)
    return T.read_two_level(c.spark, path)[2]


@query("page_order")
def _(c):
    return P.page_order(c.net, 64)


_COMP = ", reach(node) AS (SELECT 0::BIGINT UNION SELECT a.dst FROM reach JOIN adj a ON a.src = reach.node) "


@query("component", NET + _COMP + "SELECT node FROM reach")
def _(c):
    return D.component(c.net.edges, 0)


@query("component_sizes", NET + _COMP + "SELECT min(node) AS root, count(*) AS size FROM reach")
def _(c):
    return P.component_sizes(c.net.edges, c.net.nodes)


_CONNECTED = ", reach(node) AS (SELECT 0::BIGINT UNION SELECT a.dst FROM reach JOIN adj a ON a.src = reach.node), ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM reach) "


@query("connected_graph", NET + _CONNECTED + "SELECT a.id AS ni, b.id AS nj, round(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2), 6) AS w FROM edges JOIN ids a ON a.node = ni JOIN ids b ON b.node = nj")
def _(c):
    return P.connected(c.net, 0).edges.select("ni", "nj", *at("w"))


@query("graph_from_segments", NET + """, ids AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS id FROM (SELECT x1 AS x, y1 AS y FROM edges UNION SELECT x2, y2 FROM edges))
SELECT least(a.id, b.id) AS ni, greatest(a.id, b.id) AS nj, round(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2), 6) AS w FROM edges JOIN ids a ON a.x = x1 AND a.y = y1 JOIN ids b ON b.x = x2 AND b.y = y2""")
def _(c):
    return P.from_segments(N.with_ends(c.net.edges, c.net.nodes)).edges.select("ni", "nj", *at("w"))


@query("edge_statistics", NET + "SELECT count(*) AS edges, sum(w) AS total, round(avg(w), 6) AS mean, min(w) AS least, max(w) AS most FROM edges")
def _(c):
    return c.net.edges.agg(F.count("*").alias("edges"), F.sum("w").alias("total"), F.round(F.avg("w"), 6).alias("mean"), F.min("w").alias("least"), F.max("w").alias("most"))


@query("extents", NET + "SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM nodes")
def _(c):
    return U.bounding_box(c.net.nodes)


@query("snapped_places", NET + """, places AS (SELECT s_suppkey::BIGINT AS pid, ((s_suppkey * 7919) % 1000 + 0.5)::DOUBLE AS px, ((s_suppkey * 6151) % 900 + 0.25)::DOUBLE AS py FROM supplier),
pr AS (SELECT pid, ni, nj, w, x1, y1, x2, y2, px, py, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM places, edges),
g AS (SELECT pid, ni, nj, t * w AS pos, sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2) AS gap FROM pr)
SELECT pid, ni, nj, round(pos, 6) AS pos, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(gap, 9), ni, nj) AS r FROM g) WHERE r = 1""")
def _(c):
    k = F.col("s_suppkey").cast("long")
    places = c.table("supplier").select(k.alias("pid"), ((k * 7919) % 1000 + 0.5).alias("x"), ((k * 6151) % 900 + 0.25).alias("y"))
    return P.snapped(places, c.net, 100).select("pid", "ni", "nj", *at("pos", "gap"))


# -- sets and sorts


@query("multiset_difference", NET + "SELECT ni AS node FROM edges EXCEPT ALL SELECT nj FROM edges")
def _(c):
    return c.net.edges.select(F.col("ni").alias("node")).exceptAll(c.net.edges.select(F.col("nj").alias("node")))


@query("concatenation", NET + "SELECT ni AS node FROM edges UNION ALL SELECT nj FROM edges")
def _(c):
    return c.net.edges.select(F.col("ni").alias("node")).union(c.net.edges.select("nj"))


@query("distinct_nodes", NET + "SELECT ni AS node FROM edges UNION SELECT nj FROM edges")
def _(c):
    return c.net.edges.select(F.col("ni").alias("node")).union(c.net.edges.select("nj")).distinct()


@query("closest_nodes", NET + ", p(node, d) USING KEY (node) AS (SELECT 60::BIGINT, 0.0::DOUBLE UNION SELECT a.dst, min(p.d + a.w) FROM p JOIN adj a ON a.src = p.node LEFT JOIN recurring.p r ON r.node = a.dst WHERE r.d IS NULL OR p.d + a.w < r.d GROUP BY a.dst) SELECT node, d FROM p ORDER BY d, node LIMIT 40")
def _(c):
    return R.closest_nodes(c.net, 60, 40)


# -- range counts and estimates


@query("network_range_count", DIST + "SELECT q.qset, q.qi, count(pd.pt_id) AS n FROM queries q LEFT JOIN pd ON pd.qi = q.qi AND pd.d <= 700 GROUP BY q.qset, q.qi")
def _(c):
    return E.range_count(c.net, c.queries, 700)


@query("euclid_range_count", NET + "SELECT q.qset, q.qi, count(p.pt_id) AS n FROM qxy q LEFT JOIN pxy p ON sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 500 GROUP BY q.qset, q.qi")
def _(c):
    return E.euclid_range_count(N.with_xy(c.net.points, c.net), c.queries_xy, 500)


@query("distance_ranks", DIST + "SELECT qset, qi, d, row_number() OVER (PARTITION BY qset, qi ORDER BY d, pt_id) AS y FROM pd WHERE d <= 700")
def _(c):
    return E.cumulative(E.point_distances(c.net, c.queries, 700))


_FIT = DIST + ", cdf AS (SELECT qset, qi, d, row_number() OVER (PARTITION BY qset, qi ORDER BY d, pt_id) AS y FROM pd WHERE d <= 900), smp AS (SELECT qi, ln(d) AS x, ln(y) AS ly FROM cdf WHERE d > 0) "


def _samples(c):
    cdf = E.cumulative(E.point_distances(c.net, c.queries, 900))
    return cdf.filter("d > 0").select("qi", F.log("d").alias("x"), F.log(F.col("y").cast("double")).alias("ly"))


@query("power_fit", _FIT + "SELECT qi, round(regr_intercept(ly, x), 5) AS a, round(regr_slope(ly, x), 5) AS b FROM smp GROUP BY qi")
def _(c):
    return E.power_fit(_samples(c), "qi").select("qi", *at("a", "b", digits=5))


@query("trimmed_fit", _FIT + ", lim AS (SELECT qi, min(x) + 0.2 * (max(x) - min(x)) AS lo, max(x) - 0.2 * (max(x) - min(x)) AS hi FROM smp GROUP BY qi) SELECT qi, round(regr_intercept(ly, x), 5) AS a, round(regr_slope(ly, x), 5) AS b, round(corr(ly, x), 5) AS r FROM smp JOIN lim USING (qi) WHERE x BETWEEN lo AND hi GROUP BY qi")
def _(c):
    return E.trimmed_fit(_samples(c), "qi").select("qi", *at("a", "b", "r", digits=5))


@query("thinned_samples")
def _(c):
    return E.thinned(E.cumulative(E.point_distances(c.net, c.queries, 900)))


@query("polynomial_fit")
def _(c):
    return E.polynomial_fit(E.cumulative(E.point_distances(c.net, c.queries, 900)))


@query("fitted_estimates", _FIT + ", f AS (SELECT qi, regr_intercept(ly, x) AS a, regr_slope(ly, x) AS b FROM smp GROUP BY qi) SELECT qi, trunc(exp(a + b * ln(500))) AS est FROM f")
def _(c):
    return E.power_fit(_samples(c), "qi").select("qi", S.power_law(F.lit(500.0), F.col("a"), F.col("b")).cast("double").alias("est"))


@query("estimates")
def _(c):
    return E.estimate(c.net, E.random_nodes(c.net, 30), E.choose_anchors(c.net, 8), 500, 900)


@query("estimate_errors")
def _(c):
    got = E.estimate(c.net, E.random_nodes(c.net, 30), E.choose_anchors(c.net, 8), 500, 900).checkpoint()
    return E.errors(got, "lpl").withColumn("of", F.lit("lpl")).unionByName(E.errors(got, "poly").withColumn("of", F.lit("poly"))).unionByName(E.errors(got, "opt").withColumn("of", F.lit("opt")))


@query("box_counts", NET + "SELECT s, round(ln(sum(n * n)), 9) AS ly FROM (SELECT s, floor(x / s) AS cx, floor(y / s) AS cy, count(*) AS n FROM pxy, (SELECT unnest([50.0, 100.0, 200.0, 400.0]) AS s) GROUP BY ALL) GROUP BY s")
def _(c):
    return E.box_counts(N.with_xy(c.net.points, c.net), [50, 100, 200, 400]).select(F.round(F.exp("x"), 6).alias("s"), *at("ly", digits=9))


# -- generators (seeded; rows only)


@query("mean_step", NET + "SELECT round(0.4 * avg(w), 9) AS step FROM edges")
def _(c):
    return c.spark.createDataFrame([(round(R.mean_step(c.net, 0.4), 9),)], "step double")


@query("spaced_points")
def _(c):
    return R.spaced_points(c.net, 60)


@query("carried_points")
def _(c):
    return R.carried_points(c.net, 60)


@query("clustered_points")
def _(c):
    return R.clusters(c.net, 6, 50, 8)


@query("generated_queries")
def _(c):
    return R.queries_within(c.net, 8, 0.04)


# -- the same group search in more dimensions


@query("embedding_group_nn", "WITH q AS (SELECT vec_id AS qi, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT e.vec_id, sum(sqrt(list_sum(list_transform(list_zip(e.embedding, q.v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))) AS total FROM embeddings e, q GROUP BY e.vec_id) SELECT vec_id, round(total, 4) AS total FROM p ORDER BY total, vec_id LIMIT 10")
def _(c):
    all_ = c.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return U.vector_group_nearest(all_, all_.filter("vec_id % 50 = 0").select("v"), 10).select("vec_id", F.round("total", 4).alias("total"))  # the stated query set
