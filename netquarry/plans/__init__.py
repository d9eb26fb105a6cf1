"""Choice of a physical strategy for aggregate nearest neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import ann as _ann
from ..operators import search as _search
from ..operators.distances import LOCAL_EDGES
from ..sources.network import Network

#: Ways to search a broadcast network, one task a group.
LOCAL_WAYS = ("expand", "refine", "threshold")


@dataclass(frozen=True)
class Plan:
    """distance: local or frame; search: expand, refine or threshold (local, they stop early), full (all distances), concurrent (growing radius) or filtered (Euclidean filter); straight: whether straight lines bound distances."""

    distance: str
    search: str
    reason: str
    straight: bool = True


def choose(net: Network, euclidean: bool = True) -> Plan:
    """By the counted edges and points: a network that fits a worker is searched there as far as the answer asks; a larger one by joins, as far as a growing radius asks.

    euclidean: weights are at least straight lines. Otherwise no bound uses them.
    """
    if _search.fits(net):
        return Plan("local", "expand", f"at most {LOCAL_EDGES} edges and {_search.LOCAL_POINTS} points", euclidean)
    return Plan("frame", "concurrent", f"over {LOCAL_EDGES} edges or {_search.LOCAL_POINTS} points", euclidean)


def ann(net: Network, queries: DataFrame, k: int = 10, agg: str = "sum", weights: bool = False, mode: str = "point", strategy: str = "auto", search: str | None = None, euclidean: bool = True) -> DataFrame:
    """The k best points (mode point: qset, rank, pt_id, ni, nj, pos, agg_dist, comp) or the best place (mode center: qset, ni, nj, pos, agg_dist) for each group of queries."""
    plan = choose(net, euclidean) if strategy == "auto" else Plan(strategy, search or ("expand" if strategy == "local" else "full"), "asked for", euclidean)
    way = search or plan.search
    if mode == "center":
        if plan.distance == "local" and way != "full":
            return _search.center_search(net, queries, agg, weights, euclidean).select("qset", "ni", "nj", "pos", "agg_dist")
        return _ann.center(net, queries, agg, weights, strategy=plan.distance)
    if mode != "point":
        raise ValueError(f"mode is point or center, not {mode}")
    if way in LOCAL_WAYS:
        return _search.ann_search(net, queries, k, agg, weights, way, euclidean).select("qset", "rank", "pt_id", "ni", "nj", "pos", "agg_dist", "comp")
    if way == "filtered" and not euclidean:
        raise ValueError("the Euclidean filter needs weights of at least the straight line")
    how = {"full": _ann.ann_points, "concurrent": _ann.ann_concurrent, "filtered": _ann.ann_filter_refine}[way]
    return how(net, queries, k, agg, weights, strategy=plan.distance)
