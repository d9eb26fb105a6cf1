"""Small networks and a plain reference search for the tests."""

import heapq
import random


def network(spark, edges, points=(), coords=None):
    from netquarry.sources.network import Network

    ids = sorted({n for e in edges for n in e[:2]})
    coords = coords or {n: (float(k), 0.0) for k, n in enumerate(ids)}
    nodes = spark.createDataFrame([(n, *map(float, coords[n])) for n in coords], "node_id long, x double, y double")
    e = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "ni long, nj long, w double")
    p = spark.createDataFrame([(k, a, b, float(o)) for k, (a, b, o) in enumerate(points)], "pt_id long, ni long, nj long, pos double")
    return Network(nodes, e, p)


def group(spark, rows):
    """rows: (qset, qi, ni, nj, pos[, weight])."""
    return spark.createDataFrame([(*r[:4], float(r[4]), float(r[5]) if len(r) > 5 else 1.0) for r in rows], "qset long, qi long, ni long, nj long, pos double, weight double")


def search(edges, ni, nj, pos):
    """Distances to all nodes from a place, by plain Dijkstra."""
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    w = next(w for a, b, w in edges if (a, b) == (ni, nj))
    done, heap = {}, [(pos, ni), (w - pos, nj)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in done:
            done[n] = d
            for m, v in adj[n]:
                heapq.heappush(heap, (d + v, m))
    return done


def place_distance(edges, q, p):
    """Distance from a place q to a place p, both (ni, nj, pos); None if unreachable."""
    done = search(edges, *q)
    w = next(w for a, b, w in edges if (a, b) == (p[0], p[1]))
    found = [done[n] + x for n, x in ((p[0], p[2]), (p[1], w - p[2])) if n in done]
    if q[:2] == p[:2]:
        found.append(abs(q[2] - p[2]))
    return min(found) if found else None


def random_network(seed, n=30, extra=25, points=60):
    """Connected, weights at least the straight length, all numbers multiples of 0.25."""
    rng = random.Random(seed)
    coords = {k: (rng.randint(0, 200), rng.randint(0, 200)) for k in range(n)}
    edges = {}
    for k in range(1, n):
        edges[(rng.randrange(k), k)] = 0
    while len(edges) < n - 1 + extra:
        a, b = sorted(rng.sample(range(n), 2))
        edges[(a, b)] = 0
    out = []
    for a, b in sorted(edges):
        (x1, y1), (x2, y2) = coords[a], coords[b]
        out.append((a, b, float(abs(x1 - x2) + abs(y1 - y2) + rng.randint(1, 20))))
    pts = []
    for _ in range(points):
        a, b, w = rng.choice(out)
        pts.append((a, b, rng.randint(0, int(w * 4)) / 4))
    return coords, out, pts
