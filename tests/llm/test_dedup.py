import hashlib
import random
import re

import numpy as np
import pytest

from netquarry.llm.exact_dedup import Snapshot, exact_dedup, group_entries, digest_rows, ingest
from netquarry.llm.graph import components
from netquarry.llm.line_dedup import LineState, dropped_lines, line_dedup, line_keys
from netquarry.llm import common, graph
from netquarry.llm import exact_dedup as exact_dedup_module
from netquarry.llm import near_dedup as ND

WS = re.compile(r"[\x20\x09-\x0D]")
WIDE = "doc_id long, text string, TEXT string, keep_id string, batch string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], WIDE)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "δέλτα", "\t", " ", "\n", " ", "x"]
    base = ["".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(n // 3)]
    return [(k, rng.choice([None, "", *base])) for k in range(n)]


def test_exact_dedup(spark):
    rows = [*texts(1, 120), (500, "a b" * 20000), (501, "ab" * 20000), (7, "again"), (7, "again"), (None, "again"), (None, "only null")]
    want = {}
    for i, t in rows:
        want.setdefault(WS.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    got = exact_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by[r.text_sha256] and r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup(table(spark, [])).count() == 0


def test_snapshot_screens(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(300)], "doc_id long, text string")
    rows = digest_rows(docs).checkpoint()
    snapshot = Snapshot.build(group_entries(rows.filter("doc_id < 200")), bucket_keys=40)
    assert snapshot.segments[0].filters.count() == snapshot.segments[0].buckets == 5
    screened = snapshot.screen(group_entries(rows))
    known = {r.keep_id for r in screened.filter("maybe").collect()}
    assert set(range(200)) <= known and len(known) < 215
    after, collided = ingest(snapshot, rows.filter("doc_id >= 150"), docs.select("doc_id", "text"))
    assert after.entries.count() == 300 and collided.isEmpty() and after.entries.filter("n = 2").count() == 50
    assert snapshot.entries.count() == 200 and len(after.segments) == 2 and after.segments[0] is snapshot.segments[0]


def test_snapshots_merge_their_segments(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup_module, "SEGMENTS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    rows = [(k, f"text {k % 9}" if k % 3 else "the same") for k in range(90)]
    got = exact_dedup(table(spark, rows), batches=4).collect()
    for r in got:
        same = [i for i, t in rows if t == dict(rows)[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), r.doc_id == min(same))


def brute_lines(rows):
    keys = lambda t: [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    held = {}
    for n, (i, t) in enumerate(rows):
        for k in set(keys(t)):
            if len(k) >= 20:
                held.setdefault(k, []).append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if not (k in held and len(held[k]) >= 3 and i < max(held[k]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def line_rows(seed, n=60):
    rng = random.Random(seed)
    pool = [f"this is a common line number {k} ééé" for k in range(6)] + ["short", "", " \r", "x" * 19, "ü" * 20, "ü" * 19]
    return [(k, rng.choice([None, "", "\n".join(rng.choice([x, x.upper().replace("É", "é").replace("Ü", "ü"), f"  {x}\t"]) for x in rng.choices(pool, k=rng.randint(1, 8)))])) for k in range(n)]


def test_line_dedup(spark):
    rows = [*line_rows(1), (900, "long line " * 20000)]
    got = line_dedup(table(spark, rows))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()) == brute_lines(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.collect())
    assert line_dedup(table(spark, [])).count() == 0


def test_line_state_is_reversible(spark):
    rows = line_rows(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    state = LineState.of(line_keys(docs.filter("doc_id < 30"))).insert(line_keys(docs.filter("doc_id >= 30")))
    gone = state.delete(docs.filter("doc_id % 3 = 0").select("doc_id"))
    left = [r for r in rows if r[0] % 3]
    got = dropped_lines(docs.filter("doc_id % 3 <> 0"), gone, texts=False)
    assert sorted(tuple(r) for r in got.collect()) == brute_lines(left)
    again = gone.insert(line_keys(docs.filter("doc_id % 3 = 0")))
    assert sorted(map(tuple, again.counts.collect())) == sorted(map(tuple, state.counts.collect()))
    screened = gone.screen(again.counts).collect()
    kept = {r.key for r in gone.counts.collect()}
    assert all(r.maybe for r in screened if r.key in kept) and sum(r.maybe for r in screened) <= len(kept) + 2


def test_null_doc_ids_are_deleted_too(spark):
    same = "the same long line in all documents"
    rows = [(None, f"{same}\nfirst line of a text without an id"), (None, same), (1, same), (2, f"{same}\nanother line of enough code points"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    state = LineState.of(line_keys(docs))
    gone = state.delete(docs.filter("doc_id is null").select("doc_id").limit(1))
    assert sorted((r.doc_id, r.key) for r in gone.refs.collect()) == sorted((r.doc_id, r.key) for r in line_keys(docs.filter("doc_id is not null")).collect())
    assert gone.repeated().count() == 0 and state.repeated().count() == 1
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_dropped) for r in dropped_lines(docs, state, texts=False).collect()))
    assert got == [(False, 1, 1), (False, 2, 0), (True, 0, 0), (True, 0, 1), (True, 0, 1)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute_near(rows, words, percent):
    sets = [shingle_set(t, words) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def near_rows(seed, n=240):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    bases = [[word() for _ in range(rng.choice([1, 2, 5, 40, 200]))] for _ in range(n // 8)]
    rows = [(0, None), (1, ""), (2, " \n")]
    for k in range(3, n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return rows


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_groups(spark, words, percent):
    rows = near_rows(words)
    got = ND.near_groups(table(spark, rows), words, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute_near(rows, words, percent)


def test_near_dense_regions_go_deeper(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(ND, "REGION", 30)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in ND.near_groups(table(spark, rows), 3, 85).collect())
    assert got == brute_near(rows, 3, 85)


@pytest.mark.parametrize("region", [10, 40])
def test_near_links_at_the_threshold_in_large_clusters(spark, monkeypatch, region):
    """Chains at the very threshold in one loose cluster of many times a region, with hot rare shingles: blocks and meetings."""
    rng = random.Random(31)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(240):
        w = list(base)
        own = random.Random(k // 12)
        for at in own.sample(range(0, 120, 4), 3):  # what a family shares
            w[at] = f"f{k // 12}" if k % 5 else f"f{k // 24}"
        for at in rng.sample(range(120), rng.randint(1, 3)):
            w[at] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(ND, "REGION", region)
    want = brute_near(rows, 3, 85)
    assert 1 < len({c for _, _, c, _ in want}) < 200
    got = ND.near_groups(table(spark, rows), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


@pytest.mark.parametrize("region,held", [(3, 5), (4, 1000), (1000, 7)])
def test_runs_of_an_order(monkeypatch, region, held):
    """Neighbours with a long common prefix share a region, or a hub where their run was cut; regions fit; others never meet."""
    monkeypatch.setattr(ND, "REGION", region)
    monkeypatch.setattr(ND, "HELD", held)
    rng = np.random.default_rng(region)
    place = np.sort(rng.integers(0, 2, (400, ND.DEEPEST)).astype(np.uint16).view([("", np.uint16)] * ND.DEEPEST), axis=0).view(np.uint16).reshape(400, -1)
    place[:, :2] += (np.arange(400)[:, None] // 40).astype(np.uint16)
    tree = (np.arange(400) // 200).astype(np.int32)
    node = np.array([ND._node(b"%d" % k) for k in range(400)], "V16")
    runs, regions, hubs = ND._Runs(3), {}, {}
    for at in [*range(0, 400, 23), None]:
        got = runs.add(None if at is None else (tree[at : at + 23], place[at : at + 23], node[at : at + 23], np.ones(min(23, 400 - at), np.int64)))
        if got:
            for spots, number in got[2]:
                for k, r in zip(spots, number, strict=True):
                    regions.setdefault(int(r), []).append(got[0][k].tobytes())
            for a, hub in got[3]:
                hubs.setdefault(a, set()).add(hub)
    of = {}
    for r, members in regions.items():
        assert 1 < len(members) <= region and len(set(members)) == len(members)
        for m in members:
            of.setdefault(m, set()).add(r)
    for k in range(399):
        a, b = node[k].tobytes(), node[k + 1].tobytes()
        near = tree[k] == tree[k + 1] and (place[k, : ND.SHALLOWEST] == place[k + 1, : ND.SHALLOWEST]).all()
        assert bool(of.get(a, set()) & of.get(b, set()) or hubs.get(a, set()) & hubs.get(b, set())) or not near
        if not near:
            assert not of.get(a, set()) & of.get(b, set())


def test_near_groups_of_nulls_and_very_long_texts(spark, monkeypatch):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(None, "one two three four"), (None, "one two three four"), (None, None), (8, long), (9, long + " more"), (10, long[:9000]), (11, "One two THREE four"), (12, ""), (12, None)]
    monkeypatch.setattr(ND, "REGION_SHINGLES", 20_000)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in ND.near_groups(table(spark, rows), 3, 85).collect())
    assert got == [(False, 0, 0, None, True), (False, 0, 2, 11, False), (False, 0, 2, 11, False), (True, 8, 29998, 8, True), (True, 9, 29999, 8, False), (True, 10, len(long[:9000].split()) - 2, 10, True), (True, 11, 2, 11, True), (True, 12, 0, 12, True), (True, 12, 0, 12, True)]


def test_hot_keys_are_joined_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    left = spark.createDataFrame([(k % 7 if k % 2 else 1, k) for k in range(200)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(5)], "k long, r string")
    hot = common.hot_keys(left.groupBy("k").count(), ["k"], "count")
    assert {r.k for r in hot.collect()} == set(range(7)) and common.hot_keys(left.limit(0).groupBy("k").count(), ["k"], "count") is None
    few = spark.createDataFrame([(1,)], "k long")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
        assert sorted(map(tuple, common.join_split(left, right, ["k"], few, how).collect()), key=str) == want


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    monkeypatch.setattr(common, "HOT_KEYS", 50)
    edges = [(500, k) for k in range(100, 200)] + [(k, 1000 + k) for k in range(100, 150)] + [(7, 500), (2000, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 2000 if n in (2000, 2001) else 7 for e in edges for n in e}


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (2, "A b c d e f g"), (9, "other words here now yes"), (9, "other words here now yes"), (5, None), (6, "")]
    got = ND.keep_one(table(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == [2, 5, 6, 9] and got.columns == table(spark, rows).columns
    assert ND.near_groups(table(spark, [])).count() == 0


def test_components_end_once_edges_are_stars(spark, monkeypatch):
    tables, scratch = [], graph.scratch
    monkeypatch.setattr(graph, "scratch", lambda *a: tables.append(a) or scratch(*a))
    stars = spark.createDataFrame([(i, i % 3) for i in range(3, 30)], "a long, b long")
    got = {r.node: r.root for r in components(stars).collect()}
    assert got == {i: i % 3 for i in range(30)}
    assert len(tables) == 1  # the edges themselves; two more a round
    tables.clear()
    off_centre = spark.createDataFrame([(9, i) for i in range(9)], "a long, b long")
    assert {r.node: r.root for r in components(off_centre).collect()} == dict.fromkeys(range(10), 0)
    assert len(tables) == 3
    assert components(stars.limit(0)).count() == 0


def test_shingler_forgets_words():
    shingle = ND.Shingler(3)
    want = shingle(b"some words that stay")
    for k in range(60):
        shingle(b" ".join(b"w%d" % i for i in range(k * 5000, (k + 1) * 5000)))
        assert len(shingle.known) <= ND.KNOWN + 5000 and ND.KNOWN <= 200_000
    assert (shingle(b"SOME words that stay") == want).all()
