"""MinHash near-dedup with an LSH forest, confirmed on full shingle sets.

Rows with equal shingle sets collapse to one node (a hash of the set), so exact copies cost nothing
further. A node's signature is ``HASHES`` minima. Each tree of the forest is one sorted order of all
nodes: by the signature read from position tree * STRIDE on (cyclically), of which ``DEEPEST`` places
take part in the order. Neighbours in an order have a longest common prefix; successive neighbours
that share ``SHALLOWEST`` places and more form a run, and nodes of a run are candidates. A run of over
``REGION`` nodes or ``REGION_SHINGLES`` shingles is cut where the common prefix of its neighbours is
shortest, again and again until each region fits, so depth adapts to the density of each region by
itself; what still agrees in all DEEPEST places is cut, in that order, into windows that overlap by
half. Orders are dealt by ranges, so a dense stretch is as many tasks as its size asks for. Within a
region, signatures split nodes that are clearly unlike.

What the forest joins is a loose cluster; all nodes of a run that was cut, be it by depth or by the
end of a range, are one cluster through a hub of their prefix. Full sets are then compared exactly:
within the whole cluster if it fits a cell, otherwise within each of its regions in every tree first,
and then, for links between what that left apart, by ``rest_cells``: linked sets must share one of
their rarest shingles, and every such meeting of two components is a cell. So no link is lost, in
clusters of any size, but those that no tree proposes (probability (1 - s**3)**16 for a pair at
similarity s, under 3e-7 at 0.85) and those whose signatures agree ``MARGIN`` standard errors too little.

Nodes, clusters, shingles and roots that hold many rows are joined where those rows are (join_split).

Defined cases: null text and text without words have the empty set, are linked with nothing and form
their own component; texts under ``words`` words are one shingle; very long texts are read whole, and
one beyond REGION_SHINGLES is a region with its next neighbours alone; equal sets are linked whatever
the text; rows that repeat a doc_id are nodes by their own text; null doc_ids are never the smallest
unless alone; an empty table gives no rows; extra columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, hot_keys, join_split, pick, pieces, sealed, written
from .graph import components

HASHES, TREES = 64, 16
STRIDE = HASHES // TREES
SHALLOWEST, DEEPEST = 3, 16
REGION, REGION_SHINGLES = 2000, 3_000_000
#: Nodes of a run that a task holds; a longer run is cut as by the end of a range.
HELD = 100_000
#: Words whose hashes a task keeps: what it holds adds to what its worker has kept from other stages.
KNOWN = 200_000
#: Standard errors that a pair's signature estimate may lie under the threshold and still be compared.
MARGIN = 5.0
_U = np.uint64
_RNG = np.random.default_rng(90210)
_A = (_RNG.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        import xxhash

        own = text.lower().split()  # bytes: A-Z only, and the contract's white space only
        if not own:
            return np.zeros(0, _U)
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        ids = list(map(known.get, own))
        if None in ids:
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w, i in zip(own, ids, strict=True) if i is None)
            ids = [known[w] for w in own]
        return shingle_hashes(np.array(ids, _U), self.words)


def shingle_hashes(ids: np.ndarray, words: int) -> np.ndarray:
    n = min(words, len(ids))
    with np.errstate(over="ignore"):
        h = np.full(len(ids) - n + 1, n, _U)
        for k in range(n):
            h = (h ^ ids[k : len(ids) - n + 1 + k]) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
    return np.unique(h)


def _node(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) minima, 16 bits each, of non-empty sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    x = (np.concatenate(sets) >> _U(20)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), HASHES), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            low = np.minimum.reduceat(x * _A[k] + _B[k], starts)
            low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out[:, k] = (low >> np.uint32(16)).astype(np.uint16)
    return out


def shingled(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row, n (set size), node (hash of the set; null if empty), sig."""

    def run(batches):
        import pyarrow as pa

        shingle = Shingler(words)
        for batch in pieces(batches, 256):
            sets = [shingle(x) for x in as_bytes(batch.column("text"))]
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full) if full else ())
            sigs = [next(rows).tobytes() if len(s) else None for s in sets]
            nodes = [_node(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "row", "n", "node", "sig"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n long, node binary, sig binary")


class _Runs:
    """Cuts one range of the orders, given in successive pieces, into regions; ``part`` makes their numbers unique."""

    def __init__(self, part: int):
        self.next, self.held, self.edge = part << 40, None, True  # edge: the held run may begin in an earlier range or piece

    def _regions(self, common: np.ndarray, n: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
        """The ranges of a run that fit a region, cut where the common prefix with the one before is shortest."""
        found, open_ = [], [(low, high)]
        while open_:
            low, high = open_.pop()
            if high - low < 2:
                continue
            if high - low <= REGION and n[low:high].sum() <= REGION_SHINGLES:
                found.append((low, high))
                continue
            inner = common[low + 1 : high]
            least = inner.min()
            if least < DEEPEST:
                cuts = [low, *(np.flatnonzero(inner == least) + low + 1).tolist(), high]
                open_ += zip(cuts[:-1], cuts[1:], strict=True)
                continue
            halves, size, shingles = [low], 0, 0
            for k in range(low, high):
                if size and (size >= max(1, REGION // 2) or shingles + n[k] > REGION_SHINGLES // 2):
                    halves.append(k)
                    size, shingles = 0, 0
                size, shingles = size + 1, shingles + n[k]
            ends = [*halves[1:], high]
            found += [(a, b) for a, b in zip(halves, ends[1:] or ends, strict=False)]
        return found

    def _out(self, rows: tuple, runs: list[tuple[int, int, bool]]):
        """Members (tree, region, node) and, of runs that are cut, (node, hub)."""
        tree, place, node, n, common = rows
        members, edges = [], []
        for low, high, cut in runs:
            regions = self._regions(common, n, low, high)
            for a, b in regions:
                members.append((np.arange(a, b), np.full(b - a, self.next)))
                self.next += 1
            if cut or regions != [(low, high)] and high - low > 1:
                hub = _node(b"hub %d " % tree[low] + place[low, :SHALLOWEST].tobytes())
                edges += [(node[k].tobytes(), hub) for k in range(low, high)]
        return members, edges

    def add(self, rows: tuple | None):
        """The members and edges that are certain after more rows (tree, place, node, n), or, with None, at the end."""
        if rows is not None:
            held = rows if self.held is None else tuple(np.concatenate(x) for x in zip(self.held, rows, strict=True))
        else:
            held, self.held = self.held, None
            if held is None:
                return None
        tree, place, node, n = held
        same = place[1:] == place[:-1]
        common = np.zeros(len(tree), np.int64)
        common[1:] = np.where(tree[1:] != tree[:-1], 0, np.where(same.all(1), DEEPEST, same.argmin(1)))
        starts = np.flatnonzero(common < SHALLOWEST)
        if not len(starts) or starts[0]:
            starts = np.concatenate([[0], starts])
        ends = np.append(starts[1:], len(tree))
        first, edge = True, self.edge
        if rows is not None:  # the last run may go on
            last = int(starts[-1])
            if len(tree) - last <= HELD:
                self.held, self.edge = tuple(x[last:] for x in held), edge and last == 0
                starts, ends = starts[:-1], ends[:-1]
                cut_last = False
            else:
                self.held, self.edge, cut_last = None, True, True
        else:
            cut_last = True
        several = ends - starts > 1
        runs = []
        for k in np.flatnonzero(several | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)):
            cut = (edge and k == 0) or (cut_last and k == len(starts) - 1)
            if several[k] or cut:
                runs.append((int(starts[k]), int(ends[k]), bool(cut)))
        return node, tree, *self._out((tree, place, node, n, common), runs)


def _forest(batches):
    """tree, region, node of the regions, and node, hub of cut runs, of one range of rows in order."""
    import pyarrow as pa
    from pyspark import TaskContext

    runs = _Runs(TaskContext.get().partitionId())

    def emitted(got):
        if got is None:
            return
        node, tree, members, edges = got
        if members:
            at, region = (np.concatenate(x) for x in zip(*members, strict=True))
            nodes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(node[at].tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(tree[at], pa.int32()), pa.array(region, pa.int64()), nodes, pa.nulls(len(at), pa.binary())], names=["tree", "region", "node", "hub"])
        if edges:
            none = len(edges)
            yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), *[pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)]], names=["tree", "region", "node", "hub"])

    for batch in batches:
        if batch.num_rows:
            place = np.frombuffer(b"".join(batch.column("place").to_pylist()), np.uint16).reshape(-1, DEEPEST)
            node = np.frombuffer(b"".join(batch.column("node").to_pylist()), "V16")
            yield from emitted(runs.add((batch.column("tree").to_numpy(), place, node, batch.column("n").to_numpy())))
    yield from emitted(runs.add(None))


def regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tree, region, node: every region of two or more nodes. nodes: node, n, sig. Also (a, b): from each node of a run that was cut to the run's hub."""
    twice = F.concat("sig", "sig")
    trees = nodes.select("node", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    places = trees.select("tree", F.substring(twice, F.col("tree") * (2 * STRIDE) + 1, F.lit(2 * DEEPEST)).alias("place"), "node", "n")
    order = ["tree", "place", "node"]
    ranged = places.repartitionByRange(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(_forest, "tree int, region long, node binary, hub binary"), "regions")
    return found.filter("hub is null").select("tree", "region", "node"), found.filter("hub is not null").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _grouped(batches, key: str):
    """Successive tables of equal key from sorted batches."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        values = keys.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[-1].column(key)[0].as_py() != part.column(key)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _stars(n: int, near) -> list[tuple[int, int]]:
    """Edges (member, first of its component) of n items; near(i, rest) says which of rest are linked with i."""
    rest, edges = np.arange(n), []
    while len(rest) > 1:
        root, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            new = rest[hit]
            rest = rest[~hit]
            edges += [(int(i), int(root)) for i in new]
            queue += new.tolist()
    return edges


def _edge_batch(edges):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])


def loose_edges(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges between nodes of a region whose signatures agree in at least ``threshold`` of their places, directly or over others."""

    def run(batches):
        edges = []
        for table in _grouped(batches, "region"):
            ids = table.column("node").to_pylist()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            found = _stars(len(ids), lambda i, rest, sig=sig: (sig[rest] == sig[i]).mean(1) >= threshold)
            edges += [(ids[i], ids[j]) for i, j in found]
            if len(edges) > 50_000:
                yield _edge_batch(edges)
                edges = []
        if edges:
            yield _edge_batch(edges)

    rows = members.join(nodes.select("node", "sig"), "node").select("region", "node", "sig")
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "a binary, b binary")


def exact_edges(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a cell's nodes: 100 * intersection >= percent * union, on full sets. cells: cell, node, shingles (sorted, as bytes)."""

    def run(batches):
        edges = []
        for table in _grouped(batches, "cell"):
            ids = table.column("node").to_pylist()
            sets = [np.frombuffer(x, _U) for x in table.column("shingles").to_pylist()]
            order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
            ids, sets = [ids[i] for i in order], [sets[i] for i in order]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            shingles, flat = np.unique(np.concatenate(sets), return_inverse=True)
            starts, flag = np.cumsum(sizes) - sizes, np.zeros(len(shingles), np.int32)

            def near(i, rest, sizes=sizes, starts=starts, flat=flat, flag=flag):
                hit = np.zeros(len(rest), bool)
                able = np.flatnonzero((100 * np.minimum(sizes[rest], sizes[i])) >= percent * np.maximum(sizes[rest], sizes[i]))
                if not len(able):
                    return hit
                own = flat[starts[i] : starts[i] + sizes[i]]
                flag[own] = 1
                them = rest[able]
                ends = np.cumsum(sizes[them])
                spot = np.repeat(starts[them] - ends + sizes[them], sizes[them]) + np.arange(ends[-1])
                both = np.add.reduceat(flag[flat[spot]], ends - sizes[them])
                flag[own] = 0
                hit[able] = 100 * both >= percent * (sizes[them] + sizes[i] - both)
                return hit

            edges += [(ids[i], ids[j]) for i, j in _stars(len(ids), near)]
            if len(edges) > 50_000:
                yield _edge_batch(edges)
                edges = []
        if edges:
            yield _edge_batch(edges)

    return cells.select("cell", "node", "shingles").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """node (hash of the set), shingles of docs (text)."""

    def run(batches):
        import pyarrow as pa

        shingle = Shingler(words)
        for batch in pieces(batches, 256):
            sets = [x for x in (shingle(t).tobytes() for t in as_bytes(batch.column("text"))) if x]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node binary, shingles binary")


def _exploded(batches):
    """root, node, comp, n, shingle for each shingle of a set."""
    import pyarrow as pa

    for batch in pieces(batches, 64):
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        spot = pa.array(np.repeat(np.arange(len(sets)), sizes))
        rest = [batch.column(c).take(spot) for c in ("root", "node", "comp")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets))], names=["root", "node", "comp", "n", "shingle"])


def rest_cells(open_: DataFrame, percent: int) -> DataFrame:
    """cell, node: cells that hold the ends of every link between different components of a cluster. open_: root, node, comp, shingles.

    In any one order of a cluster's shingles, two sets of the similarity share one of their first n - ceil(percent * n / 100) + 1;
    the order is by rarity, so these meet few. A meeting within one component needs no cell, meetings of the same nodes need one.
    A meeting too large for a cell is dealt in blocks: the nodes outside its largest component against all of it.
    """
    small = open_.select(F.xxhash64("root").alias("root"), F.xxhash64("node").alias("node"), F.xxhash64("comp").alias("comp"), "shingles")
    rows = small.mapInArrow(_exploded, "root long, node long, comp long, n long, shingle long")
    rows = rows.select(F.xxhash64("root", "shingle").alias("key"), "node", "comp", "n")
    often = written(rows.groupBy("key").agg(F.count("*").alias("often")), "often")
    ranked = join_split(rows, often, ["key"], hot_keys(often, ["key"], "often")).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("often", "key")))
    first = ranked.filter((F.col("rank") <= F.expr(f"n - ({percent} * n + 99) div 100 + 1")) & (F.col("often") > 1))
    first = written(first.select("key", "node", "comp", "n"), "rarest")
    held = first.groupBy("key", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.bit_xor("node").alias("x"), F.sum(F.shiftright("node", 32)).alias("s"))
    meets = held.groupBy("key").agg(
        F.count("*").alias("comps"), F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"),
        F.max(F.struct("size", "shingles")).alias("top"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"), F.sum("size").alias("rows"),
    ).filter("comps > 1").dropDuplicates(["size", "shingles", "x", "s"])
    fits = (F.col("size") <= REGION) & (F.col("shingles") <= REGION_SHINGLES)

    def blocks(size, shingles):
        return F.greatest(F.lit(1), F.ceil(size * 2 / REGION), F.ceil(shingles * 2 / REGION_SHINGLES)).cast("int")

    top = [F.col("top.size"), F.col("top.shingles")]
    meets = meets.select("key", "rows", "main", F.when(fits, 0).otherwise(blocks(*top)).alias("mains"), blocks(F.col("size") - top[0], F.col("shingles") - top[1]).alias("others"))
    meets = written(meets, "meets")
    cells = join_split(first, meets.drop("rows"), ["key"], hot_keys(meets, ["key"], "rows")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("comp") == F.col("main"), F.greatest("mains", F.lit(1))).otherwise(F.col("others"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    to_others = F.transform(every(F.col("others")), lambda o: F.xxhash64("key", F.lit("main"), "block", o))
    to_mains = F.transform(every(F.col("mains")), lambda m: F.xxhash64("key", F.lit("main"), m, "block"))
    among = F.transform(F.filter(every(F.col("others")), lambda o: o != F.col("block")), lambda o: F.xxhash64("key", F.lit("others"), F.least(o, "block"), F.greatest(o, "block")))
    dealt = F.when(F.col("mains") == 0, F.array(F.col("key"))).when(F.col("comp") == F.col("main"), to_others).otherwise(F.concat(to_mains, among))
    pairs = cells.select(F.explode(dealt).alias("cell"), F.col("node").alias("id"))
    return pairs.join(open_.select(F.xxhash64("node").alias("id"), "node"), "id").select("cell", "node")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, row (hash of the text)."""
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.xxhash64("text"))
    signed = written(shingled(rows, words), "signed")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
    nodes = written(nodes, "nodes")
    members, cut = regions(nodes)
    share = percent / 100
    loose = written(loose_edges(members, nodes, share - MARGIN * (share * (1 - share) / HASHES) ** 0.5).unionByName(cut), "loose")
    clusters = written(components(loose).join(nodes.select("node", "rep", "n"), "node"), "clusters")
    size = clusters.groupBy("root").agg(((F.count("*") <= REGION) & (F.sum("n") <= REGION_SHINGLES)).alias("fits"), F.count("*").alias("members"))
    size = written(size, "sizes")
    large = hot_keys(size, ["root"], "members")
    sized = join_split(clusters, size.select("root", "fits"), ["root"], large).select("node", "rep", "root", "fits")
    whole = sized.filter("fits").select(F.xxhash64("root").alias("cell"), "node")
    split = members.join(sized.filter("not fits").select("node", "root"), "node").select(F.xxhash64("region", "tree", "root").alias("cell"), "node")
    # Rows with a node's smallest doc_id; the set's own hash says whose set it is, should rows of other texts repeat that doc_id.
    def sets(of: DataFrame) -> DataFrame:
        wanted = of.select(F.col("rep").alias("id")).distinct()
        return _sets(rows.join(wanted, rows.doc_id.eqNullSafe(wanted.id), "left_semi"), words).dropDuplicates(["node"])

    links = written(exact_edges(whole.unionByName(split).join(sets(clusters), "node"), percent), "links")
    joined = written(components(links), "joined")
    apart = sized.filter("not fits").join(joined.select("node", F.col("root").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = apart.groupBy("root").agg((F.min("comp") != F.max("comp")).alias("several")).filter("several").select("root")
    apart = written(join_split(apart, several, ["root"], large).select("root", "node", "comp", "rep"), "apart")
    if not apart.isEmpty():
        open_ = written(apart.join(sets(apart), "node").select("root", "node", "comp", "shingles"), "open")
        more = exact_edges(rest_cells(open_, percent).join(open_.select("node", "shingles"), "node"), percent)
        known = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
        joined = written(components(known.unionByName(written(more, "more"))), "all-joined")
    least = joined.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("members"))
    least = written(least, "least")
    named = join_split(joined, least.select("root", "least"), ["root"], hot_keys(least, ["root"], "members")).select("node", "least")
    labels = written(nodes.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id")), "labels")
    copied = hot_keys(nodes, ["node"], "rows")
    out = join_split(signed.select("doc_id", "row", F.col("n").alias("n_shingles"), "node"), labels, ["node"], copied, "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, of which one of each group stays: that with the smallest doc_id, of rows that repeat it the one with the smallest text hash.

    Documents without words are all kept but for exact repeats of a row's doc_id and text.
    """
    docs, restored = sealed(docs, doc_id, text)
    groups = written(near_groups(docs, words, percent, doc_id, text).filter("kept"), "kept")
    linked = groups.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("k")).select("k.*")
    stay = written(linked.unionByName(groups.filter("n_shingles = 0").select("doc_id", "row").distinct()), "stay").toDF("_stay_id", "_stay_row")
    again = written(groups.groupBy("doc_id", "row").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    again = again.select(F.col("doc_id").alias("_again_id"), F.col("row").alias("_again_row"))
    same = F.col("_stay_id").eqNullSafe(F.col("_again_id")) & F.col("_stay_row").eqNullSafe(F.col("_again_row"))
    here = F.col(doc_id).cast("long").eqNullSafe(F.col("_stay_id")) & F.col("_row").eqNullSafe(F.col("_stay_row"))
    keyed = docs.withColumn("_row", F.xxhash64(F.col(text)))
    if again.isEmpty():
        return restored(keyed.join(stay, here, "left_semi"))
    kept = keyed.join(stay.join(again, same, "left_anti"), here, "left_semi")
    return restored(kept.unionByName(keyed.join(stay.join(again, same, "left_semi"), here, "left_semi").dropDuplicates([doc_id, "_row"])))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")
