"""Mixing sources to target weights by the cube method (Deville and Tille, 2004).

Each source has a target number of words; a document is taken floor(target / source_size) times for
sure and once more with the fractional rest as its inclusion probability. The flight phase moves
these probabilities through the null space of two balancing constraints for each source, words and
documents, until they are 0 or 1. It decides the largest documents first: a step moves the largest
undecided one and, against it, all smaller ones of its block a little, along the projection that
changes neither total; where the smaller ones cannot offset a document in both totals, words alone
are balanced. Blocks are of bounded size (by a hash within each source, so a source with a third of
all documents is many blocks); each leaves at most two of its smallest documents undecided, which
meet in the next level's blocks, until one block a source is left. The landing problem of the at most
two that remain there is solved by giving up the document total, then by one draw. Every step and
the draw keep expectations, so each document is taken with its inclusion probability, and the words
taken differ from the target by less than one of the smallest documents, unless a document is longer
than all others of its source can offset. A source of one block whose words a draw misses by over
``NEAR`` (a few documents of very unlike sizes) is drawn again, at most ``DRAWS`` times, and the
nearest draw counts: there nearness goes before exact probabilities. Random numbers come from
the seed, source, level and block alone, so reruns agree whatever the partitioning.

Rows that are equal in doc_id, source and size are one unit with a count: their sure copies and one
fractional rest, dealt to them in any order, so no number of repeats (null doc_ids, say) makes a
block larger.

Defined cases: null text has size 0; documents of size 0 are taken 0 times; very long texts are
counted whole; a null source is a source of its own, last in order; repeated rows are documents of
their own; a source without words has target 0; ties in size go by a hash of doc_id; sources that tie
in the level of their cap are capped together; an empty table gives no rows; extra columns, also with
clashing names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, filesystem, pick, pieces, scratch, sealed, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK = 2048
#: The share of its words by which the draw of a small source may miss them, and how often it is drawn at most (less often in larger blocks).
NEAR, DRAWS = 0.01, 64
#: Equal rows that one task lists at a time.
REPEATS = 10_000
#: Rows of a file, in a stretch, whose copies are looked up together.
SLOT_ROWS = 1 << 16
SEED = 20240607
_EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words between the contract's white space) of docs (doc_id, source, text)."""

    def count(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            n = [len(x.split()) for x in as_bytes(batch.column("text"))]  # bytes.split: space and U+0009 to U+000D
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "size"])

    return docs.select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, size long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, docs, source_size, target: share of all words by weight, no source above most times its size.

    The repeated resharing of what is above has a closed form: with sources by rising cap / weight, those whose cap lies under the level
    that is left for the rest are capped, and the rest get weight times that level. Its windows are over one row for each source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("live"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    caps = ranked.withColumn("w", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(rising), F.lit(0.0)))
    levels = caps.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    final = F.max(F.when(F.col("free"), F.col("level"))).over(whole)
    return levels.select("source", "docs", "live", "source_size", F.when(F.col("free"), F.least(F.col("w") * final, F.col("cap"))).otherwise(F.col("cap")).alias("target"))


def _direction(s: np.ndarray, q: np.ndarray, both: bool) -> np.ndarray | None:
    """The move of the undecided (sizes s, probabilities q; the first by 1) that keeps the words and, if both, the number of documents; None if the others cannot offset the first.

    Of all such moves that with the least squares over q * (1 - q), so what is nearly decided moves least.
    """
    rest, w = s[1:], q[1:] * (1 - q[1:])
    if not len(rest):
        return None
    if not both:
        own = w * rest
        return np.concatenate([[1.0], -s[0] / (own @ rest) * own])
    whole = w.sum()
    mean = (w @ rest) / whole
    apart = rest - mean
    own = w * apart
    spread, gap = own @ apart, mean - s[0]
    flat = spread <= _EPS * whole * max(s[0], 1.0) ** 2
    if flat and abs(gap) > _EPS * max(s[0], 1.0):
        return None
    return np.concatenate([[1.0], -w / whole + (0.0 if flat else gap / spread * own)])


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, docs: bool = True) -> np.ndarray:
    """Probabilities after the flight phase, largest documents first: sum(p * size) is kept and each p in expectation, at most two (without docs: one) are left between 0 and 1.

    sum(p) is kept too with docs, but for steps in which the smaller documents could not offset the largest in both.
    """
    p = np.asarray(p, float).copy()
    live = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    live = live[np.argsort(-size[live], kind="stable")]
    s, q = size[live].astype(float), p[live]

    def ways(u):
        """How far along u and against it until some probability is 0 or 1, and whether that is the first's."""
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf))
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf))
        return up.min(), down.min(), min(up[0], down[0]) <= max(up.min(), down.min()) * (1 + _EPS)

    while len(q) > (2 if docs else 1):
        move = _direction(s, q, docs)
        found = ways(move) if move is not None else None
        if docs and (found is None or not found[2]):
            alone = _direction(s, q, False)
            other = ways(alone)
            if found is None or other[2]:
                move, found = alone, other
        up, down, _ = found
        q = q + (up if rng.random() * (up + down) < down else -down) * move
        stay = (q > _EPS) & (q < 1 - _EPS)
        if stay.all():  # rounding: the nearest to a border is decided
            near = int(np.argmin(np.minimum(q, 1 - q)))
            stay[near] = False
        p[live[~stay]] = (q[~stay] > 0.5).astype(float)
        live, s, q = live[stay], s[stay], q[stay]
    p[live] = q
    return p


def landing(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All decided: what the flight left goes on with words alone, and the last one is drawn."""
    p = flight(size, p, rng, docs=False)
    left = np.flatnonzero((p > 0) & (p < 1))
    p[left] = (rng.random(len(left)) < p[left]).astype(float)
    return p


def nearest(size: np.ndarray, p: np.ndarray, drawn: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``drawn`` if its words are within NEAR of their expectation, otherwise the nearest of some draws more."""
    want = p @ size
    for _ in range(min(DRAWS, DRAWS * 256 // max(1, len(size)))):
        if abs(drawn @ size - want) <= NEAR * want:
            break
        more = landing(size, flight(size, p, rng), rng)
        if abs(more @ size - want) < abs(drawn @ size - want):
            drawn = more
    return drawn


def _seed(*what) -> int:
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=8).digest(), "little")


def _settler(seed: int, level: int):
    def settle(pdf):
        import pandas as pd

        source, own = pdf["source"].iloc[0], int(pdf["block"].iloc[0])
        source = None if pd.isna(source) else source
        tie = pd.util.hash_array(pdf["doc_id"].astype("float64").fillna(-0.5).to_numpy(), categorize=False)
        pdf = pdf.assign(tie=tie).sort_values(["size", "tie", "doc_id", "p"], ascending=[False, True, True, True], kind="stable")
        size = pdf["size"].to_numpy(np.float64)
        rng = np.random.default_rng(_seed(seed, source, level, own))
        chance = pdf["p"].to_numpy(np.float64)
        p = flight(size, chance, rng)
        if int(pdf["blocks"].iloc[0]) == 1:
            p = landing(size, p, rng)
            if level == 0:  # the whole source
                p = nearest(size, chance, p, rng)
        return pdf.assign(p=p)[["doc_id", "source", "size", "p"]]

    return settle


def cube(units: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """units: doc_id, source, size (together unique), p. Returns doc_id, source, size, extra (0 or 1), balanced on words and documents within each source."""
    state, done, level = units.select("doc_id", "source", "size", "p"), None, 0
    while True:
        counts = state.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("of"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        salted = state.join(written(counts, "blocks"), F.col("source").eqNullSafe(F.col("of")), "inner")
        salted = salted.select("doc_id", "source", "size", "p", "blocks", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + level)), F.col("blocks")).cast("int").alias("block"))
        moved = written(salted.groupBy("source", "block").applyInPandas(_settler(seed, level), "doc_id long, source string, size long, p double"), "cube")
        decided = moved.filter("p = 0 or p = 1").select("doc_id", "source", "size", F.col("p").cast("int").alias("extra"))
        done = decided if done is None else done.unionByName(decided)
        state, level = moved.filter("p > 0 and p < 1"), level + 1
        if state.isEmpty():
            return done


def _listed(units: DataFrame) -> DataFrame:
    """One row for each of a unit's ``n`` rows (doc_id, source, size, n, all): the first ``all % n`` get a copy more. Units of many rows are cut before they are listed."""
    cut = units.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long"))))
    many = cut.filter(F.col("n") > REPEATS).repartition("doc_id", "source", "size", "from")
    rows = cut.filter(F.col("n") <= REPEATS).unionByName(many)
    no = F.explode(F.sequence("from", F.least(F.col("from") + REPEATS, F.col("n")) - 1))
    return rows.withColumn("no", no).withColumn("copies", F.floor(F.col("all") / F.col("n")) + F.when(F.col("no") < F.col("all") % F.col("n"), 1).otherwise(0))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies (how often it is taken), taken (copies * size)."""
    rows = pick(docs, doc_id=doc_id, source=source, text=text)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("source", F.col("source").cast("string"))
    sized = written(sizes(rows), "sizes")
    aims = written(targets(sized, weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    rates = aims.select(F.col("source").alias("of"), "source_size", "target", ratio.alias("ratio"))
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    joined = units.join(rates, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("wish", F.when(F.col("size") > 0, F.col("n") * F.col("ratio")).otherwise(0.0))
    joined = joined.withColumn("sure", F.floor(F.col("wish") + _EPS)).withColumn("p", F.greatest(F.col("wish") - F.col("sure"), F.lit(0.0)))
    joined = written(joined, "units")
    drawn = cube(joined.filter(F.col("p") > _EPS), seed)
    extra = drawn.select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("size").alias("_size"), "extra")
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_of")) & (F.col("size") == F.col("_size"))
    settled = joined.join(extra, own, "left").withColumn("all", (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("long"))
    out = _listed(settled.select("doc_id", "source", "size", "source_size", "target", "n", "all"))
    copies = F.col("copies").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _slotted(docs: DataFrame) -> DataFrame | None:
    """docs with ``_slot``, a number of the stretch of a file that a row is from; None if they are not just read from files that number their rows."""
    try:
        return docs.withColumn("_slot", F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / SLOT_ROWS)))
    except AnalysisException:
        return None


def _looked_up(slotted: DataFrame, each: DataFrame) -> DataFrame:
    """slotted (doc_id, _slot and others) with ``_each`` of ``each`` (_id, _each; one row for each doc_id).

    Only ids are shuffled, to files of whole slots in the shared folder; a task reads those of the slots that its rows are from, so texts stay where they are.
    """
    spark = slotted.sparkSession
    folder, buckets = scratch(spark, "copies"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = slotted.select("doc_id", "_slot").join(each, F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))).select("_id", "_slot", "_each")
    sent = sent.withColumn("bucket", F.pmod("_slot", F.lit(buckets)).cast("int")).repartition(buckets, "bucket")
    sent.write.option("compression", "zstd").partitionBy("bucket").parquet(folder)
    held = {}

    def slot_of(slot: int):
        """The ids of a slot in order, their copies, and those of a null id."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        fs, root = filesystem(folder)
        ids, copies, none = [np.empty(0, np.int64)], [np.empty(0, np.int32)], None
        for file in fs.get_file_info(FileSelector(f"{root}/bucket={slot % buckets}", allow_not_found=True)):
            if file.base_name.startswith("part-"):
                with fs.open_input_file(file.path) as source:
                    own = pq.ParquetFile(source).read(["_id", "_slot", "_each"])
                own = own.filter(pc.equal(own["_slot"], slot))
                known = own.filter(pc.is_valid(own["_id"]))
                ids.append(known["_id"].to_numpy())
                copies.append(known["_each"].to_numpy())
                none = next(iter(own.filter(pc.is_null(own["_id"]))["_each"].to_pylist()), none)
        ids, copies = np.concatenate(ids), np.concatenate(copies)
        order = np.argsort(ids, kind="stable")
        return ids[order], copies[order], none

    @F.arrow_udf("int")
    def look_up(doc_id, slot):
        import pyarrow as pa

        null, wanted, slots = doc_id.is_null().to_numpy(zero_copy_only=False), doc_id.fill_null(0).to_numpy(), slot.to_numpy()
        out, now = np.empty(len(slots), np.int32), np.unique(slots)
        for gone in held.keys() - set(now.tolist()):
            del held[gone]
        for k in now.tolist():
            ids, copies, none = held[k] if k in held else held.setdefault(k, slot_of(k))
            rows = np.flatnonzero((slots == k) & ~null)
            at = np.searchsorted(ids, wanted[rows])
            lost = (at >= len(ids)) | (ids[np.minimum(at, len(ids) - 1)] != wanted[rows]) if len(ids) else np.ones(len(rows), bool)
            without = (slots == k) & null
            if lost.any() or without.any() and none is None:
                raise ValueError(f"slot {k}: copies of a doc_id are missing; the files of the documents have changed")
            out[rows] = copies[at]
            out[without] = none or 0
        return pa.array(out)

    return slotted.withColumn("_each", look_up.asNondeterministic()(F.col("doc_id").cast("long"), "_slot"))  # so it runs once a row


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, source, text), each as often as it is taken, with their own columns. Rows that share a doc_id share its copies out in the order of a hash of the text.

    Rows read from Parquet files get their copies where they are; others meet them in a join.
    """
    docs, restored = sealed(docs, "doc_id", "source", "text")
    taken = mix(docs, **options).groupBy("doc_id").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n"))
    taken = written(taken, "taken").withColumnRenamed("doc_id", "_id")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    slotted = _slotted(docs)
    if slotted is not None:
        copies = _looked_up(slotted, taken.select("_id", F.when(F.col("_n") == 1, F.col("_copies")).otherwise(0).cast("int").alias("_each")))
    else:
        copies = docs.join(taken.filter("_n = 1"), same).withColumn("_each", F.col("_copies").cast("int"))
    copies = copies.select(*docs.columns, "_each")
    shared = taken.filter("_n > 1")
    if not shared.isEmpty():  # only these are put in order
        turn = F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("text"))) - 1
        each = (F.floor(F.col("_copies") / F.col("_n")) + F.when(F.col("_turn") < F.col("_copies") % F.col("_n"), 1).otherwise(0)).cast("int")
        copies = copies.unionByName(docs.join(shared, same).withColumn("_turn", turn).withColumn("_each", each).select(*docs.columns, "_each"))
    return restored(copies.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_each")))))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
