"""Exact dedup against immutable snapshots screened by static binary-fuse filters.

A snapshot is a list of immutable segments, one for each batch: a table of one entry per distinct
normalised text of the batch (SHA-256, the row that stays, the group's size), split by digest into
buckets of bounded size, with one binary-fuse filter per bucket. Neither is ever changed: a batch
adds a segment, and only after ``SEGMENTS`` of them are they merged into one. An incoming batch is
grouped by digest on its own (map-side combined, so a group of any size arrives as a few partial
rows), its distinct digests are screened bucket by bucket, and only positives are joined to the exact
entries, where both representatives' bytes are compared. Rows meet their group's entry in a join that
leaves the rows of hot digests where they are.

Defined cases: null text counts as empty; empty texts are equal to each other; very long texts are
digested whole; ties on the number of code points keep the smallest doc_id, null doc_id last; a
repeated row is one more member of its group; an empty table gives no rows; extra columns, also with
clashing names, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, SPACES, as_bytes, hot_keys, join_split, pick, written
from .fuse import BinaryFuse

#: Distinct digests for each bucket, and so for each filter and each task that builds or probes one.
BUCKET_KEYS = 200_000
#: Segments of a snapshot; one more, and they are merged.
SEGMENTS = 8
ENTRY = "digest binary, keep_id long, keep_chars long, n long"


def _digests(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column("text")
        kept = [x.translate(None, SPACE_BYTES) for x in as_bytes(texts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([hashlib.sha256(x).digest() for x in kept], pa.binary()), pc.fill_null(pc.utf8_length(texts).cast(pa.int64()), 0)],
            names=["doc_id", "digest", "chars"],
        )


def digest_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the text without white space), chars (code points of the text)."""
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_digests, "doc_id long, digest binary, chars long")


def _best():
    """The member that stays: most code points, then smallest doc_id (null last)."""
    return F.min(F.struct((-F.col("keep_chars")).alias("c"), F.col("keep_id").isNull().alias("z"), F.col("keep_id").alias("i")))


def group_entries(rows: DataFrame) -> DataFrame:
    """One entry per distinct digest of a batch."""
    one = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("chars").alias("keep_chars"))
    grouped = one.groupBy("digest").agg(_best().alias("b"), F.count("*").alias("n"))
    return grouped.select("digest", F.col("b.i").alias("keep_id"), (-F.col("b.c")).alias("keep_chars"), "n")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in digests), "<u8")


def _build(key, table):
    import pyarrow as pa

    made = BinaryFuse.build(_keys(table.column("digest").to_pylist()))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})


def _probe(left, right):
    import pyarrow as pa

    digests = left.column("digest").to_pylist()
    maybe = left.column("maybe").to_numpy().copy()
    for data in right.column("filter").to_pylist():
        maybe |= BinaryFuse.from_bytes(data).contains(_keys(digests))
    return left.select(["digest", "keep_id", "keep_chars", "n"]).append_column("maybe", pa.array(maybe))


def _merged(entries: DataFrame) -> DataFrame:
    """One entry for each digest of several segments."""
    grouped = entries.groupBy("digest").agg(_best().alias("b"), F.sum("n").alias("n"))
    return grouped.select("digest", F.col("b.i").alias("keep_id"), (-F.col("b.c")).alias("keep_chars"), "n")


@dataclass(frozen=True)
class Segment:
    """Immutable: ``entries`` (ENTRY; one a digest) and ``filters`` (bucket, filter) in the shared folder."""

    entries: DataFrame
    filters: DataFrame
    buckets: int

    @classmethod
    def build(cls, entries: DataFrame, bucket_keys: int = BUCKET_KEYS) -> "Segment":
        entries = written(entries.select("digest", "keep_id", "keep_chars", "n"), "entries")
        buckets = max(1, -(-entries.count() // bucket_keys))
        filters = entries.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").applyInArrow(_build, "bucket int, filter binary")
        return cls(entries, written(filters, "fuse"), buckets)


@dataclass(frozen=True)
class Snapshot:
    """Immutable: a digest counts with all segments that hold it."""

    segments: tuple[Segment, ...]

    @classmethod
    def build(cls, entries: DataFrame, bucket_keys: int = BUCKET_KEYS) -> "Snapshot":
        return cls((Segment.build(entries, bucket_keys),))

    @property
    def held(self) -> DataFrame:
        """The entries of all segments."""
        return reduce(DataFrame.unionByName, [s.entries for s in self.segments])

    @property
    def entries(self) -> DataFrame:
        return self.held if len(self.segments) == 1 else _merged(self.held)

    def screen(self, incoming: DataFrame) -> DataFrame:
        """The incoming entries with ``maybe``: false says that the snapshot surely lacks the digest."""
        out = incoming.select(*[c.split()[0] for c in ENTRY.split(", ")], F.lit(False).alias("maybe"))
        for segment in self.segments:
            left = out.withColumn("bucket", _bucket(segment.buckets))
            out = left.groupBy("bucket").cogroup(segment.filters.groupBy("bucket")).applyInArrow(_probe, f"{ENTRY}, maybe boolean")
        return out

    def grown(self, entries: DataFrame) -> "Snapshot":
        """The snapshot with one segment more, or of one segment if they are many."""
        grown = Snapshot((*self.segments, Segment.build(entries)))
        return grown if len(grown.segments) <= SEGMENTS else Snapshot.build(grown.entries)


def _differing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Digests whose two representatives have other bytes (a collision). Reads the texts of positives only."""
    ids = found.select("digest", F.explode(F.array("keep_id", "old_id")).alias("doc_id"))
    texts = docs.withColumn("norm", F.translate(F.coalesce("text", F.lit("")), SPACES, "").cast("binary")).select("doc_id", "norm")
    both = ids.join(texts, ids.doc_id.eqNullSafe(texts.doc_id)).filter(F.unhex(F.sha2("norm", 256)) == F.col("digest"))
    return both.groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("differs")).filter("differs").select("digest")


def ingest(snapshot: Snapshot, batch_rows: DataFrame, docs: DataFrame) -> tuple[Snapshot, DataFrame]:
    """The next snapshot after ``batch_rows`` (of digest_rows), and the digests of the batch that collide without equal bytes.

    docs: doc_id and text of both the snapshot's and the batch's rows, read for positives only.
    """
    own = written(snapshot.screen(group_entries(batch_rows)), "screened")
    old = snapshot.held.select("digest", F.col("keep_id").alias("old_id"))
    found = written(own.filter("maybe").join(old, "digest").select("digest", "keep_id", "old_id"), "positives")
    collided = written(_differing(found, docs), "collided")
    fresh = own if collided.isEmpty() else own.join(collided, "digest", "left_anti")
    return snapshot.grown(fresh), collided


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    The rows come in ``batches`` batches by a hash of doc_id; the first makes a snapshot, each other one is ingested.
    Of rows that repeat doc_id and text, each counts and all with the id that stays are kept.
    """
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = written(digest_rows(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "digests")
    snapshot, apart = Snapshot.build(group_entries(rows.filter("batch = 0"))), None
    for k in range(1, batches):
        snapshot, collided = ingest(snapshot, rows.filter(F.col("batch") == k), docs)
        if not collided.isEmpty():  # never seen with SHA-256: these stay groups of their own batch
            own = rows.filter(F.col("batch") == k).join(collided, "digest", "left_semi")
            apart = group_entries(own).withColumn("apart", F.lit(k)) if apart is None else apart.unionByName(group_entries(own).withColumn("apart", F.lit(k)))
    entries = snapshot.entries.withColumn("apart", F.lit(-1))
    if apart is not None:
        entries = entries.unionByName(apart.select(entries.columns))
        rows = rows.join(apart.select("digest", F.col("apart").alias("batch"), F.col("apart").alias("at")), ["digest", "batch"], "left").withColumn("apart", F.coalesce("at", F.lit(-1)))
    else:
        rows = rows.withColumn("apart", F.lit(-1))
    joined = rows.join(entries.select("digest", "apart", "keep_id", "n"), ["digest", "apart"])
    return joined.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
