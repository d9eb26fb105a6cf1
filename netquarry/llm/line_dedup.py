"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

State: ``refs`` (doc_id, row, key; one row for each document row that holds the key, row a hash of its
text) and ``counts`` (key, n_docs, max_doc), both exact, and one cuckoo filter per shard of the keys, which only screens: keys
of a batch that a filter lacks are surely new and skip the join with the exact table; the others are
joined exactly. A deletion subtracts references and takes the keys that reach zero out of the
filters. Batches are aggregated by key before anything is shuffled, so a line that a third of all
documents share arrives as one partial row for each task, and references meet the keys that lose
lines in a join that leaves those of hot keys where they are.

Defined cases: null or empty text is one empty line; a key is the line without the contract's white
space at both ends and with A-Z lowered; keys under 20 code points are never dropped; each row is a
document of its own, also if its doc_id or text repeats, and of a dropped key all rows with the
largest doc_id keep their lines; null doc_ids count as smallest; several lines of one document with
one key count once and are kept or dropped together; very long texts and lines are read whole; a
deletion takes all rows of its doc_ids, null too; an empty table gives no rows; extra columns,
also with clashing names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, as_bytes, hot_keys, join_split, pick, pieces, written
from .cuckoo import Cuckoo, Full

#: Keys for each shard: bounds the filter and the task that probes or changes it.
SHARD_KEYS = 250_000
MIN_CHARS, MIN_DOCS = 20, 3


def _key(line: bytes, min_chars: int) -> bytes | None:
    line = line.strip(SPACE_BYTES).lower()  # of bytes: A-Z only
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row (hash of the text), key (128-bit hash): the distinct keys of each row's lines."""

    def keys(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            found, sizes = [], []
            for text in as_bytes(batch.column("text")):
                own = {_key(x, min_chars) for x in text.split(b"\n")}
                own.discard(None)
                found.extend(own)
                sizes.append(len(own))
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(found, pa.binary())], names=["doc_id", "row", "key"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(keys, "doc_id long, row long, key binary")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _ints(table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("key").to_pylist()), "<u8")[::2]


class LineState:
    """Exact tables of the documents so far, and their filters, which are built when an operation first needs them."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame | None = None, shards: int = 0, pending: tuple | None = None):
        """pending: an earlier state and the keys that its filters still lack."""
        self.refs, self.counts, self._filters, self.shards, self._pending = refs, counts, filters, shards, pending

    @classmethod
    def of(cls, refs: DataFrame) -> "LineState":
        return cls(refs, written(_counted(refs), "counts"))

    @property
    def filters(self) -> DataFrame:
        if self._filters is None and self._pending:
            before, new = self._pending
            self._filters, self.shards, self._pending = before._changed(new, "insert"), before.shards, None
        elif self._filters is None:
            self.shards = max(1, -(-self.counts.count() // SHARD_KEYS))

            def build(key, table):
                import pyarrow as pa

                return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([Cuckoo.build(_ints(table)).to_bytes()], pa.binary())})

            grouped = self.counts.select(_shard(self.shards).alias("shard"), "key").groupBy("shard")
            self._filters = written(grouped.applyInArrow(build, "shard int, filter binary"), "cuckoo")
        return self._filters

    def screen(self, batch: DataFrame) -> DataFrame:
        """The batch's counted keys with ``maybe``: false says that the state surely lacks the key."""

        def probe(left, right):
            import pyarrow as pa

            maybe = np.zeros(left.num_rows, bool)
            for data in right.column("filter").to_pylist():
                maybe |= Cuckoo.from_bytes(data).contains(_ints(left))
            return left.select(["key", "n_docs", "max_doc"]).append_column("maybe", pa.array(maybe))

        filters = self.filters
        left = batch.select("key", "n_docs", "max_doc", _shard(self.shards).alias("shard"))
        return left.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(probe, "key binary, n_docs long, max_doc long, maybe boolean")

    def _changed(self, keys: DataFrame, how: str) -> DataFrame:
        """The filters after inserting or deleting keys; a shard that overflows is doubled until its keys fit."""
        shards, before = self.shards, self.counts

        def change(left, right):
            import pyarrow as pa

            own, rows = _ints(left), right.to_pylist()
            data = next((r["filter"] for r in rows if r["filter"] is not None), None)
            made = Cuckoo.from_bytes(data) if data else Cuckoo.sized(len(own))
            try:
                (made.insert if how == "insert" else made.delete)(own)
            except Full:
                old = np.frombuffer(b"".join(r["key"] for r in rows if r["key"] is not None), "<u8")[::2]
                made = Cuckoo.build(np.concatenate([old, own]))
            shard = left.column("shard")[0].as_py() if left.num_rows else rows[0]["shard"]
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})

        held = self.filters.select("shard", "filter", F.lit(None).cast("binary").alias("key")).unionByName(
            before.select(_shard(shards).alias("shard"), F.lit(None).cast("binary").alias("filter"), "key")
        )
        left = keys.select("key", _shard(shards).alias("shard"))
        return written(left.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(change, "shard int, filter binary"), "cuckoo")

    def insert(self, refs: DataFrame) -> "LineState":
        """The state with more documents (rows of line_keys). Untouched filters are carried over; the changed ones follow when needed."""
        batch = written(self.screen(_counted(refs)), "screened")
        known = batch.filter("maybe").select("key", F.col("n_docs").alias("more"), F.col("max_doc").alias("newer"))
        grown = self.counts.join(known, "key", "left").select(
            "key", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "newer").alias("max_doc")
        )
        false_hits = batch.filter("maybe").join(self.counts.select("key"), "key", "left_anti")
        new = batch.filter("not maybe").unionByName(false_hits).select("key", "n_docs", "max_doc")
        counts = written(grown.unionByName(new), "counts")
        outgrown = counts.count() > 2 * SHARD_KEYS * self.shards  # then the next use builds more shards
        return LineState(self.refs.unionByName(refs), counts, pending=None if outgrown else (self, new))

    def delete(self, doc_ids: DataFrame) -> "LineState":
        """The state without the documents whose doc_id is in the one-column table."""
        ids = doc_ids.toDF("id").distinct()
        own = F.col("doc_id").eqNullSafe(F.col("id"))
        gone = written(_counted(self.refs.join(ids, own, "left_semi")), "gone")
        refs = written(self.refs.join(ids, own, "left_anti"), "refs")
        touched = _counted(refs.join(gone.select("key"), "key", "left_semi"))
        counts = written(self.counts.join(gone.select("key"), "key", "left_anti").unionByName(touched), "counts")
        dead = gone.select("key").join(touched.select("key"), "key", "left_anti")
        self.filters  # noqa: B018  built before they are changed
        return LineState(refs, counts, self._changed(dead, "delete"), self.shards)

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """key, max_doc of the keys that lose their lines outside max_doc."""
        return self.counts.filter(F.col("n_docs") >= min_docs).select("key", "max_doc")


def dropped_lines(docs: DataFrame, state: LineState, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, texts: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, if texts, kept (the text that stays) for each row of docs (doc_id, text)."""

    def rebuild(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            lines, dropped, digests, left = [], [], [], []
            for text, drops in zip(as_bytes(batch.column("text")), batch.column("drops").to_pylist(), strict=True):
                own = text.split(b"\n")
                if drops:
                    drops = set(drops)
                    kept = [x for x in own if _key(x, min_chars) not in drops]
                    text = b"\n".join(kept)
                else:
                    kept = own
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
                digests.append(hashlib.sha256(text).hexdigest())
                left.append(text)
            out = {"doc_id": batch.column("doc_id"), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array(digests)}
            if texts:
                out["kept"] = pa.array(left, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    repeated = state.counts.filter(F.col("n_docs") >= min_docs)
    keys = join_split(state.refs, state.repeated(min_docs), ["key"], hot_keys(repeated, ["key"], "n_docs")).filter(F.coalesce(F.col("doc_id") < F.col("max_doc"), F.col("doc_id").isNull() & F.col("max_doc").isNotNull()))
    drops = keys.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("their")).agg(F.collect_set("key").alias("drops"))  # of one row's own lines
    rows = docs.withColumn("row", F.xxhash64("text"))
    both = rows.join(drops, rows.doc_id.eqNullSafe(drops.id) & (rows.row == drops.their), "left").select("doc_id", "text", "drops")
    return both.mapInArrow(rebuild, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * texts)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2, texts: bool = True) -> DataFrame:
    """dropped_lines for all rows, inserted in ``batches`` batches by a hash of doc_id."""
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    refs = written(line_keys(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "refs")
    part = [refs.filter(F.col("batch") == k).select("doc_id", "row", "key") for k in range(batches)]
    state = LineState.of(part[0])
    for more in part[1:]:
        state = state.insert(more)
    state.refs = refs.select("doc_id", "row", "key")  # the union of all batches, as one scan
    return dropped_lines(docs, state, texts=texts)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), d AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id < c.max_doc AS dropped FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
