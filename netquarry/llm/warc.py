"""WARC archives: writing, normalising monolithic gzip, and reading back through a sidecar offset index.

A monolithic archive is one gzip stream around many records, so no record can be read alone. The
normaliser inflates each such file once as a stream, rewrites every record as a gzip member of its
own and writes a sidecar index (Parquet) with each record's offset and length; readers then seek.
Archives are split at ``ARCHIVE_BYTES`` of content, so one task's file is bounded; memory is bounded
by one record. Files carry the name of the attempt that wrote them, and only those listed in the
manifest tables count, so lost and repeated tasks do no harm.

Defined cases: a null payload is empty; payloads under ``MIN_REVISIT`` bytes are always responses;
rows that repeat the largest page_id of a payload are all responses; null page_ids count as smallest
and are written as ``null``; control characters and blanks in a url are percent-encoded, a null url
is empty; very long payloads are written whole; an empty table gives no archive and no rows; extra
columns, also with clashing names, are ignored; NUL padding after a member is skipped; a stream cut
off in the middle, or one with other than the records that its manifest names, raises, unless
``truncated="keep"`` asks for its whole records, marked ``truncated``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, hot_keys, join_split, pick, scratch, written

MIN_REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MONOLITHS = "path string, records long, content_bytes long"
ARCHIVES = "path string, index_path string, records long, truncated boolean"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, path string, offset long, length long, payload binary"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in (url or ""))


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(record_id: str | None) -> int | None:
    found = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found.lstrip("-").isdigit() else None


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """A response record, or a revisit whose block has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_uri(url)}"]
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}


class Inflated:
    """The records of a gzip stream (one member or many), one at a time; ``truncated`` is set if it ends too soon."""

    def __init__(self, stream):
        self.stream, self.truncated = stream, False

    def _content(self):
        inflate, begun = zlib.decompressobj(31), False
        while chunk := self.stream.read(READ_BYTES):
            while chunk:
                if not begun:  # between members: padding may go on over many chunks
                    chunk = chunk.lstrip(b"\0")
                    if not chunk:
                        break
                    begun = True
                try:
                    out = inflate.decompress(chunk, 4 * READ_BYTES)
                except zlib.error:
                    self.truncated = True
                    return
                if out:
                    yield out
                chunk = inflate.unconsumed_tail
                if inflate.eof:
                    chunk, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
        self.truncated |= begun

    def __iter__(self):
        held, content = bytearray(), self._content()

        def fill(n: int) -> bool:
            while len(held) < n:
                more = next(content, None)
                if more is None:
                    return False
                held.extend(more)
            return True

        while True:
            while held[:2] == b"\r\n" or (not held and fill(1) and held[:2] == b"\r\n"):
                del held[:2]
            if not held and not fill(1):
                return
            while (end := held.find(b"\r\n\r\n")) < 0:
                if not fill(len(held) + 1):
                    self.truncated = True
                    return
            head = bytes(held[:end])
            size = int(_headers(head).get("content-length", 0))
            if not head.startswith(b"WARC/") or not fill(end + 4 + size):
                self.truncated = True
                return
            yield head, bytes(held[end + 4 : end + 4 + size])
            del held[: end + 4 + size]


def write_monoliths(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages: page_id, url, payload (binary), refers_to, revisit. Writes whole-file gzip archives; returns their manifest."""

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, out, rows = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for page_id, url, payload, refers, revisit in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit")], strict=True):
                if out is None:
                    path = f"{root}/crawl-{part:06d}-{len(rows):04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    raw = fs.open_output_stream(path, compression=None)
                    out, n, size = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0), 0, 0
                data = record(page_id, url, payload or b"", refers, revisit)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    raw.close()
                    rows.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            raw.close()
            rows.append((path, n, size))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["path", "records", "content_bytes"])

    return written(pages.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(write, MONOLITHS), "monoliths")


def _spread(files: DataFrame) -> DataFrame:
    """One row is one archive: dealt out evenly, however few partitions their manifest has."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def normalise(monoliths: DataFrame, folder: str, truncated: str = "raise") -> DataFrame:
    """One member per record plus a sidecar index for each file of ``monoliths`` (column path, and records if known); returns the new manifest.

    A file that is cut off or has another number of records raises, or is marked if truncated is "keep".
    """
    if truncated not in ("raise", "keep"):
        raise ValueError(f"truncated is raise or keep, not {truncated}")

    def rewrite(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            said = batch.column("records").to_pylist() if "records" in batch.schema.names else [None] * batch.num_rows
            for source, records in zip(batch.column("path").to_pylist(), said, strict=True):
                path = f"{root}/{source.rpartition('/')[2].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                index, offset = [], 0
                with fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(path, compression=None) as out:
                    found = Inflated(raw)
                    for head, block in found:
                        member = gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)
                        out.write(member)
                        fields = _headers(head)
                        index.append((fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), offset, len(member)))
                        offset += len(member)
                cut = found.truncated or records not in (None, len(index))
                if cut and truncated == "raise":
                    raise ValueError(f"{source}: {'cut off after' if found.truncated else 'has'} {len(index)} records, {'an unknown number' if records is None else records} expected")
                names = ["record_id", "record_type", "url", "offset", "length"]
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                table = pa.table([pa.array([r[k] for r in index], kind) for k, kind in enumerate(kinds)], names=names)
                pq.write_table(table, f"{path}.idx.parquet", filesystem=fs, compression="zstd")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f"{path}.idx.parquet"]), pa.array([len(index)], pa.int64()), pa.array([cut])], names=["path", "index_path", "records", "truncated"])

    return written(_spread(monoliths).mapInArrow(rewrite, ARCHIVES), "archives")


def _parse(head: bytes, block: bytes) -> tuple:
    fields = _headers(head)
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, said = fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
    if kind == "revisit":
        size = int(_headers(http).get("content-length", 0))
        digest = base64.b32decode(said.removeprefix("sha1:")).hex()
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if said and base64.b32decode(said.removeprefix("sha1:")).hex() != digest:
            raise ValueError(f"{fields.get('warc-record-id')}: the payload does not have its digest")
    return _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, size, digest, _page(fields.get("warc-refers-to")), payload if kind != "revisit" else None


def read_records(archives: DataFrame, folder: str, record_types: tuple[str, ...] | None = None, payloads: bool = True, truncated: str = "raise") -> DataFrame:
    """RECORDS of normalised archives: each is read at the offset that the sidecar index names, so unwanted types are skipped unread.

    An archive marked truncated raises unless truncated is "keep"; an index of other than the manifest's number of records always does.
    """
    if truncated not in ("raise", "keep"):
        raise ValueError(f"truncated is raise or keep, not {truncated}")

    def read(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, _ = filesystem(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for file in batch.to_pylist():
                with fs.open_input_file(file["index_path"]) as side:
                    index = pq.read_table(side).to_pylist()
                if len(index) != file["records"] or (file["truncated"] and truncated == "raise"):
                    raise ValueError(f"{file['path']}: {len(index)} of {file['records']} records in the index, truncated: {file['truncated']}")
                rows, held = [], 0
                with fs.open_input_file(file["path"]) as raw:
                    for at in index:
                        if record_types and at["record_type"] not in record_types:
                            continue
                        raw.seek(at["offset"])
                        whole = Inflated(io.BytesIO(raw.read(at["length"])))
                        head, block = next(iter(whole), (None, None))
                        if head is None or whole.truncated:
                            raise ValueError(f"{file['path']}: no whole record at {at['offset']}")
                        *row, payload = _parse(head, block)
                        rows.append((*row, file["path"], at["offset"], at["length"], payload if payloads else None))
                        held += len(block)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _spread(archives).mapInArrow(read, RECORDS)


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, payload) with refers_to and revisit.

    Only digests and ids meet by payload (a common payload arrives as partial maxima, and its ids stay where they are); payloads meet their decision by page_id.
    """
    keyed = pages.withColumn("sha", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload"))
    keys = written(keyed.filter(F.col("size") >= min_revisit).select("page_id", "sha"), "payloads")
    last = written(keys.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1"), "repeated")
    others = join_split(keys, last.select("sha", "last"), ["sha"], hot_keys(last, ["sha"], "n")).filter(~F.col("page_id").eqNullSafe(F.col("last"))).distinct()
    others = written(others, "revisits").select(F.col("page_id").alias("id"), F.col("sha").alias("their"), "last")
    joined = keyed.join(others, keyed.page_id.eqNullSafe(others.id) & (keyed.sha == others.their), "left")
    return joined.select("page_id", "url", "payload", F.col("last").alias("refers_to"), F.col("their").isNotNull().alias("revisit"))


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as monolithic archives below ``folder``, normalise them, and return the normalised manifest."""
    rows = pick(pages, page_id=page_id, url=url, payload=html)
    rows = rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("payload", F.coalesce(F.col("payload"), F.lit("")).cast("binary"))
    return normalise(write_monoliths(with_revisits(rows), f"{folder}/crawl"), f"{folder}/normalised")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(archives, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM k
"""
