"""Token ids as Parquet list columns: delta or dictionary encoding, row groups of bounded size, page indexes.

The rows are ranged and sorted by doc_id; each task encodes its range and writes one file below a
shared folder, under a name of its own attempt. The manifest (part, path, docs, tokens, first and
last doc_id) names the files that count, so a repeated or lost task leaves at most an unlisted file.
``start`` positions follow from the manifest's running token counts and each row's own place in its
file. A reader takes files by the manifest; within them Spark's Parquet reader takes the columns
asked for, row groups by their statistics, and of those only the pages (of ``PAGE_ROWS`` rows at
most) that the column and offset indexes name, so ids of few documents, or the metadata columns
alone, are read without the rest.

Any file of the tokenizers library can be given: texts go through the library whole, but for files
that normalise and cut as ``CUTS`` says, whose pieces are encoded once each.

Defined cases: null or empty text is the end id alone; a repeated doc_id gives one entry for each
row, in the order of a hash of the text, then the text; null doc_ids come first and are in no range
of doc_ids; an empty table gives an empty manifest and no rows; very long texts are encoded whole;
extra columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, pick, scratch

END_ID = 1
GROUP_TOKENS = 1 << 20
PAGE_BYTES, PAGE_ROWS = 64 << 10, 64
MANIFEST = "part int, path string, first_id long, last_id long, docs long, tokens long, row_groups int"
FILE = "doc_id long, at long, n_tokens int, ids array<long>"
#: Beyond this many words or ids a worker's cache is set aside, and the one before it, of words not met since, forgotten.
CACHE_WORDS, CACHE_IDS = 300_000, 2_500_000
#: Fixed values of word_bpe_49k.json: its normalisers, its cut, what becomes of the rest, and its model.
CUTS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
    "BPE",
)
#: How such a tokenizer cuts lowered text, for texts of plain Latin characters. ODD finds the others,
#: whose normal form, case or white space need the library itself, and what could be a special token.
_L, _N = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = f"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n{_L}{_N}]+"
ODD = "[\x00-\x08\x0b-\x1f\x7f-\xa0<]|[^\x00-\u012f]"


def cuts_words(tokenizer) -> bool:
    """Whether a tokenizer's file says that ids of a text are those of its CUTS pieces, and no special token is without ``<``."""
    said = json.loads(tokenizer.to_str())
    parts = (said.get("normalizer") or {}).get("normalizers"), (said.get("pre_tokenizer") or {}).get("pretokenizers"), (said.get("model") or {}).get("type")
    return parts == CUTS and not said.get("truncation") and all(x["content"].startswith("<") for x in said.get("added_tokens") or ())


def byte_signs() -> dict[int, str]:
    """The sign that the ByteLevel step writes for each byte that is not its own."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


class _Known(dict):
    """The ids of words as bytes; those not known are taken from the cache before this one, or made."""

    def __init__(self, make):
        self.make, self.before, self.held = make, {}, 0

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.make(word)
        self[word] = found
        self.held += len(found)
        return found

    def bound(self) -> None:
        if len(self) > CACHE_WORDS or self.held > 4 * CACHE_IDS:
            self.before, self.held = dict(self), 0
            self.clear()


class WordEncoder:
    """Encodes whole texts, with a tokenizer that cuts_words by word, each piece once while the cache holds it.

    Such a tokenizer lowers text, drops white space and cuts at letters, numbers and other signs before
    it looks for subwords, so the ids of a text are those of its words' pieces in order. Texts are cut
    into words here, words that the worker does not know into pieces by the same rule, and the library's
    model encodes each new piece: a plain one is its own normal form, so the steps before the model would
    change nothing. Words with other characters go through the whole library.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = cuts_words(self.tokenizer)
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.odd, self.cut = re.compile(ODD).search, re.compile(PIECES).findall
        self.known = _Known(self._ids)

    def _ids(self, word: str) -> bytes:
        if not (word.isascii() and word.isalpha()):
            if self.odd(word):
                return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
            pieces = self.cut(word)
            if len(pieces) > 1:
                return b"".join([self.known[x] for x in pieces])
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.signs)
        return array("I", [x.id for x in self.model.tokenize(word)]).tobytes()

    def _cut(self, text: str) -> list[str]:
        """The words of a text, at its white space: lowered, but those with odd characters as they are."""
        if not self.odd(text):
            return text.lower().split()
        return [word if self.odd(word) else word.lower() for word in text.replace("\n", " ").replace("\t", " ").split(" ") if word]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by END_ID, and how many each text has."""
        if not self.words:
            found = [[*x.ids, END_ID] for x in self.tokenizer.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes
        found, sizes, ids, end = [], np.empty(len(texts), np.int64), self.known.__getitem__, np.uint32(END_ID).tobytes()
        for k, x in enumerate(texts):
            own = b"".join(map(ids, self._cut(x or "")))
            found += [own, end]
            sizes[k] = len(own) // 4 + 1
            self.known.bound()
        return np.frombuffer(b"".join(found), np.uint32), sizes


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, encoding: str = "delta", group_tokens: int = GROUP_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files and return the manifest, itself written to ``folder``/manifest.

    tokenizer: a file of the tokenizers library that is readable on each executor. encoding: "delta" or "dictionary" for the ids.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"encoding is delta or dictionary, not {encoding}")

    def write(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = filesystem(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.field("element", pa.uint32(), nullable=False)))])
        part = task.partitionId()
        path = f"{root}/part-{part:06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}.parquet"
        first, last, docs_, tokens, groups, out, held, encoder = None, None, 0, 0, 0, None, [], _encoder(tokenizer)

        def flush():
            nonlocal out, groups, held
            if out is None:
                fs.create_dir(root, recursive=True)
                how = {"column_encoding": dict.fromkeys(["ids.list.element", "doc_id", "at", "n_tokens"], "DELTA_BINARY_PACKED"), "use_dictionary": False} if encoding == "delta" else {"use_dictionary": ["ids.list.element"], "dictionary_pagesize_limit": 1 << 20}
                out = pq.ParquetWriter(path, schema, filesystem=fs, compression="zstd", data_page_size=PAGE_BYTES, max_rows_per_page=PAGE_ROWS, write_batch_size=PAGE_ROWS, write_page_index=True, write_statistics=["doc_id", "n_tokens"], **how)
            out.write_table(pa.Table.from_batches(held, schema), row_group_size=1 << 30)
            groups, held = groups + 1, []

        waiting = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds the ids in memory, whatever the batch
                piece = batch.slice(at, 256)
                ids, sizes = encoder.encode(piece.column("text").to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                held.append(pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(tokens + np.cumsum(sizes) - sizes), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.uint32()), type=schema.field("ids").type)], schema=schema))
                own = piece.column("doc_id")
                first, last = (own[0].as_py() if docs_ == 0 else first), own[-1].as_py()
                docs_, tokens, waiting = docs_ + piece.num_rows, tokens + len(ids), waiting + len(ids)
                if waiting >= group_tokens:
                    flush()
                    waiting = 0
        if held:
            flush()
        if out is not None:
            out.close()
            row = [[part], [path], [first], [last], [docs_], [tokens], [groups]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    manifest = ranged.select("doc_id", "text").mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, doc_ids: tuple[int, int] | None = None, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, ids, from the files that the manifest lists.

    doc_ids: the first and last doc_id wanted; files, row groups and pages outside are not read. The driver gets the paths of the files that are.
    """
    spark, files = manifest.sparkSession, _based(manifest)
    if doc_ids:  # a file that begins with null doc_ids has no first_id
        files = files.filter((F.col("last_id") >= doc_ids[0]) & (F.col("first_id").isNull() | (F.col("first_id") <= doc_ids[1])))
    wanted = files.select("path", "base").collect()
    if not wanted:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long" + (", ids array<long>" if ids else ""))
    found = spark.read.schema(FILE).parquet(*[f.path if "://" in f.path else f"file://{f.path}" for f in wanted])
    if doc_ids:
        found = found.filter(F.col("doc_id").between(*doc_ids))
    bases = spark.createDataFrame([(f.path.rpartition("/")[2], f.base) for f in wanted], "name string, base long")
    placed = found.withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).join(F.broadcast(bases), "name")
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), *(["ids"] if ids else []))


def _based(manifest: DataFrame) -> DataFrame:
    """The files with the number of ids before each; the window is over one row for each file, not each document."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read back from the files."""

    def read(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, _ = filesystem(folder)
        for batch in batches:
            for file in batch.to_pylist():
                source, base = pq.ParquetFile(fs.open_input_file(file["path"])), file["base"]
                for g in range(source.num_row_groups):
                    table = source.read_row_group(g).combine_chunks()
                    column = table.column("ids").combine_chunks() if table.num_rows else None
                    column = column.chunk(0) if hasattr(column, "num_chunks") else column
                    offsets = column.offsets.to_numpy()
                    flat = column.values.to_numpy().astype("<u4", copy=False)
                    sizes = np.diff(offsets).astype(np.int64)
                    if not np.array_equal(sizes, table.column("n_tokens").to_numpy()) or not np.array_equal(file["base"] + table.column("at").to_numpy(), base + np.cumsum(sizes) - sizes):
                        raise ValueError(f"{file['path']}: at, n_tokens and ids differ in row group {g}")
                    crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                    own = table.column("doc_id").combine_chunks()
                    yield pa.RecordBatch.from_arrays([own.chunk(0) if hasattr(own, "num_chunks") else own, pa.array(base + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    base += int(sizes.sum())

    return _based(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The path of an installed public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of docs to a scratch folder and return digests read back from them."""
    folder = scratch(docs.sparkSession, "tokens")
    return digests(write_tokens(docs, folder, tokenizer or tokenizer_file()), folder)


def op6_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
