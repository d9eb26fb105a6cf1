"""Helpers that the text operators share: column picking, shared scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACES.encode()
#: A key is hot if it holds over one in HOT_KEYS of all rows and over HOT_ROWS; so at most HOT_KEYS are.
HOT_KEYS, HOT_ROWS = 1000, 256


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """``alias=column`` by exact spelling, whatever other (even clashing) columns the table has."""
    names = df.columns
    for source in wanted.values():
        if source not in names:
            raise ValueError(f"no column {source!r} among {names}")
    lowered = [n.lower() for n in names]
    if len(set(lowered)) == len(names):
        return df.select(*[F.col(f"`{s}`").alias(a) for a, s in wanted.items()])
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{names.index(s)}").alias(a) for a, s in wanted.items()])


def sealed(df: DataFrame, *needed: str):
    """df with its needed columns under their own names and all others under names that cannot clash, and what puts the old names back."""
    names = df.columns
    for name in needed:
        if name not in names:
            raise ValueError(f"no column {name!r} among {names}")
    own = {names.index(n) for n in needed}
    plain = df.toDF(*[n if k in own else f"_x{k}" for k, n in enumerate(names)])
    return plain, lambda out: out.select(*plain.columns).toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='netquarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is already gone; the folder is scratch
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/netquarry-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder once nothing lazy reads it."""
    _remove(spark, path)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow's filesystem and path for a folder that the operators write binary files to."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def as_bytes(column) -> list:
    """An Arrow string column as a list of bytes; null becomes b''."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def pieces(batches, rows: int = 512):
    """Arrow batches cut into at most ``rows`` rows, so that what is made from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hot_keys(counts: DataFrame, key: list[str], n: str, rows: int | None = None) -> DataFrame | None:
    """The hot keys of a table with one row a key and the number of rows that hold it; None without any. The driver sees at most HOT_KEYS keys, since the counts sum to ``rows``."""
    if rows is None:
        rows = counts.agg(F.sum(n)).first()[0] or 0
    found = counts.filter(F.col(n) > max(HOT_ROWS, rows // HOT_KEYS)).select(*key)
    hot = found.collect()
    return counts.sparkSession.createDataFrame(hot, found.schema) if hot else None


def join_split(left: DataFrame, right: DataFrame, key: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined with right (one row a key), the hot keys' rows where they are and the others in a shuffle, so no task gets all rows of a hot key."""
    if hot is None:
        return left.join(right, key, how)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))  # at most one row a hot key
    cold = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return cold.unionByName(left.join(F.broadcast(hot), key, "left_semi").join(few, key, how))
