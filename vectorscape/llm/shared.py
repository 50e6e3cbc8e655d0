"""What the operators of this subpackage share: tables, materialisation, byte-level words.

Text kernels work on the UTF-8 buffer of an Arrow string column, so that a
batch is a flat ``uint8`` array and a word is a pair of offsets.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a kernel handles at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows of a batch that travels between the JVM and Python: a tenth of Spark's default, as rows are whole texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; from here on, batches of the session's Python operators are small enough for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder takes its place only where the setting is absent and all runs in one process (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="vectorscape-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for df in frames:
        remove_path(df.sparkSession, df.stored_at)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Keys with so many rows, or with this share of all rows, don't meet in one task of a join.
HOT_ROWS, HOT_SHARE = 1000, 100_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``left.join(right, on)``, where ``right`` has each key once and ``n`` says how many of ``total`` rows of ``left`` have it.

    Keys with many rows are sent to where their rows are. They are fewer than ``HOT_SHARE``, as their rows add up to
    ``total`` at most; all others are shuffled.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    if total <= limit or right.filter(F.col(n) > limit).isEmpty():
        return left.join(right, on)
    hot = right.filter(F.col(n) > limit)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.filter(F.col(n) <= limit), on)
    return rest.unionByName(left.join(F.broadcast(hot), on))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``limit`` bytes in each, one row at least."""
    for batch in batches:
        ends = offsets_of(batch.column(column))[1:]
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(col: pa.Array) -> np.ndarray:
    """Byte offsets of the rows of a string column, from 0; nulls are empty."""
    return utf8(col)[1]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets, from 0; nulls are empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# The two kinds of words that the contracts name.
# ALNUM: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; BLANK: [^\x20\x09-\x0D]+ as written.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
#: For bytes.translate(): A-Z lower-cased, all that is in no word made a blank.
ALNUM_BYTES = bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _BASE, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base."""
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _BASE, np.uint64))
    return _POWERS[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lower-cased ALNUM words, 64-bit hashes of them, and for each row its first word's place.

    A word never crosses a row. The last array has n + 1 entries, as offsets have.
    """
    inside = ALNUM[data]
    left = np.empty_like(inside)
    left[:1] = False
    left[1:] = inside[:-1]
    left[offsets[:-1][offsets[:-1] < len(data)]] = False
    right = np.empty_like(inside)
    right[-1:] = False
    right[:-1] = ~left[1:] & inside[1:]  # a word starts at the next byte
    right[:-1] |= ~inside[1:]
    right[-1:] = True
    starts = np.flatnonzero(inside & ~left)
    ends = np.flatnonzero(inside & right) + 1
    lengths = ends - starts
    if len(starts) == 0:
        return starts, ends, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    chars = LOWER[data[inside]].astype(np.uint64) + np.uint64(1)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(chars)) - np.repeat(begin, lengths)
    with np.errstate(over="ignore"):
        hashes = mix(np.add.reduceat(chars * powers(int(lengths.max()))[place], begin) + lengths.astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and the place of the first word of each.

    ``first`` has each row's first word, n + 1 entries.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
            h ^= h >> np.uint64(32)
        h = mix(h)
    row_end = np.repeat(first[1:], np.diff(first))[:n]  # where the row of each word ends
    at = np.flatnonzero(np.arange(n) + size <= row_end)
    return h[at], at


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def empty_text(col: str = "text"):
    """The text, or the empty string where it is null."""
    return F.coalesce(F.col(col), F.lit(""))
