"""Helpers that the operators of this subpackage share: shared-folder tables, Arrow column appends, word hashing.

Words are maximal runs of bytes outside a separator set. The separators are ASCII, so splitting UTF-8 bytes and splitting
code points give the same words. Hashes are 64 bits wide and depend on the bytes alone, so they agree between tasks.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: space and U+0009 to U+000D.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a session on one machine gets a new temporary folder; on a cluster, whose executors could not see
    one, that is an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    return stored(df, new_path(df.sparkSession, name))


class Scratch:
    """Tables of one job in a folder of its own in the shared one; those that no later step reads are dropped on the way."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, new_path(spark, name), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        table = stored(df, f"{self.root}/{self.n}-{name}")
        table.scratch_path = f"{self.root}/{self.n}-{name}"
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Only for tables all of whose dependants are written."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame, limit: int) -> DataFrame:
    """A written table of ids, hashes and numbers: sent to every task up to that count of rows, joined by shuffle beyond.

    Spark splits frequent keys of that shuffled join, since both sides are tables and none is an aggregate.
    """
    return F.broadcast(table) if table.count() <= limit else table


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def append_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """All columns of df and those that fn computes from a batch, row for row; an input column of the same name is replaced."""
    names = [f.name for f in fields]
    kept = without(df, names)
    positions = [df.columns.index(c) for c in kept.columns]
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in positions], *fn(batch)], names=schema.names)

    return df.mapInArrow(run, schema)


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def packs(blobs: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about limit bytes together (a longer text stands alone)."""
    start = size = 0
    for i, b in enumerate(blobs):
        if i > start and size + len(b) > limit:
            yield start, i
            start, size = i, 0
        size += len(b) + 1
    if start < len(blobs):
        yield start, len(blobs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def separator_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


_BLANK_TABLE = separator_table(BLANKS)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end."""
    up, down = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)])))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(blobs: list[bytes], table: np.ndarray = _BLANK_TABLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the texts joined by one blank, and the first word's index of each text (one more at the end)."""
    data = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
    sep = table[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    at = np.cumsum([0, *[len(b) + 1 for b in blobs]])
    return segment_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, at)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n consecutive words."""
    if len(words) < n:
        return words[:0]
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ words[i : len(words) - n + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)
