"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: space and the five ASCII controls 0x09-0x0D.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows up to which a table of short rows is broadcast.
BROADCAST_ROWS = 100_000

#: Bytes from which a word is hashed on its own.
LONG_WORD = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; an own temporary one only on a local master that names none."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pathlore-shared-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a new folder below the shared one; columns compress there, unlike a checkpoint's rows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, units: Column | None = None) -> DataFrame:
    """``df``, marked for broadcast if it has no more than this many short rows; they are counted, so give it a written table.

    Where rows aren't short, ``units`` tells how many short rows each counts as.
    """
    first = df.limit(rows + 1)
    n = first.count() if units is None else first.agg(F.count("*") + F.coalesce(F.sum(units), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: this one, or this one with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id, mod: int, remainder: int):
    """Whether crc32 of the id's decimal text leaves this remainder (null ids: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == remainder


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each has about ``max_bytes`` of the text column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of a batch of texts: ``vocab[codes[offsets[i]:offsets[i + 1]]]`` are those of row i."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
        flat = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        codes = flat.indices.to_numpy()
        vocab = flat.dictionary
        empty = pc.index(vocab, "").as_py()
        if empty >= 0:  # an empty text splits into one empty word
            full = codes != empty
            offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
            codes = codes[full]
        self.vocab, self.codes, self.offsets = vocab, codes, offsets

    def hashes(self, vocab: pa.Array | None = None) -> np.ndarray:
        """64-bit hash of each distinct word (of ``vocab``, if given in its place)."""
        return string_hashes(self.vocab if vocab is None else vocab)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hash of each string's bytes: byte by byte over all strings at once, long ones by XXH64."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(strings.buffers()[1], np.int32, n + 1, strings.offset * 4).astype(np.int64)
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    begin, size = at[:-1][order], length[order]
    h = np.full(n, 0xCBF29CE484222325, np.uint64)
    for k in range(min(int(size[0]), LONG_WORD)):
        m = int(np.searchsorted(-size, -k, side="left"))
        h[:m] ^= data[begin[:m] + k]
        h[:m] *= _MIX
        h[:m] ^= h[:m] >> np.uint64(32)
    out = np.empty(n, np.uint64)
    out[order] = h
    for i in order[: int(np.searchsorted(-size, -LONG_WORD, side="left"))]:
        out[i] = xxhash.xxh64_intdigest(data[at[i] : at[i + 1]].tobytes(), 7)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


def rolling(a: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k consecutive items; windows may span documents, callers mask those."""
    n = len(a) - k + 1
    if n <= 0:
        return a[:0]
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= _MIX
        h += a[i : i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def starts(offsets: np.ndarray, k: int) -> np.ndarray:
    """Flat positions at which a window of k words lies in one document."""
    n = int(offsets[-1])
    ok = np.zeros(n + 1, np.int32)
    first, last = offsets[:-1], offsets[1:] - k + 1
    long = last > first
    np.add.at(ok, first[long], 1)
    np.add.at(ok, last[long], -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the n positions that some [begin, end) covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, begin, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
