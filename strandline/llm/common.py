"""Shared folders, batch cutting and the array kernel for words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at once by array code, so that a task's memory doesn't follow Arrow's batch size and arrays stay near the cache.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "/tmp/checkpoints"
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_tables: dict[str, list[str]] = {}  # folders that a session has written, by the shared folder


def saved(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Written as a table in the shared folder and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_saved(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Deletes saved tables that no later plan reads: only those whose readers have been written themselves."""
    mine = _tables.get(spark.sparkContext.applicationId, [])
    for df in tables:
        files = df.inputFiles() if df is not None else ()
        for path in [p for p in mine if any(p in f for f in files[:1])]:
            _delete(spark, path)
            mine.remove(path)


def clear_saved(spark: SparkSession) -> int:
    """Deletes all tables this session has saved, for when their results have been written; gives their number."""
    mine = _tables.pop(spark.sparkContext.applicationId, [])
    for path in mine:
        _delete(spark, path)
    return len(mine)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that df doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is empty."""
    a = column.fill_null("").cast(pa.large_string())
    _, off, data = a.buffers()
    o = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(a) else np.zeros(0, np.uint8)
    return b, o - o[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows so that each holds about `limit` bytes of text; one row of any length stays whole."""
    for batch in batches:
        a = batch.column(text).cast(pa.large_string())
        sizes = np.diff(np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]) if len(a) else np.zeros(0, np.int64)
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        if at < len(sizes):
            yield batch.slice(at)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = {"n": 0}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        m = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            a = np.full(m, _P, np.uint64)
            b = np.full(m, _PI, np.uint64)
            a[0] = b[0] = 1
            _powers.update(n=m, p=np.cumprod(a, dtype=np.uint64), i=np.cumprod(b, dtype=np.uint64))
    return _powers["p"][:n], _powers["i"][:n]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes, by multiplication and shifts."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_MULT = np.uint64(0xD6E8FEB86659FD93)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_LONG = 128  # bytes from which a span is hashed on its own


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros past the end; a view, so only what is taken from it is read."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span, 8 bytes a step, each step mixed: no fixed power or sum, so repetitive texts don't collide."""
    from_here = loads(data)
    n = (end - start).astype(np.int64)
    with np.errstate(over="ignore"):
        h = mix((n.astype(np.uint64) * _MULT) ^ (from_here[start] & _KEEP[np.minimum(n, 8)]))
        todo = np.flatnonzero((n > 8) & (n < _LONG))
        for at in range(8, _LONG, 8):
            todo = todo[n[todo] > at]
            if not len(todo):
                break
            h[todo] = mix(h[todo] * _MULT ^ (from_here[start[todo] + at] & _KEEP[np.minimum(n[todo] - at, 8)]))
    long = np.flatnonzero(n >= _LONG)
    if len(long):
        h[long] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


def chained(values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i : i + k] for each i of at."""
    h = np.full(len(at), k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mix(h * _MULT ^ values[at + j])
    return h


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether data[start:end] equals the span of the same index in other (start, end by row), byte for byte."""
    from_here = loads(data)
    n = end - start
    ok = n == other[:, 1] - other[:, 0]
    for i in np.flatnonzero(ok & (n >= _LONG) & (start != other[:, 0])).tolist():
        ok[i] = np.array_equal(data[start[i] : end[i]], data[other[i, 0] : other[i, 1]])
    todo = np.flatnonzero(ok & (n < _LONG))
    at = 0
    while len(todo := todo[n[todo] > at]):
        keep = _KEEP[np.minimum(n[todo] - at, 8)]
        bad = (from_here[start[todo] + at] ^ from_here[other[todo, 0] + at]) & keep != 0
        ok[todo[bad]] = False
        todo = todo[~bad]
        at += 8
    return ok


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """n+1 sums of values times powers; span_hash takes the hash of any span from it. Rolling sums can collide on texts made for it, so they
    only choose places (sampling); what decides equality goes by byte_hash or by bytes."""
    p, _ = _power(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span stands."""
    _, inv = _power(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a batch of texts as arrays: start, end (bytes), doc (row), hash; first[i] is row i's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        ink = ~SPACE[data]
        left = np.ones(len(data), bool)
        left[1:] = ~ink[:-1]
        left[offsets[:-1][offsets[:-1] < len(data)]] = True
        right = np.ones(len(data), bool)
        right[:-1] = ~ink[1:]
        right[(offsets[1:] - 1)[offsets[1:] > 0]] = True
        self.start, self.end = np.flatnonzero(ink & left), np.flatnonzero(ink & right) + 1
        self.hash = byte_hash(data, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.data, self.offsets = data, offsets

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each k consecutive words of one text."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, chained(self.hash, at, k)

    def ids(self) -> np.ndarray:
        """A number for each word, the same if and only if the bytes are the same."""
        _, index, inverse = np.unique(self.hash, return_index=True, return_inverse=True)
        first = np.stack([self.start[index], self.end[index]], 1)[inverse] if len(index) else np.zeros((0, 2), np.int64)
        if same_bytes(self.data, self.start, self.end, first).all():
            return inverse
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(self.data[a:b].tobytes(), len(seen)) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)], np.int64)


def count_by(doc: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
