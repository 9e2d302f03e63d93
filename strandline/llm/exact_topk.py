"""Exact top-k search by blocks that are pruned by their bounds.

Rows are put into an order of documents in which like vectors stand near each other (by the pivot of greatest inner product, then key), and that
order is cut into blocks of BLOCK vectors. A block keeps the greatest and the least value of each component: a query's score in the block can't
exceed the sum of its components times those that make each product greatest. BLOCKS blocks and their forward index (the vectors themselves,
as a matrix) are one row of the index table. A query's own row of blocks is scored when the index is read for queries, so that each query starts
with a k-th score.

Queries go through the index in slices of at most SLICE_CELLS numbers, which are broadcast. A task walks its rows of blocks; in each, every query
orders the blocks by bound and scores them, in strides that double, until the next bound is below its k-th score so far. Blocks of equal bound
are still scored, for ties go to the smaller key. A task gives at most k rows for each query, and a window merges them.

Every row is indexed and pivots only choose the order, so results are exact for any pivots; they are PIVOTS rows in hash order, a bounded sample.

Defined cases: vectors that are null or hold null or non-finite values take no part; of vectors of different lengths the missing components count as
zero, an empty one scores 0; rows with one key are rows of their own, and only the query's own row is left out; null keys come last among ties
and are no queries; scores beyond 64 bits are clipped; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import saved

BLOCK, BLOCKS, PIVOTS = 64, 32, 64
#: Numbers of one slice of queries (8 bytes each), and of one row of the index: rows of very long vectors hold fewer blocks.
SLICE_CELLS, ROW_CELLS = 4 << 20, 1 << 17
SCALE = 256.0
_NONE = -np.inf


def dense(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of a list column as a matrix, zeros where a vector is shorter."""
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(size.max(initial=0))
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """q @ v.T over common components; by whole numbers of any size where doubles would round."""
    d = min(q.shape[1], v.shape[1])
    q, v = q[:, :d], v[:, :d]
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)))
    if np.abs(q).max() * np.abs(v).max() * d < 2.0**53:
        return q @ v.T
    return whole(q) @ whole(v).T


def whole(m: np.ndarray) -> np.ndarray:
    """The same numbers as whole numbers of any size."""
    return np.array([int(x) for x in m.ravel()], object).reshape(m.shape)


def clipped(scores: np.ndarray) -> np.ndarray:
    """Scores that were too large for doubles, within 64 bits."""
    return np.clip(scores, -(1 << 63), (1 << 63) - 1) if scores.dtype == object else scores


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No score of a query in a block is greater."""
    d = min(q.shape[1], high.shape[1])
    up, down = product(np.maximum(q[:, :d], 0), high[:, :d]), product(np.minimum(q[:, :d], 0), low[:, :d])
    if up.dtype != object and down.dtype != object:
        return up + down
    total = clipped(whole(up) + whole(down)).astype(np.float64)
    return total + np.abs(total) * 1e-12  # rounding may have lowered it


def clean(rows: DataFrame, key: str, vector: str, query: Column) -> DataFrame:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) < F.lit(float("inf")), F.lit(False)))
    return rows.filter(F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.coalesce(query, F.lit(False)).alias("q"))


def index(rows: DataFrame, block: int = BLOCK, row_cells: int = ROW_CELLS) -> DataFrame:
    """Rows of blocks (row, width, keys, queries, forward, high, low) over (key, v, q), in the order of (pivot, key)."""
    # the least hashes: one pass with a bounded heap per task
    sample = rows.select("v").orderBy(F.xxhash64("v")).limit(PIVOTS).toArrow().column("v").combine_chunks()
    pivots = dense(sample) if len(sample) else np.zeros((0, 0))
    size = np.abs(pivots).max(1, keepdims=True, initial=0)
    pivots = pivots / np.where(size > 0, size, 1)
    size = np.sqrt((pivots**2).sum(1, keepdims=True))
    pivots = pivots / np.where(size > 0, size, 1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = dense(b.column("v"))
            d = min(m.shape[1], pivots.shape[1])
            at = np.argmax(m[:, :d] @ pivots[:, :d].T, 1) if d and len(pivots) else np.zeros(len(m), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns], ["pivot", *b.schema.names])

    kind = rows.schema["v"].dataType.simpleString()
    # many rows with one key still spread: the place in the input is the last part of the order
    placed = saved(rows.mapInArrow(nearest, f"pivot int, key long, v {kind}, q boolean").withColumn("at", F.monotonically_increasing_id()), "topk-placed")
    ordered = placed.repartitionByRange("pivot", "key", "at").sortWithinPartitions("pivot", "key", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, wait, n, cells = TaskContext.get().partitionId(), 0, [], 0, 0

        def rows_of(ready: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            table = pa.Table.from_batches(ready).combine_chunks()
            v = table.column("v").combine_chunks() if table.num_rows else None
            longest = max(int(np.asarray(v.value_lengths().to_numpy(zero_copy_only=False)).max(initial=1)), 1)
            step = max(block, min(block * BLOCKS, row_cells // longest // block * block))
            for a in range(0, table.num_rows, step):
                part = table.slice(a, step)
                m = dense(part.column("v").combine_chunks())
                heads = np.arange(0, len(m), block)
                high, low = (f.reduceat(m, heads, axis=0) if m.shape[1] else np.zeros((len(heads), 0)) for f in (np.maximum, np.minimum))
                cell = "<i4" if not m.size or np.abs(m).max() < 2**31 else "<f8"
                pack = lambda x, cell=cell: pa.array([np.ascontiguousarray(x).astype(cell).tobytes()], pa.binary())
                lists = [pa.array([part.column(c).to_pylist()], pa.list_(t)) for c, t in (("key", pa.int64()), ("q", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + seq]), pa.array([m.shape[1]], pa.int32()), pa.array([cell]), pa.array([len(heads)], pa.int32()), *lists, pack(m), pack(high), pack(low)], ["row", "width", "cell", "blocks", "keys", "queries", "forward", "high", "low"])
                seq += 1

        for b in batches:
            wait.append(b)
            n, cells = n + b.num_rows, cells + len(b.column("v").flatten())
            if n >= block * BLOCKS or cells >= row_cells:
                yield from rows_of(wait)
                wait, n, cells = [], 0, 0
        if n:
            yield from rows_of(wait)

    return ordered.select("key", "v", "q").mapInArrow(cut, "row long, width int, cell string, blocks int, keys array<long>, queries array<boolean>, forward binary, high binary, low binary")


def _matrix(b: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    raw, width = b.column(name)[i].as_buffer(), b.column("width")[i].as_py()
    m = np.frombuffer(raw, b.column("cell")[i].as_py()).astype(np.float64)
    if width:
        return m.reshape(-1, width)
    return np.zeros((len(b.column("keys")[i]) if name == "forward" else b.column("blocks")[i].as_py(), 0))


def queries(table: DataFrame, k: int) -> DataFrame:
    """(row, place, key, width, vector, start) of each query: start is the k-th score of its own row of blocks, null if that has fewer others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = np.flatnonzero(np.array(b.column("queries")[i].as_py(), bool))
                if not len(at):
                    continue
                m = _matrix(b, i, "forward")
                s = clipped(product(m[at], m)).astype(np.float64)
                s[np.arange(len(at)), at] = _NONE
                start = np.partition(s, -k, axis=1)[:, -k] if len(m) >= k else np.full(len(at), _NONE)
                keys = b.column("keys")[i].as_py()
                # a huge score may have been rounded up
                start = np.where(np.abs(start) < 2.0**53, start, _NONE)
                cols = [pa.array([b.column("row")[i].as_py()] * len(at)), pa.array(at), pa.array([keys[x] for x in at], pa.int64()), pa.array([m.shape[1]] * len(at), pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([m[x].tobytes() for x in at], pa.binary()), pa.array(start, mask=~np.isfinite(start))], ["row", "place", "key", "width", "vector", "start"])

    return table.mapInArrow(run, "row long, place long, key long, width int, vector binary, start double")


def _best(rows: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The k first of each query by score, then key, null keys last."""
    score = rows["score"]
    order = np.lexsort((rows["key"], rows["none"], ~score, rows["q"]))
    q = rows["q"][order]
    head = np.ones(len(q), bool)
    head[1:] = q[1:] != q[:-1]
    at = np.arange(len(q))
    keep = order[at - np.maximum.accumulate(np.where(head, at, 0)) < k]
    return {c: x[keep] for c, x in rows.items()}


class Walk:
    """One slice of queries on its way through rows of blocks: the scores that may still be among each query's k best."""

    def __init__(self, q: np.ndarray, start: np.ndarray, k: int, block: int = BLOCK):
        self.q, self.k, self.block, self.floor = q, k, block, start.copy()
        self.top = np.full((len(q), k), _NONE)
        self.kept = {"q": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "none": np.zeros(0, bool), "score": np.zeros(0, np.int64)}
        self.scored = self.met = 0

    def through(self, keys: np.ndarray, none: np.ndarray, m: np.ndarray, high: np.ndarray, low: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> None:
        """own: (query, place) of the slice's queries that stand in these blocks."""
        bound = bounds(self.q, high, low)
        order = np.argsort(-bound, axis=1, kind="stable")
        found: list[dict] = []
        at, stride, blocks = 0, 1, bound.shape[1]
        self.met += bound.size
        while at < blocks:
            block = order[:, at : at + stride]
            limit = np.take_along_axis(bound, block, 1)
            q, j = np.nonzero(limit >= self.floor[:, None])
            if not len(q) and (limit[:, -1] < self.floor).all():
                break
            block = block[q, j]
            turn = np.argsort(block, kind="stable")
            q, block = q[turn], block[turn]
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(q) else np.zeros(0, np.int64)
            self.scored += len(q)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                mine, first = q[a:z], int(block[a]) * self.block
                score = clipped(product(self.q[mine], m[first : first + self.block]))
                here = np.flatnonzero((own[1] >= first) & (own[1] < first + self.block))
                if len(here):
                    where = np.searchsorted(mine, own[0][here])
                    there = (where < len(mine)) & (mine[np.minimum(where, len(mine) - 1)] == own[0][here])
                    score[where[there], own[1][here[there]] - first] = _NONE
                self._take(mine, score, first, keys, none, found)
            at, stride = at + stride, 2 * stride
        if found:
            rows = {c: np.concatenate([self.kept[c], *[f[c] for f in found]]) for c in self.kept}
            rows = {c: x[rows["score"] >= self.floor[rows["q"]]] for c, x in rows.items()}
            self.kept = _best(rows, self.k)

    def _take(self, mine: np.ndarray, score: np.ndarray, first: int, keys: np.ndarray, none: np.ndarray, found: list[dict]) -> None:
        near = np.flatnonzero((score >= self.floor[mine, None]).any(1))
        if not len(near):
            return
        mine, score = mine[near], score[near]
        both = np.concatenate([self.top[mine], score.astype(np.float64)], 1)
        self.top[mine] = np.partition(both, -self.k, axis=1)[:, -self.k :]
        kth = self.top[mine].min(1)
        self.floor[mine] = np.maximum(self.floor[mine], np.where(np.abs(kth) < 2.0**53, kth, _NONE))
        i, j = np.nonzero((score >= self.floor[mine, None]) & (score != _NONE))
        # of equal scores in one block only the k smallest keys can count
        found.append(_best({"q": mine[i], "key": keys[first + j], "none": none[first + j], "score": score[i, j].astype(np.int64)}, self.k))


def search(table: DataFrame, slice_rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(row, place, query_id, vec_id, score), written: up to k rows of each query from each task."""
    got = slice_rows.toArrow().combine_chunks()
    width = max(got.column("width").to_pylist(), default=0)
    q = np.zeros((got.num_rows, width))
    for i, (w, raw) in enumerate(zip(got.column("width").to_pylist(), got.column("vector").to_pylist(), strict=True)):
        q[i, :w] = np.frombuffer(raw, np.float64)
    start = got.column("start").to_pandas().fillna(_NONE).to_numpy(np.float64)
    row, place = (got.column(c).to_numpy() for c in ("row", "place"))
    names = got.column("key").to_numpy()
    held = table.sparkSession.sparkContext.broadcast((q, start, row, place, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, start, row, place, names = held.value
        walk = Walk(q, start, k, block)
        for b in batches:
            for i in range(b.num_rows):
                keys = b.column("keys")[i].values
                own = np.flatnonzero(row == b.column("row")[i].as_py())
                walk.through(keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), *[_matrix(b, i, c) for c in ("forward", "high", "low")], (own, place[own]))
        got = walk.kept
        at = got["q"]
        yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(place[at]), pa.array(names[at]), pa.array(got["key"], mask=got["none"]), pa.array(got["score"])], ["row", "place", "query_id", "vec_id", "score"])

    out = saved(table.mapInArrow(run, "row long, place long, query_id long, vec_id long, score long"), "topk-found")
    held.destroy()
    return out


def top_k(rows: DataFrame, key: str, vector: str, query: Column, k: int = 5, block: int = BLOCK, row_cells: int = ROW_CELLS, slice_cells: int = SLICE_CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each row for which `query` holds, with all other rows."""
    table = saved(index(clean(rows, key, vector, query), block, row_cells), "topk-blocks")
    asked = saved(queries(table, k), "topk-queries")
    size = asked.agg(F.count("*").alias("n"), F.max("width").alias("w")).first()
    slices = max(1, -(-size["n"] * max(size["w"] or 1, 1) // (slice_cells // 2)))  # dealt by hash, so half full on average
    dealt = asked.withColumn("slice", F.pmod(F.xxhash64("row", "place"), F.lit(slices)))
    parts = [search(table, dealt.filter(F.col("slice") == s), k, block) for s in range(slices)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, "vec_id", "embedding", F.pmod("vec_id", F.lit(50)) == 0)


ORACLE_OP12 = r"""with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(256 * x::double))) = 0),
s as (select q.rid, q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.rid <> c.rid where q.vec_id % 50 = 0),
r as (select query_id, vec_id, score, (row_number() over (partition by rid order by score desc, vec_id nulls last))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
