"""Line dedup by levelled sorted runs.

Documents arrive in batches. A batch gives a run: its line keys, sorted by hash, with the number of its documents that hold each. A run
first merge-anti-joins the keys that older runs have already brought to the limit (their count can't change a decision any more), and what
is left joins level 0. When a level has `fanout` runs they are compacted into one of the next level: counts of equal keys add up, and keys
that reach the limit move to the saturated run. After the last batch all levels are compacted once more.

Texts never move: a pass over the rows counts keys, and while the frequent keys are within BROADCAST_KEYS (counted first) a second pass drops
lines where the text stands. Beyond that bound the lines' hashes are joined by shuffle, and only the places of dropped lines come back.

Defined cases: a null or empty text is one empty line; lines of white space have an empty key and stay; equal rows count as documents of
their own; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandline.llm.common import fresh, pieces, saved

# Characters stripped from both ends of a line for its key.
STRIPPED = b" \t\n\x0b\x0c\r"
#: Frequent keys up to this many (16 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_KEYS = 200_000


def keys_of(text: str | None, min_chars: int = 1) -> list[bytes]:
    """A 16-byte hash of each line's key; empty for keys of fewer code points."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(STRIPPED).lower()  # of bytes: A-Z only
        long = len(key) >= 4 * min_chars or len(key.decode()) >= min_chars
        out.append(xxhash.xxh3_128_digest(key) if long else b"")
    return out


def pair(digests) -> tuple[pa.Array, pa.Array]:
    """Digests as two columns of 64 bits."""
    import numpy as np

    two = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(two[:, 0]), pa.array(two[:, 1])


@dataclass
class Runs:
    """The levels: each a list of sorted runs (h1, h2, n); `full` holds the keys that have reached the limit."""

    limit: int
    fanout: int = 3
    levels: list[list[DataFrame]] = field(default_factory=list)
    full: DataFrame | None = None

    def add(self, run: DataFrame) -> None:
        if self.full is not None:
            run = run.hint("merge").join(self.full.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._put(0, run)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._compact(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, merged)

    def _compact(self, runs: list[DataFrame]) -> DataFrame:
        """Adds counts of equal keys, moves full keys out, and writes both sides sorted."""
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        total = both.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        table = saved(total.sortWithinPartitions("h1", "h2"), "line-run")
        done = table.filter(F.col("n") >= self.limit).select("h1", "h2")
        self.full = done if self.full is None else self.full.unionByName(done).distinct()
        return table.filter(F.col("n") < self.limit)

    def frequent(self) -> DataFrame:
        """Keys at the limit over all batches."""
        rest = [r for level in self.levels for r in level]
        self.levels = []
        if rest:
            self._compact(rest)
        return self.full


def batch_runs(docs: DataFrame, text: str, min_chars: int, batches: int) -> list[DataFrame]:
    """One pass over the text: distinct keys of each document, counted where they are read and then by batch. A batch is a share of the rows by content hash."""
    rows = docs.select(F.pmod(F.xxhash64(F.lit(2), text), F.lit(batches)).alias("batch"), F.col(text).alias("text"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(parts, "text", 16 << 20):
            n: dict[tuple[int, bytes], int] = {}
            for batch, t in zip(b.column("batch").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k in set(keys_of(t, min_chars)):
                    if k:
                        n[batch, k] = n.get((batch, k), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in n], pa.int64()), *pair(k for _, k in n), pa.array(n.values(), pa.int64())], ["batch", "h1", "h2", "n"])

    counted = rows.mapInArrow(count, "batch long, h1 long, h2 long, n long").groupBy("batch", "h1", "h2").agg(F.sum("n").alias("n"))
    table = saved(counted.sortWithinPartitions("batch", "h1", "h2"), "line-batches")
    return [table.filter(F.col("batch") == b).select("h1", "h2", "n") for b in range(batches)]


def frequent_keys(docs: DataFrame, text: str = "text", limit: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(h1, h2) of keys found in at least `limit` documents."""
    runs = Runs(limit, fanout)
    for run in batch_runs(docs, text, min_chars, batches):
        runs.add(run)
    return runs.frequent()


def drop_frequent(rows: DataFrame, text: str, found: DataFrame, min_chars: int, out: list[str]) -> DataFrame:
    """rows with the columns `out` (kept text, lines, dropped lines, digest of the kept text). The frequent keys are broadcast."""
    got = found.toArrow()
    raw = [bytes(c.combine_chunks().cast(pa.int64()).to_numpy().astype("<i8")) for c in (got["h1"], got["h2"])] if len(got) else [b"", b""]
    keys = rows.sparkSession.sparkContext.broadcast(frozenset(raw[0][i : i + 8] + raw[1][i : i + 8] for i in range(0, len(raw[0]), 8)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(parts, text):
            done = [_split(t, keys.value, min_chars) for t in b.column(text).to_pylist()]
            cols = [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *out])

    return rows.mapInArrow(run, _with(rows, out))


def _with(rows: DataFrame, out: list[str]) -> StructType:
    return StructType([*rows.schema.fields, *[StructField(n, k) for n, k in zip(out, (StringType(), LongType(), LongType(), StringType()), strict=True)]])


def _split(text: str | None, frequent: frozenset, min_chars: int) -> tuple[str, int, int, str]:
    keys = keys_of(text, min_chars)
    return _kept(text, {i for i, k in enumerate(keys) if k in frequent})


def _kept(text: str | None, gone: set[int]) -> tuple[str, int, int, str]:
    lines = (text or "").split("\n")
    kept = (text or "") if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return kept, len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def drop_frequent_by_shuffle(rows: DataFrame, text: str, found: DataFrame, min_chars: int, out: list[str]) -> DataFrame:
    """As drop_frequent, for any number of keys: hashes of lines meet the keys by shuffle, and the places of dropped lines meet their text by its digest."""
    one, two, places = fresh(rows, "t1", "t2", "places")
    digest = [F.xxhash64(F.col(text)), F.xxhash64(F.lit(3), F.col(text))]
    texts = rows.select(digest[0].alias("t1"), digest[1].alias("t2"), F.col(text).alias("text"))

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(parts, "text"):
            for i, t in enumerate(b.column("text").to_pylist()):
                k = [(p, x) for p, x in enumerate(keys_of(t, min_chars)) if x]
                if k:
                    row = pa.array([i] * len(k))
                    yield pa.RecordBatch.from_arrays([b.column("t1").take(row), b.column("t2").take(row), pa.array([p for p, _ in k], pa.int64()), *pair(x for _, x in k)], ["t1", "t2", "pos", "h1", "h2"])

    lines = texts.mapInArrow(hashes, "t1 long, t2 long, pos long, h1 long, h2 long")
    gone = lines.join(found, ["h1", "h2"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("pos").alias("places"))
    names = rows.columns
    joined = rows.withColumns({one: digest[0], two: digest[1]}).join(gone.toDF(one, two, places), [one, two], "left")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(parts, text):
            done = [_kept(t, set(p or ())) for t, p in zip(b.column(text).to_pylist(), b.column(places).to_pylist(), strict=True)]
            cols = [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *cols], [*names, *out])

    return joined.select(*names, places).mapInArrow(run, _with(rows, out))


def dedup_lines(docs: DataFrame, out: list[str], text: str = "text", limit: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """docs with the four columns named in `out`: text without frequent lines, number of lines, of dropped lines, and digest; the columns of docs stay."""
    runs = saved(frequent_keys(docs, text, limit, min_chars, batches).distinct(), "line-frequent")
    small = runs.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return (drop_frequent if small else drop_frequent_by_shuffle)(docs, text, runs, min_chars, out)


def op1(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"), ["kept", "n_lines", "n_dropped", "kept_sha256"])
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE_LINES = r"""l as (select doc_id, rid, unnest(generate_series(1, len(ls))) as pos, unnest(ls) as line from (select doc_id, rid, string_split(coalesce(text, ''), chr(10)) as ls from docs)),
k as (select *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct rid) >= 10)"""
ORACLE_OP1 = rf"""with docs as (select row_number() over () as rid, doc_id, text from documents), {ORACLE_LINES},
d as (select doc_id, rid, count(*) as n_lines, count(f.key) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (f.key is null), '') as kept from k left join f using (key) group by doc_id, rid)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from d"""
