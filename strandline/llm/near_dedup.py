"""Near-duplicates by Order MinHash with banded alignment of candidates.

Two texts are near if a share of 0.8 or more of the longer one's words, lower-cased, can be aligned with the other's in the same order. That
holds for all pairs whose word edit similarity (1 - distance / longer length) or whose aligned five-word shingles (Jaccard) reach 0.8.

Sketch: five-word shingles, each labelled with its occurrence in the text; each order keeps its smallest ones, as many as MINIMA says, and hashes these
in text order, so a key is shared by texts that hold the same shingles in the same order. Twelve orders keep two. Where edits are scattered, a pair at
0.8 has only a fifth of its shingles in common and two minima seldom agree, so ten more orders keep one; of such pairs nine in ten share a key.
Equal texts are one node from the start. Nodes that share a key are a bucket; inside it a histogram of words bounds the aligned share from
above, and each node is linked to its nearest earlier node that passes the bound, never to all. Links are verified by banded alignment of
the words (bit-parallel, in a band as wide as the threshold allows). Verified links are contracted to classes by alternating stars. Buckets
that hold several classes go round again: now the nearest pair of each two classes is tested, then more of them, until no untested pair
across classes passes: so no link inside a bucket is lost, and a group of n copies costs about n comparisons. Only nodes with an untested pair go
round again. A bucket beyond BLOCK nodes is first cut into blocks, in other ways for each key, so that one group of copies joins up; only if several
classes are left in it does each node outside its largest class meet all blocks of its own and the neighbouring length bands, which no pair that
passes the bound reaches beyond. A pair is compared by bits of its histograms first, so most are turned down at an eighth of the bound's cost or less.

Defined cases: null is like the empty text, and texts without words form classes by equality only; texts of fewer than five words have one
shingle, so these meet only if all words are equal; rows may repeat; a class whose ids are all null has a null class id; clashing columns
don't matter as only key and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Words, byte_hash, chained, drop_saved, mix, pieces, saved, utf8

SHINGLE, SIMILARITY = 5, 0.8
MINIMA = (2,) * 12 + (1,) * 10
SKETCHES = len(MINIMA)
BINS, BLOCK, GROWTH = 512, 2000, 32
#: Counts whose reaching is held as a bit a bin: two histograms differ by as many words at least as bits.
PLANES = (1, 2, 3, 4)
#: Histograms compared at once, so that arrays stay near the cache.
NEAR_CACHE = 128
#: Nodes of a bucket up to which all its pairs are compared at once.
SMALL = 24
#: Wanted texts up to which their ids are sent to the scan.
FEW = 50_000


def shingled(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row of each shingle, hash), in text order; a text of 1 to k-1 words gives one."""
    at, h = w.shingles(k)
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for size in range(1, k):
            of = n[short] == size
            own[of] = chained(w.hash, w.first[short[of]], size)
        doc = np.concatenate([w.doc[at], short])
        order = np.argsort(doc, kind="stable")
        return doc[order], np.concatenate([h, own])[order]
    return w.doc[at], h


def occurrences(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """0, 1, ... of each hash within its text, in text order."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    i = np.arange(len(h))
    out = np.zeros(len(h), np.int64)
    out[order] = i - np.maximum.accumulate(np.where(new, i, 0))
    return out


def order_minhash(doc: np.ndarray, h: np.ndarray, n: int, minima: tuple[int, ...] = MINIMA) -> np.ndarray:
    """(n, orders) keys; minima: how many each order keeps. Rows without shingles have none of use."""
    sketches = len(minima)
    out = np.zeros((n, sketches), np.uint64)
    if not len(h):
        return out
    r = np.random.default_rng(1234)
    seeds = r.integers(1, 1 << 63, (sketches, 2), dtype=np.uint64) | np.uint64(1)
    label = mix(h + occurrences(doc, h).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    rows, sizes = doc[starts], np.diff(np.append(starts, len(doc)))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(sketches):
        with np.errstate(over="ignore"):
            v = (label ^ seeds[s, 0]) * seeds[s, 1]
        v ^= v >> np.uint64(32)
        picked = []
        for _ in range(minima[s]):
            low = np.minimum.reduceat(v, starts)
            at = np.flatnonzero(v == np.repeat(low, sizes))
            _, first = np.unique(doc[at], return_index=True)
            at = at[first]
            live = v[at] != top
            picked.append(np.where(live, at, np.iinfo(np.int64).max))
            v[at] = top
        pos = np.sort(np.stack(picked), 0)  # text order
        key = np.full(len(rows), s + 1, np.uint64)
        with np.errstate(over="ignore"):
            for p in pos:
                known = p < len(h)
                key = np.where(known, mix(key * np.uint64(31) + h[np.where(known, p, 0)]), key)
        out[rows, s] = key
    return out


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, n, keys, hist): node is the text's digest, n its words and hist their counts in BINS bins."""
    rows = docs.select(F.col(key).alias("doc_id"), digest(text).alias("node"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            n = len(b)
            w = Words(*utf8(b.column("text")), fold=True)
            keys = order_minhash(*shingled(w), n).view(np.int64)
            hist = np.bincount(w.doc * BINS + (w.hash % np.uint64(BINS)).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
            hist = np.minimum(hist, 255).astype(np.uint8)  # cut off, differences only get smaller: the bound holds
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SKETCHES, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(np.diff(w.first)), lists, pa.array([x.tobytes() for x in hist], pa.binary())], ["doc_id", "node", "n", "keys", "hist"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node binary, n long, keys array<long>, hist binary")


def digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def passing(n1: np.ndarray, n2, h1: np.ndarray, h2: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether enough words may align, words that can't) of one histogram h2, or as many, against rows h1. Bytes are summed eight at once, in two halves."""
    half, gap = np.uint64(0x00FF00FF00FF00FF), np.zeros(len(h1), np.int64)
    for at in range(0, len(h1), NEAR_CACHE):
        s = slice(at, at + NEAR_CACHE)
        one, two = h1[s], h2 if h2.ndim == 1 else h2[s]
        gaps = np.maximum(one, two)
        gaps -= np.minimum(one, two)
        eight = gaps.view(np.uint64)
        sums = (eight & half).sum(1) + ((eight >> np.uint64(8)) & half).sum(1)  # four counts of 16 bits: at most 64 times 510
        gap[s] = sums.view(np.uint16).reshape(-1, 4).sum(1, dtype=np.int64)
    return (n1 + n2 - gap) / 2 >= similarity * np.maximum(n1, n2) - 1e-9, gap


def bits(hist: np.ndarray, planes: tuple[int, ...]) -> np.ndarray:
    """(words, rows): for each of planes a bit a bin."""
    return np.ascontiguousarray(np.concatenate([np.packbits(hist >= k, axis=1) for k in planes], 1).view(np.uint64).T)


def group_links(n, own, comp, hist, take: int, similarity: float, less: list[frozenset] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of one bucket or block that pass the bound, of different classes, and the rows that have more of them. less None: each node is a
    class, and up to `take` nearest earlier nodes of each are taken; else up to `take` nearest pairs of each two classes, without pairs that meet in a
    bucket of lesser key: less has these keys of each node. One of a pair must be the block's own."""
    order = np.argsort(n, kind="stable")
    single = less is None
    n, own, hist, comp = n[order], own[order], hist[order], comp[order]
    if len(n) <= SMALL:
        i, at = np.tril_indices(len(n), -1)
        ok = (comp[at] != comp[i]).any(1) & (own[at] | own[i]) & (n[at] >= similarity * n[i] - 1e-9)
        i, at = i[ok], at[ok]
        ok, gap = passing(n[at], n[i], hist[at], hist[i], similarity)
        i, at, gap = i[ok], at[ok], gap[ok]
        if less and len(at):
            alone = np.array([less[a].isdisjoint(less[b]) for a, b in zip(order[i].tolist(), order[at].tolist(), strict=True)], bool)
            i, at, gap = i[alone], at[alone], gap[alone]
        if len(at) <= 1:
            return order[i], order[at], order[:0]
        kind = None if single else np.unique(comp, axis=0, return_inverse=True)[1].ravel()
        keep = _nearest(i if single else np.minimum(kind[at], kind[i]) * len(n) + np.maximum(kind[at], kind[i]), gap, take)
        left = np.ones(len(at), bool)
        left[keep] = False
        return order[i[keep]], order[at[keep]], order[np.union1d(i[left], at[left])]
    _, kind = np.unique(comp, axis=0, return_inverse=True)
    kind = kind.ravel()
    first, rest = bits(hist, PLANES[:1]), bits(hist, PLANES[1:])
    differing = lambda planes, j, i: np.bitwise_count(planes[:, j] ^ planes[:, i : i + 1]).sum(0, dtype=np.int64)
    mine = None if own.all() else np.flatnonzero(own)
    found: list[np.ndarray] = []
    more = np.zeros(len(n), bool)

    def leave(i: np.ndarray, at: np.ndarray, keep: np.ndarray) -> None:
        left = np.ones(len(at), bool)
        left[keep] = False
        more[at[left]] = more[i[left]] = True

    low = np.searchsorted(n, np.ceil(similarity * n - 1e-9).astype(np.int64))
    for i in range(1, len(n)):
        if mine is None or own[i]:
            j = slice(low[i], i)
            at = np.arange(low[i], i)
        else:
            j = at = mine[np.searchsorted(mine, low[i]) : np.searchsorted(mine, i)]
        if not len(at):
            continue
        room = n[j] + n[i] - 2 * similarity * n[i] + 2e-9  # words that may differ
        ok = np.flatnonzero((kind[j] != kind[i]) & (differing(first, j, i) <= room))
        at, room = at[ok], room[ok]
        if not len(at):
            continue
        at = at[differing(first, at, i) + differing(rest, at, i) <= room]
        if not len(at):
            continue
        ok, gap = passing(n[at], n[i], hist[at], hist[i], similarity)
        at, gap = at[ok], gap[ok]
        if less and len(at) and (of := less[order[i]]):
            alone = np.array([of.isdisjoint(less[j]) for j in order[at].tolist()], bool)
            at, gap = at[alone], gap[alone]
        keep = _nearest(np.zeros(len(at), np.int64) if single else kind[at], gap, take)
        leave(np.full(len(at), i), at, keep)
        at, gap = at[keep], gap[keep]
        found.append(np.stack([np.full(len(at), i), at, gap, np.minimum(kind[at], kind[i]), np.maximum(kind[at], kind[i])]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, at, gap, x, y = np.concatenate(found, 1)
    if not single:
        keep = _nearest(x * len(n) + y, gap, take)
        leave(i, at, keep)
        i, at = i[keep], at[keep]
    return order[i], order[at], order[np.flatnonzero(more)]


def _nearest(group: np.ndarray, gap: np.ndarray, take: int) -> np.ndarray:
    """Places of the `take` least gaps of each group."""
    if len(group) <= 1:
        return np.arange(len(group))
    by = np.lexsort((gap, group))
    new = np.append(True, group[by][1:] != group[by][:-1])
    rank = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return by[rank < take]


def stream_links(batches: Iterator[pa.RecordBatch], take: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of a partition whose rows are sorted by (key, block), and after them the nodes with pairs left, as a, without b. A bucket may straddle batches; pairs are done as arrays, larger buckets one by one."""
    rest: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> pa.RecordBatch:
        ids = [table[c].to_numpy() for c in ("key", "block")]
        cut = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in ids], 0)])) if len(table) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(table)))
        n, own = table["n"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
        comp = np.frombuffer(b"".join(table["comp"].to_pylist()), np.uint64).reshape(-1, 2)
        hist = np.frombuffer(b"".join(table["hist"].to_pylist()), np.uint8).reshape(-1, BINS)
        keys = table["keys"].to_pylist() if "keys" in table.column_names else None
        key_of = ids[0]
        two = cut[size == 2]
        ok, _ = passing(n[two], n[two + 1], hist[two], hist[two + 1], similarity)
        two = two[ok & (comp[two] != comp[two + 1]).any(1) & (own[two] | own[two + 1])]
        if keys is not None:
            two = np.array([i for i in two.tolist() if not any(x < key_of[i] and x in keys[i + 1] for x in keys[i])], np.int64)
        a, b, more = [two], [two + 1], []
        for at, g in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            s = slice(at, at + g)
            less = None if keys is None else [frozenset(x for x in of if x < key_of[at]) for of in keys[s]]
            x, y, left = group_links(n[s], own[s], comp[s], hist[s], take, similarity, less)
            a.append(x + at)
            b.append(y + at)
            more.append(left + at)
        node = table["node"].combine_chunks()
        key = table["key"].combine_chunks()
        none = np.zeros(sum(map(len, more)), np.int64)
        pick = lambda of, *x: of.take(pa.array(np.concatenate([*x, none[:0]])))
        ends = pa.array(np.concatenate([*b, none]), mask=np.repeat([False, True], [sum(map(len, b)), len(none)]))
        return pa.RecordBatch.from_arrays([pick(node, *a, *more), node.take(ends), pick(key, *a, *more)], ["a", "b", "key"])

    for batch in batches:
        if not len(batch):
            continue
        rest.append(batch)
        ids = [batch.column(c).to_numpy() for c in ("key", "block")]
        changed = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], 0)) if len(batch) > 1 else np.zeros(0, int)
        if len(changed):
            cut = int(changed[-1]) + 1
            rest[-1] = batch.slice(0, cut)
            yield flush(pa.Table.from_batches(rest))
            rest = [batch.slice(cut)]
    if rest:
        yield flush(pa.Table.from_batches(rest))


def aligned(a: list[int], b: list[int], need: int) -> int:
    """A length of common subsequences, `need` or more if and only if the longest reaches it. Bit-parallel, within the diagonals that `need` leaves: a clear bit is a step up."""
    if min(len(a), len(b)) < need:
        return 0
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    found, need = lo + hi, need - lo - hi
    if not a or not b or need <= 0:
        return found
    above, below = len(b) - need, len(a) - need  # rows of a that a column may lie behind, and ahead
    if above < 0 or below < 0:
        return found
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    marks: dict[int, int] = {}  # of frequent words: their places as bits
    for x, at in places.items():
        if len(at) > 8:
            flags = np.zeros(len(a), np.uint8)
            flags[at] = 1
            marks[x] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    width = above + below + 1
    full = (1 << width) - 1
    v = full
    start = -above
    for x in b:
        if x in marks:
            pm = (marks[x] >> start if start >= 0 else marks[x] << -start) & full
        else:
            pm = 0
            for i in places.get(x, ()):
                if 0 <= i - start < width:
                    pm |= 1 << (i - start)
        u = v & pm
        v = ((v + u) | (v - u)) & full
        found += not v & 1  # the lowest row leaves the band
        v = v >> 1 | 1 << (width - 1)
        start += 1
    return found + width - v.bit_count()


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Aligned words over the words of the longer text reach the threshold."""
    need = int(np.ceil(similarity * max(len(a), len(b)) - 1e-9))
    return 0 < need <= min(len(a), len(b)) and aligned(a.tolist(), b.tolist(), need) >= need


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of pairs whose texts align; texts: (node, text), one row each."""
    t = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.select("a", "b").join(t("a").hint("merge"), "a").join(t("b").hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in pieces(iter([big]), "ta"):
                x, y = (Words(*utf8(b.column(c)), fold=True) for c in ("ta", "tb"))
                of = lambda w, k: w.hash[w.first[k] : w.first[k + 1]]
                ok = [similar(of(x, k), of(y, k), similarity) for k in range(len(b))]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _linker(take: int, similarity: float):
    return lambda batches: stream_links(batches, take, similarity)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node either has one edge to a smaller node, or only edges from larger ones."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    odd = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 and down > 0")
    return odd.isEmpty()


def contracted(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, comp) of all nodes in edges, which are read more than once: comp is the least node of the component. Alternating large and small stars; each round is written."""
    e = last = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    for turn in range(rounds):
        if _is_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(low, "v").select("u", F.col("m").alias("v"))  # an edge hangs on the least node next to its lower end
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # the lower ends of one node meet in the least of them; the row of that one keeps the node itself
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e = saved(small, "near-edges")
        if turn:  # the first edges are the caller's
            drop_saved(e.sparkSession, last)
        last = e
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def merged(comps: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, comp) after new links: only the graph of classes that they join is contracted."""
    if comps is None:
        return None if links.isEmpty() else saved(contracted(links), "near-classes")
    side = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    known = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    ca, cb = F.coalesce("ca", "a"), F.coalesce("cb", "b")
    across = saved(known.select(F.greatest(ca, cb).alias("a"), F.least(ca, cb).alias("b")).filter("a <> b").distinct(), "near-across")
    if across.isEmpty():
        return comps
    to = saved(contracted(across), "near-merged")
    new = to.select("node").join(comps.select(F.col("comp").alias("node")).distinct(), "node", "left_anti").select("node", F.col("node").alias("comp"))
    old = comps.unionByName(new).select("node", F.col("comp").alias("was"))
    out = saved(old.join(to.select(F.col("node").alias("was"), "comp"), "was", "left").select("node", F.coalesce("comp", "was").alias("comp")), "near-classes")
    drop_saved(out.sparkSession, comps, across, to)
    return out


def _band(n: str, similarity: float):
    """A number of n's length band: nodes that pass the bound are of one band or of two next to each other. A band is a little wider than the bound allows."""
    return F.floor(F.ln(F.col(n)) / (-1.001 * math.log(similarity))).cast("int") if similarity < 1 else F.col(n).cast("int")


def dealt(state: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of buckets by block: key, block, own, node, n, hist, comp, and with classes the keys that the node still has. Before there are classes a node is in one block. After that
    nodes outside the largest class meet all blocks of their band and of those beside it, so that each pair across classes that may pass meets."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("long")
    side = lambda of: F.pmod(F.xxhash64("key", "node"), of)
    if "comp" not in state.columns:
        m = state.select("node", "n", "hist", F.inline("buckets"))
        return m.select("key", side(blocks).alias("block"), F.lit(True).alias("own"), "node", "n", "hist", F.col("node").alias("comp"))
    m = state.select("node", "n", "hist", "comp", F.col("buckets.key").alias("keys"), F.inline("buckets")).withColumn("band", _band("n", similarity))
    number = lambda band, i: F.shiftleft(band.cast("long"), 32) + i
    home = number(F.col("band"), side(F.greatest(F.lit(1), F.ceil(F.col("here") / BLOCK))))
    of = lambda count, band: F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(count) / BLOCK) - 1), lambda i: number(band, i))).otherwise(F.array().cast("array<long>"))
    near = F.concat(of("under", F.col("band") - 1), of("here", F.col("band")), of("over", F.col("band") + 1))
    to = F.when(blocks == 1, F.array(F.lit(-1).cast("long"))).when(F.col("comp") == F.col("top"), F.array("home")).otherwise(near)
    return m.withColumn("home", F.when(blocks == 1, F.lit(-1).cast("long")).otherwise(home)).withColumn("block", F.explode(to)).select("key", "block", (F.col("block") == F.col("home")).alias("own"), "node", "n", "hist", "comp", "keys")


def narrowed(state: DataFrame, comps: DataFrame | None, still: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The next round's nodes: (node, n, hist, comp, buckets), where buckets are those of open (key, node) that hold several classes, each with its size, its largest class
    and the sizes of the node's length band and those beside it. Keys are looked at without what is wide; a histogram moves once a node, not once a key."""
    classed = state.select("node", "n", F.col("node").alias("comp"), "buckets")
    if comps is not None:
        classed = state.select("node", "n", "buckets").join(comps, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"), "buckets")
    each = saved(classed.select("node", "comp", _band("n", similarity).alias("band"), F.inline("buckets")).select("node", "comp", "band", "key").join(still, ["key", "node"], "left_semi"), "near-keys")
    sizes = each.groupBy("key", "comp").agg(F.count("*").alias("s"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("classes"), F.sum("s").alias("c"), F.max(F.struct("s", "comp")).alias("top")).filter("classes > 1").select("key", "c", F.col("top.comp").alias("top"))
    bands = each.groupBy("key", "band").agg(F.count("*").alias("s")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "s"))).alias("bands"))
    size = lambda by: F.coalesce(F.try_element_at("bands", F.col("band") + by), F.lit(0))
    sized = each.join(largest.join(bands, "key"), "key").select("node", "comp", F.struct("key", "c", "top", size(-1).alias("under"), size(0).alias("here"), size(1).alias("over")).alias("bucket"))
    buckets = sized.groupBy("node").agg(F.first("comp").alias("comp"), F.sort_array(F.collect_list("bucket")).alias("buckets"))
    out = saved(state.select("node", "n", "hist").join(buckets, "node"), "near-state")
    drop_saved(out.sparkSession, each)
    return out


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, comp, class_id): comp is the class by its least node; class_id is the least id of the class, null if all its ids are."""
    spark = docs.sparkSession
    sketch = saved(sketched(docs, key, text), "near-sketch")
    ids = saved(sketch.select("doc_id", "node"), "near-ids")
    nodes = saved(sketch.filter("n > 0").select("node", "n", "keys", "hist").dropDuplicates(["node"]), "near-nodes")
    drop_saved(spark, sketch)  # what is wide goes as soon as it has been read for the last time
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    # one row a node that shares a key: its histogram is held once, not with each key
    shared = keyed.join(sizes, "key").groupBy("node").agg(F.collect_list(F.struct("key", "c")).alias("buckets"))
    state = saved(nodes.select("node", "n", "hist").join(shared, "node"), "near-state")
    drop_saved(spark, nodes)
    id_text = docs.select(digest(text).alias("node"), F.col(text).alias("text"))
    comps, tested, take = None, None, 1
    while True:
        rows = dealt(state, similarity).repartition("key", "block").sortWithinPartitions("key", "block")
        found = rows.mapInArrow(_linker(take, similarity), "a binary, b binary, key long")
        # a pair without b is a node with pairs left; a node has SKETCHES keys at most, so the list is short
        whole = found.groupBy(F.when(F.col("b").isNull(), F.col("a")).otherwise(F.least("a", "b")).alias("a"), F.when(F.col("b").isNotNull(), F.greatest("a", "b")).alias("b"))
        pairs = saved(whole.agg(F.collect_set(F.when(F.col("b").isNull(), F.col("key"))).alias("open")), "near-pairs")
        linked = pairs.filter("b is not null").select("a", "b")
        new = linked if tested is None else saved(linked.join(tested, ["a", "b"], "left_anti"), "near-new")
        links = None
        if not new.isEmpty():
            wanted = new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct()
            # wanted ids grow with the corpus: only while they are few do they go to the texts, else both are merged
            few = wanted.limit(FEW + 1).count() <= FEW
            texts = id_text.join(wanted.hint("broadcast" if few else "merge"), "node", "left_semi").dropDuplicates(["node"])
            links = saved(verified(new, texts, similarity), "near-links")
            comps = merged(comps, links)
        # of a node without more, all pairs across classes that pass the bound are tested, and merging only takes pairs away
        still = pairs.filter("b is null").select(F.explode("open").alias("key"), F.col("a").alias("node"))
        if tested is None:  # blocks haven't met yet
            still = still.unionByName(state.select("node", F.inline("buckets")).filter(F.col("c") > BLOCK).select("key", "node"))
        still = saved(still.distinct(), "near-open")
        done = still.isEmpty()
        if not done:
            tested = new if tested is None else tested.unionByName(new)
            left = narrowed(state, comps, still, similarity)
            drop_saved(spark, state, still, links)
            state = left
            take *= GROWTH if tested is not new else 1  # the first round tests neighbours, the second pairs of classes
            continue
        drop_saved(spark, state, still, links, pairs)
        break
    least = ids.groupBy("node").agg(F.min("doc_id").alias("least"))
    if comps is not None:
        of = least.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        by = of.groupBy("comp").agg(F.min("least").alias("class_id"))
        least = of.join(by, "comp").select("node", "comp", "class_id")
    else:
        least = least.select("node", F.col("node").alias("comp"), F.col("least").alias("class_id"))
    return ids.join(least, "node").select("doc_id", "node", "comp", "class_id")


def op3(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id")
