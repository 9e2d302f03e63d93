"""Maximal periodic runs of words, by branching tandem repeats in a suffix tree.

A tandem repeat ww at word i branches if the word after it differs from its first one; then suffixes i and i + |w| part at the tree node of depth
|w|. Stoye and Gusfield find all of them by visiting, at each node v of depth D, the leaves below all children but the largest, and asking for
each leaf i whether i + D or i - D is below v too. A leaf is visited once for each such child above it, at most log2(n) times. Every maximal run of
period q ends in a branching repeat; rotating that one to the left while the word before it equals the last of its first half gives the run's
start, and repeats that cover the same stretch with a multiple of its period are merged into the least one.

The tree is held as arrays of many texts at once, so a step of the walk is an array operation over all leaves still on their way up: suffixes
are sorted by doubling, common prefixes come from the classes of each doubling, and nodes are the intervals between smaller common prefixes. A
run of exponent x shows in x leaves below its node, so classes and nodes of fewer leaves are not split any further: their leaves hang from the
node above, where the test of the next word still tells branching repeats apart.

Texts never meet, so there is no shuffle. Defined cases: null and empty texts have no words, no runs and an empty collapsed text; equal rows give
equal results; words are compared as bytes; memory follows the longest text of a task (about 300 bytes a word); extra columns are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import pieces

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """The tree of several texts' suffixes, nodes of at least `leaves` leaves. words: a number for each word, unequal between texts; first: each
    text's first place, and the end."""

    def __init__(self, words: np.ndarray, first: np.ndarray, leaves: int):
        self.words, self.n, self.least = words, len(words), leaves
        size = np.diff(first)
        self.begin, self.stop = np.repeat(first[:-1], size), np.repeat(first[1:], size)
        self._sort()
        self._prefixes()
        self._nodes()

    def _sort(self) -> None:
        """Classes of equal 1, 2, 4, ... words: a class of enough members has its first place in the order as its number, others have one of their own each."""
        n = self.n
        order = np.argsort(self.words, kind="stable")
        key, old, rank = self.words[order], np.zeros(n, np.int64), np.empty(n + 1, np.int64)
        rank[n] = -1
        self.rank: list[np.ndarray] = []
        active, h = order, 1
        while len(active):
            at = np.arange(len(active))
            new = np.ones(len(active), bool)
            new[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            fresh = np.ones(len(active), bool)
            fresh[1:] = old[1:] != old[:-1]
            place = old + at - np.maximum.accumulate(np.where(fresh, at, 0))
            big = (np.diff(np.append(heads, len(active))) >= self.least)[group]
            rank = rank.copy()
            rank[active] = np.where(big, place[heads][group], place)
            self.rank.append(rank)
            if len(self.rank) == 1:
                self.leaf = active[big]
            else:
                h *= 2
            active = active[big]
            if not len(active):
                break
            follow = active + h
            second = np.where(follow < self.stop[active], rank[np.minimum(follow, n)] + 1, 0)
            key = rank[active] * (n + 1) + second
            turn = np.argsort(key, kind="stable")
            active, key = active[turn], key[turn]
            old = rank[active]
        if not self.rank:
            self.rank.append(rank)
            self.leaf = order
        self.leaf = self.leaf[np.argsort(self.rank[-1][self.leaf], kind="stable")]
        self.slot = np.full(n + 1, -1, np.int64)
        self.slot[self.leaf] = np.arange(len(self.leaf))

    def _prefixes(self) -> None:
        """Common words of neighbours in the order; c[r] is of leaves r - 1 and r, zero at both ends."""
        a, b = self.leaf[:-1], self.leaf[1:]
        top = np.full(len(a), -1, np.int64)
        same = np.arange(len(a))
        for k, r in enumerate(self.rank):
            same = same[r[a[same]] == r[b[same]]]
            if not len(same):
                break
            top[same] = k
        common = np.where(top >= 0, np.left_shift(1, np.maximum(top, 0)), 0)
        for k in range(int(top.max(initial=0)) - 1, -1, -1):
            more = np.flatnonzero(top > k)
            x, y = a[more] + common[more], b[more] + common[more]
            hit = self.rank[k][np.minimum(x, self.n)] == self.rank[k][np.minimum(y, self.n)]
            common[more[hit]] += 1 << k
        self.c = np.zeros(len(self.leaf) + 1, np.int64)
        self.c[1:-1] = common

    def _nodes(self) -> None:
        """Intervals of leaves, their depth and parent, the top of each heavy path, and the node each leaf hangs from."""
        c, m = self.c, len(self.leaf)
        at = np.flatnonzero(c > 0)
        zero = np.flatnonzero(c == 0)
        left, right = zero[np.searchsorted(zero, at) - 1], zero[np.minimum(np.searchsorted(zero, at), len(zero) - 1)]  # right for depth 1
        deep = np.flatnonzero(c[at] > 1)
        if len(deep):
            r, d = at[deep], c[at[deep]]
            lows = [c]  # lows[k][i]: least of c[i : i + 2**k]
            while 1 << len(lows) <= int((right - left).max()):
                p, h = lows[-1], 1 << (len(lows) - 1)
                lows.append(np.concatenate([np.minimum(p[:-h], p[h:]), p[-h:]]))
            up, down = r.copy(), r.copy()
            for k in range(len(lows) - 1, -1, -1):
                h = 1 << k
                ok = up + h <= m
                ok[ok] = lows[k][up[ok] + 1] >= d[ok]
                up[ok] += h
                ok = down - h >= 0
                ok[ok] = lows[k][down[ok] - h] >= d[ok]
                down[ok] -= h
            left[deep], right[deep] = down - 1, up + 1
        _, head, inverse = np.unique(left * (m + 1) + right, return_index=True, return_inverse=True)
        of = np.full(m + 1, -1, np.int64)
        of[at] = inverse
        self.left, self.right, self.depth = left[head], right[head], c[at[head]]
        edge = np.where(c[self.left] >= c[self.right], self.left, self.right)
        self.parent = of[edge]
        count = self.right - self.left
        kept = count >= self.least
        hang = of[np.where(c[:-1] >= c[1:], np.arange(m), np.arange(1, m + 1))] if m else np.zeros(0, np.int64)
        while len(low := np.flatnonzero(~kept[hang])):
            hang[low] = self.parent[hang[low]]
        self.hang = hang
        # the largest child of each node goes on its parent's path
        nodes = np.flatnonzero(kept & (self.parent >= 0))
        nodes = nodes[np.lexsort((count[nodes], self.parent[nodes]))]
        last = np.ones(len(nodes), bool)
        last[:-1] = self.parent[nodes][1:] != self.parent[nodes][:-1]
        path = np.arange(len(count))
        path[nodes[last]] = self.parent[nodes[last]]
        while not np.array_equal(path, further := path[path]):
            path = further
        self.path = path

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, half length) of branching tandem repeats at nodes of enough leaves."""
        w, n, found = np.append(self.words, -1), self.n, []
        i, v = self.leaf, self.hang
        while len(i):
            d, end = self.depth[v], self.stop[i]
            below = lambda j, v=v: (self.slot[j] >= self.left[v]) & (self.slot[j] < self.right[v])
            ahead = np.flatnonzero(i + d < end)
            ahead = ahead[below(i[ahead] + d[ahead], v[ahead])]
            at, half = i[ahead], d[ahead]
            parts = (at + 2 * half >= end[ahead]) | (w[at + half] != w[np.minimum(at + 2 * half, n)])
            found.append((at[parts], half[parts]))
            behind = np.flatnonzero(i - d >= self.begin[i])
            behind = behind[below(i[behind] - d[behind], v[behind])]
            at, half = i[behind], d[behind]
            parts = (at + half >= end[behind]) | (w[at] != w[np.minimum(at + half, n)])
            found.append((at[parts] - half[parts], half[parts]))
            v = self.parent[self.path[v]]
            i, v = i[v >= 0], v[v >= 0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, half = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        both = np.unique(at * (n + 1) + half)
        return both // (n + 1), both % (n + 1)


def find_runs(words: np.ndarray, first: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Rows (start, end, period) of maximal runs of at least max(min_length, min_exponent * period) words, by start and period."""
    tree = SuffixTree(words, first, min_exponent)
    at, half = tree.branching_repeats()
    need = np.maximum(min_length, min_exponent * half) - 2 * half  # words to the left that must be rotated in
    for s in range(8):  # most repeats end here
        ok = (s >= need) | (at - 1 - s >= tree.begin[at]) & (words[at - 1 - s] == words[at - 1 - s + half])
        at, half, need = at[ok], half[ok], need[ok]
    out = []
    for i, q, least, low in zip(at.tolist(), half.tolist(), need.tolist(), tree.begin[at].tolist(), strict=True):
        start, step = i, max(64, 2 * q)
        while start > low:
            a = max(low, start - step)
            differ = np.flatnonzero(words[a:start] != words[a + q : start + q])
            if len(differ):
                start = a + int(differ[-1]) + 1
                break
            start, step = a, 2 * step
        if i - start >= least:
            out.append((start, i + 2 * q, q))
    runs = np.array(sorted(out), np.int64).reshape(-1, 3)
    one = np.ones(len(runs), bool)
    one[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)  # the least period of a stretch
    runs = runs[one]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(key, n_words, runs, collapsed): runs as (start, length, period) by start and period; collapsed is the text with one period of each run, its words joined by one space."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts = [(t or "").encode().split() for t in b.column("text").to_pylist()]  # of bytes: splits at [\x20\x09-\x0D]
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            words, known = np.empty(first[-1], np.int64), 0
            for t, a, z in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True):
                number = dict(zip(set(t), range(known, known + z - a)))
                words[a:z] = np.fromiter(map(number.__getitem__, t), np.int64, z - a)
                known += len(number)
            runs = find_runs(words, first, min_length, min_exponent)
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
            np.add.at(drop, runs[:, 1], -1)
            drop = np.cumsum(drop) > 0
            doc = np.searchsorted(first, runs[:, 0], "right") - 1
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            collapsed = []
            for i, (t, a) in enumerate(zip(texts, first[:-1].tolist(), strict=True)):
                if cut[i] < cut[i + 1]:
                    gone = drop[a : a + len(t)].tolist()
                    t = [x for x, g in zip(t, gone, strict=True) if not g]
                collapsed.append(b" ".join(t).decode())
            spans = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[doc]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(RUN))
            listed = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.diff(first)), listed, pa.array(collapsed, pa.string())], ["key", "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("key", key)


def with_repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) where a tenth of the documents, by crc32 of the id, has its words from some place on replaced by repetitions of the first of them."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = docs.select(F.col(key), F.col(text), g.alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("_w"))
    n = F.size("_w")
    rows = words.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    a = F.col("_a")
    rows = rows.withColumn("_p", (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int"))

    def word(i: Column) -> Column:
        return F.get("_w", F.when(i >= a, a + (i - a) % F.col("_p")).otherwise(i))

    tail = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return rows.select(key, F.when(a.isNotNull(), tail).otherwise(F.col(text)).alias(text))


def top_run(runs: Column) -> Column:
    """The run of greatest length / period; ties go to the smallest start, then period. Runs come by start and period, so the first of the greatest stays."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op11(docs: DataFrame) -> DataFrame:
    found = periodic_runs(with_repeated_tails(docs.select("doc_id", "text"))).withColumn("top", top_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
