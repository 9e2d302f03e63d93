"""Removal of long repeated byte strings with a sparse suffix array built by deep-shallow sorting.

A string of LENGTH bytes that stands twice holds, at the same offset, the same sampled GRAM-byte string: the one of least hash within it,
and of several equal ones the first, or the last where that leaves more room to the end than the first does to the start. So only the suffixes
that start at such samples are sorted, two for every LENGTH - GRAM + 1 bytes or so, and only those whose sample stands elsewhere too. In a
stretch that repeats a short string, the samples at its ends stand for the strings that go beyond it; those within are the same after each
repeat, so a long stretch covers itself, and only the samples near its ends are kept:
1. one pass over the texts samples positions. Of the LENGTH - GRAM bytes that a match needs around the sample, half or more are on one
   side, so a sample has two keys: the hash of itself with that half on its left, and on its right. Keys are counted over the corpus;
2. samples whose key has company go to its bucket with the bytes around them, at most LENGTH - GRAM on each side;
3. in a bucket, the parts right of the sample are ordered by deep-shallow sorting: multikey quicksort on 8-byte characters down to SHALLOW
   bytes, then a blind trie for what still agrees; so are the reversed parts on the left;
4. neighbours in the left order are united from the longest common part down, the smaller cluster into the larger; a member that comes in
   meets its neighbours in the right order, which agree with it longest. Common parts of l bytes on the left and r on the right that
   reach LENGTH with the sample cover l bytes before it to r bytes after. That finds all coverage without comparing all pairs;
5. spans are gathered by text and cut out.
Besides that, documents are marked that hold more than PASSAGE - 1 words in a row which another document holds too, however few bytes these are: words
are sampled and bucketed alike, and in a bucket the runs of PASSAGE words around the sample meet those of other documents.
Equal texts are one text from the start (wholly covered, if long enough). Buckets beyond BLOCK members are cut into blocks, taken two by two.

Defined cases: null is empty; texts shorter than LENGTH lose nothing; rows may repeat (they are each other's elsewhere); offsets are UTF-8
bytes and may fall inside a character; clashing columns don't matter, as only key and text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Words, chained, distinct, drop_saved, pieces, prefix_hash, saved, span_hash, utf8

LENGTH, GRAM = 400, 100
SHALLOW, BLOCK = 32, 50_000
PASSAGE, WORD_GRAM = 51, 14
PART = 1 << 25  # bytes or words sampled at once
SAMPLED_BYTES = 1 << 19  # of short texts together
_POS_BITS = 26
LEFT, RIGHT, WORDS = 1, 2, 3  # lowest bits of a key: what it is the hash of
#: A text of more than PASSAGE - 1 words.
LONG_TEXT = rf"\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{PASSAGE - 1}}}[^\x20\x09-\x0D]"


# ---- sorting -------------------------------------------------------------------------------------------------


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Order of byte strings: ternary quicksort by 8-byte characters to SHALLOW bytes, blind tries below."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) < 2:
            out += part
        elif depth >= SHALLOW:
            out += blind_trie(strings, part)
        else:
            key = [int.from_bytes(strings[i][depth : depth + 8].ljust(8, b"\0"), "big") * 16 + min(len(strings[i]) - depth, 8) for i in part]
            pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
            less = [i for i, k in zip(part, key, strict=True) if k < pivot]
            same = [i for i, k in zip(part, key, strict=True) if k == pivot]
            more = [i for i, k in zip(part, key, strict=True) if k > pivot]
            todo.append((more, depth))
            todo.append((same, depth + 8) if pivot & 15 == 8 else (same[:1], depth) if len(same) == 1 else (same, SHALLOW))
            todo.append((less, depth))
    return out


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], part: list[int]) -> list[int]:
    """Order of strings with long common parts: a trie that keeps only branching depths, so an insertion compares with one string."""
    byte = lambda i, d: strings[i][d] if d < len(strings[i]) else -1
    root: list = [part[0]]  # a leaf is a list of equal strings; a node is (depth, {byte: child})
    for i in part[1:]:
        at = root
        while isinstance(at, tuple):
            at = at[1].get(byte(i, at[0])) or next(iter(at[1].values()))
        j = at[0]
        d = lcp(strings[i], strings[j])
        if d == len(strings[i]) == len(strings[j]):
            at.append(i)
            continue
        up, at = None, root
        while isinstance(at, tuple) and at[0] < d:
            up, at = (at, byte(i, at[0])), at[1][byte(i, at[0])]
        if isinstance(at, tuple) and at[0] == d:
            at[1][byte(i, d)] = [i]
            continue
        node = (d, {byte(j, d): at, byte(i, d): [i]})
        if up is None:
            root = node
        else:
            up[0][1][up[1]] = node
    out: list[int] = []
    stack = [root]
    while stack:
        at = stack.pop()
        if isinstance(at, tuple):
            stack += [at[1][b] for b in sorted(at[1], reverse=True)]
        else:
            out += at
    return out


def bucket_cover(left: list[bytes], right: list[bytes], need: int) -> list[list[tuple[int, int]]]:
    """For each member (bytes left of the sample reversed, bytes right of it): maximal (l, r) with l + r >= need shared with another member."""
    n = len(left)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n == 2:
        l, r = lcp(left[0], left[1]), lcp(right[0], right[1])
        if l + r >= need:
            out[0].append((l, r))
            out[1].append((l, r))
        return out
    same: dict[tuple[bytes, bytes], list[int]] = {}
    for i in range(n):
        same.setdefault((left[i], right[i]), []).append(i)
    kinds = list(same.items())
    found: list[list[tuple[int, int]]] = [[(len(a), len(b))] if len(who) > 1 and len(a) + len(b) >= need else [] for (a, b), who in kinds]
    if len(kinds) > 1:
        ls, rs = [k[0] for k, _ in kinds], [k[1] for k, _ in kinds]
        by_right = deep_shallow(rs)
        rank = [0] * len(kinds)
        for p, i in enumerate(by_right):
            rank[i] = p
        by_left = deep_shallow(ls)
        joins = sorted(((lcp(ls[a], ls[b]), p) for p, (a, b) in enumerate(zip(by_left, by_left[1:], strict=False))), reverse=True)
        cluster = {p: [rank[i]] for p, i in enumerate(by_left)}  # at each cluster's first place
        head = list(range(len(kinds)))

        def find(p: int) -> int:
            while head[p] != p:
                head[p] = head[head[p]]
                p = head[p]
            return p

        def meet(i: int, j: int, l: int) -> None:
            r = lcp(rs[i], rs[j])
            if l + r >= need:
                for x in (i, j):
                    if not found[x] or found[x][-1][1] < r or found[x][-1][0] < l:
                        found[x].append((l, r))

        for l, p in joins:
            a, b = find(p), find(p + 1)
            big, small = cluster.pop(a), cluster.pop(b)
            head[b] = a
            if len(small) > len(big):
                big, small = small, big
            met = [(x, bisect_left(big, x)) for x in small]
            for x, at in met:
                if at:
                    meet(by_right[x], by_right[big[at - 1]], l)
                if at < len(big):
                    meet(by_right[x], by_right[big[at]], l)
            if len(small) * 8 > len(big):
                big = sorted(big + small)
            else:
                for x in small:
                    insort(big, x)
            cluster[a] = big
    for (_, who), f in zip(kinds, found, strict=True):
        for i in who:
            out[i] = f
    return out


# ---- sampling ------------------------------------------------------------------------------------------------


def sliding_least(c: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    span, low = 1, c
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (width - span)], low[width - span :]) if width > span else low


def stretches(pick: np.ndarray, same: np.ndarray, values: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples to keep, start, end) of sorted samples; same[i]: sample i + 1 has the same gram in the same text.

    Equal grams at a distance d <= gram make the bytes between repeat with period d. A stretch of length + d bytes covers itself, as each string in
    it stands d bytes further too. A string that goes beyond the stretch has its sample within `length` of that end; any other, shifted by
    repeats, is found at a sample less than length + d from the start.
    """
    gap = np.diff(pick)
    step = np.where(same & (gap <= gram), gap, 0)
    if not len(step) or not step.any():
        return pick, pick[:0], pick[:0]
    cut = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
    first, last = cut, np.append(cut[1:], len(step))  # samples first..last are one chain
    d = step[first]
    start, end = pick[first], pick[last] + gram
    whole = (d > 0) & (end - start >= length + d)
    for i in np.flatnonzero(whole).tolist():  # equal hashes chose the chain; its values decide
        whole[i] = np.array_equal(values[start[i] : end[i] - d[i]], values[start[i] + d[i] : end[i]])
    first, last, d, start, end = first[whole], last[whole], d[whole], start[whole], end[whole]
    keep = np.ones(len(pick), bool)
    for a, b, x, s, e in zip(first.tolist(), last.tolist(), d.tolist(), start.tolist(), end.tolist(), strict=True):
        at = pick[a : b + 1]
        keep[a : b + 1] &= (at <= s + length + x) | (at >= e - length - x)
    return pick[keep], start, end


def picked(values: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each value, places of the sampled grams, start and end of stretches) of values that are bytes or words."""
    none = np.zeros(0, np.int64)
    n = len(values)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if n < length:
        return doc, none, none, none
    if n >= 1 << _POS_BITS:
        raise ValueError("texts are sampled in parts of less than 64 million")
    inside = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    if not len(inside):
        return doc, none, none, none
    at = np.arange(n - gram + 1)
    h = span_hash(prefix_hash(values), at, at + gram)
    mask = np.uint64((1 << _POS_BITS) - 1)
    c, width = h >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS), length - gram + 1
    left = (sliding_least(c | at.astype(np.uint64), width)[inside] & mask).astype(np.int64)
    right = (mask - (sliding_least(c | (mask - at.astype(np.uint64)), width)[inside] & mask)).astype(np.int64)
    pick = np.where(inside + (width - 1) - right > left - inside, right, left)
    pick = distinct(pick[np.concatenate([[True], pick[1:] != pick[:-1]])])
    return doc, *stretches(pick, (h[pick[1:]] == h[pick[:-1]]) & (doc[pick[1:]] == doc[pick[:-1]]), values, length, gram)


def tagged(h: np.ndarray, tag: int) -> np.ndarray:
    return h & np.uint64(0xFFFFFFFFFFFFFFFC) | np.uint64(tag)


def samples(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, key, end) of the sampled grams, one row for each key with end 0; and of stretches that cover themselves, with key 0."""
    doc, pick, start, end = picked(data, offsets, length, gram)
    half = (length - gram + 1) // 2
    base = lambda p: offsets[:-1][doc[p]]
    raw = data.tobytes() if len(pick) else b""
    d, pos, key = [doc[start]], [start - base(start)], [np.zeros(len(start), np.uint64)]
    for a, b, tag in ((pick - half, pick + gram, LEFT), (pick, pick + gram + half, RIGHT)):
        ok = (a >= base(pick)) & (b <= offsets[1:][doc[pick]])
        d.append(doc[pick[ok]])
        pos.append(pick[ok] - base(pick[ok]))
        key.append(tagged(np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True)], np.uint64), tag))
    until = np.zeros(sum(map(len, d)), np.int64)
    until[: len(start)] = end - base(start)
    return np.concatenate(d), np.concatenate(pos), np.concatenate(key), until


def word_samples(data: np.ndarray, offsets: np.ndarray, length: int = PASSAGE, gram: int = WORD_GRAM, size: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of the sample's first word, key) of sampled runs of words."""
    w = Words(data, offsets)
    d, pos, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, len(w.hash), size):
        upto = min(at + size + length - 1, len(w.hash))
        doc, pick, _, _ = picked(w.hash[at:upto], np.clip(w.first, at, upto) - at, length, gram)
        d.append(doc[pick])
        pos.append(pick + at - w.first[doc[pick]])
        key.append(tagged(chained(w.hash, pick + at, gram), WORDS))
    return np.concatenate(d), np.concatenate(pos), np.concatenate(key)


def parts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, size: int = PART):
    """(bytes, offsets, start in the text, texts) below the sampling bound: all together, or a long text's parts, each string of `length` bytes in one of them."""
    if len(data) < size:
        yield data, offsets, 0, np.arange(len(offsets) - 1)
        return
    for i in range(len(offsets) - 1):
        whole = data[offsets[i] : offsets[i + 1]]
        for at in range(0, max(len(whole) - length, 0) + 1, size):
            part = whole[at : at + size + length - 1]
            yield part, np.array([0, len(part)]), at, np.array([i])


def digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def covered(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, size: int = PART) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (node, copies, n_bytes), and spans (node, start, end) of covered bytes of texts that stand once. A span from -1 marks a text with a passage of others."""
    rows = docs.select(digest(text).alias("node"), F.col(text).alias("text"))
    need = length - gram
    row = "node binary, base long, at array<struct<pos:long,h:long,end:long>>"

    def listed(b: pa.RecordBatch, texts: np.ndarray, base: int, doc, pos, h, end) -> pa.RecordBatch:
        order = np.argsort(doc, kind="stable")
        doc, pos, end = doc[order], pos[order], end[order]
        one = pa.StructArray.from_arrays([pa.array(pos), pa.array(h[order].view(np.int64)), pa.array(end)], ["pos", "h", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32()), one)
        return pa.RecordBatch.from_arrays([b.column("node").take(pa.array(texts)), pa.array(np.full(len(texts), base)), lists], ["node", "base", "at"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SAMPLED_BYTES):
            data, offsets = utf8(b.column("text"))
            doc, pos, h = word_samples(data, offsets, size=size)
            yield listed(b, np.arange(len(b)), -1, doc, pos, h, np.zeros(len(doc), np.int64))
            before: set[tuple[int, int]] = set()  # samples of the part before that this part may have too
            for part, offs, base, row in parts(data, offsets, length, size):
                doc, pos, h, end = samples(part, offs, length, gram)
                if base:
                    new = np.array([e > 0 or (p, x) not in before for p, x, e in zip((pos + base).tolist(), h.tolist(), end.tolist(), strict=True)], bool)
                    doc, pos, h, end = doc[new], pos[new], h[new], end[new]
                late = (end == 0) & (pos >= size)
                before = set(zip((pos[late] + base).tolist(), h[late].tolist(), strict=True)) if len(row) == 1 else set()
                yield listed(b, row, base, doc, pos + base, h, np.where(end > 0, end + base, 0))

    texts = saved(rows.select("node", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).groupBy("node").agg(F.count("*").alias("copies"), F.first("n").alias("n_bytes")), "suffix-texts")
    lists = rows.filter(F.octet_length("text") >= min(length, 2 * PASSAGE - 1)).mapInArrow(sample, row).filter(F.size("at") > 0)
    kept = saved(lists.dropDuplicates(["node", "base"]), "suffix-samples")
    every = kept.select("node", F.inline("at"))
    found = every.filter("end = 0").drop("end")
    shared = found.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    wanted = found.join(shared, "h").groupBy("node").agg(F.collect_list(F.struct("pos", "h", "c")).alias("at"))
    wanted = saved(wanted, "suffix-wanted")
    own = saved(every.filter("end > 0").select("node", F.col("pos").alias("start"), "end"), "suffix-own")
    drop_saved(docs.sparkSession, kept)

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            data, offsets = utf8(b.column("text"))
            raw = data.tobytes()
            at = b.column("at")
            flat = at.flatten()
            first = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
            doc = np.repeat(np.arange(len(b)), np.diff(first))
            here, h = flat.field("pos").to_numpy(), flat.field("h").to_numpy()
            by_words = h & 3 == WORDS
            left: list[bytes] = [b""] * len(h)
            right: list[bytes] = [b""] * len(h)
            i = np.flatnonzero(~by_words)
            for k, p, lo, hi in zip(i.tolist(), (here[i] + offsets[doc[i]]).tolist(), offsets[doc[i]].tolist(), offsets[doc[i] + 1].tolist(), strict=True):
                left[k] = raw[max(lo, p - need) : p]
                right[k] = xxhash.xxh64_digest(raw[p : p + gram]) + raw[p + gram : min(hi, p + gram + need)]  # a second hash of the sample must agree
            i = np.flatnonzero(by_words)
            if len(i):
                w = Words(data, offsets)
                short, rest = (w.hash >> np.uint64(32)).astype(np.uint32), PASSAGE - WORD_GRAM
                for k, p, lo, hi in zip(i.tolist(), (here[i] + w.first[doc[i]]).tolist(), w.first[doc[i]].tolist(), w.first[doc[i] + 1].tolist(), strict=True):
                    left[k] = short[max(lo, p - rest) : p].tobytes()
                    right[k] = short[p + WORD_GRAM : min(hi, p + WORD_GRAM + rest)].tobytes()
            node = b.column("node").take(pa.array(doc))
            for s in range(0, len(h), 4096):
                e = slice(s, s + 4096)
                yield pa.RecordBatch.from_arrays([node[e], flat.field("pos")[e], flat.field("h")[e], flat.field("c")[e], pa.array(left[e], pa.binary()), pa.array(right[e], pa.binary())], ["node", "pos", "h", "c", "left", "right"])

    one = wanted.join(_one_each(rows), "node")
    ctx = one.select("node", "at", "text").mapInArrow(context, "node binary, pos long, h long, c long, left binary, right binary")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    ctx = ctx.withColumn("side", F.pmod(F.xxhash64(F.lit(6), "node", "pos"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    ctx = ctx.filter((F.col("side") != F.col("other")) | (blocks == 1))  # two blocks taken together also meet within each
    ctx = ctx.select("h", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "node", "pos", "left", "right")
    spans = ctx.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q").mapInArrow(lambda batches: bucket_spans(batches, need, gram), "node binary, start long, end long")
    return texts, spans.unionByName(own)


def _one_each(rows: DataFrame) -> DataFrame:
    """One row of each text."""
    return rows.groupBy("node").agg(F.first("text").alias("text"))


def passages(node: list[bytes], left: list[bytes], right: list[bytes], size: int = 4 * (PASSAGE - WORD_GRAM)) -> list[int]:
    """Members of a bucket, one of each text, that share PASSAGE words around the sample with another text. left and right: 4 bytes of each word's hash."""
    first: dict[bytes, int] = {}
    names = [first.setdefault(n, i) for i, n in enumerate(node)]
    if len(first) == 1:
        return []
    if len(names) == 2:
        share = lambda a, b: lcp(a, b) // 4 * 4
        back = share(_words_back(left[0]), _words_back(left[1]))
        return [0, 1] if back + share(right[0], right[1]) >= size else []
    out: set[int] = set()
    # equal runs hold the sample at the same place; copies are known by the first places already
    for l in sorted(range(0, size + 1, 4), key=lambda l: (l not in (size // 8 * 4, 0, size), l)):
        owner: dict[bytes, int] = {}  # text of each run, or -1 for several
        runs = [(name, a[len(a) - l :] + b[: size - l]) for name, a, b in zip(names, left, right, strict=True) if len(a) >= l and len(b) >= size - l]
        for name, r in runs:
            if owner.setdefault(r, name) != name:
                owner[r] = -1
        out.update(name for name, r in runs if owner[r] < 0)
        if len(out) == len(first):
            break
    return sorted(out)


def _words_back(x: bytes) -> bytes:
    """The 4-byte words in reverse order."""
    return np.frombuffer(x, np.uint32)[::-1].tobytes()


def bucket_spans(batches: Iterator[pa.RecordBatch], need: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Spans from rows sorted by bucket; a bucket may straddle batches."""
    rest: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(rest)
        ids = [t[c].to_numpy() for c in ("h", "p", "q")]
        cut = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in ids], 0)])).tolist() + [len(t)]
        left, right, pos, node = t["left"].to_pylist(), t["right"].to_pylist(), t["pos"].to_pylist(), t["node"].to_pylist()
        who, start, end = [], [], []
        for a, b in zip(cut, cut[1:], strict=False):
            if b - a < 2:
                continue
            if ids[0][a] & 3 == WORDS:
                marked = passages(node[a:b], left[a:b], right[a:b])
                who += [i + a for i in marked]
                start += [-1] * len(marked)
                end += [-1] * len(marked)
                continue
            for i, pairs in enumerate(bucket_cover([x[::-1] for x in left[a:b]], right[a:b], need + 8), a):
                if pairs:  # all of them hold the sample, so their union is one span; 8 bytes of the common right part are the sample's hash
                    who.append(i)
                    start.append(pos[i] - max(l for l, _ in pairs))
                    end.append(pos[i] + gram + max(r for _, r in pairs) - 8)
        return pa.RecordBatch.from_arrays([t["node"].combine_chunks().take(pa.array(who, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["node", "start", "end"])

    for batch in batches:
        if not len(batch):
            continue
        rest.append(batch)
        ids = [batch.column(c).to_numpy() for c in ("h", "p", "q")]
        changed = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], 0)) if len(batch) > 1 else np.zeros(0, int)
        if len(changed):
            cut = int(changed[-1]) + 1
            rest[-1] = batch.slice(0, cut)
            yield flush()
            rest = [batch.slice(cut)]
    if rest:
        yield flush()


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    kept, at, removed, runs = [], 0, 0, 0
    reach = -1
    for a, b in sorted(spans):
        if a > reach:
            runs += 1
            kept.append(raw[max(at, 0) : a])
            removed += b - a
            reach = at = b
        elif b > reach:
            removed += b - reach
            reach = at = b
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, size: int = PART) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_elsewhere) of each row; the last: it holds more than PASSAGE - 1 words in a row that another row holds too."""
    texts, spans = covered(docs, text, length, size=size)
    rows = docs.select(digest(text).alias("node"), F.col(text).alias("text"))
    single = spans.join(texts.filter("copies > 1").select("node"), "node", "left_anti")
    lists = single.groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            data, offsets = utf8(b.column("text"))
            out = []
            for i, s in enumerate(b.column("spans").to_pylist()):
                kept, gone, runs = cut_out(data[offsets[i] : offsets[i + 1]].tobytes(), [(x["start"], x["end"]) for x in s if x["start"] >= 0])
                out.append((gone, runs, hashlib.sha256(kept).hexdigest(), any(x["start"] < 0 for x in s)))
            yield pa.RecordBatch.from_arrays([b.column("node"), *[pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_()))]], ["node", "n_removed", "n_spans", "sha", "marked"])

    # the same one row of each text as in covered(), so that Spark moves texts once
    done = lists.join(_one_each(rows), "node").select("node", "spans", "text").mapInArrow(apply, "node binary, n_removed long, n_spans long, sha string, marked boolean")
    all_rows = docs.select(F.col(key).alias("doc_id"), digest(text).alias("node"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("whole"), F.coalesce(F.col(text).rlike(LONG_TEXT), F.lit(False)).alias("long"))
    out = all_rows.join(texts.select("node", "copies"), "node").join(done, "node", "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
        F.when(F.col("copies") > 1, F.col("long")).otherwise(F.coalesce("marked", F.lit(False))).alias("passage_elsewhere"),
    )


def op10(docs: DataFrame) -> DataFrame:
    return removed(docs)
