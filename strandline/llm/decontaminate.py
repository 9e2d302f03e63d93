"""Benchmark decontamination with a BM25 index of the test items and block-max WAND, a batch of passages at a time.

Index: items are cut into parts of PART words; a posting holds a part's BM25 impact divided by the part's own total, so a score is the
weighted share of the part's terms that a passage holds, from 0 to 1. Parts lie in blocks of BLOCK; each term keeps its highest impact and
its highest in each block. Every passage (PASSAGE words, overlapping by PART, so each run of PART words is inside one) is a query:
1. the highest impacts of its distinct terms must add up to the threshold, else it is left (WAND's pivot test);
2. for what passes, block maxima must, else the block is skipped;
3. only parts of blocks that pass are scored; all parts at the threshold or above are retrieved.
A retrieved item is verified on the words around the passage: both its question (all but the last sentence, or the first 70 % of words) and
its answer must overlap, measured by three-word shingles.

The index is broadcast while the items are within INDEX_BYTES (counted first); beyond it the items are split into slices of that size and
passages are run against one slice after the other.

Defined cases: null or empty texts have no passages; items without words are never found; ties and repeated rows are all reported, a
(document, item) pair of ids once; ids may be of any type, and null; empty tables give empty results; texts of any length are cut into the same
passages; clashing columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.llm.common import Words, distinct, pieces, utf8

PART, PASSAGE, BLOCK = 32, 64, 8
THRESHOLD, OVERLAP = 0.5, 0.6
K1, B = 1.2, 0.75
INDEX_BYTES = 64 << 20
GRAM = 3


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    w = Words(*utf8(pa.array(texts, pa.large_string())), fold=True)
    return [w.hash[a:b] for a, b in zip(w.first, w.first[1:], strict=False)]


def grams(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; all words together where there are fewer."""
    if len(h) < k:
        h = np.concatenate([h, np.zeros(k - len(h), np.uint64)]) if len(h) else h
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x100000001B3) + h[i : len(h) - k + 1 + i] * np.uint64(0x9E3779B97F4A7C15)
    return distinct(out)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer)."""
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    if len(parts) > 1 and len(parts[-1].split()) >= 3:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, int(0.7 * len(words)))
    return " ".join(words[:cut]), " ".join(words[cut:])


class Index:
    """Impacts of item parts by term, with maxima by term and by term and block."""

    def __init__(self, ids: list, texts: list[str]):
        whole = word_hashes(texts)
        self.items = ids
        self.length = [len(h) for h in whole]
        sides = [split_item(t) for t in texts]
        self.question = [grams(h) for h in word_hashes([q for q, _ in sides])]
        self.answer = [grams(h) for h in word_hashes([a for _, a in sides])]
        parts, self.part_item = [], []
        for i, h in enumerate(whole):
            for at in range(0, len(h), PART):
                # a short rest is part of a full stretch that ends with it
                parts.append(h[max(0, min(at, len(h) - PART)) : at + PART])
                self.part_item.append(i)
        self.part_item = np.array(self.part_item, np.int64)
        terms = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        self.terms = terms
        t, p, f = [], [], []
        for i, h in enumerate(parts):
            u, c = np.unique(h, return_counts=True)
            t.append(np.searchsorted(terms, u))
            p.append(np.full(len(u), i))
            f.append(c)
        t, p, f = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (t, p, f))
        df = np.bincount(t, minlength=len(terms))
        n = max(len(parts), 1)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        size = np.array([len(h) for h in parts], float)
        impact = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * size[p] / max(size.mean() if len(size) else 1, 1)))
        own = np.bincount(p, impact, len(parts))
        impact = impact / own[p] if len(p) else impact
        order = np.lexsort((p, t))
        self.post_part, self.post_impact = p[order], impact[order]
        self.post_first = np.searchsorted(t[order], np.arange(len(terms) + 1))
        self.top = np.zeros(len(terms))
        np.maximum.at(self.top, t, impact)
        tb, inv = np.unique(t * (n // BLOCK + 1) + p // BLOCK, return_inverse=True)
        self.block_of, self.block_top = tb % (n // BLOCK + 1), np.zeros(len(tb))
        np.maximum.at(self.block_top, inv, impact)
        self.block_first = np.searchsorted(tb // (n // BLOCK + 1), np.arange(len(terms) + 1))
        self.n_blocks = n // BLOCK + 1
        # the commonest terms can't add more than `slack` together, however often they stand in a passage
        lowest = np.argsort(self.top, kind="stable")
        light = lowest[np.cumsum(self.top[lowest]) <= 0.2]
        self.heavy = np.ones(len(terms), bool)
        self.heavy[light] = False
        self.slack = float(self.top[light].sum())

    def retrieve(self, words: Words, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, item, score) of all passages and item parts at the threshold or above."""
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(words.hash):
            return none, none, none, np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, words.hash), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == words.hash)
        term, doc = at[hit], words.doc[hit]
        inside = hit - words.first[doc]
        n = np.diff(words.first)
        step = PASSAGE - PART
        count = np.maximum(1, -(-(n - PASSAGE) // step) + 1) * (n > 0)
        base = np.cumsum(count) - count
        slot = inside // step
        total = int(count.sum())
        # a word is in the passage that starts at or before it, and in the one before that
        own = base[doc] + slot
        here, before = slot < count[doc], slot > 0
        # a bound with repetitions first: cheap, and most passages end here; stretches of one step, then pairs of them
        weight = np.where(self.heavy[term], self.top[term], 0.0)
        loose = np.bincount(own[here], weight[here], total + 1) + np.bincount(own[before] - 1, weight[before], total + 1) >= threshold - self.slack - 1e-9
        here &= loose[np.minimum(own, total)]
        before &= loose[own - 1]
        passage = np.concatenate([own[here], own[before] - 1])
        term = np.concatenate([term[here], term[before]])
        pair = distinct(passage * len(self.terms) + term)
        passage, term = pair // len(self.terms), pair % len(self.terms)
        tight = np.bincount(passage, self.top[term], total) >= threshold - 1e-9
        keep = tight[passage]
        passage, term = passage[keep], term[keep]
        found_p, found_i, found_s = [], [], []
        for lo in range(0, len(passage), 1 << 17):  # in slices, for memory; a passage's pairs may straddle two, so cut at passages
            a = np.searchsorted(passage, passage[lo]) if lo else 0
            hi = lo + (1 << 17)
            b = np.searchsorted(passage, passage[hi]) if hi < len(passage) else len(passage)
            p, t = passage[a:b], term[a:b]
            if not len(p):
                continue
            size = self.block_first[t + 1] - self.block_first[t]
            flat = np.repeat(self.block_first[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            p0 = int(p[0])
            span = int(p[-1]) - p0 + 1
            cell = (np.repeat(p, size) - p0) * self.n_blocks + self.block_of[flat]
            bound = np.bincount(cell, self.block_top[flat], span * self.n_blocks)
            live = bound >= threshold - 1e-9
            alive = np.flatnonzero(live.reshape(span, -1).any(1))
            if not len(alive):
                continue
            ok = np.zeros(span, bool)
            ok[alive] = True
            mine = ok[p - p0]
            p, t = p[mine], t[mine]
            size = self.post_first[t + 1] - self.post_first[t]
            flat = np.repeat(self.post_first[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            part = self.post_part[flat]
            pp = np.repeat(p, size)
            open_block = live[(pp - p0) * self.n_blocks + part // BLOCK]
            pp, part, imp = pp[open_block], part[open_block], self.post_impact[flat[open_block]]
            n_parts = len(self.part_item)
            key, inv = np.unique(pp * n_parts + part, return_inverse=True)
            score = np.bincount(inv, imp)
            good = score >= threshold - 1e-9
            found_p.append(key[good] // n_parts)
            found_i.append(self.part_item[key[good] % n_parts])
            found_s.append(score[good])
        if not found_p:
            return none, none, none, np.zeros(0)
        p, i, s = np.concatenate(found_p), np.concatenate(found_i), np.concatenate(found_s)
        # texts without passages share a base with the next: step to the one that owns it
        d = np.searchsorted(base + count, p, "right")
        return d, words.first[d] + (p - base[d]) * step, i, s

    def verify(self, words: Words, d: int, start: int, item: int) -> tuple[float, float]:
        """Shares of the item's question and answer shingles among the words around a passage."""
        near = self.length[item] + PASSAGE
        a, b = max(words.first[d], start - near), min(words.first[d + 1], start + PASSAGE + near)
        g = grams(words.hash[a:b])
        share = lambda q: float(np.isin(q, g).mean()) if len(q) else 1.0
        return share(self.question[item]), share(self.answer[item])


def _indexes(items: DataFrame, key: str, text: str, limit: int) -> Iterator[Index]:
    """The index, or one of each slice of about `limit` bytes."""
    items = items.filter(F.col(text).isNotNull()).select(F.col(key).alias("i"), F.col(text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    n = int(total // limit) + 1
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64(F.lit(9), "i", "t"), F.lit(n)) == i)
        got = part.toArrow().to_pylist()
        got.sort(key=lambda r: (r["i"] is None, r["i"] if r["i"] is not None else 0, r["t"]))
        yield Index([r["i"] for r in got], [r["t"] for r in got])


def _verified(index: Index, texts: pa.Array, threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item): the best score with its overlaps, of all verified pairs."""
    w = Words(*utf8(texts), fold=True)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for d, start, item, score in zip(*(x.tolist() for x in index.retrieve(w, threshold)), strict=True):
        q, a = index.verify(w, d, start, item)
        if q >= overlap and a >= overlap and (score, q, a) > best.get((d, item), (0.0, 0.0, 0.0)):
            best[d, item] = (score, q, a)
    return best


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, limit: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question, answer): verified pairs, one row each."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    id_type = items.schema[item_key].dataType
    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {id_type.simpleString()}, score double, question double, answer double"
    arrow_id = to_arrow_type(id_type)
    out = None
    for index in _indexes(items, item_key, item_text, limit):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in pieces(batches, "text"):
                best = _verified(index, b.column("text"), threshold, overlap)
                keys = sorted(best)
                ids = b.column("doc_id").take(pa.array([d for d, _ in keys], pa.int64()))
                vals = [best[k] for k in keys]
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.items[i] for _, i in keys], arrow_id), *[pa.array([v[j] for v in vals], pa.float64()) for j in range(3)]], ["doc_id", "item_id", "score", "question", "answer"])

        one = rows.mapInArrow(run, shape)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question", "answer")])


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, limit: int = INDEX_BYTES) -> DataFrame:
    """Rows of docs that hold no item, with all their columns; they are judged where they stand, slice after slice, so nothing is shuffled."""
    for index in _indexes(items, item_key, item_text, limit):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, text):
                bad = {d for d, _ in _verified(shared.value, b.column(text), threshold, overlap)}
                yield b.filter(pa.array([i not in bad for i in range(len(b))], pa.bool_())) if bad else b

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items)
