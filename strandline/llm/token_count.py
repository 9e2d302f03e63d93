"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

Pre-tokens (a run of word marks and what follows it) never merge with each other, so each distinct one, told by its characters, is merged once
and its count is kept. New pre-tokens are held as ragged symbol arrays; in every round each sequence's lowest-rank pair is found by one segmented minimum
and applied in all sequences at once. All places of that pair in a sequence merge together, left to right, unless a pair that would arise
ranks lower still, or the rank belongs to several pairs; then only the leftmost place merges, as one at a time would. Symbols outside the
vocabulary count as their UTF-8 bytes. Sequences beyond LONG symbols (text without spaces) go by rank instead of by sequence: a round takes the
lowest rank that any of them has and its places only, so the work follows the merges and not rounds times length.

Defined cases: null and empty texts have no tokens; equal rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import distinct, pieces, utf8

MARK = 0x2581
NONE = np.int64(1 << 40)
LONG = 2000
#: Distinct pre-tokens kept by a task, and the characters up to which one is kept.
MEMORY, KEPT_CHARS = 300_000, 64


class Merges:
    """Symbol ids, pair table and ranks of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names, scores = [], []
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                names.append(sp.id_to_piece(i))
                scores.append(sp.get_score(i))
        if any(MARK == ord(c) for p in names for c in p.lstrip(chr(MARK))):
            raise ValueError("pieces hold marks inside; pre-tokens aren't independent")
        self.size = len(names)
        ids = {p: i for i, p in enumerate(names)}
        values, rank = np.unique(-np.array(scores), return_inverse=True)
        shared = np.bincount(rank) > 1
        pairs = [(ids[p[:j]] * self.size + ids[p[j:]], i) for i, p in enumerate(names) for j in range(1, len(p)) if p[:j] in ids and p[j:] in ids]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.made = np.array([m for _, m in pairs], np.int64)
        self.rank = rank.astype(np.int64)
        self.tied = shared[rank]
        single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self.chars = np.array([c for c, _ in single], np.uint32)
        self.char_ids = np.array([i for _, i in single], np.int64)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Ids of code points; what isn't in the vocabulary is -1."""
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return np.where(self.chars[at] == points, self.char_ids[at], -1)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that a and b make, or -1."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.made[at], -1)

    def rank_of(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.rank[piece], NONE)

    def count(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; first: starts of the sequences, each at least one point long."""
        n = len(first)
        sym = self.symbols(points)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        seq = np.repeat(np.arange(n), np.diff(np.append(first, len(points))))
        lost = np.bincount(seq, np.where(sym < 0, width, 0), n).astype(np.int64)
        known = np.zeros(n, np.int64)
        long = np.bincount(seq, minlength=n) > LONG
        if long.any():
            some = long[seq]
            known += self._count_long(sym[some], seq[some], n)
            sym, seq = sym[~some], seq[~some]
        made = self._pairs(sym, seq)
        while len(sym):
            rank = self.rank_of(made)
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            sizes = np.diff(np.append(starts, len(sym)))
            if not live.all():  # finished sequences leave
                keep = np.repeat(live, sizes)
                known += np.bincount(seq[~keep & (sym >= 0)], minlength=n)
                sym, seq, made, rank = sym[keep], seq[keep], made[keep], rank[keep]
                best, sizes = best[live], sizes[live]
                if not len(sym):
                    break
            starts = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # of overlapping places (a a a) every second one of a run stays
            run = np.concatenate([[True], np.diff(hit) != 1])
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            m = made[hit]
            # a pair that would arise with a lower rank, or a shared rank: leftmost only
            prev_ok = (hit > 0) & (seq[np.maximum(hit - 1, 0)] == seq[hit])
            left = np.where(prev_ok, self.pair(sym[np.maximum(hit - 1, 0)], m), -1)
            nxt = np.minimum(hit + 2, len(sym) - 1)
            next_ok = (hit + 2 < len(sym)) & (seq[nxt] == seq[hit])
            right = np.where(next_ok, self.pair(m, sym[nxt]), -1)
            twin = np.where(next_ok & np.isin(nxt, hit), self.pair(m, m), -1)
            r = self.rank[m]
            odd = self.tied[m] | (self.rank_of(left) < r) | (self.rank_of(right) < r) | (self.rank_of(twin) < r)
            if odd.any():
                slow = np.zeros(n, bool)
                slow[seq[hit[odd]]] = True
                lead = np.concatenate([[True], seq[hit[1:]] != seq[hit[:-1]]])
                hit = hit[lead | ~slow[seq[hit]]]
            sym = sym.copy()
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[hit] = True
            changed[np.maximum(hit - 1, 0)] = True
            sym, seq, made, changed = sym[keep], seq[keep], made[keep], changed[keep]
            at = np.flatnonzero(changed)
            made[at] = self._pairs_at(sym, seq, at)
        return known + lost

    def _count_long(self, sym: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
        """Known symbols that are left of each of n sequences. Symbols are linked lists; places wait by the rank of the pair that starts there."""
        size = len(sym)
        sym, alive = sym.copy(), np.ones(size, bool)
        end = np.append(seq[1:] != seq[:-1], True)
        after, before = np.where(end, -1, np.arange(1, size + 1)), np.where(np.append(True, end[:-1]), -1, np.arange(-1, size - 1))
        made = self._pairs(sym, seq)
        rank = self.rank_of(made)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[made[at] >= 0]
            at = at[np.argsort(rank[at], kind="stable")]
            cut = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, cut) if len(at) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        put(np.arange(size))
        while ranks:
            r = heapq.heappop(ranks)
            hit = distinct(np.concatenate(waiting.pop(r)))
            hit = hit[alive[hit] & (rank[hit] == r)]
            if not len(hit):
                continue
            # of overlapping places (a a a) every second one of a run stays
            run = np.append(True, after[hit[:-1]] != hit[1:])
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            m, second = made[hit], after[hit]
            third = after[second]
            left = np.where(before[hit] >= 0, self.pair(sym[before[hit]], m), -1)
            right = np.where(third >= 0, self.pair(m, sym[third]), -1)
            twin = np.where(np.append(third[:-1] == hit[1:], False), self.pair(m, m), -1)
            odd = self.tied[m] | (self.rank_of(left) < r) | (self.rank_of(right) < r) | (self.rank_of(twin) < r)
            if odd.any():  # in these sequences the leftmost place only; the others wait
                slow = np.isin(seq[hit], seq[hit[odd]])
                lead = np.append(True, seq[hit[1:]] != seq[hit[:-1]])
                put(hit[slow & ~lead])
                go = lead | ~slow
                hit, m, second, third = hit[go], m[go], second[go], third[go]
            sym[hit], alive[second], after[hit] = m, False, third
            before[third[third >= 0]] = hit[third >= 0]
            changed = np.concatenate([hit, before[hit]])
            changed = distinct(changed[changed >= 0])
            made[changed] = np.where(after[changed] >= 0, self.pair(sym[changed], sym[after[changed]]), -1)
            rank[changed] = self.rank_of(made[changed])
            put(changed)
        return np.bincount(seq[alive & (sym >= 0)], minlength=n)

    def _pairs(self, sym, seq) -> np.ndarray:
        return self._pairs_at(sym, seq, np.arange(len(sym)))

    def _pairs_at(self, sym, seq, at) -> np.ndarray:
        nxt = np.minimum(at + 1, len(sym) - 1)
        ok = (at + 1 < len(sym)) & (seq[nxt] == seq[at])
        return np.where(ok, self.pair(sym[at], sym[nxt]), -1)


_pre_token = re.compile(f"{chr(MARK)}+[^{chr(MARK)}]*")


class Counter:
    """Token counts of texts, with a memory of distinct pre-tokens that is emptied when it is full."""

    def __init__(self, merges: Merges, memory: int = MEMORY):
        self.merges, self.memory, self.known = merges, memory, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = [_pre_token.findall((chr(MARK) + t).replace(" ", chr(MARK))) if t else [] for t in texts]
        if len(self.known) > self.memory:
            self.known = {}
        known = self.known
        new = list({p for of in parts for p in of if p not in known})
        tokens = {}
        if new:
            points = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)
            size = np.array([len(p) for p in new])
            tokens = dict(zip(new, self.merges.count(points, np.cumsum(size) - size).tolist(), strict=True))
            known.update((p, n) for p, n in tokens.items() if len(p) <= KEPT_CHARS)
            tokens = {p: n for p, n in tokens.items() if len(p) > KEPT_CHARS}
        return np.array([sum([known[p] if p in known else tokens[p] for p in of]) for of in parts], np.int64)


def counted(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of each row, in one pass without a shuffle. The model file is opened where the task runs."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in pieces(batches, "text"):
            counter = counter or Counter(Merges(model_path))
            n_bytes = np.diff(utf8(b.column("text"))[1])
            tokens = counter(b.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def op5(docs: DataFrame, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return counted(docs, model_path).withColumn("over_limit", F.col("n_tokens") > limit)
