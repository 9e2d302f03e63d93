"""How filters interact: what each removes in every order, and what it would remove anyway.

Rows are range-sorted by a 64-bit fingerprint of their text, then text, then id; one pass over the sorted rows compares each text with its
predecessor's and computes the other conditions from the same bytes, so each row leaves with a mask of the filters it fails. Ranges are cut by
(fingerprint, id), so one text's thousands of copies spread over many tasks. What a task can't know is whether its first text began in an
earlier range: each task also writes its groups of the first and the last fingerprint (a row or two a task) with their least ids, the least of
each such text over all tasks is found by text, and the few rows of first groups are judged by it. Fingerprints order rows and never decide.

Masks then add up: rows are counted by (id, part, mask) before labels join by id, and by (part, mask) after it. What a filter removes at a step
of an order is a sum of those counters, so the 120 orders cost nothing that grows with the rows.

Defined cases: a null text is empty and has copies among empty texts; a null part is the empty string; a null id is never a copy, has none and no label;
rows with one id and one text are no copies of each other, but of rows with a smaller id; several label rows of an id count as one with any of
their marks; no row, no part, empty result; texts of any length are read whole; extra columns are left out.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Words, count_by, distinct, pieces, saved, utf8

# The filters' letters in the order of their bits, and the characters that fail D.
LETTERS = "ABCDE"
MARKS = b"#$%&*|"
COPY = 16
_mark, _capital = np.zeros(256, bool), np.zeros(256, bool)
_mark[list(MARKS)] = True
_capital[65:91] = True


def text_masks(data: np.ndarray, offsets: np.ndarray, min_words: int, min_distinct_percent: int, max_capital_percent: int) -> np.ndarray:
    """Bits of A (few words), B (few of them distinct), C (many capitals) and D (marks) of each text."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    ids = words.ids().astype(np.int64)
    width = int(ids.max()) + 1 if len(ids) else 1
    total, different = count_by(words.doc, n), count_by(distinct(words.doc * width + ids) // width, n)
    of = lambda wanted: np.diff(np.concatenate([[0], np.cumsum(wanted)])[offsets])
    points, capitals, marks = of((data & 0xC0) != 0x80), of(_capital[data]), of(_mark[data])
    return (total < min_words) + 2 * (100 * different < min_distinct_percent * total) + 4 * (100 * capitals > max_capital_percent * points) + 8 * (marks > 0)


def sorted_masks(docs: DataFrame, key: str, text: str, part: str, min_words: int, min_distinct_percent: int, max_capital_percent: int) -> DataFrame:
    """Rows (key, part, mask, task, grp) of documents, grp only where the row's text may have begun in an earlier task; and rows with `low` and `text` of edge groups."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(t).alias("fp"), t.alias("text"), F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.repartitionByRange("fp", "key").sortWithinPartitions("fp", "text", "key")
    names = ["edge", "key", "part", "mask", "task", "grp", "text", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, head, fp, group = TaskContext.get().partitionId(), None, None, -1
        here: dict[str, list] = {}  # texts of the current fingerprint: [group, least id]
        key_type = None

        def edges():
            found = list(here.items())
            empty = [None] * len(found)
            cols = [[True] * len(found), empty, empty, empty, [task] * len(found), [g for _, (g, _) in found], [x for x, _ in found], [low for _, (_, low) in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names)

        for b in pieces(batches, "text"):
            key_type = b.schema.field("key").type
            types = [pa.bool_(), key_type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), key_type]
            masks = text_masks(*utf8(b.column("text")), min_words, min_distinct_percent, max_capital_percent).astype(np.int32)
            groups: list[int | None] = []
            for i, (f, x, k) in enumerate(zip(b.column("fp").to_pylist(), b.column("text").to_pylist(), b.column("key").to_pylist(), strict=True)):
                if f != fp:
                    if fp is not None and fp == head:
                        yield edges()
                    head = f if head is None else head
                    fp, here = f, {}
                at = here.get(x)
                if at is None:
                    group += 1
                    at = here[x] = [group, None]
                if k is not None:
                    if at[1] is None:
                        at[1] = k
                    elif k > at[1]:
                        masks[i] |= COPY
                groups.append(at[0] if f == head else None)
            none = pa.nulls(b.num_rows)
            cols = [pa.array([False] * b.num_rows), b.column("key"), b.column("part"), pa.array(masks), pa.array([task] * b.num_rows, pa.int32()), pa.array(groups, pa.int32()), none.cast(pa.string()), none.cast(key_type)]
            yield pa.RecordBatch.from_arrays(cols, names)
        if here:
            yield edges()

    return rows.mapInArrow(run, f"edge boolean, key {kind}, part string, mask int, task int, grp int, text string, low {kind}")


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", min_words: int = 100, min_distinct_percent: int = 80, max_capital_percent: int = 10) -> DataFrame:
    """(key, part, mask) of each row: bit b of mask is set if it fails filter LETTERS[b] on its own."""
    table = saved(sorted_masks(docs, key, text, part, min_words, min_distinct_percent, max_capital_percent), "audit-masks")
    edge = table.filter("edge")
    least = edge.groupBy("text").agg(F.min("low").alias("least"))
    begun = edge.join(least, "text").filter(F.col("least") < F.coalesce("low", F.col("least"))).unionByName(edge.join(least, "text").filter("low is null and least is not null"))
    begun = begun.select("task", "grp", "least").distinct()
    # at most a row a task, and one more for each text that shares a fingerprint with another at a task's edge
    rows = table.filter("not edge").join(F.broadcast(begun), ["task", "grp"], "left")
    copy = F.coalesce(F.col("key") > F.col("least"), F.lit(False))
    return rows.select(F.col("key").alias(key), "part", F.when(copy, F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and mask, and those of them that labels mark. Rows of one id add up before the join."""
    rows = masks.groupBy(key, "part", "mask").agg(F.count("*").alias("n"))
    mark = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(c)
    marks = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(mark("quality"), mark("toxic"))
    joined = rows.join(marks, key, "left")
    n = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).cast("long")
    return joined.groupBy("part", "mask").agg(F.sum("n").cast("long").alias("n"), n("quality").alias("good"), n("toxic").alias("toxic"))


def steps() -> list[dict]:
    """Each step of each order: its filter's bit, and the bits of the filters before it."""
    out = []
    for order in itertools.permutations(LETTERS):
        prior = 0
        for i, letter in enumerate(order):
            bit = 1 << LETTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": i + 1, "bit": bit, "prior": prior})
            prior |= bit
    return out


def by_order(counted: DataFrame) -> DataFrame:
    """One row per part, order and step, from additive counters."""
    every = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order:string,step:int,bit:int,prior:int>>")
    rows = counted.withColumn("s", F.explode(every)).select("part", "mask", "n", "good", "toxic", "s.*")
    m = F.col("mask")
    fails, gone = m.bitwiseAND(F.col("bit")) != 0, m.bitwiseAND(F.col("prior")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(m == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    return by_order(counters(failures(docs, key, text, part), labels, key))


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


ORACLE_OP13 = r"""with d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
lo as (select t, min(doc_id) as least from d group by t),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by doc_id),
w as (select d.*, least, coalesce(good, 0) as good, coalesce(bad, 0) as bad, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') as ws from d join lo on lo.t = d.t left join l on l.doc_id = d.doc_id),
m as (select part, good, bad, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int
 + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask from w),
c as (select part, mask, count(*) as n, sum(good) as good, sum(bad) as bad from m group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as bit),
o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e
 where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as prior from o, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (select part, filter_order, step::int as step, bit, coalesce(sum(n) filter (mask & (bit | prior) = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & bit <> 0 and mask & prior = 0), 0)::bigint as removed,
 coalesce(sum(n) filter (mask & bit <> 0 and mask & prior <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
 coalesce(sum(good) filter (mask & bit <> 0 and mask & prior = 0), 0)::bigint as good_lost, coalesce(sum(bad) filter (mask & bit <> 0 and mask & prior = 0), 0)::bigint as toxic_lost from c, s group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r"""
