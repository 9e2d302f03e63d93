"""Quality rules of documents and of their hosts.

Each document gets counts by array code over whole texts and a verdict of the base rules. Failures are then summed by host, the hosts'
failure rates are shrunk towards the common rate by a beta prior that is fitted to all hosts by moments, and hosts whose shrunk rate is
too high lose all their documents: the verdicts are joined back by host.

Defined cases: a null text has no words and fails; a null host is a host of its own; equal rows are judged alike and each counts; an empty
table gives an empty result; extra columns stay out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Words, chained, count_by, distinct, mix, pieces, saved, utf8

# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACES = b" \t\n\x0b\x0c\r"
_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True


def count_batch(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    words = Words(data, offsets)
    doc_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    heads = (data & 0xC0) != 0x80  # first bytes of code points
    ink = np.concatenate([[0], np.cumsum(heads)])
    chars = ink[words.end] - ink[words.start]
    marks = np.flatnonzero(_symbol[data])
    # words in 3-word windows found twice or more in their text; windows are equal if their words are
    ids = words.ids()
    at = np.flatnonzero(words.doc[:-2] == words.doc[2:]) if len(ids) > 2 else np.zeros(0, np.int64)
    cover = np.zeros(len(ids) + 3, np.int64)
    if len(at):
        # equal windows have equal hashes; only those go on to be compared
        h = chained(ids.view(np.uint64) if ids.dtype == np.int64 else ids.astype(np.uint64), at, 3) ^ mix(words.doc[at].astype(np.uint64))
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        at = at[distinct(np.concatenate([order[same], order[same + 1]]))]
        twice = at[_not_alone(words.doc[at], ids[at], ids[at + 1], ids[at + 2])]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 3, -1)
    covered = np.cumsum(cover)[: len(ids)] > 0
    return {
        "n_words": count_by(words.doc, n),
        "word_chars": count_by(words.doc, n, chars),
        "n_symbols": count_by(doc_of(marks), n),
        "n_dup_lines": _repeated_lines(data, offsets),
        "n_repeat_words": count_by(words.doc[covered], n),
    }


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier one, compared as bytes."""
    raw = data.tobytes()
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(SPACES)]
        out.append(len(lines) - len(set(lines)))
    return np.array(out, np.int64)


def _not_alone(*keys: np.ndarray) -> np.ndarray:
    """Whether another row has the same keys."""
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(order), bool)
    same[1:] = np.all([k[order][1:] == k[order][:-1] for k in keys], 0)
    pair = same.copy()
    pair[:-1] |= same[1:]
    out = np.zeros(len(order), bool)
    out[order] = pair
    return out


def measured(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """(key, host, counts, base_failed) of each row, in one pass without a shuffle."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host {rows.schema['host'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            got = count_batch(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *[pa.array(got[c]) for c in COUNTS]], ["doc_id", "host", *COUNTS])

    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return rows.mapInArrow(count, ddl).withColumn("base_failed", failed)


def host_verdicts(measures: DataFrame, max_rate: float = 0.6) -> DataFrame:
    """(host, n, failed, rate, host_kept): rate is the mean of the beta posterior; the prior has the hosts' mean rate, and the weight that moments of their spread give."""
    hosts = measures.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    r = F.col("failed") / F.col("n")
    moments = hosts.agg(F.sum("n").alias("N"), F.sum("failed").alias("K"), F.count("*").alias("H"), F.sum(F.col("n") * r * r).alias("S2"), F.sum(F.col("n") * F.col("n")).alias("N2"))
    mean = F.greatest(F.least(F.col("K") / F.col("N"), F.lit(1 - 1e-6)), F.lit(1e-6))
    # between-host variance: spread of rates beyond what binomial chance gives, over hosts weighted by size
    spread = F.col("S2") - F.col("N") * mean * mean
    between = (spread - (F.col("H") - 1) * mean * (1 - mean)) / F.greatest(F.col("N") - F.col("N2") / F.col("N") - (F.col("H") - 1), F.lit(1e-9))
    weight = F.when(between > 0, F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(2.0)), F.lit(1e4))).otherwise(1e4)
    prior = moments.select(mean.alias("mean"), weight.alias("weight")).first()  # one row of two numbers
    if prior is None or prior["mean"] is None:
        prior = {"mean": 0.5, "weight": 1.0}
    m, w = F.lit(float(prior["mean"])), F.lit(float(prior["weight"]))
    rate = (F.col("failed") + m * w) / (F.col("n") + w)
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate <= max_rate).alias("host_kept"))


def judged(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", max_rate: float = 0.6) -> DataFrame:
    """Counts, base_failed, the host's rate and kept. The measures are written once, so text is read once."""
    m = saved(measured(docs, host, key, text), "quality")
    hosts = host_verdicts(m, max_rate).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "host_kept")
    out = m.join(hosts, m["host"].eqNullSafe(hosts["_host"]), "left")
    return out.select("doc_id", "host", *COUNTS, "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def op2(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_OP2 = r"""with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
w as (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k from (select rid, ws, unnest(generate_series(1, len(ws) - 2)) as i from w where len(ws) >= 3)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from g) where c >= 2),
p as (select rid, count(distinct i + o) as n_repeat_words from r, (select unnest([0, 1, 2]) as o) group by rid),
l as (select rid, count(*) - count(distinct line) as n_dup_lines from (select rid, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
c as (select d.rid, doc_id, source, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
 coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from d join w using (rid) left join p using (rid) left join l using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
h as (select source, count(*) as n, count(*) filter (base_failed) as k from b group by source),
m as (select sum(n)::double as nn, count(*)::double as hh, sum(k)::double as kk, sum(k::double * k / n) as s2, sum(n::double * n) as n2 from h),
m1 as (select *, greatest(least(kk / nn, 1 - 1e-6), 1e-6) as mean from m),
m2 as (select mean, (s2 - nn * mean * mean - (hh - 1) * mean * (1 - mean)) / greatest(nn - n2 / nn - (hh - 1), 1e-9) as v from m1),
m3 as (select mean, case when v > 0 then least(greatest(mean * (1 - mean) / v - 1, 2.0), 1e4) else 1e4 end as weight from m2),
hv as (select source, (k + mean * weight) / (n + weight) <= 0.6 as ok from h, m3)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and ok as kept from b join hv on hv.source is not distinct from b.source"""
