"""Mixing sources to target weights with soft membership, by DataFrame functions only.

1. A bounded sample of a labelled table (SAMPLE rows per domain, in hash order) gives word weights per domain: a smoothed multinomial model
   over hashed words. Every document gets posteriors of all domains: its mean log-likelihoods, scaled as if it had at most EVIDENCE words,
   so long texts stay soft.
2. Rates r >= 0 of documents are fitted by least squares: the expected tokens of domain d, sum over documents of r * tokens * p_d, should
   meet the target share of all tokens. Projected gradient from r = 1, preconditioned by the domains' Gram matrix; an iteration is one
   aggregation to (number of domains) sums, which is all that reaches the driver. A step that doesn't lower the squared miss is halved; where
   bounds stop preconditioned steps, plain ones follow. It ends when the largest miss is below TOLERANCE of all tokens, or when steps lower the
   squared miss by less than FLAT of it: then no nonnegative rates meet the targets, and these miss them least. If ROUNDS don't reach either, it
   raises an error.

Defined cases: null and empty texts have no tokens, get the prior's posteriors, and any rate fits them; a domain without labelled rows takes no
part, and the targets of the others are scaled up to 1; without labelled rows all rates are 1; rows with one id count as one document, null ids
too; texts of any length count whole; an empty table gives an empty result; clashing columns don't matter, as only key and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import saved

BUCKETS, SAMPLE, EVIDENCE, ROUNDS, TOLERANCE, FLAT = 1 << 16, 1000, 64, 200, 1e-4, 1e-5
#: Domains of the labels table and their target shares of all tokens.
TARGETS = {"good": 0.9, "low": 0.08, "toxic": 0.02}


def label_domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")



def word_rows(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(_id, bucket) of each word; a text without words has one row whose bucket is null."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(key).alias("_id"), *more, F.explode_outer(words).alias("w"))
    return rows.select("_id", *more, F.when(F.col("w").isNotNull(), F.pmod(F.xxhash64("w"), F.lit(BUCKETS))).cast("int").alias("bucket"))


def word_weights(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str, text: str) -> tuple[DataFrame | None, dict[str, float], list[str]]:
    """((bucket, l_0, l_1, ...), log of each domain's chance of an unseen bucket, domains found). The sample is bounded by SAMPLE rows a domain."""
    ids = None
    for d in domains:
        part = labelled.filter(F.col("domain") == d).select(F.col(key).alias(key), "domain").dropDuplicates([key]).orderBy(F.xxhash64(F.lit(13), key)).limit(SAMPLE)
        ids = part if ids is None else ids.unionByName(part)
    sample = docs.select(key, text).join(F.broadcast(ids), key)
    counts = saved(word_rows(sample, key, text, "domain").filter("bucket is not null").groupBy("bucket").pivot("domain", domains).agg(F.count(F.lit(1))).na.fill(0), "mix-words")
    totals = counts.agg(*[F.coalesce(F.sum(f"`{d}`"), F.lit(0)).alias(d) for d in domains]).first()
    found = [d for d in domains if totals[d] > 0]
    if not found:
        return None, {}, []
    log = lambda d: F.log((F.col(f"`{d}`") + 0.5) / (totals[d] + 0.5 * BUCKETS))
    weights = counts.select("bucket", *[log(d).alias(f"l_{i}") for i, d in enumerate(found)])
    return weights, {d: math.log(0.5 / (totals[d] + 0.5 * BUCKETS)) for d in found}, found


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """((_id, tokens, p array), domains in the order of p)."""
    weights, unseen, found = word_weights(docs, labelled, domains, key, text)
    # every row of docs has a row here, so grouping gives all ids, a null one too, and nothing is joined back
    if weights is None:
        n = word_rows(docs, key, text).groupBy("_id").agg(F.count("bucket").alias("tokens"))
        return n.select("_id", "tokens", F.array().cast("array<double>").alias("p")), []
    scored = word_rows(docs, key, text).join(F.broadcast(weights), "bucket", "left")  # at most BUCKETS rows
    of = lambda i, d: F.sum(F.when(F.col("bucket").isNotNull(), F.coalesce(f"l_{i}", F.lit(unseen[d]))))
    rows = scored.groupBy("_id").agg(F.count("bucket").alias("tokens"), *[of(i, d).alias(f"s_{i}") for i, d in enumerate(found)])
    n = F.col("tokens")
    soft = F.least(n, F.lit(EVIDENCE)) / F.greatest(n, F.lit(1))
    logits = [F.coalesce(f"s_{i}", F.lit(0.0)) * soft for i in range(len(found))]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    rows = rows.select("_id", n.alias("tokens"), F.array(*[F.exp(x - top) for x in logits]).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.select("_id", "tokens", F.transform("e", lambda x: x / total).alias("p")), found


def solve(m: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination for a handful of domains."""
    n = len(b)
    a = [[*row, x] for row, x in zip(m, b, strict=True)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        for r in range(n):
            if r != i and a[i][i]:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] if a[i][i] else 0.0 for i in range(n)]


def fit_rates(rows: DataFrame, shares: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """rows (_id, tokens, p) with rate."""
    d = len(shares)
    p = [F.col("p")[i] for i in range(d)]
    w = F.col("tokens").cast("double")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    along = lambda y: sum((F.lit(float(v)) * x for v, x in zip(y, p, strict=True)), F.lit(0.0))
    current, best, size, steps, plain, flat = rows.withColumn("rate", F.lit(1.0)), math.inf, 1.0, 0, False, 0
    step = miss = spread = None
    for _ in range(rounds):
        tried = current
        if step is not None:
            down = along(miss) if plain else along(step)
            # a rate at zero grows only if that lowers the miss; so each direction does
            move = F.when((F.col("rate") > 0) | (along(miss) < 0), F.lit(size / spread if plain else size) * down).otherwise(0.0)
            tried = current.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move))
        live = F.when(F.col("rate") > 0, w).otherwise(0.0)
        got = tried.agg(F.sum(w).alias("n"), *[F.sum(F.col("rate") * w * p[i]).alias(f"a{i}") for i in range(d)], *[F.sum(live * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(w * p[i] * p[i]).alias(f"d{i}") for i in range(d)]).first()
        total = got["n"] or 0.0
        if not total:
            return current
        now = [(got[f"a{i}"] - shares[i] * total) / total for i in range(d)]
        square = sum(x * x for x in now)
        if square >= best:
            size /= 2
            if not plain and size < 1 / 16:
                plain, size = True, 1.0
            elif size < 1e-6:
                return current
            continue
        flat = flat + 1 if square > best * (1 - FLAT) else 0
        current, best, miss, steps = tried, square, now, steps + 1
        size = 2 * size if plain else min(1.0, 2 * size)
        if max(map(abs, miss)) < tolerance or plain and flat >= 3:
            return current
        if flat >= 3:
            plain, size, flat = True, 1.0, 0
        gram = [[got[f"g{min(i, j)}_{max(i, j)}"] / total + (1e-6 if i == j else 0.0) for j in range(d)] for i in range(d)]
        step, spread = solve(gram, miss), sum(got[f"d{i}"] for i in range(d)) / total
        if steps % 6 == 0:  # the expression stays short
            current = saved(current, "mix-rates")
    raise RuntimeError(f"rates miss the targets by {math.sqrt(best):.2g} after {rounds} rounds")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate); labelled: (key, domain). Domains that aren't found have p 0."""
    rows, found = posteriors(docs, labelled, list(targets), key, text)
    rows = saved(rows, "mix-posteriors")
    if found:
        whole = sum(targets[d] for d in found)
        rows = fit_rates(rows, [targets[d] / whole for d in found])
    else:
        rows = rows.withColumn("rate", F.lit(1.0))
    zero = F.lit(0.0)
    return rows.select(F.col("_id").alias(key), F.col("tokens").alias("n_tokens"), *[(F.col("p")[found.index(d)] if d in found else zero).alias(f"p_{d}") for d in targets], "rate")


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    labelled = labels.select("doc_id", label_domain().alias("domain")).filter("domain is not null")
    return mixed(docs, labelled, TARGETS)
