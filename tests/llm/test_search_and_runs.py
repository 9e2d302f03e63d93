"""Periodic runs, exact top-k search and the filter audit against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import exact_topk, filter_audit, periodic_runs

ODD = [None, "", " \t\n ", "\n", "a", "a", "é日本𝒳 \x0b b", "a " * 40, "\x1c a \x85 a " * 9]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_scan(w, min_length=6, min_exponent=4):
    """Stretches whose least period q they are, tried period by period."""
    found, n = {}, len(w)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def tailed(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def op11_by_scan(doc_id, text):
    w = tailed(doc_id, text)
    runs = runs_by_scan(w)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else [None] * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def words_at_random(r):
    parts = []
    for _ in range(r.randint(1, 6)):
        base = [r.choice("abc") for _ in range(r.randint(1, 7))]
        parts += base * r.randint(1, 9) + base[: r.randint(0, len(base))]
    return parts[: r.randint(1, 120)]


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_of_many_texts_at_once(exponent):
    r = random.Random(exponent)
    texts = [words_at_random(r) for _ in range(150)] + [["x"], [], ["y"] * 50, list("ab" * 40), list("aab" * 30) + list("aab" * 2)]
    ids, words = {}, []
    for t, w in enumerate(texts):
        words += [ids.setdefault((t, x), len(ids)) for x in w]
    first = np.cumsum([0, *map(len, texts)])
    got = periodic_runs.find_runs(np.array(words, np.int64), first.astype(np.int64), 6, exponent)
    want = [(first[t] + s, first[t] + s + n, q) for t, w in enumerate(texts) for s, n, q in runs_by_scan(w, 6, exponent)]
    assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_branching_repeats_are_all_found():
    """Without a least number of leaves beyond two, all branching tandem repeats of a text."""
    r = random.Random(5)
    for _ in range(100):
        w = [r.choice("ab") for _ in range(r.randint(0, 40))]
        tree = periodic_runs.SuffixTree(np.array([ord(x) for x in w], np.int64), np.array([0, len(w)]), 2)
        want = {(i, q) for i in range(len(w)) for q in range(1, (len(w) - i) // 2 + 1) if w[i : i + q] == w[i + q : i + 2 * q] and (i + 2 * q == len(w) or w[i + 2 * q] != w[i])}
        assert {(int(i), int(q)) for i, q in zip(*tree.branching_repeats(), strict=True)} == want


def test_op11(frame, prose, spark):
    r = random.Random(2)
    texts = [*ODD, *[prose(i, 80) for i in range(40)], *[" ".join(words_at_random(r)) for _ in range(150)], prose(7, 4000), "x y " * 3000 + prose(8, 500), "\n".join(["same line of words"] * 12)]
    texts += [texts[60]] * 3
    docs = frame(texts)
    got = {x["doc_id"]: tuple(x) for x in periodic_runs.op11(docs).collect()}
    assert got == {i: op11_by_scan(i, t) for i, t in enumerate(texts)}
    assert periodic_runs.op11(frame([])).count() == 0
    none = spark.createDataFrame([(None, "b a a a a a a a", "clash")], "doc_id long, text string, runs string")
    assert tuple(periodic_runs.op11(none).first())[:5] == (None, 1, 1, 7, 1)


def test_tails(frame):
    texts = [f"a{i} b c  d\te f{i}" for i in range(300)]
    got = {x["doc_id"]: WORD.findall(x["text"]) for x in periodic_runs.with_repeated_tails(frame(texts)).collect()}
    assert got == {i: tailed(i, t) for i, t in enumerate(texts)} and any(got[i] != WORD.findall(t) for i, t in enumerate(texts))


def scores_by_hand(rows, k=5):
    clean = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256.0 * x) for x in v):
            clean.append((i, [math.floor(256.0 * x) for x in v]))
    out = []
    for a, (q, v) in enumerate(clean):
        if q is None or q % 50:
            continue
        score = lambda w: min(max(sum(x * y for x, y in zip(v, w, strict=False)), -(1 << 63)), (1 << 63) - 1)
        near = sorted((-score(w), i is None, i or 0, i) for b, (i, w) in enumerate(clean) if a != b)[:k]
        out += [(q, rank + 1, x[3], -x[0]) for rank, x in enumerate(near)]
    return sorted(out, key=repr)


def found(spark, rows, kind="float", **sizes):
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, row string, key int")
    got = exact_topk.top_k(df, "vec_id", "embedding", F.pmod("vec_id", F.lit(50)) == 0, **sizes) if sizes else exact_topk.op12(df)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_topk(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 12))
    vector = lambda i: [float(np.float32(x)) for x in centres[i % 6] + 0.3 * r.normal(size=12)]
    rows = [(i, vector(i)) for i in range(700)]
    rows += [(i, rows[50][1]) for i in range(700, 1000)]  # one very common vector, ties by key
    rows += [(100, rows[3][1]), (100, rows[100][1]), (100, rows[100][1]), (None, rows[50][1]), (-50, vector(2))]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 12), (1150, [float("inf")] + [0.0] * 11), (1200, []), (1250, [1.0, -2.0]), (1300, vector(1) + [9.0])]
    want = scores_by_hand(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, block=8, row_cells=500, slice_cells=200) == want  # several slices, short rows of the index


def test_topk_of_few_and_huge(spark):
    assert found(spark, []) == [] and found(spark, [(50, [1.0])]) == []
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (50, [0.5, 0.25])]
    assert found(spark, rows) == scores_by_hand(rows)
    big = [(i, [float(2 ** (20 + i % 5)) + i / 256, 1.0 - i / 256, float(i) * 1e6]) for i in range(120)]
    assert found(spark, big, "double") == scores_by_hand(big)
    beyond = [(0, [1e300, 1.0]), (1, [-1e300, 1.0]), (2, [1e300, 5.0]), (3, [1.0, 1.0])]
    assert found(spark, beyond, "double") == scores_by_hand(beyond)
    assert found(spark, [(0, [1e308]), (1, [1.0])], "double") == []  # 256 times it is not finite


def test_blocks_are_pruned():
    """Blocks whose bound is below the k-th score are not scored."""
    r = np.random.default_rng(3)
    m = np.floor(256 * np.repeat(r.normal(size=(32, 16)), 64, axis=0) + 8 * r.normal(size=(2048, 16)))
    heads = np.arange(0, 2048, 64)
    walk = exact_topk.Walk(m[::97], np.full(len(m[::97]), -np.inf), 5)
    nobody = np.zeros(0, np.int64)
    walk.through(np.arange(2048), np.zeros(2048, bool), m, np.maximum.reduceat(m, heads), np.minimum.reduceat(m, heads), (nobody, nobody))
    s = m[::97] @ m.T
    for i in range(len(s)):
        mine = walk.kept["q"] == i
        assert sorted(walk.kept["score"][mine]) == sorted(s[i])[-5:]
    assert walk.scored < walk.met / 4


def audit_by_hand(rows, labels):
    """rows (doc_id, text, lang); every filter of every order applied to what is left."""
    fails = []
    for i, t, _ in rows:
        t, w = t or "", WORD.findall(t or "")
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in rows)
        fails.append(f)
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[c] == 1} for c in (1, 2))
    out = {}
    for part in {p or "" for *_, p in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if fails[k][f]}
                left -= gone
                out[part, "".join(order), step] = [len(left), len(gone), sum(fails[k][f] for k in mine) - len(gone), sum(fails[k][f] and sum(fails[k].values()) == 1 for k in mine),
                                                   sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
    shapley = collections.Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_filter_audit(spark, prose, partitions):
    r = random.Random(4)
    base = [*ODD, prose(1, 120), prose(2, 99), prose(3, 150) + " #", "UPPER CASE " * 70, prose(4, 130).upper(), prose(5, 5000), "a b c d e " * 40]
    rows = [(i, r.choice(base), r.choice(["en", "de", None, ""])) for i in range(160)]
    rows += [(200 + i, base[9], "en") for i in range(150)]  # copies over many ranges
    rows += [(3, base[9], "en"), (3, base[9], "en"), (None, base[9], "fr"), (None, base[9], "fr"), (None, None, None), (7, "twice", "en"), (7, "twice", "en")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, lang string, mask string, n int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for x in filter_audit.op13(docs, marks).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == audit_by_hand(rows, labels)


def test_filter_audit_with_one_fingerprint(spark, monkeypatch):
    """Texts that share a fingerprint stay apart, also where ranges end among them."""
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    rows = [(i, f"text {i % 3}", "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        got = {x["doc_id"]: bool(x["mask"] & 16) for x in filter_audit.failures(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {i: i > 2 for i in range(100)}


def test_filter_audit_of_nothing(frame, spark):
    assert filter_audit.op13(frame([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
