"""Recall near the threshold, null ids in mixtures, odd markup and deep pages."""

import random
import re
import resource
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import html_extract, mixing, near_dedup, quality, suffix_dedup, token_count
from strandline.llm.html_extract import Page


def share(a, b):
    """Aligned words over the longer text's, by plain dynamic programming."""
    d = np.zeros(len(b) + 1, int)
    for x in a:
        new, best = [0], 0
        for j, y in enumerate(b):
            best = d[j] + 1 if x == y else max(d[j + 1], new[-1])
            new.append(best)
        d = np.array(new)
    return d[-1] / max(len(a), len(b))


@pytest.mark.parametrize("similarity", [0.80, 0.82, 0.85, 0.9])
def test_recall_of_scattered_edits(frame, prose, similarity):
    """Pairs of 200 words with single words replaced at random places, the hardest kind of edit: nine in ten or more are found."""
    r = random.Random(int(1000 * similarity))
    texts = []
    for s in range(120):
        w = [f"{x}{i % 7}" for i, x in enumerate(prose(1000 + s, 200).split())]
        x = w[:]
        for at in r.sample(range(200), round(200 * (1 - similarity))):
            x[at] = f"new{at}"
        texts += [" ".join(w), " ".join(x)]
    assert all(share(texts[i].split(), texts[i + 1].split()) >= similarity - 1e-9 for i in range(0, 20, 2))
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.op3(frame(texts)).collect()}
    assert sum(got[i + 1] == i for i in range(0, 240, 2)) >= 0.9 * 120
    assert all(got[i] == i for i in range(0, 240, 2))


def test_mixing_counts_null_ids(spark, prose):
    docs = [(i, f"{'alpha' if i % 3 else 'beta'} {prose(i, 20)}") for i in range(60)] + [(None, "alpha " * 50), (None, "beta " * 7), (None, None), (70, ""), (71, None), (72, " \n ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "good" if i % 3 else "low") for i in range(40)], "doc_id long, domain string")
    for marks in (labelled, labelled.limit(0)):
        got = mixing.mixed(df, marks, {"good": 0.7, "low": 0.3}).toPandas()
        tokens = {None if i != i else int(i): n for i, n in zip(got.doc_id, got.n_tokens, strict=True)}
        assert tokens == {**{i: 21 for i in range(60)}, None: 57, 70: 0, 71: 0, 72: 0}
    # brute force of the posteriors: the null id is one document of all its words
    rows, found = mixing.posteriors(df, labelled, ["good", "low"])
    weights, unseen, _ = mixing.word_weights(df, labelled, ["good", "low"], "doc_id", "text")
    table = {x["bucket"]: (x["l_0"], x["l_1"]) for x in weights.collect()}
    bucket = {x["w"]: x["b"] for x in spark.createDataFrame([("alpha",), ("beta",)], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    s = np.array([50 * table[bucket["alpha"]][k] + 7 * table[bucket["beta"]][k] for k in (0, 1)])  # 57 words, fewer than EVIDENCE, count in full
    want = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    assert found == ["good", "low"] and np.allclose(rows.filter("_id is null").first()["p"], want)


def shown(source):
    return [b[2] for b in Page(source).blocks]


def test_markup_never_leaks():
    assert shown("<p onclick=it's>y</p><p>z") == ["y", "z"]
    assert shown("<p title=\"a>b\">one<p title='c>d'>two<p a = \"x>y\" b>three") == ["one", "two", "three"]
    assert shown("<p it's>y<p \"quoted\">z") == ["y", "z"]
    assert shown("a<!-->b<!--->c<!-- x > y -->d<!-- open") == ["abcd"]
    assert shown("<!doctype html><?xml version='1'?>one</ p>two</>three<") == ["onetwothree<"]
    assert shown("1 < 2 and 3 <4") == ["1 < 2 and 3 <4"]
    assert shown("<p title=\"never closed>text <b>x</b>") == []  # as in browsers, the value runs to the end
    assert shown("<a href=x/>link</a> <img alt='a>b'>tail") == ["link tail"]
    r = random.Random(1)
    for _ in range(300):  # attributes of any form, with quotes only where they may stand
        attrs = " ".join(r.choice(["a", "b=c", "c='it is>'", 'd="e>f"', "g=h'i", 'j=k"l', "m'n", "o = p"]) for _ in range(r.randint(0, 5)))
        assert shown(f"<p {attrs}>inside</p>after") == ["inside", "after"]


def test_deep_page_in_bounded_memory():
    """A megabyte of nested tags."""
    code = "import resource, sys; sys.path.insert(0, '.'); from strandline.llm.html_extract import Page; a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; p = Page('<div>' * 200_000 + 'x' + '</b>' * 1000); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) / 1024, len(p.tags), p.blocks[0][2])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert float(out[0]) < 200 and out[1:] == ["200000", "x"]
    assert resource.getpagesize() > 0


def test_stray_ends_are_quick():
    assert shown("<b>" * 50_000 + "</i>" * 50_000 + "x") == ["x"]


def test_html_of_odd_tables(spark, prose):
    shape = "page_id long, url string, html string, host string, slot string, blocks int"
    assert html_extract.op8(spark.createDataFrame([], shape)).count() == 0
    long = "<article>" + "".join(f"<p>{prose(i, 200)}" for i in range(800)) + "</article>"
    rows = [(1, "http://a.example/1", long, "clash", "clash", 1), (1, "http://a.example/1", long, "clash", "clash", 1), (None, None, "<p>no url", None, None, None), (2, "http://b.example", "<div>" * 20_000 + "deep", "h", "s", 2)]
    got = {(r["page_id"], r["n_chars"]): r["text"] for r in html_extract.op8(spark.createDataFrame(rows, shape)).collect()}
    text = "\n".join(" ".join(prose(i, 200).split()) for i in range(800))
    assert got == {(1, len(text)): text, (None, 6): "no url", (2, 4): "deep"}


def test_occurrence_vectors_by_brute_force(spark, prose):
    """Classes by sums of hashes are the classes of equal occurrence vectors, written out page by page."""
    r = random.Random(2)
    pages = []
    for i in range(12):
        extra = "".join(f"<div class=x{j}><p>{prose(j, 3)}</div>" for j in range(4) if r.random() < 0.6)
        pages.append((i, "http://h.example/", f"<html><body><div id=top>Site</div>{extra}<main>{'<p>same words</p>' * r.randint(1, 3)}<p>{prose(100 + i, 12)}</main></body></html>"))
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").select("page_id", "url", html_extract.host_of(F.col("url")).alias("host"), "html", F.xxhash64("page_id", "html").alias("page"))
    got = {x["token"]: x for x in html_extract.token_stats(rows).collect()}
    vectors, once, support = {}, {}, {}
    for i, _, source in pages:
        p = Page(source)
        for t in [t for t, _ in p.tags] + [b[0] for b in p.blocks if b[0]]:
            vectors.setdefault(t, {}).setdefault(i, 0)
            vectors[t][i] += 1
    for t, v in vectors.items():
        support[t], once[t] = len(v), sum(c == 1 for c in v.values())
    assert set(got) - {0} == set(vectors) and got[0]["support"] == 12
    assert all((got[t]["support"], got[t]["once"]) == (support[t], once[t]) for t in vectors)
    by_sum, by_vector = {}, {}
    for t, v in vectors.items():
        by_sum.setdefault((got[t]["vec"], got[t]["support"]), set()).add(t)
        by_vector.setdefault(tuple(sorted(v.items())), set()).add(t)
    assert sorted(map(sorted, by_sum.values())) == sorted(map(sorted, by_vector.values()))
    # the frame, and the template's own text outside articles, by their definitions
    parsed = [Page(source) for _, _, source in pages]
    tags, inside = {t for p in parsed for t, _ in p.tags}, {b[0] for p in parsed for b in p.blocks if b[5]}
    mates = {t: len(by_vector[tuple(sorted(v.items()))]) for t, v in vectors.items()}
    template = html_extract.templates(html_extract.token_stats(rows)).collect()[0]
    assert {x["token"] for x in template["frame"]} == {t for t in tags if once[t] == support[t] >= 3}
    assert set(template["own"]) - inside == {t for t in set(vectors) - tags - inside if support[t] >= 6 and (mates[t] > 1 or 10 * support[t] >= 9 * 12)}


def test_clashing_columns_and_long_texts(spark, prose):
    long = " ".join(prose(i, 1000) for i in range(30))
    base = [(1, long, "en", "s", 5), (2, "a b c " * 30, "de", None, 1), (2, "a b c " * 30, "de", None, 1), (3, None, None, None, None)]
    clash = {"n_words": F.lit("x"), "base_failed": F.lit("x"), "host": F.lit("x"), "h": F.lit("x"), "node": F.lit("x"), "pos": F.lit("x"), "n_bytes": F.lit("x"), "n_tokens": F.lit("x"), "key": F.lit("x")}
    plain = spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long")
    odd = plain.withColumns(clash)
    for op in (quality.op2, suffix_dedup.op10, token_count.op5):
        same = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert same(op(odd)) == same(op(plain)), op
    words = {r["doc_id"]: r["n_words"] for r in quality.op2(odd).collect()}
    assert words == {1: len(re.findall(r"\S+", long)), 2: 90, 3: 0}


def test_revisits_of_all_pages_equal_sql(spark):
    """Every page with an id is revisited once; the rows of a third of them are those of the query beside it."""
    import duckdb

    from strandline.llm import queries

    folder, name = "/root/testdata/sf0.001", "warc_revisits_all_pages"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    names = sorted(queries.QUERIES[name](spark, folder).columns)
    got = [tuple(r) for r in queries.QUERIES[name](spark, folder).select(names).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(f"select {', '.join(names)} from ({queries.ORACLE[name]})").fetchall(), key=repr)
    assert len(got) == con.execute("select count(page_id) from pages").fetchone()[0] and {r[names.index("outcome")] for r in got} == {"resolved", "mismatch", "orphan"}
    third = queries.QUERIES["op9_warc_revisits"](spark, folder).select("record_id").collect()
    assert {r["record_id"] for r in third} < {r[names.index("record_id")] for r in got}


def test_hot_buckets_meet_by_length_and_only_with_pairs_left(spark):
    r = np.random.default_rng(5)
    size, longest = 6 * near_dedup.BLOCK, 3000
    n = np.exp(r.uniform(np.log(20), np.log(longest), size)).astype(int)
    nodes = spark.createDataFrame([(bytes([i % 256, i // 256]), int(x), bytes(2), [(7, size)]) for i, x in enumerate(n)], "node binary, n long, hist binary, buckets array<struct<key:long,c:long>>")
    still = nodes.select("node", F.inline("buckets")).select("key", "node")
    rows = near_dedup.dealt(near_dedup.narrowed(nodes, None, still))
    met = rows.groupBy("block").agg(F.sum(F.col("own").cast("int")).alias("own"), F.collect_list("n").alias("all")).collect()
    assert sum(x["own"] for x in met) == size  # each node is at home once
    assert sum(len(x["all"]) for x in met) < 4 * size  # before: each of the bucket's blocks, so 6 times
    at = {(x["node"], x["block"]): x for x in rows.select("node", "block", "own", "n").collect()}
    home = {node: (block, x["n"]) for (node, block), x in at.items() if x["own"]}
    some = list(home.items())[::97]
    pairs = [(a, b) for a, (_, x) in some for b, (_, y) in some if 0.8 * max(x, y) <= min(x, y)]
    assert pairs and all((a, home[b][0]) in at or (b, home[a][0]) in at for a, b in pairs)


def test_nodes_without_pairs_left_leave_the_bucket():
    hist = np.zeros((40, near_dedup.BINS), np.uint8)
    for i in range(40):
        hist[i, (i * 12) : (i * 12) + 12] = 1
    hist[1:4] = hist[0]  # four that pass, all others far apart
    n = np.full(40, 12)
    comp = np.stack([np.arange(40)] * 2, 1).astype(np.uint64)
    a, b, left = near_dedup.group_links(n, np.ones(40, bool), comp, hist, 1, 0.8, None)
    assert len(a) == len(b) == 3 and set(left.tolist()) == {1, 2, 3}  # the pairs left are among these
    a, b, left = near_dedup.group_links(n, np.ones(40, bool), comp, hist, 32, 0.8, [frozenset()] * 40)
    assert len(a) == 6 and not len(left)
