"""Members around places by spans, and group prefixes by kind of link."""

import random

import pytest

from strandline.operators import endpoints, spans
from strandline.schema import FACTS

NODES = "node_id long, document string, at long"


def nested(r, document, a, z, depth, out):
    """Random spans inside [a, z)."""
    while a < z and depth < 60:
        start = r.randint(a, z)
        end = r.randint(start, z)
        i = len(out)
        out.append((document, start, end, i, f"S{i}" if i % 4 else None, f"A{i}" if i % 8 == 0 else None))
        nested(r, document, start, end, depth + 1, out)
        a = end + r.randint(0, 2)


def innermost(found, document, at):
    inside = [s for s in found if s[0] == document and s[1] <= at < s[2] and (s[4] or s[5])]
    best = max(inside, key=lambda s: (s[1], -s[2], s[3]), default=None)
    return best and (best[4] or best[5])


def test_random_nesting(spark):
    r = random.Random(3)
    found = []
    for d in ("a", "b", "c"):
        nested(r, d, 0, 120, 0, found)
    found += [("deep", i, 4000 - i, 10_000 + i, f"D{i}" if i % 3 == 0 else None, None) for i in range(1500)]
    places = [(i, d, at) for i, (d, at) in enumerate([(d, at) for d in ("a", "b", "c") for at in range(-2, 125)] + [("deep", at) for at in range(0, 4000, 37)] + [("other", 5), (None, 5), ("a", None)])]
    got = spans.enclosing_spans(spark.createDataFrame(found, FACTS["raw_declarations"]), spark.createDataFrame(places, NODES))
    assert {x["node_id"]: x["source_fqn"] for x in got.collect()} == {i: n for i, d, at in places if d and at is not None and (n := innermost(found, d, at))}


def test_accessors_equal_spans_and_neighbours(spark):
    found = [
        ("f", 0, 100, 0, "T", None), ("f", 10, 40, 1, "T.P", None), ("f", 15, 25, 2, None, "T.P"), ("f", 50, 60, 3, "T.M()", None), ("f", 52, 58, 4, None, None),  # property, its accessor, method, local function
        ("f", 60, 70, 5, "T.N()", None), ("f", 70, 80, 6, "T.O", None), ("f", 70, 80, 7, "T.O.inner", None), ("f", 80, 80, 8, "T.empty", None),
    ]
    places = {5: "T", 20: "T.P", 30: "T.P", 40: "T", 55: "T.M()", 59: "T.M()", 60: "T.N()", 75: "T.O.inner", 80: "T", 99: "T"}
    df = spark.createDataFrame([(at, "f", at) for at in places] + [(100, "f", 100)], NODES)
    got = spans.enclosing_spans(spark.createDataFrame(found, FACTS["raw_declarations"]), df)
    assert {x["node_id"]: x["source_fqn"] for x in got.collect()} == places
    sites = spark.createDataFrame([("App", "f", 55, 1, "X.Y()", None), ("App", "f", 55, 2, None, ["X.Z()"]), ("App", "g", 5, 3, "X.Y()", None)], FACTS["raw_call_sites"])
    calls = spans.attributed(sites, spark.createDataFrame(found, FACTS["raw_declarations"]))
    assert {(x["project"], x["source_fqn"], x["ord"], x["exact_fqn"]) for x in calls.collect()} == {("App", "T.M()", 1, "X.Y()"), ("App", "T.M()", 2, None)}


def test_crossing_spans_raise(spark):
    found = spark.createDataFrame([("f", 0, 10, 0, "A", None), ("f", 5, 15, 1, "B", None)], FACTS["raw_declarations"])
    with pytest.raises(Exception, match="spans cross in f"):
        spans.enclosing_spans(found, spark.createDataFrame([(1, "f", 7)], NODES)).collect()
    assert spans.enclosing_spans(found.limit(0), spark.createDataFrame([(1, "f", 7)], NODES)).count() == 0


def test_group_prefixes_by_kind_of_link(spark):
    # a group, ten calls that change nothing, another group, a local, a group
    rows = [(1, None, True, "/api/")] + [(i, i - 1, False, None) for i in range(2, 12)] + [(12, 11, True, "~/v1"), (13, 12, False, None), (14, 13, True, "users"), (15, 14, True, None)]
    links = [(i, False) for i in range(2, 12)] + [(13, True), (15, False)]
    got = endpoints.group_prefixes(spark.createDataFrame(rows, FACTS["raw_groups"]), spark.createDataFrame(links, FACTS["raw_group_links"]))
    assert {r["node_id"]: r["prefix"] for r in got.collect()} == {1: "/api", **dict.fromkeys(range(2, 12), "/api"), 12: "/api/~/v1", 13: "/api/~/v1", 14: "/api/~/v1/users", 15: "/api/~/v1/users"}
    chain = spark.createDataFrame([(i, i - 1 if i else None, True, f"g{i}") for i in range(12)], FACTS["raw_groups"])
    want = {i: "".join(f"/g{j}" for j in range(max(0, i - 7), i + 1)) for i in range(12)}
    for some in (None, spark.createDataFrame([], FACTS["raw_group_links"])):
        assert {r["node_id"]: r["prefix"] for r in endpoints.group_prefixes(chain, some).collect()} == want
