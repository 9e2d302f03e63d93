"""Layout, constraints and concurrent writers of the stored catalog."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline import schema
from strandline.operators import explorer
from strandline.plans import catalog as plans
from strandline.plans.catalog import Catalog, ConstraintError

T = schema.TABLES


def symbols(spark, n, project=None):
    return spark.range(1, n + 1).select(
        "id", F.lit("Method").alias("kind"), F.concat(F.lit("m"), "id").alias("name"), F.concat(F.lit("N.T"), F.col("id") % 97, F.lit(".m"), F.col("id")).alias("fqn"), F.lit("m()").alias("display"),
        F.lit(project).cast("long").alias("project_id"), F.concat(F.lit("N.T"), F.col("id") % 97).alias("container_fqn"),
    )


def project_rows(spark, *names):
    return spark.createDataFrame([(i, n, None, None, True) for i, n in enumerate(names, 1)], T["projects"])


def endpoint_rows(spark, ids, project=None):
    return spark.createDataFrame([(i, "GET", f"/r{i}", "h", None, None, "MinimalApi", project, None, None, False, False, None, None, "Exact") for i in ids], T["endpoints"])


def links(spark, pairs):
    return spark.createDataFrame([(e, i, f"T{i}", f"T{i}") for i, e in enumerate(pairs)], "endpoint_id long, pos long, target_fqn string, target_display string")


def rows_read(df) -> int:
    """Rows that the scans of df gave, after row groups and pages were skipped."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_lookups_read_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "ROW_GROUP_BYTES", 64 << 10)
    n = 60_000
    c = Catalog.open(spark, str(tmp_path / "c"))
    edges = spark.range(n * 2).select(F.lit(1).cast("long").alias("project_id"), F.concat(F.lit("N.T"), (F.col("id") % n + 1) % 97, F.lit(".m"), F.col("id") % n + 1).alias("source_fqn"), F.lit("Calls").alias("kind"),
                                      F.concat(F.lit("N.T"), (F.col("id") * 7 % n + 1) % 97, F.lit(".m"), F.col("id") * 7 % n + 1).alias("target_fqn"), F.lit("t").alias("target_display"), F.lit("Exact").alias("provenance"))
    with c.begin_rebuild() as s:
        s.add_projects(project_rows(spark, "P"))
        s.add_symbols(symbols(spark, n, 1))
        s.add_relations(edges)
        s.complete("/w/a.sln")
    stored, forward, back = c.table("symbols"), c.table("relations"), c.table("relations_by_target")
    assert forward.count() == back.count() == n and forward.exceptAll(back).isEmpty()
    lookups = {
        "name": stored.filter("fqn = 'N.T5.m102'"),
        "id": stored.filter("id = 4711"),
        "members": explorer.members(stored, "N.T11", ordered=False),
        "calls": forward.filter("source_symbol_id = 300 and kind = 'Calls'"),
        "called": back.filter("target_symbol_id = 300 and kind = 'Calls'"),
        "nothing": stored.filter("fqn = 'N.T5.m102x'"),
    }
    want = {"name": 1, "id": 1, "members": sum(i % 97 == 11 for i in range(1, n + 1)), "calls": 1, "called": 1, "nothing": 0}
    for what, df in lookups.items():
        assert len(df.collect()) == want[what], what
        assert rows_read(df) < n / 6, what
    assert rows_read(stored) == n


def test_lookup_by_bloom_filter(spark, tmp_path):
    """A name inside a file's range that isn't in the file: its row groups are not read."""
    c = Catalog.open(spark, str(tmp_path / "c"))
    with c.begin_rebuild() as s:
        s.add_symbols(symbols(spark, 30_000))
        s.complete("/w")
    assert rows_read(c.table("symbols").filter("fqn = 'N.T50.m1234x'")) == 0
    assert rows_read(c.table("symbols").filter("id = 40000")) == 0


def test_one_shuffle_checks_uniqueness(spark):
    """The key of a unique index is the range of the layout, so nothing is dealt out again for the check."""
    order, unique = plans.LAYOUT["relations"][0], plans.UNIQUE["relations"]
    rows = spark.range(100).selectExpr("id", "id % 7 as source_symbol_id", "string(id % 2) as kind", "string(id) as target_fqn")
    plan = rows.repartitionByRange(*order).sortWithinPartitions(*unique, "id").withColumn("nth", F.row_number().over(Window.partitionBy(*unique).orderBy("id")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("Sort ") == 1


@pytest.fixture(scope="module")
def live(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store") / "c"
    c = Catalog.open(spark, str(root))
    with c.begin_rebuild() as s:
        s.add_symbols(symbols(spark, 3))
        s.complete("/w")
    return root, c


@pytest.mark.parametrize(("what", "build"), [
    ("name is null", lambda spark, s: s.add_symbols(symbols(spark, 5).withColumn("name", F.when(F.col("id") != 3, F.col("name"))))),
    ("unknown symbol kind", lambda spark, s: s.add_symbols(symbols(spark, 5).withColumn("kind", F.lit("Odd")))),
    ("project_id is no row of projects", lambda spark, s: (s.add_projects(project_rows(spark, "A")), s.add_symbols(symbols(spark, 5, 2)))),
    ("repeated ids in symbols", lambda spark, s: (s.add_symbols(symbols(spark, 5)), s.add_symbols(symbols(spark, 2)))),
    ("repeated ids in projects", lambda spark, s: s.add_projects(project_rows(spark, "A").unionByName(project_rows(spark, "B")))),
    ("endpoint_id is no row of endpoints", lambda spark, s: s.add_endpoints(endpoint_rows(spark, [1]), links(spark, [1, 2]))),
    ("unknown endpoint provenance", lambda spark, s: s.add_endpoints(endpoint_rows(spark, [1]).withColumn("provenance", F.lit("Guess")))),
    ("requires_auth is null", lambda spark, s: s.add_endpoints(endpoint_rows(spark, [1]).drop("requires_auth"))),
    ("message is null", lambda spark, s: s.add_diagnostics(spark.createDataFrame([("Error", None, None)], "severity string, project string, message string"))),
])
def test_violations_leave_the_live_version(spark, live, what, build):
    root, _ = live
    c = Catalog.open(spark, str(root))
    with pytest.raises(ConstraintError, match=what), c.begin_rebuild() as s:
        build(spark, s)
        s.complete("/other")
    again = Catalog.open(spark, str(root))
    assert again.metadata()["source_path"] == "/w" and again.table("symbols").count() == 3
    assert sum(f.name.startswith("v-") for f in root.iterdir()) == 1


def test_repeated_edges_are_seen(spark, tmp_path, monkeypatch):
    """Merging makes edges unique; if it didn't, the commit would tell."""
    c = Catalog.open(spark, str(tmp_path / "c"))
    monkeypatch.setattr(plans.resolve, "resolve_edges", lambda staged, _: staged.unionByName(staged).select(F.lit(1).alias("source_symbol_id"), "kind", F.lit(None).cast("long").alias("target_symbol_id"), "target_fqn", "target_display", "provenance"))
    with pytest.raises(ConstraintError, match="repeated source_symbol_id, kind, target_fqn"), c.begin_rebuild() as s:
        s.add_relations(spark.createDataFrame([(1, "a", "Calls", "b", "b", "Exact")], schema.STAGED_RELATIONS))
        s.complete("/w")


def test_dependencies_go_with_their_endpoint(spark, tmp_path):
    c = Catalog.open(spark, str(tmp_path / "c"))
    with c.begin_rebuild() as s:
        s.add_endpoints(endpoint_rows(spark, [1, 2, 3]), links(spark, [1, 2, 2, 3]))
        s.drop_endpoints(spark.createDataFrame([(2,)], "id long"))
        s.complete("/w")
    assert sorted(r["id"] for r in c.table("endpoints").collect()) == [1, 3]
    assert sorted((r["id"], r["endpoint_id"]) for r in c.table("endpoint_dependencies").collect()) == [(1, 1), (2, 3)]


def test_diagnostics_keep_their_order(spark, tmp_path):
    c = Catalog.open(spark, str(tmp_path / "c"))
    shape = "severity string, project string, message string"
    with c.begin_rebuild() as s:
        s.add_diagnostics(spark.createDataFrame([("Warning", "Z", "third"), ("Error", "A", "first"), ("Info", None, "second")], shape))
        s.add_diagnostics(spark.createDataFrame([("Error", "A", "a", 2), ("Error", "A", "b", 1)], f"{shape}, ord int").select("severity", "project", "message"))
        s.complete("/w")
    assert [r["message"] for r in c.table("diagnostics").orderBy("id").collect()] == ["third", "first", "second", "a", "b"]


def base(spark, root):
    c = Catalog.open(spark, root)
    with c.begin_rebuild() as s:
        s.set_setting("theme", "dark")
        s.complete("/w/a.sln")
    return c


def test_two_writers_of_settings(spark, tmp_path):
    root = str(tmp_path / "c")
    one = base(spark, root)
    two = Catalog.open(spark, root)
    tries = []
    put = two.store.put_new
    two.store.put_new = lambda name, text: tries.append(name) or put(name, text)
    one.set_setting("a", "1")
    two.set_setting("b", "2")  # has not seen a
    assert len(tries) == 2 and tries[0] != tries[1]
    one.set_setting("a", "3")
    assert Catalog.open(spark, root).settings().items() >= {("a", "3"), ("b", "2"), ("theme", "dark")}


def test_settings_written_during_a_rebuild_stay(spark, tmp_path):
    root = str(tmp_path / "c")
    one = base(spark, root)
    with one.begin_rebuild() as s:
        s.add_symbols(symbols(spark, 2))
        Catalog.open(spark, root).set_setting("late", "yes")
        s.complete("/w/b.sln")
    got = Catalog.open(spark, root)
    assert got.setting("late") == "yes" and got.metadata()["source_path"] == "/w/b.sln" and got.table("symbols").count() == 2


def test_a_writer_that_stopped_half_way_has_published(spark, tmp_path):
    root = str(tmp_path / "c")
    one = base(spark, root)
    before = one.store.read("current.json")
    one.set_setting("a", "1")
    one.store.replace("current.json", before)  # as if it had ended before the pointer was replaced
    again = Catalog.open(spark, root)
    assert again.setting("a") == "1"
    again.set_setting("b", "2")
    again.collect_garbage()
    assert Catalog.open(spark, root).settings().items() >= {("a", "1"), ("b", "2")}
    assert [f.name for f in (tmp_path / "c" / "log").glob("0*.json")] == [f"{again.number:012}.json"]
    assert json.loads(again.store.read("current.json"))["number"] == again.number
