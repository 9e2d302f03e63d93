"""From facts to a catalog, deep chains, cancellation and streaming intake."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from strandline.operators import diagnostics, endpoints, explorer
from strandline.plans.build import build_from_facts
from strandline.plans.catalog import Catalog
from strandline.schema import FACTS, TABLES
from strandline.sources import facts as facts_source
from strandline.streaming import intake, progress


@pytest.mark.parametrize("depth", [65, 100, 1000])
def test_deep_chains(spark, depth):
    spans = spark.createDataFrame([(i, i - 1 if i else None, "Top" if i == 0 else "Mid" if i == depth // 2 else None) for i in range(depth)] + [(5000, 4999, None), (4999, None, None)], FACTS["raw_spans"])
    got = {r["node_id"]: r["source_fqn"] for r in endpoints.enclosing(spans).collect()}
    assert got == {i: "Top" if i < depth // 2 else "Mid" for i in range(depth)}
    if depth <= 100:
        types = spark.createDataFrame([(f"T{i}", f"T{i - 1}" if i else None) for i in range(depth)], "fqn string, base_fqn string")
        last = {r["base"]: r["distance"] for r in endpoints.base_chain(types).filter(f"fqn = 'T{depth - 1}'").collect()}
        assert last == {f"T{depth - 1 - d}": d for d in range(depth)}


def test_cycles_raise(spark):
    ring = spark.createDataFrame([("A", "C", "A", "n"), ("B", "A", "B", "n"), ("C", "B", "C", "n")], "fqn string, container_fqn string, name string, ns string")
    symbols = spark.createDataFrame([(1, "Class", "T", "A", "T", 1, None, None, None, None, None, None), *[(i + 2, "Class", r["name"], r["fqn"], r["name"], 1, None, r["container_fqn"], None, None, None, None) for i, r in enumerate(ring.collect())]], TABLES["symbols"])
    with pytest.raises(Exception, match="hold each other"):
        explorer.tree(spark.createDataFrame([], TABLES["projects"]), symbols).collect()


def test_deep_tree(spark):
    names = [f"N{i}" for i in range(30)]
    rows = [(i, "Class", n, n, n, 1, None, names[i - 1] if i else None, None, None, None, None) for i, n in enumerate(names)]
    tree = explorer.tree(spark.createDataFrame([(1, "P", None, None, True)], TABLES["projects"]), spark.createDataFrame(rows, TABLES["symbols"]))
    assert {(r["level"], r["name"]) for r in tree.collect()} == {(0, "P"), (1, ""), *[(i + 2, n) for i, n in enumerate(names)]}


def test_build_from_facts(spark, tmp_path):
    mvc, anchor = "Microsoft.AspNetCore.Mvc", "Microsoft.AspNetCore.Routing.IEndpointRouteBuilder"
    symbol = lambda p, o, kind, sub, fqn, ns=None, holder=None: (p, o, kind, sub, False, False, True, fqn.split(".")[-1], fqn, fqn.split(".")[-1], ns, holder, f"/w/{p}.cs", o, 0, "Public")
    data = {
        "raw_projects": [("Web", "/w/Web.csproj", "Web", "ok", None), ("core", None, None, "unloaded", "not compiled"), ("Broken", None, None, "failed", "no such SDK")],
        "raw_symbols": [symbol("Web", 0, "NamedType", "Class", "Shop.CartController", "Shop"), symbol("Web", 1, "Method", "Ordinary", "Shop.CartController.Pay()", "Shop", "Shop.CartController"), symbol("core", 0, "NamedType", "Interface", "Core.ITill", "Core"), symbol("core", 1, "Method", "Ordinary", "Core.ITill.Ring()", "Core", "Core.ITill"), symbol("core", 2, "Method", "Ordinary", "Core.Till.Ring()", "Core", "Core.Till")],
        "raw_types": [("Shop.CartController", "CartController", f"{mvc}.ControllerBase", False, "Class")],
        "raw_methods": [("Shop.CartController.Pay()", "Shop.CartController", "Pay", None, "Ordinary", "Public", False, False, None), ("Core.Loud.Ring()", "Core.Loud", "Ring", None, "Ordinary", "Public", False, False, "Core.Till.Ring()")],
        "raw_attributes": [("Shop.CartController", 0, "RouteAttribute", mvc, ["shop/[controller]"], {}), ("Shop.CartController.Pay()", 0, "HttpPostAttribute", mvc, ["pay"], {})],
        "raw_calls": [("Web", "Shop.CartController.Pay()", 1, "Core.ITill.Ring()", None)],
        "raw_implements": [("Core.Till", "Core.ITill.Ring()", "Core.Till.Ring()", "Core.Till", True)],
        "raw_map_calls": [(1, "/w/Start.cs", "MapGet", anchor, "/open", 2, None, None, None), (2, "/w/Start.cs", "MapGet", anchor, "/many", 2, None, None, None)],
        "raw_handlers": [(2, "Shop.Over(int)"), (2, "Shop.Over(string)")],
        "raw_parameters": [(1, 0, "Core.ITill", "ITill")],
        "raw_inline_calls": [(1, 3, "Core.ITill.Ring()", "Ring()"), (1, 4, None, None)],
        "raw_documents": [("Web", "/w/Start.cs", None), ("Web", "/w/Bad.cs", "syntax tree lost")],
        "raw_errors": [("Web", 1, "CS0246", "no type Y")],
        "raw_problems": [("Failure", "cannot read"), ("Hint", "slow disk")],
    }
    for table, rows in data.items():
        spark.createDataFrame(rows, FACTS[table]).write.parquet(f"{tmp_path}/facts/{table}")
    told = []
    c = Catalog.open(spark, str(tmp_path / "c"))
    m = build_from_facts(c, "/w/All.sln", facts_source.load(spark, f"{tmp_path}/facts"), lambda *a: told.append(a))
    assert (m["project_count"], m["symbol_count"], m["endpoint_count"]) == (2, 5, 3)
    assert [d for _, d, _ in told] == sorted(d for _, d, _ in told) and {t for *_, t in told} == {told[-1][1]} == {9}
    assert {"Wrote 5 row(s) of symbols.", "Wrote 3 row(s) of endpoints.", "Wrote 7 row(s) of diagnostics."} <= {what for what, *_ in told}
    assert [(r["name"], r["loaded"]) for r in c.table("projects").orderBy("id").collect()] == [("core", False), ("Web", True)]
    edges = {(r["kind"], r["target_fqn"], r["target_symbol_id"] is None) for r in c.table("relations").collect()}
    assert edges == {("Calls", "Core.ITill.Ring()", False), ("Implements", "Core.ITill.Ring()", False)}  # the override's source isn't indexed
    found = {r["route"]: r for r in c.table("endpoints").collect()}
    assert set(found) == {"/shop/Cart/pay", "/open", "/many"} and found["/shop/Cart/pay"]["handler_symbol_id"] is not None
    assert found["/shop/Cart/pay"]["line"] == 2 and found["/open"]["provenance"] == "Inferred" and found["/open"]["project_id"] == 2
    links = [(r["endpoint_id"], r["target_fqn"]) for r in c.table("endpoint_dependencies").orderBy("id").collect()]
    assert links == [(found["/open"]["id"], "Core.ITill"), (found["/open"]["id"], "Core.ITill.Ring()")]
    notes = {(r["severity"], r["project"], r["message"][:12]) for r in diagnostics.listed(c.table("diagnostics")).collect()}
    assert notes == {("Error", None, "cannot read"), ("Warning", None, "slow disk"), ("Error", "core", "not compiled"), ("Error", "Broken", "no such SDK"), ("Warning", "Web", "Skipped /w/B"), ("Warning", None, "Handlers wit"), ("Warning", "Web", "1 compilatio")}


def test_intake_appends_once(spark, tmp_path):
    rows = lambda i: spark.createDataFrame([("P", f"S{i}", i, "T", None)], FACTS["raw_calls"])
    rows(1).write.parquet(f"{tmp_path}/in/raw_calls")
    for more in (None, 2):
        if more:
            rows(more).write.mode("append").parquet(f"{tmp_path}/in/raw_calls")
        intake.append(intake.stream(spark, f"{tmp_path}/in", "raw_calls"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r["source_fqn"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["S1", "S2"]


def test_cancelled_build_leaves_the_catalog(spark, tmp_path):
    c = Catalog.open(spark, str(tmp_path / "c"))
    with c.begin_rebuild() as s:
        s.add_symbols(spark.createDataFrame([(1, "Class", "A", "A", "A", None, None, None, None, None, None, None)], TABLES["symbols"]))
        s.complete("/w/a.sln")
    with pytest.raises(Exception, match="(?i)cancel"), progress.cancellable(spark) as group:
        threading.Thread(target=lambda: [progress.cancel(spark, group) for _ in range(60) if not time.sleep(0.25)], daemon=True).start()
        with c.begin_rebuild() as s:
            s.add_symbols(spark.range(10**12).selectExpr("id", "'Class' kind", "'n' name", "'f' fqn", "'d' display"))
            s.complete("/w/b.sln")
    assert Catalog.open(spark, str(tmp_path / "c")).metadata()["source_path"] == "/w/a.sln"


def test_progress_counts_the_work_done(spark, tmp_path):
    """Neither number of tasks falls, both grow table by table, and at the end they are equal; an error of the listener changes nothing."""
    told = []

    def tell(p):
        told.append(p)
        raise RuntimeError("listener")

    rows = spark.range(4000).selectExpr("id + 1 as id", "'Class' as kind", "'n' as name", "concat('f', id) as fqn", "'d' as display")
    c = Catalog.open(spark, str(tmp_path / "c"))
    with progress.metered(spark, tell, every=0.05) as report, c.begin_rebuild() as s:
        s.add_symbols(rows)
        s.add_relations(rows.selectExpr("fqn as source_fqn", "'Calls' as kind", "concat('f', id) as target_fqn", "'t' as target_display", "'Exact' as provenance", "cast(null as bigint) as project_id"))
        s.complete("/w/a.sln", told=lambda table, n: report(f"{n} {table}", 0, 0))
    done, total = [p.done for p in told], [p.total for p in told]
    assert done == sorted(done) and total == sorted(total) and all(d <= t for d, t in zip(done, total, strict=True)) and done[-1] == total[-1] > 10
    at = {p.message: p.done for p in told}
    assert 0 < at["4000 symbols"] < at["0 endpoints"] <= at["0 diagnostics"]
    assert c.refresh().metadata()["symbol_count"] == 4000


def test_skipped_stages_are_not_waited_for(spark):
    told = []
    with progress.metered(spark, told.append, every=0.05) as report:
        rows = spark.range(0, 1000, 1, 6).groupBy((F.col("id") % 7).alias("k")).count().persist()
        for i in range(3):
            rows.orderBy("k").collect()
            report(f"pass {i}", 0, 0)
        rows.unpersist()
    assert told[-1].done == told[-1].total > 6
