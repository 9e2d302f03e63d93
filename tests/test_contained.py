"""Builds from broken facts, traces of few endpoints, and long chains of bases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strandline import schema
from strandline.operators import endpoints, resolve, trace
from strandline.plans.build import build_from_facts
from strandline.plans.catalog import Catalog, build_index
from strandline.schema import FACTS, STAGED_RELATIONS, TABLES
from strandline.sources import facts as facts_source


def symbol(project, i):
    return {"project": project, "ord": i, "kind_name": "NamedType", "type_kind": "Class", "in_source": True, "name": f"T{i}", "fqn": f"{project}.T{i}", "display": f"T{i}"}


def write_lines(folder, table, project, rows):
    place = folder / table / f"project={project}"
    place.mkdir(parents=True)
    (place / "part-0.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_malformed_rows_cost_their_project(spark, tmp_path):
    for p in ("Good", "Torn", "Gap", "Odd"):
        write_lines(tmp_path, "raw_projects", p, [{"project": p, "status": "ok" if p != "Odd" else "perhaps"}])
        write_lines(tmp_path, "raw_symbols", p, [symbol(p, i) for i in range(3)] + (['{"project": "Torn", "ord": 9, "name'] if p == "Torn" else []))
    write_lines(tmp_path, "raw_types", "Gap", [{"fqn": "Gap.T0", "name": None}])
    write_lines(tmp_path, "raw_types", "Good", [{"fqn": "Good.T0", "name": "T0"}])
    c = Catalog.open(spark, str(tmp_path / "c"))
    m = build_from_facts(c, "/w", facts_source.load_contained(spark, str(tmp_path), "json"))
    assert (m["project_count"], m["symbol_count"]) == (1, 3) and c.table("projects").first()["name"] == "Good"
    notes = {r["project"]: (r["severity"], r["message"]) for r in c.table("diagnostics").collect()}
    assert notes == {"Torn": ("Error", "raw_symbols: a row can't be read (1)"), "Gap": ("Error", "raw_types: a value is missing (1)"), "Odd": ("Error", "raw_projects: the status is unknown (1)")}


def test_unreadable_files_cost_their_project(spark, tmp_path):
    for p in ("Good", "Cut", "Tail"):
        for table, rows in (("raw_projects", [{"project": p, "status": "ok"}]), ("raw_symbols", [symbol(p, i) for i in range(2000)])):
            spark.createDataFrame([tuple(r.get(f.name) for f in FACTS[table]) for r in rows], FACTS[table]).coalesce(1).write.parquet(f"{tmp_path}/{table}/project={p}")
    for p, damage in (("Cut", lambda b: b[: len(b) // 2]), ("Tail", lambda b: b"no Parquet at all")):
        file = next((tmp_path / "raw_symbols" / f"project={p}").glob("*.parquet"))
        file.write_bytes(damage(file.read_bytes()))
        for crc in file.parent.glob(".*.crc"):
            crc.unlink()
    got = facts_source.load_contained(spark, str(tmp_path))
    assert {(r["project"], r["status"], (r["message"] or "")[:13]) for r in got["raw_projects"].collect()} == {("Good", "ok", ""), ("Cut", "failed", "raw_symbols: "), ("Tail", "failed", "raw_symbols: ")}
    assert got["raw_symbols"].select("project").distinct().collect() == [("Good",)] and got["raw_symbols"].count() == 2000


def test_rows_of_no_project(spark, tmp_path):
    for table, rows in (("raw_projects", [("A", None, None, "ok", None)]), ("raw_types", [("A.T", None, None, None, None), ("A.U", "U", None, None, None)])):
        spark.createDataFrame(rows, "project string, file_path string, assembly_name string, status string, message string" if table == "raw_projects" else "fqn string, name string, base_fqn string, is_abstract boolean, type_kind string").write.parquet(f"{tmp_path}/{table}")
    got = facts_source.load_contained(spark, str(tmp_path))
    assert [r["fqn"] for r in got["raw_types"].collect()] == ["A.U"] and got["raw_projects"].count() == 1
    assert [tuple(r) for r in got["raw_problems"].collect()] == [("Failure", "raw_types: a value is missing (1)")]
    assert set(facts_source.load_contained(spark, str(tmp_path / "nothing"))) == set(FACTS)


def test_an_unknown_kind_costs_its_project(spark, tmp_path):
    def load(name):
        i = {"A": 1, "B": 2, "C": 3}[name]
        kind = "Odd" if name == "B" else "Class"
        return {"projects": spark.createDataFrame([(i, name, None, None, True)], TABLES["projects"]), "symbols": spark.createDataFrame([(i, kind, "n", f"{name}.n", "n", i, None, None, None, None, None, None)], TABLES["symbols"])}

    c = Catalog.open(spark, str(tmp_path / "c"))
    m = build_index(c, "/w", ["A", "B", "C"], load)
    assert m["project_count"] == 2 and sorted(r["fqn"] for r in c.table("symbols").collect()) == ["A.n", "C.n"]
    assert [(r["severity"], r["project"]) for r in c.table("diagnostics").collect()] == [("Error", "B")] and "unknown kind Odd" in c.table("diagnostics").first()["message"]


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(8)
    n = 400
    symbols = spark.createDataFrame([(i, "Method", f"m{i}", f"N.m{i}", f"d{i % 50}", 1, None, None, None, None, None, None) for i in range(n)], TABLES["symbols"])
    # islands of twenty symbols with hubs and cycles, so few endpoints reach few of them
    links = [(1, f"N.m{a}", r.choice(["Calls", "Calls", "Implements", "Overrides"]), f"N.m{a // 20 * 20 + b}", "t", "Exact") for a in range(n) for b in r.sample(range(20), r.choice([0, 1, 2, 9])) if a % 20 != b]
    relations = resolve.resolve_edges(spark.createDataFrame(links, STAGED_RELATIONS), symbols).cache()
    ends = spark.createDataFrame([(i, f"N.m{i * 7 % n}" if i % 3 else None) for i in range(60)], "id long, handler_fqn string")
    deps = spark.createDataFrame([(i, p, f"N.m{(i * 11 + p) % n}", (i * 11 + p) % n if p < 3 else None) for i in range(0, 60, 3) for p in range(4)], "endpoint_id long, pos long, target_fqn string, symbol_id long")
    return symbols.cache(), relations, ends.cache(), deps.cache()


@pytest.mark.parametrize("few", [1000, 0])
def test_traces_of_few_endpoints(spark, graph, monkeypatch, few):
    symbols, relations, ends, deps = graph
    monkeypatch.setattr(trace, "FEW", few)  # by lists in filters, and by joins
    wanted = [4, 9, 22]
    full = {tuple(r) for r in trace.trace(ends, deps, relations, symbols).filter(F.col("endpoint_id").isin(wanted)).collect()}
    got = trace.trace_of(ends.filter(F.col("id").isin(wanted)), deps, relations, symbols, relations)
    assert {tuple(r) for r in got.collect()} == full and len({r[0] for r in full}) == 3
    part = trace.reachable(spark.createDataFrame([(28,), (99,)], "id long"), relations, relations, schema.MAX_TRACE_DEPTH + 1)
    assert 0 < part.distinct().count() <= relations.filter("int(source_symbol_id / 20) in (1, 4)").count() < relations.count() / 5
    assert trace.trace_of(ends.limit(0), deps, relations, symbols).count() == 0


def test_a_chain_of_ten_thousand_bases(spark):
    n = 10_000
    rows = spark.range(n).select(F.concat(F.lit("T"), "id").alias("fqn"), F.when(F.col("id") > 0, F.concat(F.lit("T"), F.col("id") - 1)).alias("base_fqn"), F.when(F.col("id") % 4000 == 0, F.col("id")).alias("route"))
    got = endpoints.along_bases(rows, "route")
    assert got.count() == n and got.filter("route <> int(int(substring(fqn, 2)) / 4000) * 4000").isEmpty()
    methods = rows.select("fqn", F.coalesce("base_fqn", F.lit("System.Object.M()")).alias("overridden_fqn"))
    assert [tuple(r) for r in endpoints.override_roots(methods).groupBy("root").count().collect()] == [("System.Object.M()", n)]
    ring = spark.createDataFrame([("A", "B", 1), ("B", "A", 2)], "fqn string, base_fqn string, v int")
    with pytest.raises(ValueError, match="comes back"):
        endpoints.along_bases(ring, "v")
