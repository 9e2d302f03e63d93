"""From the facts of a compiler front end to a catalog: one set-oriented job for all projects.

What fails stays contained: a project that failed has no row and an Error, one that wasn't compiled has a row with loaded false and an Error, a
document that failed is a Warning and its project stays, compile errors are one Warning a project, and problems of opening the workspace are
Errors or Warnings without a project.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import diagnostics, endpoints, resolve, spans
from strandline.plans.catalog import LAYOUT, Catalog
from strandline.sources import facts as facts_source


def projects(raw: DataFrame) -> DataFrame:
    """(id, name, file_path, assembly_name, loaded) of projects that didn't fail, ids by upper-cased name."""
    rows = raw.filter(F.col("status") != "failed").select(F.col("project").alias("name"), "file_path", "assembly_name", (F.col("status") == "ok").alias("loaded"))
    return resolve.assign_ids(rows, F.upper("name"), "name")


def symbols(raw: DataFrame, project_rows: DataFrame) -> DataFrame:
    ids = project_rows.select(F.col("name").alias("project"), F.col("id").alias("project_id"))
    return endpoints.symbols_from_facts(facts_source.declared(raw)).join(ids, "project").drop("project", "ord")


def relations(facts: dict[str, DataFrame], symbol_rows: DataFrame, project_rows: DataFrame) -> DataFrame:
    """Staged edges: calls with their own project, implementations and overrides with those of their source symbol."""
    ids = project_rows.select(F.col("name").alias("project"), F.col("id").alias("project_id"))
    raw = facts["raw_calls"].unionByName(spans.attributed(facts["raw_call_sites"], facts["raw_declarations"]))
    calls = endpoints.call_edges(raw, symbol_rows).join(ids, "project")
    own = endpoints.implements_edges(facts["raw_implements"]).unionByName(endpoints.override_edges(facts["raw_methods"])).distinct()
    named = symbol_rows.groupBy(F.col("fqn").alias("target_fqn")).agg(F.min("display").alias("known"))
    of = symbol_rows.select(F.col("fqn").alias("source_fqn"), "project_id").distinct()
    own = own.join(of, "source_fqn").join(named, "target_fqn", "left").withColumn("target_display", F.coalesce("known", "target_fqn"))
    columns = ["project_id", "source_fqn", "kind", "target_fqn", "target_display", "provenance"]
    return calls.select(columns).unionByName(own.select(columns))


def endpoint_rows(facts: dict[str, DataFrame], symbol_rows: DataFrame, project_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endpoints, dependencies) of controllers and map calls; a controller's place is its handler's, a map call belongs to its document's project."""
    place = symbol_rows.groupBy(F.col("fqn").alias("handler_fqn")).agg(F.min_by(F.struct("project_id", "file_path", "line"), "id").alias("at"))
    by_type = endpoints.controller_endpoints(facts["raw_types"], facts["raw_methods"], facts["raw_attributes"]).join(place, "handler_fqn", "left")
    by_type = by_type.select(*[c for c in by_type.columns if c != "at"], F.col("at.project_id"), F.col("at.file_path"), F.col("at.line"), F.lit(None).cast("long").alias("call_id"))
    ids = project_rows.select(F.col("name").alias("project"), F.col("id").alias("project_id"))
    documents = facts["raw_documents"].join(ids, "project").groupBy("document").agg(F.min("project_id").alias("project_id"))
    where = facts["raw_map_calls"].select("call_id", "document").join(documents, "document", "left").select("call_id", "project_id", F.col("document").alias("file_path"))
    by_call = endpoints.map_call_endpoints(facts["raw_map_calls"], facts["raw_groups"], facts["raw_chain"], facts["raw_group_links"]).join(where, "call_id").withColumn("line", F.lit(None).cast("int"))
    both = by_type.unionByName(by_call.select(by_type.columns))
    return endpoints.with_dependencies(both, endpoints.inline_dependencies(facts["raw_parameters"], facts["raw_inline_calls"]))


def notes(facts: dict[str, DataFrame]) -> DataFrame:
    """Diagnostics of all kinds of contained failure, with their order: of opening the workspace, by project, and that there is none."""

    def part(rows: DataFrame, stage: int, kind: int) -> DataFrame:
        at = F.struct(F.lit(stage).alias("stage"), F.upper("project").alias("project"), F.lit(kind).alias("kind"), F.col("message").alias("message"))
        return rows.select("severity", "project", "message", at.alias("ord"))

    return (
        part(diagnostics.load_problems(facts["raw_problems"]), 0, 0)
        .unionByName(part(diagnostics.failed_projects(facts["raw_projects"]), 1, 0))
        .unionByName(part(diagnostics.failed_documents(facts["raw_documents"]), 1, 1))
        .unionByName(part(endpoints.overloaded_handlers(facts["raw_map_calls"], facts["raw_handlers"]), 1, 2))
        .unionByName(part(diagnostics.compile_health(facts["raw_errors"]), 1, 3))
        .unionByName(part(diagnostics.no_projects(facts["raw_projects"]), 2, 0))
    )


def build_from_facts(catalog: Catalog, source_path: str, facts: dict[str, DataFrame], progress: Callable | None = None) -> dict:
    """Builds and publishes a catalog from fact tables (schema.FACTS); gives its metadata.

    `progress` is called with (message, done, total): what is done are the written tables, two of facts and those of the catalog, each named with
    its rows once Spark has counted them while writing."""
    tell, total = progress or (lambda *_: None), 2 + len(LAYOUT)
    done = 0

    def written(table: str, rows: int) -> None:
        nonlocal done
        done += 1
        tell(f"Wrote {rows:,} row(s) of {table}.", done, total)

    with catalog.begin_rebuild() as session:
        tell("Reading projects...", done, total)
        project_rows = resolve.cut(projects(facts["raw_projects"]))  # ids are looked up from several sides
        done += 1
        tell("Reading symbols...", done, total)
        symbol_rows = resolve.cut(symbols(facts["raw_symbols"], project_rows))
        done += 1
        tell("Binding edges and endpoints...", done, total)
        rows, links = endpoint_rows(facts, symbol_rows, project_rows)
        session.add_projects(project_rows)
        session.add_symbols(symbol_rows)
        session.add_relations(relations(facts, symbol_rows, project_rows))
        session.add_endpoints(rows.drop("call_id"), links)
        session.add_diagnostics(notes(facts))
        session.complete(source_path, told=written)
    m = catalog.metadata()
    tell(f"Indexed {m['symbol_count']:,} symbols in {m['project_count']} project(s).", total, total)
    return m
