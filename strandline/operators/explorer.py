"""Explorer queries over the catalog: lists, lookups and one-hop navigation, for one key or for all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import schema
from strandline.functions import text as X
from strandline.operators import resolve

SYMBOL_COLUMNS = ("id", "kind", "name", "fqn", "display", "project_id", "namespace", "container_fqn", "file_path", "line", "start_column", "accessibility")


def with_project(rows: DataFrame, projects: DataFrame, out: str = "project") -> DataFrame:
    """Project name by id, null where there is none. Projects are few; the optimizer broadcasts them while they are below its threshold."""
    return rows.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias(out)), "project_id", "left")


def symbol_rows(symbols: DataFrame, projects: DataFrame) -> DataFrame:
    return with_project(symbols, projects).select(*SYMBOL_COLUMNS, "project")


def projects_with_counts(projects: DataFrame, symbols: DataFrame) -> DataFrame:
    counts = symbols.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("symbol_count"))
    return projects.join(counts, "id", "left").withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0).cast("long"))).orderBy(*project_order())


def project_order() -> tuple:
    return (X.nocase("name"), "id")


def scoped(projects: DataFrame, name: str | None) -> DataFrame:
    return projects if name is None else projects.filter(F.col("name") == name)


def namespaces(symbols: DataFrame, project_id: int | None = None, ordered: bool = True) -> DataFrame:
    """Distinct namespaces of top-level types; no namespace is the empty string and sorts first."""
    rows = symbols.filter((F.col("kind") != "Namespace") & F.col("container_fqn").isNull())
    if project_id is not None:
        rows = rows.filter(F.col("project_id") == project_id)
    got = rows.select("project_id", F.coalesce("namespace", F.lit("")).alias("namespace")).distinct()
    return got.orderBy(*namespace_order()) if ordered else got


def namespace_order() -> tuple:
    return ("project_id", X.nocase("namespace"), "namespace")


def types(symbols: DataFrame, project_id: int | None = None, namespace: str | None = None, ordered: bool = True) -> DataFrame:
    rows = symbols.filter((F.col("kind") != "Namespace") & F.col("container_fqn").isNull())
    if project_id is not None:
        rows = rows.filter(F.col("project_id") == project_id)
    if namespace is not None:
        rows = rows.filter(F.coalesce("namespace", F.lit("")) == namespace)
    return rows.orderBy(X.nocase("name"), "fqn", "id") if ordered else rows


def members(symbols: DataFrame, container_fqn: str | None = None, ordered: bool = True) -> DataFrame:
    """Members of a container in all projects, of all containers if none is given."""
    rows = symbols.filter(F.col("container_fqn").isNotNull() if container_fqn is None else F.col("container_fqn") == container_fqn)
    return rows.orderBy(*member_order()) if ordered else rows


def member_order() -> tuple:
    return ("kind", X.nocase("name"), "fqn", "id")


def numbered_members(symbols: DataFrame, out: str = "seq") -> DataFrame:
    """Members of all containers with their place in their container's list."""
    w = Window.partitionBy("container_fqn").orderBy(*member_order())
    return members(symbols, ordered=False).withColumn(out, F.row_number().over(w).cast("long"))


def symbol_by_id(symbols: DataFrame, symbol_id: int) -> DataFrame:
    return symbols.filter(F.col("id") == symbol_id).limit(1)


def hops(relations: DataFrame, symbols: DataFrame, kinds: tuple[str, ...], forward: bool, start: list[int] | None = None, ordered: bool = True) -> DataFrame:
    """One hop from each start symbol (all if none are given): distinct indexed symbols at the other end."""
    a, b = ("source_symbol_id", "target_symbol_id") if forward else ("target_symbol_id", "source_symbol_id")
    edges = relations.filter(F.col("kind").isin(*kinds) & F.col(a).isNotNull() & F.col(b).isNotNull())
    if start is not None:
        edges = edges.filter(F.col(a).isin(*start) if start else F.lit(False))
    pairs = edges.select(F.col(a).alias("start_id"), F.col(b).alias("id")).distinct()
    rows = pairs.join(symbols, "id")
    return rows.orderBy("start_id", X.nocase("display"), "fqn", "id") if ordered else rows


def callees(relations: DataFrame, symbols: DataFrame, start: list[int] | None = None, ordered: bool = True) -> DataFrame:
    return hops(relations, symbols, ("Calls",), True, start, ordered)


def implementations(relations: DataFrame, symbols: DataFrame, start: list[int] | None = None, ordered: bool = True) -> DataFrame:
    return hops(relations, symbols, ("Implements", "Overrides"), False, start, ordered)


def tree(projects: DataFrame, symbols: DataFrame) -> DataFrame:
    """The whole tree: (level, parent, name, id, kind): projects, namespaces, top-level types, then members of members.
    Each level is one join on container_fqn; it ends at the first empty level, and raises where containers hold each other."""
    p = projects.select(F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent"), "name", "id", F.lit("Project").alias("kind"))
    ns = with_project(namespaces(symbols, ordered=False), projects).select(F.lit(1).alias("level"), F.col("project").alias("parent"), F.col("namespace").alias("name"), F.lit(None).cast("long").alias("id"), F.lit("Namespace").alias("kind"))
    level = types(symbols, ordered=False).select("id", "fqn", "name", "kind", F.coalesce("namespace", F.lit("")).alias("parent"), F.array("fqn").alias("above"))
    out, depth = p.unionByName(ns), 2
    inner = symbols.filter(F.col("container_fqn").isNotNull()).select("id", "fqn", "name", "kind", "container_fqn")
    while True:
        out = out.unionByName(level.select(F.lit(depth).alias("level"), "parent", "name", "id", "kind"))
        holders = level.filter(F.col("kind").isin(*schema.TYPE_KINDS)).groupBy(F.col("fqn").alias("container_fqn")).agg(F.first("above").alias("above"))
        step = inner.join(holders, "container_fqn")
        again = F.raise_error(F.concat(F.lit("containers hold each other: "), F.col("fqn")))
        level = step.select("id", F.when(F.array_contains("above", F.col("fqn")) & F.col("kind").isin(*schema.TYPE_KINDS), again).otherwise(F.col("fqn")).alias("fqn"), "name", "kind", F.col("container_fqn").alias("parent"), F.concat("above", F.array("fqn")).alias("above"))
        depth += 1
        if depth > 5:  # usual nesting is shallow; deeper levels don't compute the ones above again
            level = resolve.cut(level)
        if level.isEmpty():
            return out


def retained(selected: DataFrame, filtered: DataFrame) -> DataFrame:
    """Selected endpoints that the filtered list still has."""
    return selected.join(filtered.select("id"), "id", "left_semi")


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def totals(projects: DataFrame, symbols: DataFrame, endpoints: DataFrame) -> DataFrame:
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, rows in (("projects", projects), ("symbols", symbols), ("endpoints", endpoints))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def matches(text: str | None, *columns: str) -> Column:
    """True if the trimmed text is empty or part of any column, ignoring case."""
    part = (text or "").strip()
    if not part:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | X.contains_ignoring_case(F.col(c), F.lit(part))
    return out
