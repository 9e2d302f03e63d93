"""What the explorer shows: summaries, labels, glyphs and formatted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import text as X

# Glyph of each symbol kind.
GLYPHS = {
    "Namespace": "{}", "Class": "C", "Interface": "I", "Record": "R", "Struct": "S", "Enum": "E", "Delegate": "D",
    "Method": "M", "Constructor": "Ct", "Property": "P", "Field": "F", "Event": "Ev",
}


def lookup(values: dict[str, str], key: Column, default: str = "?") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


def glyph(kind: Column) -> Column:
    return lookup(GLYPHS, kind)


def authorization_summary(anonymous: Column, requires: Column, policies: Column, roles: Column) -> Column:
    return (
        F.when(anonymous, "Anonymous")
        .when(~requires, "")
        .when(F.size(policies) > 0, F.array_join(policies, ", "))
        .when(F.size(roles) > 0, F.array_join(roles, ", "))
        .otherwise("Authorized")
    )


def origin(path: Column, line: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(F.concat(X.basename(path), F.lit(":"), F.coalesce(line.cast("string"), F.lit("?"))))


def verb_class(method: Column) -> Column:
    return (
        F.when(method.isin("GET", "HEAD"), "get").when(method == "POST", "post").when(method.isin("PUT", "PATCH"), "put").when(method == "DELETE", "delete").otherwise("other")
    )


def gutter(depth: Column) -> Column:
    return (depth * 16 + 12).cast("long")


def step_container(container_fqn: Column, namespace: Column) -> Column:
    return F.coalesce(container_fqn, namespace, F.lit(""))


def step_relation(step_kind: Column) -> Column:
    return F.when(step_kind == "Implements", "implements").otherwise("")


def step_note(step_end: Column) -> Column:
    return F.when(step_end == "Repeated", "shown above").when(step_end == "Deeper", "continues deeper").otherwise("")


def trace_summary(count: Column, truncated: Column) -> Column:
    return (
        F.when(count == 0, "Nothing this endpoint reaches is declared in this solution.")
        .when(truncated, F.concat(F.lit("First "), count.cast("string"), F.lit(" steps; the flow is longer than that.")))
        .when(count == 1, "1 step")
        .otherwise(F.concat(count.cast("string"), F.lit(" steps")))
    )


def health(indexing: Column, failed: Column, has_index: Column, warnings: Column) -> Column:
    return F.when(indexing, "Indexing").when(failed, "Failed").when(~has_index, "None").when(warnings > 0, "Warnings").otherwise("Ready")


def health_text(state: Column) -> Column:
    return lookup({"Indexing": "Indexing…", "Failed": "Indexing failed", "Warnings": "Indexed with issues", "Ready": "Index up to date"}, state, "Not indexed")


def home_relative(path: Column, home: str) -> Column:
    base = home.rstrip("/")
    return F.when(path == base, "~").when(path.startswith(base + "/"), F.concat(F.lit("~"), F.substring(path, F.lit(len(base) + 1), F.length(path)))).otherwise(path)


def breadcrumb(path: Column, workspace: Column) -> Column:
    """Path relative to the workspace, unless it lies outside; segments joined by a chevron."""
    base = F.concat(F.rtrim(workspace, F.lit("/")), F.lit("/"))
    shown = F.when(workspace.isNotNull() & F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
    return F.array_join(F.split(shown, "/"), "  ›  ")


def local_time(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm")


def node_title(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "<global namespace>").otherwise(name)


def node_badge(count: Column) -> Column:
    return F.when(count > 0, F.format_number(count, 0)).otherwise("")


def editor_command(template: Column, path: Column, line: Column) -> Column:
    """{file} and {line} in a command; the file is appended where no placeholder names it."""
    placed = F.replace(F.replace(template, F.lit("{file}"), path), F.lit("{line}"), F.coalesce(line, F.lit(1)).cast("string"))
    return F.when(template.contains("{file}"), placed).otherwise(F.concat(placed, F.lit(" "), path))


def detail_rows(e) -> Column:
    """Eight label and value pairs of an endpoint row, in order."""
    pairs = [
        ("Method", e["http_method"]),
        ("Route", e["route"]),
        ("Handler", F.coalesce(e["handler_fqn"], F.lit("inline handler"))),
        ("Kind", F.when(e["kind"] == "ControllerAction", "Controller action").otherwise("Minimal API")),
        ("Project", F.coalesce(e["project"], F.lit("-"))),
        ("Source", F.coalesce(F.nullif(e["origin"], F.lit("")), F.lit("not located"))),
        ("Authorization", F.coalesce(F.nullif(e["auth"], F.lit("")), F.lit("none declared"))),
        ("Routing", F.when(e["provenance"] == "Exact", "resolved exactly").otherwise("partly inferred")),
    ]
    return F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(k).alias("label"), v.alias("value")) for i, (k, v) in enumerate(pairs, 1)])
