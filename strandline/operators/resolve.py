"""From names to identities: staged edges, handlers and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline import shared


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: written to the shared folder and read back."""
    return shared.written(df, "cut")


def first_wins(staged: DataFrame, keys: tuple[str, ...] = ("source_fqn", "kind", "target_fqn"), order: str = "ord") -> DataFrame:
    """One row per key: the first by `order`, with its own provenance. Partial aggregation instead of a window, so a hot key isn't gathered."""
    rest = [c for c in staged.columns if c not in keys]
    best = staged.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return best.select(*keys, "r.*")


def ids_by_name(symbols: DataFrame) -> DataFrame:
    """(fqn, id): the least id of each name over all projects. Compute once and share."""
    return symbols.groupBy("fqn").agg(F.min("id").alias("id"))


def with_identity(rows: DataFrame, names: DataFrame, name_col: str, out: str) -> DataFrame:
    """Left join to the least id of a name; null where the name isn't indexed."""
    found = names.select(F.col("fqn").alias(name_col), F.col("id").alias(out))
    return rows.join(found, name_col, "left")


def merge_edges(staged: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges by source id. The source must be indexed in its own project (else the edge goes; duplicates fan out).
    Equal (source, kind, target, display) merge, Exact wins; then the least display of each (source, kind, target) stays with its provenance.
    Rows merge by name before they meet their sources, so a repeated edge of a repeated name gives each of its sources one row, not all of them."""
    by_name = staged.groupBy("project_id", "source_fqn", "kind", "target_fqn", "target_display").agg(F.bool_or(F.col("provenance") == "Exact").alias("exact"))
    sources = symbols.select(F.col("project_id"), F.col("fqn").alias("source_fqn"), F.col("id").alias("source_symbol_id"))
    by_display = (
        by_name.join(sources, ["source_fqn", "project_id"])
        .groupBy("source_symbol_id", "kind", "target_fqn", "target_display")
        .agg(F.bool_or("exact").alias("exact"))
    )
    return (
        by_display.groupBy("source_symbol_id", "kind", "target_fqn")
        .agg(F.min(F.struct("target_display", "exact")).alias("r"))
        .select("source_symbol_id", "kind", "target_fqn", "r.target_display", F.when(F.col("r.exact"), "Exact").otherwise("Inferred").alias("provenance"))
    )


def resolve_edges(staged: DataFrame, symbols: DataFrame) -> DataFrame:
    edges = with_identity(merge_edges(staged, symbols), ids_by_name(symbols), "target_fqn", "target_symbol_id")
    return edges.select("source_symbol_id", "kind", "target_symbol_id", "target_fqn", "target_display", "provenance")


def assign_ids(rows: DataFrame, *order, out: str = "id") -> DataFrame:
    """1..n by a total order, rows with equal keys in any order among themselves.

    The rows are range-partitioned by the key once and written with the number of their partition and their place in it. Everything after that reads
    the written table, so the counts that are summed up are counts of the very partitions that are numbered, whatever is sampled or lost and computed
    again. The other columns' hash is the last part of the range, so many rows with one key still spread over partitions."""
    plain = [c for c, kind in rows.dtypes if "map<" not in kind]
    keyed = rows.withColumns({"_k": F.struct(*order), "_h": F.xxhash64(*plain)})
    ranged = keyed.repartitionByRange("_k", "_h").sortWithinPartitions("_k", "_h").drop("_k", "_h")
    placed = shared.written(ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "numbered")
    counts = placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    # one row a partition
    offsets = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n") - F.col("first") + 1).alias("_add"))
    return placed.join(F.broadcast(offsets), "_p").withColumn(out, F.col("_i") + F.col("_add")).drop("_p", "_i", "_add")
