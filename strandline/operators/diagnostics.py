"""Diagnostics: reading with defaults, compile-error roll-up and containment of broken input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import schema
from strandline.functions import model as M


def listed(diagnostics: DataFrame) -> DataFrame:
    """In insertion order; an unknown severity reads as Info."""
    return diagnostics.select("id", M.defaulted(F.col("severity"), schema.SEVERITIES, "Info").alias("severity"), "project", "message").orderBy("id")


def compile_health(errors: DataFrame) -> DataFrame:
    """errors: (project, ord, error_id, message). One Warning row per project with errors: how many, how many are unresolved references, and the first."""
    missing = F.col("error_id").isin(*schema.UNRESOLVED_ERROR_IDS)
    per = errors.groupBy("project").agg(
        F.count("*").alias("errors"),
        F.count_if(missing).alias("unresolved"),
        F.coalesce(F.min_by(F.when(missing, F.col("message")), F.when(missing, F.col("ord"))), F.min_by("message", "ord")).alias("example"),
    )
    n, u = F.col("errors").cast("string"), F.col("unresolved").cast("string")
    lost = F.concat(n, F.lit(" compilation error(s), among them "), u, F.lit(" unresolved reference(s), such as: "), F.col("example"), F.lit(". Endpoints and relations of this project are under-reported."))
    partly = F.concat(n, F.lit(" compilation error(s); the project is analysed in part. First: "), F.col("example"))
    return per.select("project", F.lit("Warning").alias("severity"), "errors", "unresolved", "example", F.when(F.col("unresolved") > 0, lost).otherwise(partly).alias("message"))


def load_problems(problems: DataFrame) -> DataFrame:
    """problems: (kind, message) of opening a workspace: a Failure is an Error, anything else a Warning."""
    return problems.select(F.when(F.col("kind") == "Failure", "Error").otherwise("Warning").alias("severity"), F.lit(None).cast("string").alias("project"), "message")


def failed_projects(projects: DataFrame) -> DataFrame:
    """projects: (project, status, message), status ok, failed (no project row) or unloaded (row with loaded false): their Error rows."""
    return projects.filter(F.col("status") != "ok").select(F.lit("Error").alias("severity"), "project", "message")


def failed_documents(documents: DataFrame) -> DataFrame:
    """documents: (project, document, error?): a Warning for each that failed; the project stays."""
    text = F.concat(F.lit("Skipped "), F.col("document"), F.lit(": "), F.col("error"))
    return documents.filter(F.col("error").isNotNull()).select(F.lit("Warning").alias("severity"), "project", text.alias("message"))


def no_projects(projects: DataFrame) -> DataFrame:
    """One Warning row if there are no projects, else none."""
    return projects.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("Warning").alias("severity"), F.lit(None).cast("string").alias("project"), F.lit("This workspace has no project that could be loaded.").alias("message"))
