"""Bound facts of a compiler front end as tables: the input contract of the index build.

Binding of source text isn't done here; a front end writes these rows as Parquet or JSON, one table each (schema.FACTS).
"""

from __future__ import annotations

import functools
import operator
import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema, shared

# What a row of raw_projects may say.
STATUSES = ("ok", "failed", "unloaded")


def read(spark: SparkSession, folder: str, table: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema.FACTS[table]).format(fmt).load(f"{folder}/{table}")


def projects_in_order(raw_symbols: DataFrame) -> DataFrame:
    """Project names by upper-cased name; ids follow this order."""
    return raw_symbols.select("project").distinct().orderBy(F.upper("project"), "project")


def declared(raw_symbols: DataFrame) -> DataFrame:
    """Rows that the index takes: declared in source, not implicit."""
    return raw_symbols.filter(~F.coalesce("is_implicit", F.lit(False)) & (F.coalesce("in_source", F.lit(False)) | (F.col("kind_name") == "Namespace")))


def load(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All fact tables of a folder; one that isn't there is empty."""
    out = {}
    for table, shape in schema.FACTS.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        out[table] = read(spark, folder, table, fmt) if there else spark.createDataFrame([], shape)
    return out


def _readable(spark: SparkSession, folder: str, table: str, fmt: str) -> tuple[DataFrame, list[tuple[str | None, str]]]:
    """(rows with _of and _broken, lost files as (project, message)). The rows are written once; a file that ends the job is left out and the rest is read again."""
    shape = schema.FACTS[table]
    path, lost = f"{folder}/{table}", []
    reader = spark.read.format(fmt).option("basePath", path).option("mode", "PERMISSIVE")
    text = fmt == "json"
    wanted = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in shape)}{', _corrupt string' if text else ''}"
    if text:
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt")
    files = list(reader.schema(wanted).load(path).inputFiles())
    of = lambda f: urllib.parse.unquote(f.split("/project=")[1].split("/")[0]) if "/project=" in f else None
    empty = spark.createDataFrame([], shape).withColumns({"_of": F.lit(None).cast("string"), "_broken": F.lit(None).cast("string")})
    while files:
        rows = reader.schema(wanted).load(files)
        place = F.nullif(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "/project=([^/]+)/", 1)), F.lit(""))
        named = F.col("project") if "project" in shape.fieldNames() else F.lit(None).cast("string")
        broken = F.lit(None).cast("string")
        if text:
            inside = F.nullif(F.regexp_extract("_corrupt", r'"project"\s*:\s*"([^"]*)"', 1), F.lit(""))
            named, broken = F.coalesce(named, inside), F.when(F.col("_corrupt").isNotNull(), "a row can't be read")
        rows = rows.select(*shape.fieldNames(), F.coalesce(named, place).alias("_of"), broken.alias("_broken"))
        try:
            return shared.written(rows, f"facts-{table}"), lost
        except Exception as e:  # Spark reports unreadable files by several types; what names no file of ours isn't about one
            bad = [f for f in files if f.rsplit("/", 1)[1] in str(e)]
            if not bad:
                raise
            lost += [(of(f), f"{table}: {f.rsplit('/', 1)[1]} can't be read") for f in bad]
            files = [f for f in files if f not in bad]
    return empty, lost


def load_contained(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """As load, but a file that can't be read, a malformed row, a missing value or an unknown status costs its project and not the build.

    Files may lie in folders project=<name> below a table's; then all of a file's rows are that project's, also in tables without a project column.
    A project with broken input has no rows in any table and a raw_projects row with status failed and the reasons. What no project can be told for
    costs only the broken rows, and becomes a row of raw_problems."""
    tables, found = {}, []
    for table, shape in schema.FACTS.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            tables[table] = spark.createDataFrame([], shape)
            continue
        rows, lost = _readable(spark, folder, table, fmt)
        missing = functools.reduce(operator.or_, [F.col(f.name).isNull() for f in shape if not f.nullable])
        wrong = F.when(missing, "a value is missing")
        if table == "raw_projects":
            wrong = F.coalesce(wrong, F.when(~F.col("status").isin(*STATUSES), "the status is unknown"))
        tables[table] = rows.withColumn("_broken", F.coalesce("_broken", wrong))
        bad = tables[table].filter("_broken is not null").groupBy("_of", "_broken").agg(F.count("*").alias("n"))
        found.append(bad.select("_of", F.concat(F.lit(f"{table}: "), F.col("_broken"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("message")))
        if lost:
            found.append(spark.createDataFrame(lost, "_of string, message string"))
    if not found:
        return tables
    reasons = shared.written(functools.reduce(DataFrame.unionByName, found), "facts-broken")
    projects = reasons.filter("_of is not null").groupBy("_of").agg(F.array_join(F.sort_array(F.collect_set("message")), "; ").alias("message"))  # a few reasons a table
    for table, shape in schema.FACTS.items():
        if "_broken" in tables[table].columns:
            tables[table] = tables[table].filter("_broken is null").join(projects.select("_of"), "_of", "left_anti").select(*shape.fieldNames())
    failed = projects.select(F.col("_of").alias("project"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("assembly_name"), F.lit("failed").alias("status"), "message")
    tables["raw_projects"] = tables["raw_projects"].unionByName(failed)
    nobody = reasons.filter("_of is null").select(F.lit("Failure").alias("kind"), "message")
    tables["raw_problems"] = tables["raw_problems"].unionByName(nobody)
    return tables
