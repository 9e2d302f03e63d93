"""Workspaces, source files and the recent list."""

from __future__ import annotations

import hashlib
import json
import os
import re
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import schema
from strandline.functions import text as X

# Extensions by rank, and folder names that are never entered.
EXTENSIONS = {".slnx": 0, ".sln": 1, ".csproj": 2}
PRUNED = ("bin", "obj", ".git", "node_modules", ".vs", ".idea")
SOLUTIONS = (0, 1)  # ranks
LISTERS = 16  # folders listed at the same time
LISTING = T.StructType().add("path", "string").add("is_dir", "boolean").add("depth", "integer")


def is_supported(path):
    return X.extension(path).isin(*EXTENSIONS)


def _place(spark: SparkSession, path: str):
    """(file system, path as given rows spell it): absolute, without a scheme where none was given. Any store that Hadoop reads."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = given.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(given)
    return fs, full.toString() if given.toUri().getScheme() else full.toUri().getPath()


def listing(spark: SparkSession, root: str, max_depth: int = schema.MAX_WORKSPACE_DEPTH) -> DataFrame:
    """(path, is_dir, depth) of the solutions, projects and folders at and below a folder of the shared file system, level by level.

    Folders are pruned before they are listed: none below a solution, none that is hidden or known to hold no sources, none deeper than max_depth.
    Those of one level are listed at the same time. What can't be listed, or isn't there, gives nothing."""
    try:
        fs, base = _place(spark, root)
    except Py4JJavaError:
        return spark.createDataFrame([], LISTING)
    made = spark._jvm.org.apache.hadoop.fs.Path

    def entries(folder: str) -> list[tuple[str, bool]]:
        try:
            found = [(f.getPath().getName(), f.isDirectory()) for f in fs.listStatus(made(folder))]
        except Py4JJavaError:
            return []
        return sorted((f"{folder.rstrip('/')}/{name}", is_dir) for name, is_dir in found if is_dir or _rank(name) is not None)

    rows: list[tuple[str, bool, int]] = []
    level, depth = [], 0
    if _listable(fs, made(base), "isDirectory"):
        level = [base]
    elif _listable(fs, made(base), "isFile"):
        rows.append((base, False, 0))
    with ThreadPoolExecutor(LISTERS) as pool:
        while level:
            below = []
            for found in pool.map(entries, level):
                rows += [(path, is_dir, depth) for path, is_dir in found]
                if depth < max_depth and not any(_rank(path) in SOLUTIONS for path, is_dir in found if not is_dir):
                    below += [path for path, is_dir in found if is_dir and not _is_pruned(path.rsplit("/", 1)[1])]
            level, depth = below, depth + 1
    return spark.createDataFrame(rows, LISTING)


def _listable(fs, path, test: str) -> bool:
    try:
        return getattr(fs, test)(path)
    except Py4JJavaError:
        return False


def _rank(path: str) -> int | None:
    return EXTENSIONS.get(os.path.splitext(path)[1].lower())


def _is_pruned(name: str) -> bool:
    return name.startswith(".") or name.lower() in PRUNED


def candidates(files: DataFrame, root: str) -> DataFrame:
    """Solutions and projects of a listing, best first: rank, depth, file name. Nothing below a folder that holds a solution, nor in pruned folders."""
    rel = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    segments = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    pruned = F.exists(segments, lambda s: F.lower(s).isin(*PRUNED) | s.startswith("."))
    found = files.filter(~F.col("is_dir") & is_supported(F.col("path"))).filter(~pruned | (F.col("depth") == 0))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rows = found.select("path", "depth", folder.alias("folder"), X.extension(F.col("path")).alias("ext"))
    rank = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.col("ext")]
    solved = rows.filter(F.col("ext") != ".csproj").select(F.col("folder").alias("above")).distinct()
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = rows.select("path", F.explode(up).alias("above")).filter(F.col("above") != F.regexp_replace("path", "/[^/]*$", "")).join(solved, "above", "left_semi").select("path").distinct()
    kept = rows.join(below, "path", "left_anti").withColumn("rank", rank)
    kind = F.when(F.col("ext") == ".csproj", "Project").otherwise("Solution")
    return kept.select("path", kind.alias("kind"), "rank", "depth").orderBy("rank", "depth", F.upper(X.basename(F.col("path"))), "path")


def find_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A file gives itself if supported, a folder its candidates, a missing path nothing."""
    try:
        fs, base = _place(spark, path)
    except Py4JJavaError:
        return candidates(spark.createDataFrame([], LISTING), "/")
    inside = _listable(fs, spark._jvm.org.apache.hadoop.fs.Path(base), "isDirectory")
    return candidates(listing(spark, path), base if inside else base.rsplit("/", 1)[0])


def resolve(spark: SparkSession, path: str) -> str | None:
    best = find_candidates(spark, path).limit(1).collect()
    return best[0]["path"] if best else None


def source_text(spark: SparkSession, path: str) -> str | None:
    """Whole text of one file; a comment above the size cap; None if missing or unreadable. Reads by Spark, so the path may be in any store."""
    try:
        rows = spark.read.format("binaryFile").load(path)
        big = F.col("length") > schema.SOURCE_FILE_CAP
        got = rows.select(F.when(big, F.concat(F.lit("// "), X.basename(F.col("path")), F.lit(" is too large to show ("), F.format_number(F.col("length") / 1024 / 1024, 1), F.lit(" MB)"))).otherwise(F.decode(F.when(~big, F.col("content")), "UTF-8")).alias("t")).limit(1).collect()
    except Exception as e:  # Spark reports missing and unreadable paths by several types
        if "PATH_NOT_FOUND" in str(e) or "Permission denied" in str(e):
            return None
        raise
    return got[0]["t"] if got else None


def recent(stored: DataFrame, existing: DataFrame, limit: int = schema.RECENT_LIMIT) -> DataFrame:
    """(pos, path) of JSON text rows (json): paths that exist, first `limit`. Text that isn't a list of strings gives nothing."""
    paths = stored.select(F.posexplode(F.from_json("json", "array<string>")).alias("pos", "path")).filter(F.col("path").isNotNull())
    return paths.join(existing, "path", "left_semi").orderBy("pos").limit(limit).select("pos", "path")


def add_recent(paths, path, limit: int = schema.RECENT_LIMIT):
    """Array column with `path` in front, without its other spellings by case, at most `limit` long."""
    rest = F.filter(paths, lambda x: F.upper(x) != F.upper(path))
    return F.slice(F.concat(F.array(path), rest), 1, limit)


class RecentList:
    """The recent list as a JSON file; errors of reading give an empty list, errors of writing are ignored."""

    def __init__(self, file: str):
        self.file = file

    def load(self) -> list[str]:
        try:
            with open(self.file, encoding="utf-8") as f:
                got = json.load(f)
        except (OSError, ValueError):
            return []
        return [p for p in got if isinstance(p, str) and os.path.exists(p)][: schema.RECENT_LIMIT] if isinstance(got, list) else []

    def add(self, path: str) -> list[str]:
        out = [path, *[p for p in self.load() if p.upper() != path.upper()]][: schema.RECENT_LIMIT]
        try:
            os.makedirs(os.path.dirname(self.file) or ".", exist_ok=True)
            with open(self.file, "w", encoding="utf-8") as f:
                json.dump(out, f)
        except OSError:
            pass
        return out


def catalog_path(folder: str, workspace: str) -> str:
    """Place of a workspace's catalog: its file stem and 16 hex digits of the full path's SHA-256."""
    full = os.path.abspath(workspace)
    name = re.sub(r"[/\x00]", "_", os.path.splitext(os.path.basename(full))[0]) or "workspace"
    return os.path.join(folder, f"{name}-{hashlib.sha256(full.encode()).hexdigest()[:16]}.db")


def catalog_name(path):
    """The same name as a column expression."""
    name = F.regexp_replace(X.stem(path), "[/\\x00]", "_")
    return F.concat(F.when(name == "", "workspace").otherwise(name), F.lit("-"), F.substring(F.sha2(path, 256), 1, 16), F.lit(".db"))
