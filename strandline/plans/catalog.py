"""The stored catalog: versioned Parquet folders behind one small pointer, replaced as a whole.

`<root>/current.json` names the live version folder. A rebuild writes a new folder and swaps the pointer at the end, so readers keep what
they have, and a rebuild that is abandoned changes nothing. All files go through Hadoop's file system, so the root may be in any store.

Every change of the pointer has a number and is first put under `log/` with that number, by a rename that fails if the number is taken. A writer
that comes second reads what the first one wrote, makes its change to that and takes the next number, so of two writers neither loses anything.
Readers go on from `current.json` through later entries of the log, so a writer that stopped between the two has still published.

Tables are laid out for lookups by key (LAYOUT): range-clustered, with Bloom filters in the footers, in small row groups; edges are stored once by
each end. While a table is written its constraints are observed in the same pass; a violation ends the rebuild before the pointer moves.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from strandline import schema
from strandline.functions import text as X
from strandline.operators import resolve

#: Order in which a table is range-clustered, and its columns with Bloom filters.
LAYOUT = {
    "projects": (("id",), ()),
    "symbols": (("fqn", "project_id", "id"), ("id", "fqn", "container_fqn")),
    "relations": (("source_symbol_id", "kind", "target_fqn"), ("source_symbol_id", "target_symbol_id")),
    "relations_by_target": (("target_symbol_id", "kind", "source_symbol_id", "target_fqn"), ("target_symbol_id",)),
    "endpoints": (("route", "http_method", "id"), ("id", "handler_fqn")),
    "endpoint_dependencies": (("endpoint_id", "id"), ("endpoint_id",)),
    "diagnostics": (("id",), ()),
}
#: Tables that hold another one's rows in another order.
COPIES = {"relations_by_target": "relations"}
UNIQUE = {"relations": ("source_symbol_id", "kind", "target_fqn")}
VOCABULARY = {
    "symbols": {"kind": schema.SYMBOL_KINDS},
    "relations": {"kind": schema.RELATION_KINDS, "provenance": schema.PROVENANCES},
    "endpoints": {"kind": schema.ENDPOINT_KINDS, "provenance": schema.PROVENANCES},
}
REFERENCES = {"symbols": ("project_id", "projects"), "endpoints": ("project_id", "projects"), "endpoint_dependencies": ("endpoint_id", "endpoints")}
ROW_GROUP_BYTES = 8 << 20


class ConstraintError(ValueError):
    """Rows that the catalog may not hold."""


class Conflict(RuntimeError):
    """Another writer took the number of this change."""


class Store:
    """Small files and folders of one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def read(self, name: str) -> str | None:
        p = self.path(name)
        if not self.fs.exists(p):
            return None
        s = self.fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def replace(self, name: str, text: str) -> None:
        """Written beside, then renamed over: a reader sees the old or the new text. The rename is atomic where the store's is."""
        new = self.path(f".{name}.{uuid.uuid4().hex}")
        s = self.fs.create(new, True)
        try:
            s.write(bytearray(text.encode()))
        finally:
            s.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        array = self.jvm.java.lang.reflect.Array.newInstance(options.getClass(), 1)
        array[0] = options
        context.rename(new, self.path(name), array)

    def put_new(self, name: str, text: str) -> bool:
        """Written beside, then renamed to a name that mustn't be taken; False if it is."""
        target = self.path(name)
        if self.fs.exists(target):
            return False
        new = self.path(f".{name.replace('/', '-')}.{uuid.uuid4().hex}")
        s = self.fs.create(new, True)
        try:
            s.write(bytearray(text.encode()))
        finally:
            s.close()
        self.fs.mkdirs(target.getParent())
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE.getClass(), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(new, target, none)
        except Py4JJavaError as e:
            self.fs.delete(new, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Catalog:
    """An opened catalog. Without a usable version every table is empty."""

    POINTER = "current.json"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.refresh()

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Catalog:
        return cls(spark, root)

    def refresh(self) -> Catalog:
        """Looks up the live version; one of another schema version, or a pointer that can't be read, counts as none and is discarded."""
        text = self.store.read(self.POINTER)
        self.live = self._usable(text)
        if text is not None and self.live is None:
            self.store.delete("log")
            self.store.delete(self.POINTER)
            return self
        while (later := self.store.read(self._entry(self.number + 1))) is not None:
            found = self._usable(later)
            if found is None:
                break
            self.live = found
        return self

    @staticmethod
    def _usable(text: str | None) -> dict | None:
        try:
            pointer = json.loads(text) if text is not None else None
            return pointer if pointer and pointer["version"] == schema.VERSION else None
        except (ValueError, KeyError, TypeError):
            return None

    @property
    def number(self) -> int:
        """Changes so far."""
        return self.live.get("number", 0) if self.live else 0

    @staticmethod
    def _entry(number: int) -> str:
        return f"log/{number:012}.json"

    def commit(self, change: Callable[[dict | None], dict], tries: int = 20) -> Catalog:
        """Publishes change(live pointer); made anew on what another writer has published meanwhile. Raises Conflict after `tries`."""
        for _ in range(tries):
            pointer = change(json.loads(json.dumps(self.live)) if self.live else None) | {"number": self.number + 1}
            text = json.dumps(pointer)
            if self.store.put_new(self._entry(pointer["number"]), text):
                self.live = pointer
                self.store.replace(self.POINTER, text)
                return self
            self.refresh()
        raise Conflict(f"the catalog at {self.store.root} changed {tries} times meanwhile")

    def table(self, name: str) -> DataFrame:
        """One of schema.TABLES, or relations_by_target: the relations clustered by their other end."""
        shape = schema.TABLES[COPIES.get(name, name)]
        if self.live is None:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(f"{self.store.root}/{self.live['folder']}/{name}")

    def settings(self) -> dict[str, str]:
        return dict(self.live["settings"]) if self.live else {}

    def setting(self, key: str) -> str | None:
        return self.settings().get(key)

    def set_setting(self, key: str, value: str) -> None:
        """Insert or replace; settings that others write meanwhile stay."""

        def change(live: dict | None) -> dict:
            if live is None:
                raise ValueError("no live version")
            live["settings"][key] = value
            return live

        self.commit(change)

    def metadata(self) -> dict | None:
        """None unless the source path and a readable time of indexing are there."""
        s = self.settings()
        try:
            at = datetime.fromisoformat(s["indexed_at"])
            path = s["source_path"]
        except (KeyError, ValueError):
            return None
        return {"source_path": path, "indexed_at": at, **{f"{k}_count": self.live["counts"].get(t, 0) for k, t in (("project", "projects"), ("symbol", "symbols"), ("endpoint", "endpoints"))}}

    def has_usable_index_for(self, path: str) -> bool:
        m = self.metadata()
        return m is not None and m["source_path"].upper() == path.upper() and m["symbol_count"] > 0

    def begin_rebuild(self) -> Rebuild:
        return Rebuild(self)

    def collect_garbage(self) -> None:
        """Deletes version folders that aren't live, and entries of the log that `current.json` has; for after readers of older versions are done."""
        self.refresh()
        if self.live is not None:
            self.store.replace(self.POINTER, json.dumps(self.live))
        for f in self.store.fs.listStatus(self.store.path("")):
            name = f.getPath().getName()
            if name.startswith("v-") and (self.live is None or name != self.live["folder"]):
                self.store.delete(name)
        if self.live is not None and self.store.fs.exists(self.store.path("log")):
            for f in self.store.fs.listStatus(self.store.path("log")):
                name = f.getPath().getName()
                if name < self._entry(self.number).removeprefix("log/"):
                    self.store.delete(f"log/{name}")


class Rebuild:
    """A rebuild in progress: append tables, then complete() or abandon(). Leaving the `with` block without complete() abandons."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.folder = catalog, f"v-{uuid.uuid4().hex}"
        self.parts: dict[str, list[DataFrame]] = {}
        self.settings, self.at_begin = {}, catalog.settings()
        self.removed: DataFrame | None = None

    def __enter__(self) -> Rebuild:
        return self

    def __exit__(self, *_) -> None:
        if self.folder:
            self.abandon()

    def _add(self, table: str, rows: DataFrame) -> None:
        self.parts.setdefault(table, []).append(rows)

    def add_projects(self, rows: DataFrame) -> None:
        """(id, name, file_path, assembly_name, loaded); ids follow the order of upper-cased names where none are given."""
        self._add("projects", rows if "id" in rows.columns else resolve.assign_ids(rows, F.upper("name"), "name"))

    def add_symbols(self, rows: DataFrame) -> None:
        self._add("symbols", rows)

    def add_relations(self, rows: DataFrame) -> None:
        self._add("staged_relations", rows)

    def add_endpoints(self, rows: DataFrame, dependencies: DataFrame | None = None) -> None:
        self._add("endpoints", rows)
        if dependencies is not None:
            self._add("endpoint_dependencies", dependencies)

    def drop_endpoints(self, ids: DataFrame) -> None:
        """Endpoints with these ids (column id) go, and what depends on them goes with them."""
        ids = ids.select("id")
        self.removed = ids if self.removed is None else self.removed.unionByName(ids)

    def add_diagnostics(self, rows: DataFrame) -> None:
        """In the order of calls, in each by a column `ord` if there is one, else as the rows come."""
        n = len(self.parts.get("diagnostics", []))
        at = F.struct(F.lit(n).alias("call"), F.monotonically_increasing_id().alias("row"))
        self._add("diagnostics", rows.withColumn("_at", at))

    def set_setting(self, key: str, value: str) -> None:
        self.settings[key] = value

    def _all(self, table: str) -> DataFrame | None:
        parts = self.parts.get(table)
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _write(self, table: str, rows: DataFrame | None, numbered: bool = False) -> DataFrame:
        """Writes a table in its layout. Counts of what its constraints forbid are observed in the same pass."""
        spark, path, shape = self.catalog.spark, f"{self.catalog.store.root}/{self.folder}/{table}", schema.TABLES[COPIES.get(table, table)]
        empty = rows is None
        if empty:
            rows = spark.createDataFrame([], shape)
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
        bad: dict[str, Column] = {f"{f.name} is null": F.col(f.name).isNull() for f in shape if not f.nullable}
        for c, known in VOCABULARY.get(table, {}).items():
            bad[f"unknown {table.rstrip('s')} {c}"] = ~F.col(c).isin(*known)
        if table in REFERENCES:
            column, parent = REFERENCES[table]
            there = spark.read.schema(schema.TABLES[parent]).parquet(f"{self.catalog.store.root}/{self.folder}/{parent}").select(F.col("id").alias(column), F.lit(True).alias("_there"))
            rows = rows.join(there, column, "left")
            bad[f"{column} is no row of {parent}"] = F.col(column).isNotNull() & F.col("_there").isNull()
        order, filters = LAYOUT[table]
        rows = rows.coalesce(1) if empty else rows.repartitionByRange(*order).sortWithinPartitions(*order)
        if table in UNIQUE:
            # ranges of these very columns hold equal keys together, in order: no further shuffle or sort
            rows = rows.sortWithinPartitions(*UNIQUE[table], "id")
            rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*UNIQUE[table]).orderBy("id")))
            bad[f"repeated {', '.join(UNIQUE[table])}"] = F.col("_nth") > 1
        seen, i = Observation(), F.col("id").cast("decimal(19,0)")
        watched = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.sum(i).alias("sum"), F.sum(i * i).alias("squares"), *[F.count_if(x).alias(what) for what, x in bad.items()])
        writer = watched.select(*[f.name for f in shape]).write.option("parquet.block.size", ROW_GROUP_BYTES)
        for c in filters:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "50000")
        writer.parquet(path)
        got, out = seen.get, spark.read.schema(shape).parquet(path)
        n = got["n"]
        self.counts[table] = n
        self.told(table, n)
        broken = [f"{got[what]} row(s) of {table}: {what}" for what in bad if got[what]]
        whole = n == 0 or (got["least"], got["most"], got["sum"], got["squares"]) == (1, n, n * (n + 1) // 2, n * (n + 1) * (2 * n + 1) // 6)
        if numbered and not whole:
            broken.append(f"ids of {table} are not 1 to {n}")
        elif not whole and table not in COPIES and not out.groupBy("id").count().filter("count > 1").isEmpty():
            broken.append(f"repeated ids in {table}")  # only ids that aren't 1 to n are read again
        if broken:
            raise ConstraintError("; ".join(broken))
        return out

    def _same_number(self, what: str, before: DataFrame | int, after: str) -> None:
        n = before if isinstance(before, int) else before.count()
        if n != self.counts[after]:
            raise ConstraintError(f"{n} {what} came in, {self.counts[after]} rows of {after} were written")

    def complete(self, source_path: str, at: datetime | None = None, told: Callable[[str, int], None] | None = None) -> Catalog:
        """Resolves edges, handlers and dependencies against the written symbols, stamps metadata and makes the version live.
        `told` is called after each table of LAYOUT with its name and number of rows."""
        self.counts: dict[str, int] = {}
        self.told = told or (lambda *_: None)
        projects_in = self._all("projects")
        if projects_in is not None and "loaded" in projects_in.columns:
            projects_in = projects_in.withColumn("loaded", F.coalesce("loaded", F.lit(True)))
        self._write("projects", projects_in)
        symbols = self._write("symbols", self._all("symbols"))
        names = resolve.ids_by_name(symbols)
        staged = self._all("staged_relations")
        edges = None
        if staged is not None:
            edges = self._write("relations", resolve.assign_ids(resolve.resolve_edges(staged, symbols), "source_symbol_id", "kind", "target_fqn"), numbered=True)
        else:
            self._write("relations", None)
        self._write("relations_by_target", edges)
        self._same_number("relations", self.counts["relations"], "relations_by_target")
        endpoints = self._all("endpoints")
        if endpoints is not None:
            lists = {c: X.join_list(F.col(c)) for c in ("policies", "roles") if c in endpoints.columns and endpoints.schema[c].dataType.typeName() == "array"}
            endpoints = resolve.with_identity(endpoints.drop("handler_symbol_id").withColumns(lists), names, "handler_fqn", "handler_symbol_id")
            if self.removed is not None:
                endpoints = endpoints.join(self.removed, "id", "left_anti")
        self._write("endpoints", endpoints)
        links = self._all("endpoint_dependencies")
        own = links is not None and "id" in links.columns
        if links is not None:
            if self.removed is not None:
                links = links.join(self.removed.select(F.col("id").alias("endpoint_id")), "endpoint_id", "left_anti")
            if not own:
                links = resolve.assign_ids(links, "endpoint_id", "pos", "target_fqn")
            links = resolve.with_identity(links.drop("symbol_id"), names, "target_fqn", "symbol_id")
        self._write("endpoint_dependencies", links, numbered=links is not None and not own)
        notes = self._all("diagnostics")
        own = notes is not None and "id" in notes.columns
        if notes is not None and not own:
            order = [F.col("_at.call"), *([F.col("ord")] if "ord" in notes.columns else []), F.col("_at.row")]
            notes = resolve.assign_ids(resolve.cut(notes), *order)
        self._write("diagnostics", notes, numbered=notes is not None and not own)
        stamp = {"source_path": source_path, "indexed_at": (at or datetime.now(UTC)).isoformat()}
        counts = {t: self.counts[t] for t in ("projects", "symbols", "endpoints")}

        def change(live: dict | None) -> dict:
            # settings that were written while this rebuild ran stay
            since = {k: v for k, v in (live or {"settings": {}})["settings"].items() if self.at_begin.get(k) != v and k not in stamp}
            return {"version": schema.VERSION, "folder": self.folder, "settings": since | self.settings | stamp, "counts": counts}

        self.catalog.refresh().commit(change)
        self.folder = ""
        return self.catalog.refresh()

    def abandon(self) -> None:
        """The live version stays as it is."""
        if self.folder:
            self.catalog.store.delete(self.folder)
            self.folder = ""


def _unfit(loaded: dict[str, dict[str, DataFrame]]) -> dict[str, str]:
    """Projects whose rows hold a kind that the catalog doesn't know or lack a value it needs, with the reason; one job a table for all projects."""
    out: dict[str, list[str]] = {}
    for table in {t for data in loaded.values() for t in data}:
        shape = schema.TABLES.get(table, schema.STAGED_RELATIONS)
        words = VOCABULARY.get("relations" if table == "staged_relations" else table, {})
        parts = []
        for name, data in loaded.items():
            if table in data:
                rows = data[table]
                need = [F.when(F.col(f.name).isNull(), f"{f.name} is null") for f in shape if not f.nullable and f.name in rows.columns]
                known = [F.when(~F.col(c).isin(*values), F.concat(F.lit(f"unknown {c} "), F.col(c))) for c, values in words.items() if c in rows.columns]
                parts.append(rows.select(F.lit(name).alias("project"), F.coalesce(*need, *known, F.lit(None).cast("string")).alias("why")))
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        for r in both.filter("why is not null").groupBy("project").agg(F.count("*").alias("n"), F.min("why").alias("why")).collect():  # a row a project
            out.setdefault(r["project"], []).append(f"{r['n']} row(s) of {table}: {r['why']}")
    return {k: "; ".join(sorted(v)) for k, v in out.items()}


def build_index(catalog: Catalog, source_path: str, projects: list[str], load: Callable, progress: Callable | None = None) -> dict:
    """Builds a catalog from per-project fact tables. load(name) gives a dict of DataFrames (projects, symbols, staged_relations, endpoints,
    endpoint_dependencies, diagnostics); one that raises is skipped with an Error row and the others go on. Returns the metadata."""
    tell = progress or (lambda *_: None)
    spark = catalog.spark
    notes: list[tuple] = []
    loaded: dict[str, dict[str, DataFrame]] = {}
    with catalog.begin_rebuild() as session:
        for i, name in enumerate(projects):
            tell(f"Indexing {name}...", i, len(projects))
            try:
                data = load(name)
                for table, rows in data.items():
                    missing = {f.name for f in schema.TABLES.get(table, schema.STAGED_RELATIONS) if not f.nullable and f.name != "id"} - set(rows.columns)
                    if missing:
                        raise ValueError(f"{table} lacks {', '.join(sorted(missing))}")
            except Exception as e:  # one project's failure, of whatever kind, must not end the build
                notes.append(("Error", name, f"The project was skipped, as indexing it failed: {e}"))
                continue
            loaded[name] = data
        for name, why in _unfit(loaded).items():
            del loaded[name]
            notes.append(("Error", name, f"The project was skipped, as indexing it failed: {why}"))
        notes.sort(key=lambda x: projects.index(x[1]))
        for data in loaded.values():
            for table, rows in data.items():
                session._add(table, rows)
        if not projects:
            notes.append(("Warning", None, "This workspace has no project that could be loaded."))
        tell("Writing index...", len(projects), len(projects))
        if notes:
            session.add_diagnostics(spark.createDataFrame(notes, "severity string, project string, message string"))
        session.complete(source_path)
    m = catalog.metadata()
    tell(f"Indexed {m['symbol_count']:,} symbols in {m['project_count']} project(s).", len(projects), len(projects))
    return m
