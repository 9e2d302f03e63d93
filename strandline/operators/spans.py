"""Which declaration a place in a document stands in, from source spans alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline import shared

#: Starts, ends and points of a stretch, about.
STRETCH = 200_000


def enclosing_spans(spans: DataFrame, points: DataFrame) -> DataFrame:
    """points (document, at, and any other columns) with source_fqn: the innermost declaration with an indexed name around each; points outside all of
    them drop out.

    spans: (document, start, end, ord, symbol_fqn, associated_fqn), end excluded. A span's name is its own symbol, else the one it belongs to (an
    accessor's property); a span with neither (a local function) leaves its places to the span around it. Of equal spans the one of greater ord is the
    inner one; empty spans hold nothing; nulls in document, start, end or at never match.

    Starts, ends and points are put in order once, by document and place, and written in stretches of about STRETCH rows, so neither a long document nor a
    place with many points is one task's. A span that is open where a stretch begins is opened there again, outer ones first; these are as many as spans are
    nested. The number of open spans after each row of a stretch is its level; the innermost span open at a point is the last one that was opened at the
    point's level, so a second window by (stretch, document, level) finds it, at any depth of nesting and without links to parents. Spans that cross raise."""
    known = spans.select("document", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("ord").cast("long").alias("ord"), F.coalesce("symbol_fqn", "associated_fqn").alias("name"))
    known = known.filter(F.col("name").isNotNull() & F.col("document").isNotNull() & (F.col("end") > F.col("start")))
    zero, own, payload = F.lit(0).cast("long"), F.struct("start", "end", "ord", "name"), F.struct(*points.columns)
    nothing = F.lit(None).cast(points.select(payload.alias("p")).schema["p"].dataType)
    no_span = F.lit(None).cast(known.select(own.alias("s")).schema["s"].dataType)
    shape = lambda rows, at, phase, t1, t2, step, span, point: rows.select("document", at.cast("long").alias("at"), F.lit(phase).alias("phase"), t1.alias("t1"), t2.alias("t2"), F.lit(step).alias("step"), span.alias("span"), point.alias("point"))
    # at one place spans end before others start, inner ones first; then outer ones start before inner ones; then come points
    rows = shape(known, F.col("end"), 0, -F.col("start"), -F.col("ord"), -1, own, nothing)
    rows = rows.unionByName(shape(known, F.col("start"), 1, -F.col("end"), F.col("ord"), 1, own, nothing))
    rows = rows.unionByName(shape(points.filter(F.col("document").isNotNull() & F.col("at").isNotNull()), F.col("at"), 2, zero, zero, 0, no_span, payload))
    key = ("document", "at", "phase", "t1", "t2")
    total = rows.count()
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // STRETCH))
    plain = [f"point.`{c}`" for c, kind in points.dtypes if "map<" not in kind]
    # a point's hash is the last part of the range, so many points at one place still spread
    ranged = rows.withColumn("h", F.when(F.col("phase") == 2, F.xxhash64(*plain))).repartitionByRange(n, *key, "h").drop("h")
    rows = shared.written(ranged.withColumn("stretch", F.spark_partition_id()), "spans")
    at = F.struct(*key)
    ends = rows.groupBy("stretch").agg(F.min(at).alias("low"), F.max(at).alias("high"))  # one row a stretch
    closing = F.struct("document", F.col("span.end").alias("at"), F.lit(0).alias("phase"), (-F.col("span.start")).alias("t1"), (-F.col("span.ord")).alias("t2"))
    leaving = rows.filter("phase = 1").join(F.broadcast(ends.select("stretch", "high")), "stretch").withColumn("closing", closing).filter(F.col("closing") > F.col("high"))
    later = F.broadcast(ends.select(F.col("stretch").alias("into"), "low"))
    opened = leaving.join(later, (F.col("into") > F.col("stretch")) & (F.col("low") <= F.col("closing"))).withColumn("stretch", F.col("into"))
    # opened again before all else, in the order of their starts
    rows = rows.withColumn("again", F.lit(1)).unionByName(opened.select(*rows.columns, F.lit(0).alias("again"))).repartition(n, "stretch")
    order = ("again", "at", "phase", "t1", "t2")
    so_far = lambda *by: Window.partitionBy("stretch", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", F.sum("step").over(so_far("document")) + F.when(F.col("phase") == 0, 1).otherwise(0))
    rows = rows.withColumn("inner", F.last(F.when(F.col("phase") == 1, F.col("span")), ignorenulls=True).over(so_far("document", "level")))
    crossed = (F.col("phase") == 0) & ~F.col("span").eqNullSafe(F.col("inner"))
    kept = F.when(crossed, F.raise_error(F.concat(F.lit("spans cross in "), F.col("document"))).cast("boolean")).otherwise((F.col("phase") == 2) & (F.col("level") > 0))
    return rows.filter(kept).select("point.*", F.col("inner.name").alias("source_fqn"))


def attributed(sites: DataFrame, spans: DataFrame) -> DataFrame:
    """Calls (project, source_fqn, ord, exact_fqn, candidate_fqns) from call sites (project, document, at, ord, exact_fqn, candidate_fqns); a site outside all spans has no caller and drops out."""
    return enclosing_spans(spans, sites).select("project", "source_fqn", "ord", "exact_fqn", "candidate_fqns")
