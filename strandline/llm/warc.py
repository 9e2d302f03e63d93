"""Not-modified revisits of web captures: the full response that a 304 stands for, found by an as-of join.

Records are rows (record_id, uri, date, kind response or revisit, status, headers, body). A revisit takes the latest response with status
200 of the same canonical URL that is not later than it. The join never gathers a URL: records of one moment are combined first, time is cut into
spans, the last response of each (URL, span) is one map-side combined aggregate, a window carries it over the spans of a URL (at most SPANS
rows), and only distinct moments of one URL and span are ordered together. Validators must agree: the entity tag if the revisit has one (compared weakly), else
its Last-Modified; a revisit without validators is taken on trust. The merged headers are the response's, updated by those that a 304 may
carry. Bodies move once, joined by record id.

Defined cases: null URLs, dates and headers resolve nothing; a response of the same moment counts as earlier, and of several the one with the largest record id; a
revisit earlier than all responses is an orphan; records with one id are one record (the least by date, kind, status, URL and headers), so repeated
rows change nothing; a response without id can't be referred to and answers nothing, revisits without id stay rows of their own; empty tables
give empty results; bodies of any length are only moved; clashing columns don't matter.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPANS = 512
# Headers that a 304 response may update, and query parameters that don't name a document.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

RECORD = "record_id string, uri string, date timestamp, kind string, status int, headers map<string,string>, body binary"


def canonical(url: Column) -> Column:
    """Scheme dropped, host lower-cased without www. and default port, no fragment, tracking or trailing slash, parameters sorted. Null for what isn't an absolute URL."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def distinct_records(records: DataFrame) -> DataFrame:
    """One row of each record id; rows without one stay. Bodies aren't read."""
    columns = ["uri", "date", "kind", "status", "headers"]
    order = F.struct("date", "kind", "status", "uri", header_text(F.col("headers")).alias("h"))
    known = records.filter(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.min_by(F.struct(*columns), order).alias("r")).select("record_id", *[F.col("r")[c].alias(c) for c in columns])
    return known.unionByName(records.filter(F.col("record_id").isNull()).select("record_id", *columns))


def resolved(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, response_id, outcome (resolved, trusted, mismatch, orphan), headers."""
    r = distinct_records(records).select("record_id", canonical(F.col("uri")).alias("u"), F.unix_micros(F.col("date").cast("timestamp")).alias("t"), "kind", "status", "headers")
    ends = r.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    a, width = ends["a"] or 0, max(((ends["b"] or 0) - (ends["a"] or 0)) // SPANS + 1, 1)
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    rows = r.filter(full | (F.col("kind") == "revisit")).filter(F.col("u").isNotNull() & F.col("t").isNotNull())
    rows = rows.withColumn("span", F.floor((F.col("t") - F.lit(a)) / F.lit(width)).cast("int"))
    moments = rows.groupBy("u", "span", "t").agg(F.max(F.when(full, F.col("record_id"))).alias("rid"), F.max(F.col("kind") == "revisit").alias("asked"))
    answer = F.when(F.col("rid").isNotNull(), F.struct("t", F.col("rid").alias("record_id")))
    last = moments.filter("rid is not null or asked").groupBy("u", "span").agg(F.max(answer).alias("last"))
    before = Window.partitionBy("u").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = last.withColumn("earlier", F.max("last").over(before)).select("u", "span", "earlier")
    inside = Window.partitionBy("u", "span").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = moments.withColumn("near", F.max(answer).over(inside)).filter("asked")
    picks = near.join(earlier, ["u", "span"], "left").select("u", "t", F.coalesce("near", "earlier").alias("pick"))
    revisits = rows.filter(F.col("kind") == "revisit").select("record_id", "u", "t", F.col("headers").alias("h"))
    found = revisits.join(picks, ["u", "t"], "left")
    responses = rows.filter(full).select(F.col("record_id").alias("response_id"), F.col("headers").alias("rh"))
    out = found.withColumn("response_id", F.col("pick.record_id")).join(responses, "response_id", "left")
    etag, rtag = weak(F.col("h")["etag"]), weak(F.col("rh")["etag"])
    since, rsince = F.col("h")["last-modified"], F.col("rh")["last-modified"]
    outcome = (
        F.when(F.col("response_id").isNull(), "orphan")
        .when(etag.isNotNull(), F.when(etag.eqNullSafe(rtag), "resolved").otherwise("mismatch"))
        .when(since.isNotNull(), F.when(since.eqNullSafe(rsince), "resolved").otherwise("mismatch"))
        .otherwise("trusted")
    )
    ok = F.col("outcome").isin("resolved", "trusted")
    none = F.create_map().cast("map<string,string>")
    update = F.map_filter(F.coalesce("h", none), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(F.coalesce("rh", none), lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    odd = r.filter((F.col("kind") == "revisit") & (F.col("u").isNull() | F.col("t").isNull())).select("record_id", F.col("u").alias("canonical_url"), F.lit(None).cast(records.schema["record_id"].dataType).alias("response_id"), F.lit("orphan").alias("outcome"), F.lit(None).cast("map<string,string>").alias("headers"))
    got = out.withColumn("outcome", outcome).select("record_id", F.col("u").alias("canonical_url"), F.when(ok, F.col("response_id")).alias("response_id"), "outcome", F.when(ok, merged).alias("headers"))
    return got.unionByName(odd)


def header_text(headers: Column) -> Column:
    """Lines 'name: value' by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def with_bodies(found: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the body of their response."""
    bodies = records.filter(F.col("record_id").isNotNull()).groupBy(F.col("record_id").alias("response_id")).agg(F.min("body").alias("body"))
    return found.join(bodies, "response_id", "left")


# ---- files ---------------------------------------------------------------------------------------------------


def parse(data: bytes) -> Iterator[tuple]:
    """Records of a WARC file's bytes, plain or gzip by member: (record_id, uri, date, kind, status, headers, body)."""
    from datetime import datetime

    f = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    with f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            head: dict[str, str] = {}
            while (line := f.readline().strip()) != b"":
                k, _, v = line.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            block = f.read(int(head.get("content-length", 0)))
            kind = head.get("warc-type", "")
            status, headers, body = None, {}, block
            if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
                top, _, body = block.partition(b"\r\n\r\n")
                lines = top.decode("latin-1").split("\r\n")
                code = lines[0].split(" ")[1:2]
                status = int(code[0]) if code and code[0].isdigit() else None
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            try:
                date = datetime.fromisoformat(head.get("warc-date", "").replace("Z", "+00:00"))
            except ValueError:
                date = None
            yield head.get("warc-record-id"), head.get("warc-target-uri", "").strip("<>") or None, date, kind, status, headers, body


def render(record_id: str, uri: str, date: str, kind: str, status: int, headers: dict[str, str], body: bytes) -> bytes:
    """One gzip member; parse() reads it back."""
    http = f"HTTP/1.1 {status} X\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nContent-Length: {len(http)}\r\n\r\n"
    return gzip.compress(head.encode() + http + b"\r\n\r\n", mtime=0)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; a file is one task's work, as gzip can't be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import BinaryType, IntegerType, MapType, StringType, StructType, TimestampType

        shape = StructType().add("record_id", StringType()).add("uri", StringType()).add("date", TimestampType()).add("kind", StringType()).add("status", IntegerType()).add("headers", MapType(StringType(), StringType())).add("body", BinaryType())
        schema = to_arrow_schema(shape)
        for b in batches:
            for data in b.column("content").to_pylist():
                rows: list[tuple] = []
                for row in parse(data):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


# ---- query ---------------------------------------------------------------------------------------------------


def captures(pages: DataFrame, every: int = 3) -> DataFrame:
    """Capture records of a table of pages: each page is a response, and one in `every` has a later or (every seventh of these) much earlier revisit.
    A page without an id has no moment, so it is a response without a date and is never revisited."""
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    when = F.lit(1_700_000_000) + (p * 7919) % 1_000_000
    common = lambda c, d, t: [F.lit("cache-control"), c, F.lit("date"), d.cast("string"), F.lit("etag"), t]
    full = pages.select((p * 2).alias("record_id"), F.col("url").alias("uri"), F.timestamp_seconds(when).alias("date"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html"), *common(F.lit("max-age=60"), when, tag)).alias("headers"), F.col("html").cast("binary").alias("body"))
    later = when + F.when(p % 7 == 0, -900_000).otherwise(86_400)
    sent = F.when(p % 15 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    age = F.concat(F.lit("max-age="), (p % 100).cast("string"))
    again = pages.filter(p % every == 0).select((p * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("uri"), F.timestamp_seconds(later).alias("date"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.create_map(F.lit("set-cookie"), F.lit("x=1"), *common(age, later, sent)).alias("headers"), F.lit(None).cast("binary").alias("body"))
    return full.unionByName(again)


def op9(pages: DataFrame, every: int = 3) -> DataFrame:
    """Revisits of the pages table with their merged headers and the digest of the body they stand for."""
    records = captures(pages, every)
    bodies = pages.select((F.col("page_id") * 2).alias("response_id"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("body_sha256"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n_bytes")).filter("response_id is not null")
    bodies = bodies.groupBy("response_id").agg(F.min(F.struct("body_sha256", "n_bytes")).alias("b")).select("response_id", "b.*")
    found = resolved(records).join(bodies, "response_id", "left")
    return found.select("record_id", "canonical_url", "response_id", "outcome", header_text(F.col("headers")).alias("headers"), "body_sha256", "n_bytes")


ORACLE_OP9 = r"""with x as (select *, '"' || md5(coalesce(html, '')) || '"' as tag, 1700000000 + (page_id * 7919) % 1000000 as t from pages),
r as (select page_id * 2 as record_id, url as uri, t, 'response' as kind, 'max-age=60' as age, tag from x
 union all select page_id * 2 + 1, regexp_replace(url, '#.*$', '') || '#again', t + case when page_id % 7 = 0 then -900000 else 86400 end, 'revisit', 'max-age=' || (page_id % 100), case when page_id % 15 = 0 then '"other"' else 'W/' || tag end from x where page_id % 3 = 0),
c as (select *, regexp_replace(regexp_replace(lower(regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '') as host,
 regexp_replace(regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path,
 array_to_string(list_sort(list_filter(string_split(regexp_extract(uri, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' and not regexp_matches(q, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') as query from r),
u as (select record_id, t, kind, age, tag, case when host <> '' then host || path || case when query <> '' then '?' || query else '' end end as canonical_url from c),
v as (select v.*, p.record_id as rid, p.tag as rtag from u v asof left join (select *, t as rt from u where kind = 'response' qualify row_number() over (partition by canonical_url, t order by record_id desc) = 1) p on p.canonical_url = v.canonical_url and v.t >= p.rt where v.kind = 'revisit'),
o as (select *, case when rid is null then 'orphan' when regexp_replace(tag, '^W/', '') = rtag then 'resolved' else 'mismatch' end as outcome from v)
select record_id, canonical_url, case when outcome = 'resolved' then rid end as response_id, outcome,
 case when outcome = 'resolved' then 'cache-control: ' || age || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || t || chr(10) || 'etag: ' || tag end as headers,
 case when outcome = 'resolved' then sha256(coalesce(html, '')) end as body_sha256, case when outcome = 'resolved' then octet_length(encode(coalesce(html, ''))) end as n_bytes
from o left join pages on page_id * 2 = rid"""
#: The same with a revisit of every page.
ORACLE_OP9_ALL = ORACLE_OP9.replace("where page_id % 3 = 0", "where page_id is not null")
