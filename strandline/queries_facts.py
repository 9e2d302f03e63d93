"""Registered queries of the rules on compiler facts, which are made from the test tables; each SQL text states the result from these tables by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import queries
from strandline.functions import model as M
from strandline.functions import routes as R
from strandline.functions import text as X
from strandline.operators import diagnostics, endpoints, explorer, resolve, spans, trace
from strandline.queries import query

MVC, BASE = R.MVC_NAMESPACE, endpoints.CONTROLLER_BASES[0]


def null():
    return F.lit(None).cast("string")


def name(prefix: str, key, suffix: str = ""):
    return F.concat(F.lit(prefix), key.cast("string"), F.lit(suffix))


@query("facts_symbols", """
with r as (select case when p_partkey % 3 = 0 then 'beta' else 'Alpha' end as project, p_partkey as ord, p_partkey % 8 as k, p_name, p_partkey % 5 = 0 as implicit, p_partkey % 7 <> 0 as in_source, p_size from part),
k as (select *, case k when 0 then 'Namespace' when 1 then 'Record' when 2 then 'Struct' when 3 then 'Constructor' when 4 then 'Method' when 5 then 'Property' when 6 then 'Delegate' end as kind from r)
select row_number() over (order by upper(project), ord) as id, kind, concat('F', ord) as fqn, nullif(case when ord % 2 = 0 then '' else 'N' end, '') as namespace, p_size + 1 as line, case when kind <> 'Namespace' then 'Public' end as accessibility
from k where kind is not null and not implicit and (kind = 'Namespace' or in_source)""")
def facts_symbols(m):
    p = F.col("p_partkey")
    k = p % 8
    raw = m.raw("part").select(
        F.when(p % 3 == 0, "beta").otherwise("Alpha").alias("project"), p.alias("ord"),
        F.when(k == 0, "Namespace").when(k.isin(1, 2, 6, 7), "NamedType").when(k.isin(3, 4), "Method").otherwise("Property").alias("kind_name"),
        F.when(k.isin(1, 2), "Struct").when(k == 3, "StaticConstructor").when(k == 4, "Destructor").when(k == 6, "Delegate").when(k == 7, "Module").alias("type_kind"),
        (k == 1).alias("is_record"), (p % 5 == 0).alias("is_implicit"), (p % 7 != 0).alias("in_source"), F.col("p_name").alias("name"), name("F", p).alias("fqn"), F.col("p_name").alias("display"),
        F.when(p % 2 == 0, "").otherwise("N").alias("namespace"), null().alias("container_fqn"), null().alias("file_path"), F.col("p_size").cast("int").alias("line0"), F.lit(0).alias("column0"), F.lit("Public").alias("accessibility"),
    )
    return endpoints.symbols_from_facts(raw).select("id", "kind", "fqn", "namespace", "line", "accessibility")


@query("enclosing_members", "select c_custkey as node_id, concat('S', c_custkey - c_custkey % 150) as source_fqn from customer where c_custkey >= 150")
def enclosing_members(m):
    """Chains of 150 nodes; the first of each is a member, and the first chain has none."""
    c = F.col("c_custkey")
    spans = m.raw("customer").select(c.alias("node_id"), F.when(c % 150 != 0, c - 1).alias("parent_id"), F.when((c % 150 == 0) & (c > 0), name("S", c)).alias("symbol_fqn"))
    return endpoints.enclosing(spans)


@query("call_edges", """
with b as (select l_orderkey % 400 as s, l_orderkey * 8 + l_linenumber as ord, case when l_linenumber % 3 = 0 then l_suppkey when l_linenumber % 3 = 1 and l_suppkey % 2 = 0 then l_suppkey end as t, l_linenumber % 3 = 0 as exact from lineitem),
f as (select *, row_number() over (partition by s, t order by ord) as n from b where t is not null and t <> s and t % 6 < 2)
select concat('M', s) as source_fqn, concat('M', t) as target_fqn, concat('shown ', t) as target_display, case when exact then 'Exact' else 'Inferred' end as provenance from f where n = 1""")
def call_edges(m):
    """An exact target, one candidate (Inferred), or several (none); only methods and constructors are targets."""
    n, s = F.col("l_linenumber") % 3, F.col("l_suppkey")
    one = F.array(name("M", s))
    candidates = F.when((n == 1) & (s % 2 == 0), one).when(n == 1, F.concat(one, F.array(F.lit("M0")))).otherwise(F.array().cast("array<string>"))
    raw = m.raw("lineitem").select(F.lit("P").alias("project"), name("M", F.col("l_orderkey") % 400).alias("source_fqn"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.when(n == 0, name("M", s)).alias("exact_fqn"), candidates.alias("candidate_fqns"))
    k = F.col("s_suppkey") % 6
    targets = m.raw("supplier").select(F.when(k == 0, "Method").when(k == 1, "Constructor").otherwise("Property").alias("kind"), name("M", F.col("s_suppkey")).alias("fqn"), name("shown ", F.col("s_suppkey")).alias("display"))
    return endpoints.call_edges(raw, targets).select("source_fqn", "target_fqn", "target_display", "provenance")


@query("bound_targets", """
select l_orderkey * 8 + l_linenumber as id, l_partkey, case when l_returnflag = 'R' then l_linestatus when l_returnflag = 'A' then concat('only', l_suppkey) end as target, case when l_returnflag = 'R' then 'Exact' when l_returnflag = 'A' then 'Inferred' end as provenance from lineitem""")
def bound_targets(m):
    flag = F.col("l_returnflag")
    only = F.array(name("only", F.col("l_suppkey")))
    target, provenance = M.bind(F.when(flag == "R", F.col("l_linestatus")), F.when(flag == "A", only).when(flag == "R", only).otherwise(F.concat(only, F.array(F.lit("other")))))
    return m.raw("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_partkey", target.alias("target"), provenance.alias("provenance"))


@query("dispatch_edges", """
select concat('I', p_partkey) as source_fqn, 'Implements' as kind, concat('X', p_partkey % 10) as target_fqn from part where p_partkey % 4 = 0 and p_size % 2 = 0
union all select concat('I', p_partkey), 'Overrides', concat('B', p_partkey % 20) from part where p_partkey % 5 = 0""")
def dispatch_edges(m):
    p = F.col("p_partkey")
    pairs = m.raw("part").select(F.lit("T").alias("type_fqn"), name("X", p % 10).alias("interface_member_fqn"), name("I", p).alias("impl_fqn"), F.when(p % 4 == 0, "T").otherwise("Other").alias("impl_type_fqn"), (F.col("p_size") % 2 == 0).alias("impl_in_source"))
    methods = m.raw("part").select(name("I", p).alias("fqn"), F.when(p % 5 == 0, name("B", p % 20)).alias("overridden_fqn"))
    return endpoints.implements_edges(pairs).unionByName(endpoints.override_edges(methods)).drop("provenance")


def controller_facts(m) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers are types in chains of three below a framework base, parts their methods."""
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    cls = lambda k: name("App.C", k, "Controller")
    sup, n = m.raw("supplier"), m.raw("supplier").count()
    types = sup.select(cls(s).alias("fqn"), name("C", s, "Controller").alias("name"), F.when(s % 4 == 0, BASE).when(s % 4 != 3, cls(s - 1)).alias("base_fqn"), (s % 8 == 0).alias("is_abstract"), F.lit("Class").alias("type_kind"))
    own = F.concat(cls(p % n + 1), name(".M", p, "()"))
    methods = m.raw("part").select(
        own.alias("fqn"), cls(p % n + 1).alias("type_fqn"), name("M", p).alias("name"), null().alias("display"), F.when(p % 23 == 0, "Conversion").otherwise("Ordinary").alias("method_kind"), F.when(p % 7 == 0, "Private").otherwise("Public").alias("accessibility"),
        (p % 11 == 0).alias("is_static"), F.lit(False).alias("is_implicit"), F.when(p % 13 == 0, "System.Object.ToString()").alias("overridden_fqn"),
    )
    none = F.create_map().cast("map<string,string>")

    def attribute(rows, owner, when, ord_, cls_name, positional=None, named=None):
        value = F.array() if positional is None else F.array(positional)
        return rows.filter(when).select(owner.alias("owner_fqn"), F.lit(ord_).cast("long").alias("ord"), F.lit(f"{cls_name}Attribute").alias("class_name"), F.lit(MVC).alias("class_ns"), value.cast("array<string>").alias("positional"), (none if named is None else named).alias("named"))

    parts, text = m.raw("part"), F.lit
    found = [
        attribute(sup, cls(s), s % 4 == 0, 0, "Route", text("api/[controller]")), attribute(sup, cls(s), s % 12 == 2, 0, "Route", text("v2/{area}/[controller]")), attribute(sup, cls(s), s % 12 == 2, 1, "Route", text("v3")),
        attribute(sup, cls(s), s % 5 == 0, 2, "Area", name("ar", s)), attribute(sup, cls(s), s % 3 == 0, 3, "Authorize", text("P")), attribute(sup, cls(s), s % 8 == 3, 4, "ApiController"),
        attribute(parts, own, p % 3 == 0, 0, "HttpGet", text("{id}")), attribute(parts, own, p % 3 == 1, 0, "HttpPost"), attribute(parts, own, p % 10 == 0, 5, "Route", text("x/{action}")), attribute(parts, own, p % 17 == 0, 6, "NonAction"),
        attribute(parts, own, p % 19 == 0, 7, "AllowAnonymous"), attribute(parts, own, p % 9 == 0, 8, "Authorize", None, F.create_map(text("Policy"), text("Q"), text("Roles"), text("ops, sre,"))),
    ]
    attributes = found[0]
    for rows in found[1:]:
        attributes = attributes.unionByName(rows)
    return types, methods, attributes


@query("controller_endpoints", """
with n as (select count(*) as n from supplier),
a as (select p_partkey as p, p_partkey % n + 1 as s from part, n where p_partkey % n + 1 < n and p_partkey % 7 <> 0 and p_partkey % 11 <> 0 and p_partkey % 13 <> 0 and p_partkey % 17 <> 0 and p_partkey % 23 <> 0),
c as (select *, s - s % 4 as top from a where s % 8 <> 0 and (s % 4 <> 3 or s % 8 = 3)),
d as (select *, case when s % 4 = 3 then case when s % 5 = 0 then s end when s - s % 5 >= top then s - s % 5 end as ar,
 case when s % 12 = 2 then ['v2/{area}/[controller]', 'v3'] when s % 4 = 3 then [''] else ['api/[controller]'] end as prefixes,
 case when p % 3 = 0 then 'GET' when p % 3 = 1 then 'POST' else 'ANY' end as verb,
 case when p % 3 = 0 then '{id}' when p % 10 = 0 then 'x/{action}' else '' end as suffix from c),
e as (select *, unnest(prefixes) as prefix from d where p % 3 < 2 or p % 10 = 0 or s % 4 <> 3)
select verb as http_method, concat('/', trim(replace(replace(replace(case when prefix = '' then suffix else concat(prefix, '/', suffix) end, '[controller]', concat('C', s)), '{area}', coalesce('ar' || ar, '{area}')), '{action}', concat('M', p)), '/')) as route,
 concat('App.C', s, 'Controller.M', p, '()') as handler_fqn, s % 3 = 0 or p % 9 = 0 as requires_auth, p % 19 = 0 as allows_anonymous,
 array_to_string(list_concat(case when s % 3 = 0 then ['P'] else [] end, case when p % 9 = 0 then ['Q'] else [] end), ', ') as policies, case when p % 9 = 0 then 'ops, sre' else '' end as roles
from e where prefix <> '' or suffix <> ''""")
def controller_endpoints(m):
    got = endpoints.controller_endpoints(*controller_facts(m))
    return got.select("http_method", "route", "handler_fqn", "requires_auth", "allows_anonymous", F.array_join("policies", ", ").alias("policies"), F.array_join("roles", ", ").alias("roles"))


@query("map_call_endpoints", """
with recursive g as (select c_custkey as node_id, case when c_custkey % 4 <> 0 then c_custkey - 1 end as parent_id, case when c_custkey % 2 = 0 then concat('/g', c_custkey) else '' end as part from customer),
w as (select node_id, parent_id, part as prefix, 1 as d from g union all select w.node_id, g.parent_id, concat(g.part, w.prefix), w.d + 1 from w join g on g.node_id = w.parent_id where w.d < 8),
x as (select node_id, arg_max(prefix, d) as prefix from w group by node_id),
c as (select o_orderkey as call_id, o_custkey % 7 as k, o_custkey, o_orderstatus = 'F' as known from orders where o_orderkey % 11 <> 0 and o_custkey % 13 <> 0 and o_custkey % 7 <> 6)
select call_id, case k when 0 then 'GET' when 1 then 'POST' when 2 then 'PUT' when 3 then 'DELETE' when 4 then 'PATCH' else 'ANY' end as http_method, concat(coalesce(prefix, ''), '/r', o_custkey) as route,
 case when known then 'Handle()' else 'inline handler' end as handler_display, case when known then 'H.Handle()' end as handler_fqn, case when known then 'Exact' else 'Inferred' end as provenance,
 call_id % 4 = 0 as requires_auth, call_id % 9 = 0 as allows_anonymous, case when call_id % 4 = 0 then 'W, V' else '' end as policies
from c left join x on x.node_id = o_custkey""")
def map_call_endpoints(m):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(x) for x in ("MapGet", "MapPost", "MapPut", "MapDelete", "MapPatch", "MapMethods", "MapFallback")])
    known = F.col("o_orderstatus") == "F"
    calls = m.raw("orders").select(
        o.alias("call_id"), F.lit("d").alias("document"), F.get(names, (c % 7).cast("int")).alias("map_name"), F.when(c % 13 == 0, "Other").otherwise(f"{R.ROUTING_ANCHOR}Builder").alias("first_param_type"),
        F.when(o % 11 != 0, name("/r", c, "/")).alias("route"), F.lit(2).alias("n_args"), F.when(known, "H.Handle()").alias("handler_fqn"), F.when(known, "Handle()").alias("handler_display"), c.alias("receiver_id"),
    )
    k = F.col("c_custkey")
    groups = m.raw("customer").select(k.alias("node_id"), F.when(k % 4 != 0, k - 1).alias("parent_id"), (k % 2 == 0).alias("is_map_group"), name("/g", k).alias("literal"))
    links = m.raw("orders").select(o.alias("call_id"), F.explode(F.array(F.struct(F.lit(2).cast("long").alias("ord"), F.lit("V").alias("v")), F.struct(F.lit(1).cast("long").alias("ord"), F.lit("W").alias("v")))).alias("x"))
    chain = links.filter("call_id % 4 = 0").select("call_id", "x.ord", F.lit("RequireAuthorization").alias("method"), F.array("x.v").alias("literals"))
    chain = chain.unionByName(m.raw("orders").filter(o % 9 == 0).select(o.alias("call_id"), F.lit(3).cast("long").alias("ord"), F.lit("AllowAnonymous").alias("method"), F.array().cast("array<string>").alias("literals")))
    got = endpoints.map_call_endpoints(calls, groups, chain)
    return got.select("call_id", "http_method", "route", "handler_display", "handler_fqn", "provenance", "requires_auth", "allows_anonymous", F.array_join("policies", ", ").alias("policies"))


@query("override_roots", "select concat('V', c_custkey) as fqn, concat('V', c_custkey - c_custkey % 70) as root from customer where c_custkey >= 70 union all select concat('V', c_custkey), 'V0' from customer where c_custkey < 70")
def override_roots(m):
    c = F.col("c_custkey")
    return endpoints.override_roots(m.raw("customer").select(name("V", c).alias("fqn"), F.when(c % 70 != 0, name("V", c - 1)).alias("overridden_fqn")))


@query("stored_times", "select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as stored, true as same from events")
def stored_times(m):
    """Text of the catalog's time format and back."""
    ts = F.col("ts").cast("timestamp")
    stored = M.format_timestamp(ts)
    return m.raw("events").select(F.col("event_id").alias("id"), stored.alias("stored"), (M.parse_timestamp(stored) == ts).alias("same"))


@query("plural_counts", "select concat(format('{:,}', p.n), case when p.n = 1 then ' symbol' else ' symbols' end) as metric, p.name, case when p.name = 'CANADA' then '~' else concat('~/', p.name, '.csproj') end as place from (select projects.name, count(s.id) as n from projects left join symbols s on s.project_id = projects.id group by projects.name) p", "projects", "symbols")
def plural_counts(m):
    from strandline.functions import display as D
    from strandline.operators import explorer

    rows = explorer.projects_with_counts(m.projects, m.symbols)
    path = F.when(F.col("name") == "CANADA", "/home/u").otherwise(F.concat(F.lit("/home/u/"), F.col("name"), F.lit(".csproj")))
    return rows.select(X.plural(F.col("symbol_count"), "symbol", "symbols").alias("metric"), "name", D.home_relative(path, "/home/u").alias("place"))


@query("trace_of_few", f"select * from ({queries.TRACE_SQL.strip()}) t where endpoint_id in (select id from endpoints where route = '/api/building/7')", "relations", "endpoint_dependencies", "endpoints", "symbols")
def trace_of_few(m):
    """Traces of the endpoints of one route, from the part of the graph they reach."""
    symbols, relations = resolve.cut(m.symbols), resolve.cut(m.relations)  # stored tables, as in a catalog
    return trace.trace_of(m.endpoints.filter("route = '/api/building/7'"), m.endpoint_dependencies, relations, symbols)


SPANS = """k as (select p_partkey as k, p_partkey & -p_partkey as low from part),
s as (select concat('d', k % 3) as document, k * 16 as a, (k + low) * 16 as z, case when k % 7 = 0 then concat('P', k) when k % 5 <> 0 then concat('M', k) end as name from k)"""


@query("enclosing_spans", f"with {SPANS}, l as (select *, row_number() over () as rid from lineitem) select any_value(l_orderkey * 8 + l_linenumber) as node_id, arg_max(name, a) as source_fqn from l join s on document = concat('d', l_suppkey % 3) and l_partkey * 16 + l_linenumber >= a and l_partkey * 16 + l_linenumber < z and name is not null group by rid")
def enclosing_spans(m):
    """Spans nested by the powers of two in their keys: members, accessors of properties, and local functions without a name; each order line is a place."""
    k = F.col("p_partkey")
    low = k.bitwiseAND(-k)
    found = m.raw("part").select(name("d", k % 3).alias("document"), (k * 16).alias("start"), ((k + low) * 16).alias("end"), k.alias("ord"), F.when((k % 5 != 0) & (k % 7 != 0), name("M", k)).alias("symbol_fqn"), F.when(k % 7 == 0, name("P", k)).alias("associated_fqn"))
    places = m.raw("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node_id"), name("d", F.col("l_suppkey") % 3).alias("document"), (F.col("l_partkey") * 16 + F.col("l_linenumber")).alias("at"))
    return spans.enclosing_spans(found, places).select("node_id", "source_fqn")


@query("group_prefix_links", """
with recursive g as (select c_custkey as node_id, case when c_custkey % 60 <> 0 then c_custkey - 1 end as parent_id, c_custkey % 5 as k, case when c_custkey % 5 = 0 then concat('/', trim(case when c_custkey % 2 = 0 then concat('~/g', c_custkey, '/') else concat('/h', c_custkey) end, '/')) else '' end as part from customer),
w as (select node_id, parent_id, part as prefix, case when k < 2 then 1 else 0 end as counted from g
 union all select w.node_id, g.parent_id, concat(g.part, w.prefix), w.counted + case when g.k < 2 then 1 else 0 end from w join g on g.node_id = w.parent_id where w.counted < 8),
r as (select c_custkey as node_id from customer where exists (select 1 from g where g.node_id <= c_custkey and g.node_id >= c_custkey - c_custkey % 60 and g.k < 2))
select node_id, arg_max(prefix, counted) as prefix from (select node_id, prefix, counted * 1000 + length(prefix) as counted from w) join r using (node_id) group by node_id""")
def group_prefix_links(m):
    """Chains of 60 nodes: of five, one is a group, one a local and three are calls between; some literals start with ~/ or end with a slash."""
    c = F.col("c_custkey")
    literal = F.when(c % 2 == 0, name("~/g", c, "/")).otherwise(name("/h", c))
    groups = m.raw("customer").select(c.alias("node_id"), F.when(c % 60 != 0, c - 1).alias("parent_id"), (c % 5 == 0).alias("is_map_group"), F.when(c % 5 == 0, literal).alias("literal"))
    links = m.raw("customer").filter(c % 5 != 0).select(c.alias("node_id"), (c % 5 == 1).alias("is_local"))
    return endpoints.group_prefixes(groups, links)


@query("projects_in_order", "select id, name, row_number() over (order by translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id) as seq from projects", "projects")
def projects_in_order(m):
    return resolve.assign_ids(m.projects.select("id", "name"), *explorer.project_order(), out="seq")


@query("namespaces_in_order", """with n as (select distinct project_id, coalesce(namespace, '') as namespace from symbols where kind <> 'Namespace' and container_fqn is null)
select project_id, namespace, row_number() over (order by project_id, translate(namespace, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), namespace) as seq from n""", "symbols")
def namespaces_in_order(m):
    return resolve.assign_ids(explorer.namespaces(m.symbols, ordered=False), *explorer.namespace_order(), out="seq")


@query("selection_retained_all", "select id from endpoints where upper(route) like '%/API/A%'", "endpoints")
def selection_retained_all(m):
    """As selection_retained, with every endpoint selected."""
    return explorer.retained(m.endpoints.select("id"), m.endpoints.filter(explorer.matches("/api/a", "route")))


@query("compile_health_messages", """
with x as (select project, id as ord, case when id % 3 = 0 then 'CS0246' when id % 7 = 0 then 'CS0012' else 'CS1002' end as error_id, message from diagnostics where project is not null and severity = 'Error'),
g as (select project, count(*) as n, count(*) filter (error_id <> 'CS1002') as u, coalesce(arg_min(message, ord) filter (error_id <> 'CS1002'), arg_min(message, ord)) as example from x group by project)
select project, 'Warning' as severity, case when u > 0 then concat(n, ' compilation error(s), among them ', u, ' unresolved reference(s), such as: ', example, '. Endpoints and relations of this project are under-reported.')
 else concat(n, ' compilation error(s); the project is analysed in part. First: ', example) end as message from g""", "diagnostics")
def compile_health_messages(m):
    code = F.when(F.col("id") % 3 == 0, "CS0246").when(F.col("id") % 7 == 0, "CS0012").otherwise("CS1002")
    rows = m.diagnostics.filter(F.col("project").isNotNull() & (F.col("severity") == "Error"))
    return diagnostics.compile_health(rows.select("project", F.col("id").alias("ord"), code.alias("error_id"), "message")).select("project", "severity", "message")


@query("step_and_health_texts", """
select event_id as id, case when event_id % 3 = 0 then 'implements' else '' end as relation, case event_id % 4 when 0 then 'shown above' when 1 then 'continues deeper' else '' end as note,
 case event_id % 5 when 0 then 'Indexing…' when 1 then 'Indexing failed' when 2 then 'Indexed with issues' when 3 then 'Index up to date' else 'Not indexed' end as health from events""")
def step_and_health_texts(m):
    from strandline.functions import display as D

    e = F.col("event_id")
    of = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (e % n).cast("int"))
    return m.raw("events").select(
        e.alias("id"), D.step_relation(of(3, "Implements", "Calls", "Entry")).alias("relation"), D.step_note(of(4, "Repeated", "Deeper", "Terminal", "Expanded")).alias("note"),
        D.health_text(of(5, "Indexing", "Failed", "Warnings", "Ready", "None")).alias("health"),
    )
