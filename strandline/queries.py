"""Registered queries over the test tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema
from strandline.functions import display as D
from strandline.functions import model as M
from strandline.functions import routes as R
from strandline.functions import text as X
from strandline.operators import diagnostics, endpoints, explorer, resolve, trace
from strandline.sources import adapter, workspace
from strandline.sources.adapter import Model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NK = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SYMBOL = "s.id, s.kind, s.name, s.fqn, s.display, s.project_id, s.namespace, s.container_fqn, s.file_path, s.line, s.start_column, s.accessibility"


def query(name: str, sql: str | None, *views: str):
    """Registers a function of a Model; the SQL text is put behind the views it names."""

    def register(f: Callable[[Model], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Model(spark, folder))
        if sql is not None:
            text = sql.strip()
            if views:
                recursive = text.startswith("with recursive ")
                text = text.removeprefix("with recursive ") if recursive else text.removeprefix("with ") if text.startswith("with ") else text
                joined = ", " if sql.strip().startswith("with ") else " "
                text = f"with {'recursive ' if recursive else ''}{adapter.prelude(*views)}{joined}{text}"
            ORACLE[name] = text
        return f

    return register


@query("projects_with_counts", "select p.id, p.name, p.file_path, p.assembly_name, p.loaded, (select count(*) from symbols s where s.project_id = p.id) as symbol_count from projects p", "projects", "symbols")
def projects_with_counts(m):
    return explorer.projects_with_counts(m.projects, m.symbols)


@query("scoped_projects", "select id, name from projects where name = (select min(name) from projects)", "projects")
def scoped_projects(m):
    first = m.projects.agg(F.min("name").alias("name")).first()["name"]
    return explorer.scoped(m.projects, first).select("id", "name")


@query("namespaces", "select distinct project_id, coalesce(namespace, '') as namespace from symbols where kind <> 'Namespace' and container_fqn is null", "symbols")
def namespaces(m):
    return explorer.namespaces(m.symbols, ordered=False)


@query("types", f"select {SYMBOL}, p.name as project from symbols s left join projects p on p.id = s.project_id where s.kind <> 'Namespace' and s.container_fqn is null", "symbols", "projects")
def types(m):
    return explorer.symbol_rows(explorer.types(m.symbols, ordered=False), m.projects)


@query("members", f"select {SYMBOL}, p.name as project from symbols s left join projects p on p.id = s.project_id where s.container_fqn is not null", "symbols", "projects")
def members(m):
    return explorer.symbol_rows(explorer.members(m.symbols, ordered=False), m.projects)


@query("member_order", f"select container_fqn, id, row_number() over (partition by container_fqn order by kind, {NK.format('name')}, fqn, id) as seq from symbols where container_fqn is not null", "symbols")
def member_order(m):
    return explorer.numbered_members(m.symbols).select("container_fqn", "id", "seq")


@query("symbol_lookup", f"select {SYMBOL}, p.name as project from symbols s left join projects p on p.id = s.project_id where s.id = 1000007", "symbols", "projects")
def symbol_lookup(m):
    return explorer.symbol_rows(explorer.symbol_by_id(m.symbols, 1000007), m.projects)


@query("kind_list", "select id, kind from symbols where kind in ('Class', 'Record')", "symbols")
def kind_list(m):
    return m.symbols.filter(M.any_of(F.col("kind"), ["Class", "Record"])).select("id", "kind")


@query("tree", """
with t as (select 2 as level, coalesce(namespace, '') as parent, name, id, kind, fqn from symbols where kind <> 'Namespace' and container_fqn is null)
select 0 as level, null as parent, name, id, 'Project' as kind from projects
union all select distinct 1, p.name, coalesce(s.namespace, ''), cast(null as bigint), 'Namespace' from symbols s left join projects p on p.id = s.project_id where s.kind <> 'Namespace' and s.container_fqn is null
union all select level, parent, name, id, kind from t
union all select 3, s.container_fqn, s.name, s.id, s.kind from symbols s where s.container_fqn in (select fqn from t)
""", "projects", "symbols")
def tree(m):
    return explorer.tree(m.projects, m.symbols)


@query("resolved_relations", "select source_symbol_id, kind, target_symbol_id, target_fqn, target_display, provenance from relations", "relations")
def resolved_relations(m):
    return resolve.resolve_edges(m.staged_relations, m.symbols)


EDGE_FACTS = "select s.project_id, s.source_fqn, s.kind, s.target_fqn, s.target_display, s.provenance, row_number() over (order by s.project_id, s.source_fqn, s.kind, s.target_fqn, s.target_display desc, s.provenance desc) as ord from staged_relations s"


@query("edge_dedup_first_wins", f"with o as ({EDGE_FACTS}) select project_id, source_fqn, kind, target_fqn, target_display, provenance from o qualify row_number() over (partition by project_id, source_fqn, kind, target_fqn order by ord) = 1", "staged_relations")
def edge_dedup(m):
    rows = resolve.assign_ids(m.staged_relations, F.col("project_id"), F.col("source_fqn"), F.col("kind"), F.col("target_fqn"), F.struct("target_display", "provenance"), out="up")
    return resolve.first_wins(rows.withColumn("ord", -F.col("up")), ("project_id", "source_fqn", "kind", "target_fqn")).drop("ord", "up")


@query("callees", f"select r.source_symbol_id as start_id, {SYMBOL} from (select distinct source_symbol_id, target_symbol_id from relations where kind = 'Calls') r join symbols s on s.id = r.target_symbol_id", "relations", "symbols")
def callees(m):
    return explorer.callees(m.relations, m.symbols, ordered=False).select("start_id", *explorer.SYMBOL_COLUMNS)


@query("implementations", f"select r.target_symbol_id as start_id, {SYMBOL} from (select distinct source_symbol_id, target_symbol_id from relations where kind in ('Implements', 'Overrides') and target_symbol_id is not null) r join symbols s on s.id = r.source_symbol_id", "relations", "symbols")
def implementations(m):
    return explorer.implementations(m.relations, m.symbols, ordered=False).select("start_id", *explorer.SYMBOL_COLUMNS)


@query("resolved_endpoints", "select e.id, e.handler_fqn, f.id as handler_symbol_id from endpoints e left join (select fqn, min(id) as id from symbols group by fqn) f on f.fqn = e.handler_fqn", "endpoints", "symbols")
def resolved_endpoints(m):
    return resolve.with_identity(m.endpoints.select("id", "handler_fqn"), resolve.ids_by_name(m.symbols), "handler_fqn", "handler_symbol_id").select("id", "handler_fqn", "handler_symbol_id")


@query("endpoint_dependencies", "select endpoint_id, row_number() over (partition by endpoint_id order by pos, symbol_id nulls first, target_fqn, target_display) as seq, target_fqn, target_display, symbol_id from endpoint_dependencies", "endpoint_dependencies")
def endpoint_dependencies(m):
    listed = endpoints.grouped_dependencies(m.endpoint_dependencies)
    rows = listed.select("endpoint_id", F.posexplode("dependencies").alias("i", "d"))
    return rows.select("endpoint_id", (F.col("i") + 1).cast("long").alias("seq"), "d.target_fqn", "d.target_display", "d.symbol_id")


AUTH = """case when allows_anonymous then 'Anonymous' when not requires_auth then '' when policies is not null then policies when roles is not null then array_to_string(list_filter(list_transform(string_split(roles, ','), lambda x: trim(x)), lambda x: x <> ''), ', ') else 'Authorized' end"""
LISTED = f"""select e.id, e.http_method, e.route, e.handler_display, e.kind, p.name as project, e.provenance, {AUTH} as auth, (select count(*) from endpoint_dependencies d where d.endpoint_id = e.id) as n_dependencies,
 row_number() over (order by {NK.format('route')}, http_method, e.id) as seq from endpoints e left join projects p on p.id = e.project_id"""


def _listed(m):
    e = endpoints.endpoint_list(m.endpoints, m.projects, m.endpoint_dependencies, ordered=False)
    return e.withColumn("auth", endpoints.auth_summary(e))


@query("endpoints_list", f"select id, http_method, route, handler_display, kind, project, provenance, auth, n_dependencies, seq from ({LISTED})", "endpoints", "projects", "endpoint_dependencies")
def endpoints_list(m):
    rows = _listed(m).select("id", "http_method", "route", "handler_display", "kind", "project", "provenance", "auth", F.size("dependencies").cast("long").alias("n_dependencies"))
    return resolve.assign_ids(rows, X.nocase("route"), "http_method", "id", out="seq")


@query("endpoint_filter", "select e.id, e.route from endpoints e left join projects p on p.id = e.project_id where p.name = 'NATION_3' and (upper(e.route) like '%BUILD%' or upper(e.handler_display) like '%BUILD%' or upper(e.http_method) like '%BUILD%')", "endpoints", "projects")
def endpoint_filter(m):
    return endpoints.filtered(_listed(m), "NATION_3", " build ").select("id", "route")


@query("selection_retained", "select id from endpoints where id % 3 = 0 and upper(route) like '%/API/A%'", "endpoints")
def selection_retained(m):
    kept = m.endpoints.filter(explorer.matches("/api/a", "route"))
    return explorer.retained(m.endpoints.filter("id % 3 = 0").select("id"), kept)


@query("auth_summary", f"select id, {AUTH} as auth from endpoints", "endpoints")
def auth_summary(m):
    return m.endpoints.select("id", D.authorization_summary(F.col("allows_anonymous"), F.col("requires_auth"), X.split_list(F.col("policies")), X.split_list(F.col("roles"))).alias("auth"))


@query("authorization_layering", """select id, array_to_string(case when policies is null then ['Base'] else ['Base', 'Elevated', 'Managers'] end, ', ') as policies, requires_auth or id % 4 = 0 as requires_auth from endpoints""", "endpoints")
def authorization_layering(m):
    base = F.array(F.lit("Base"))
    return m.endpoints.select("id", F.array_join(endpoints.layered(F.concat(base, base), X.split_list(F.col("policies"))), ", ").alias("policies"), (F.col("requires_auth") | (F.col("id") % 4 == 0)).alias("requires_auth"))


@query("list_codec", "select id, coalesce(array_to_string(list_filter(list_transform(string_split(roles, ','), lambda x: trim(x)), lambda x: x <> ''), ', '), null) as roles, coalesce(len(list_filter(list_transform(string_split(roles, ','), lambda x: trim(x)), lambda x: x <> '')), 0) as n from endpoints", "endpoints")
def list_codec(m):
    parts = X.split_list(F.col("roles"))
    return m.endpoints.select("id", X.join_list(parts).alias("roles"), F.size(parts).cast("long").alias("n"))


@query("diagnostics", "select id, case when severity in ('Info', 'Warning', 'Error') then severity else 'Info' end as severity, project, message from diagnostics", "diagnostics")
def diagnostics_list(m):
    return diagnostics.listed(m.diagnostics)


ERRORS = "select project, id as ord, case when id % 3 = 0 then 'CS0246' when id % 7 = 0 then 'CS0012' else 'CS1002' end as error_id, message from diagnostics where project is not null and severity = 'Error'"


@query("compile_health", f"with x as ({ERRORS}) select project, 'Warning' as severity, count(*) as errors, cast(sum(case when error_id <> 'CS1002' then 1 else 0 end) as bigint) as unresolved, coalesce(arg_min(message, ord) filter (error_id <> 'CS1002'), arg_min(message, ord)) as example from x group by project", "diagnostics")
def compile_health(m):
    code = F.when(F.col("id") % 3 == 0, "CS0246").when(F.col("id") % 7 == 0, "CS0012").otherwise("CS1002")
    rows = m.diagnostics.filter(F.col("project").isNotNull() & (F.col("severity") == "Error"))
    return diagnostics.compile_health(rows.select("project", F.col("id").alias("ord"), code.alias("error_id"), "message")).drop("message")


@query("metadata", "select 'endpoints' as what, count(*) as n from endpoints union all select 'projects', count(*) from projects union all select 'symbols', count(*) from symbols", "endpoints", "projects", "symbols")
def metadata(m):
    return explorer.totals(m.projects, m.symbols, m.endpoints)


def _trace(m):
    return trace.trace(m.endpoints, m.endpoint_dependencies, m.relations, m.symbols)


TRACE_SQL = """with recursive nk as (select id, fqn, display, translate(display, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from symbols),
edges as (
  select distinct r.target_symbol_id as src, r.source_symbol_id as dst, 0 as k from relations r where r.kind in ('Implements', 'Overrides') and r.target_symbol_id is not null
  union all
  select distinct r.source_symbol_id, r.target_symbol_id, 1 from relations r where r.kind = 'Calls' and r.target_symbol_id is not null),
adj as (select e.src, list({'n': e.dst, 'k': e.k} order by e.k, nk.key, nk.fqn, nk.id) as ch from edges e join nk on nk.id = e.dst group by e.src),
fm as (select fqn, min(id) as id from symbols group by fqn),
dep as (select endpoint_id, symbol_id, min(pos) as pos from endpoint_dependencies where symbol_id is not null group by endpoint_id, symbol_id),
ent as (
  select e.id as e, [{'n': fm.id, 'd': 0, 'k': 2}] as stack from endpoints e join fm on fm.fqn = e.handler_fqn
  union all
  select d.endpoint_id, list({'n': d.symbol_id, 'd': 0, 'k': 2} order by d.pos, d.symbol_id) from dep d join endpoints e on e.id = d.endpoint_id where e.handler_fqn is null group by d.endpoint_id),
w as (
  select e, 0 as seq, stack, []::bigint[] as seen, null::bigint as n, null::int as d, null::int as k, null::varchar as fin from ent
  union all
  select w.e, w.seq + 1,
    case when list_contains(w.seen, w.stack[1].n) or a.ch is null or w.stack[1].d >= 8 then w.stack[2:]
         else list_concat(list_transform(a.ch, lambda x: {'n': x.n, 'd': w.stack[1].d + 1, 'k': x.k}), w.stack[2:]) end,
    list_append(w.seen, w.stack[1].n), w.stack[1].n, w.stack[1].d, w.stack[1].k,
    case when list_contains(w.seen, w.stack[1].n) then 'Repeated' when a.ch is null then 'Terminal' when w.stack[1].d >= 8 then 'Deeper' else 'Expanded' end
  from w left join adj a on a.src = w.stack[1].n
  where len(w.stack) > 0 and w.seq < 400)
select w.e as endpoint_id, cast(w.seq as bigint) as seq, w.n as symbol_id, cast(w.d as bigint) as depth,
  case w.k when 0 then 'Implements' when 1 then 'Calls' else 'Entry' end as step_kind, w.fin as step_end, (w.seq = 400 and len(w.stack) > 0) as truncated
from w where w.seq > 0"""


STEPS_SQL = TRACE_SQL[: TRACE_SQL.index("select w.e as endpoint_id")]


@query("trace_summary", STEPS_SQL + """, n as (select e as endpoint_id, max(seq) as steps, bool_or(seq = 400 and len(stack) > 0) as cut from w where seq > 0 group by e),
r as (select e.id as endpoint_id, coalesce(n.steps, 0) as steps, coalesce(n.cut, false) as truncated from endpoints e left join n on n.endpoint_id = e.id)
select endpoint_id, cast(steps as bigint) as steps, truncated, case when steps = 0 then 'Nothing this endpoint reaches is declared in this solution.' when truncated then concat('First ', steps, ' steps; the flow is longer than that.') when steps = 1 then '1 step' else concat(steps, ' steps') end as summary from r""", "relations", "endpoint_dependencies", "endpoints", "symbols")
def trace_summary(m):
    got = trace.counts(m.endpoints, m.endpoint_dependencies, m.relations, m.symbols)
    return got.select("endpoint_id", "steps", "truncated", D.trace_summary(F.col("steps"), F.col("truncated")).alias("summary"))


@query("trace_steps", TRACE_SQL, "relations", "endpoint_dependencies", "endpoints", "symbols")
def trace_steps(m):
    return _trace(m)


STEP_VIEW = "select s.id, case when s.kind in ('Namespace','Class','Interface','Record','Struct','Enum','Delegate') then true else false end as is_container, case s.kind when 'Class' then 'C' when 'Interface' then 'I' when 'Record' then 'R' when 'Struct' then 'S' when 'Enum' then 'E' when 'Delegate' then 'D' when 'Method' then 'M' when 'Constructor' then 'Ct' when 'Property' then 'P' when 'Field' then 'F' else '?' end as glyph, concat(string_split(s.file_path, '/')[-1], ':', s.line) as origin, coalesce(s.container_fqn, s.namespace, '') as container, cast(s.line % 9 * 16 + 12 as bigint) as gutter from symbols s"


@query("symbol_display", STEP_VIEW, "symbols")
def symbol_display(m):
    return m.symbols.select(
        "id", M.is_container(F.col("kind")).alias("is_container"), D.glyph(F.col("kind")).alias("glyph"), D.origin(F.col("file_path"), F.col("line")).alias("origin"),
        D.step_container(F.col("container_fqn"), F.col("namespace")).alias("container"), D.gutter(F.col("line") % 9).alias("gutter"),
    )


@query("detail_rows", f"""with l as ({LISTED}), e as (select l.*, x.handler_fqn from l join endpoints x on x.id = l.id)
select id, u.pos, u.label, u.value from (select id, unnest([{{'pos': 1::bigint, 'label': 'Method', 'value': http_method}}, {{'pos': 2::bigint, 'label': 'Route', 'value': route}}, {{'pos': 3::bigint, 'label': 'Handler', 'value': coalesce(handler_fqn, 'inline handler')}},
 {{'pos': 4::bigint, 'label': 'Kind', 'value': case when kind = 'ControllerAction' then 'Controller action' else 'Minimal API' end}}, {{'pos': 5::bigint, 'label': 'Project', 'value': coalesce(project, '-')}}, {{'pos': 6::bigint, 'label': 'Source', 'value': 'not located'}},
 {{'pos': 7::bigint, 'label': 'Authorization', 'value': coalesce(nullif(auth, ''), 'none declared')}}, {{'pos': 8::bigint, 'label': 'Routing', 'value': case when provenance = 'Exact' then 'resolved exactly' else 'partly inferred' end}}]) as u from e)""", "endpoints", "projects", "endpoint_dependencies")
def detail_rows(m):
    rows = _listed(m).withColumn("origin", D.origin(F.lit(None).cast("string"), F.lit(None).cast("int")))
    return rows.select("id", F.explode(D.detail_rows(rows)).alias("d")).select("id", "d.pos", "d.label", "d.value")


@query("verb_class", "select id, case when http_method in ('GET','HEAD') then 'get' when http_method = 'POST' then 'post' when http_method in ('PUT','PATCH') then 'put' when http_method = 'DELETE' then 'delete' else 'other' end as verb_class from endpoints", "endpoints")
def verb_class(m):
    return m.endpoints.select("id", D.verb_class(F.col("http_method")).alias("verb_class"))


ROUTES = "select c_custkey as id, case c_custkey % 3 when 0 then '' when 1 then concat('api/', c_mktsegment, '/') else concat('/', c_name) end as prefix, case c_custkey % 5 when 0 then '' when 1 then '{id}' when 2 then '/healthz' when 3 then '~/top/' else 'a/b/' end as suffix from customer"


def _routes(m):
    c = F.col("c_custkey")
    prefix = F.when(c % 3 == 0, "").when(c % 3 == 1, F.concat(F.lit("api/"), F.col("c_mktsegment"), F.lit("/"))).otherwise(F.concat(F.lit("/"), F.col("c_name")))
    suffix = F.when(c % 5 == 0, "").when(c % 5 == 1, "{id}").when(c % 5 == 2, "/healthz").when(c % 5 == 3, "~/top/").otherwise("a/b/")
    return m.raw("customer").select(c.alias("id"), prefix.alias("prefix"), suffix.alias("suffix"))


@query("route_combine", f"with r as ({ROUTES}) select id, prefix, suffix, concat('/', trim(case when suffix like '/%' then suffix when suffix like '~/%' then ltrim(suffix, '~') when prefix = '' then suffix else concat(rtrim(prefix, '/'), '/', suffix) end, '/')) as route from r")
def route_combine(m):
    return _routes(m).withColumn("route", R.combine(F.col("prefix"), F.col("suffix")))


@query("token_substitution", """with t as (select p_partkey as id, concat(replace(p_brand, '#', ''), 'Controller') as controller, case when p_size % 2 = 0 then p_type end as area, p_name as action,
 case p_partkey % 4 when 0 then 'api/[controller]/[ACTION]' when 1 then '[area]/{action=Index}/{id?}' when 2 then 'x/{action:regex(^a$)}/[controller]' else '{area}/{Controller}/{actionId}' end as template from part),
n as (select *, replace(controller, 'Controller', '') as short from t)
select id, case id % 4 when 0 then concat('api/', short, '/', action) when 1 then concat(coalesce(area, '[area]'), '/', action, '/{id?}') when 2 then concat('x/{action:regex(^a$)}/', short) else concat(coalesce(area, '{area}'), '/', short, '/{actionId}') end as route from n""")
def token_substitution(m):
    p = F.col("p_partkey")
    template = F.when(p % 4 == 0, "api/[controller]/[ACTION]").when(p % 4 == 1, "[area]/{action=Index}/{id?}").when(p % 4 == 2, "x/{action:regex(^a$)}/[controller]").otherwise("{area}/{Controller}/{actionId}")
    controller = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("Controller"))
    return m.raw("part").select(p.alias("id"), R.substitute_tokens(template, controller, F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.col("p_name")).alias("route"))


ACTIONS = "select s_suppkey as id, case when s_suppkey % 3 = 0 then [] when s_suppkey % 3 = 1 then ['v1'] else ['v1', 'v2'] end as prefixes, case when s_suppkey % 4 = 0 then [] else ['{id}', s_name] end as suffixes from supplier"


@query("action_expansion", f"with a as ({ACTIONS}), p as (select id, unnest(case when len(prefixes) = 0 then [''] else prefixes end) as prefix, suffixes from a), q as (select id, prefix, unnest(case when len(suffixes) = 0 then [''] else suffixes end) as suffix from p) select id, prefix, suffix, concat('/', trim(case when prefix = '' then suffix else concat(prefix, '/', suffix) end, '/')) as route from q where prefix <> '' or suffix <> ''")
def action_expansion(m):
    s = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    prefixes = F.when(s % 3 == 0, none).when(s % 3 == 1, F.array(F.lit("v1"))).otherwise(F.array(F.lit("v1"), F.lit("v2")))
    suffixes = F.when(s % 4 == 0, none).otherwise(F.array(F.lit("{id}"), F.col("s_name")))
    rows = m.raw("supplier").select(s.alias("id"), prefixes.alias("p"), suffixes.alias("q"))
    full = rows.withColumn("prefix", F.explode(R.or_empty(F.col("p")))).withColumn("suffix", F.explode(R.or_empty(F.col("q"))))
    return full.filter("prefix <> '' or suffix <> ''").select("id", "prefix", "suffix", R.combine(F.col("prefix"), F.col("suffix")).alias("route"))


BASES = "select concat('T', c_custkey) as fqn, case when c_custkey % 5 <> 0 then concat('T', c_custkey - 1) end as base_fqn, case when c_custkey % 5 in (0, 2) then concat('r', c_custkey) end as route from customer"


@query("inherited_route", f"with recursive t as ({BASES}), c as (select fqn, base_fqn, route, 0 as d from t union all select c.fqn, t.base_fqn, t.route, c.d + 1 from c join t on t.fqn = c.base_fqn where c.route is null) select fqn, route from c where route is not null")
def inherited_route(m):
    c = F.col("c_custkey")
    name = lambda k: F.concat(F.lit("T"), k.cast("string"))
    types = m.raw("customer").select(name(c).alias("fqn"), F.when(c % 5 != 0, name(c - 1)).alias("base_fqn"), F.when((c % 5).isin(0, 2), F.concat(F.lit("r"), c.cast("string"))).alias("route"))
    return endpoints.along_bases(types, "route").filter(F.col("route").isNotNull())


@query("group_prefix", "with recursive g as (select c_custkey as node_id, case when c_custkey % 4 <> 0 then c_custkey - 1 end as parent_id, case when c_custkey % 2 = 0 then concat('/g', c_custkey) else '' end as part from customer), w as (select node_id, parent_id, part as prefix, 1 as d from g union all select w.node_id, g.parent_id, concat(g.part, w.prefix), w.d + 1 from w join g on g.node_id = w.parent_id where w.d < 8) select node_id, case when arg_max(prefix, d) = '' then '' else arg_max(prefix, d) end as prefix from w group by node_id")
def group_prefix(m):
    c = F.col("c_custkey")
    groups = m.raw("customer").select(c.alias("node_id"), F.when(c % 4 != 0, c - 1).alias("parent_id"), (c % 2 == 0).alias("is_map_group"), F.concat(F.lit("/g"), c.cast("string")).alias("literal"))
    return endpoints.group_prefixes(groups)


@query("inline_dependencies", "with d as (select l_orderkey as call_id, cast(l_partkey as varchar) as target_fqn, min({'p': case when l_tax = 0.0 then 0 else 1 end, 'o': l_linenumber, 's': l_suppkey}) as first_at from lineitem group by all), n as (select call_id, target_fqn, row_number() over (partition by call_id order by first_at, target_fqn) as pos from d) select call_id, pos, target_fqn from n where pos <= 24")
def inline_dependencies(m):
    rows = m.raw("lineitem").select(F.col("l_orderkey").alias("call_id"), F.struct(F.col("l_linenumber").alias("o"), F.col("l_suppkey").alias("s")).alias("ord"), F.col("l_partkey").cast("string").alias("target_fqn"), F.lit("").alias("target_display"), F.col("l_tax"))
    return endpoints.inline_dependencies(rows.filter("l_tax = 0"), rows.filter("l_tax <> 0")).drop("target_display")


@query("bind_candidates", "with b as (select l_orderkey * 8 + l_linenumber as id, case when l_returnflag = 'R' then l_shipmode end as x from (select l_orderkey, l_linenumber, l_returnflag, l_linestatus as l_shipmode from lineitem)) select id, count(*) as n, count(x) as exact from b group by id")
def bind_candidates(m):
    rows = m.raw("lineitem")
    target, provenance = M.bind(F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")), F.array())
    got = rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), target.alias("t"), provenance.alias("p"))
    return got.groupBy("id").agg(F.count("*").alias("n"), F.count(F.when(F.col("p") == "Exact", F.col("t"))).alias("exact"))


PATHS = "select s_suppkey as id, concat('/w/', r, '/', s_name, case s_suppkey % 4 when 0 then '.slnx' when 1 then '.SLN' when 2 then '.csproj' else '.txt' end) as path, cast(s_suppkey % 3 as int) as depth from (select *, case when s_nationkey % 2 = 0 then 'a' else 'B' end as r from supplier)"


@query("candidate_ranking", f"with p as ({PATHS}), x as (select *, case when lower(path) like '%.slnx' then 0 when lower(path) like '%.sln' then 1 when lower(path) like '%.csproj' then 2 end as rank from p) select path, rank, row_number() over (order by rank, depth, upper(string_split(path, '/')[-1]), path) as seq from x where rank is not null")
def candidate_ranking(m):
    s = F.col("s_suppkey")
    ext = F.when(s % 4 == 0, ".slnx").when(s % 4 == 1, ".SLN").when(s % 4 == 2, ".csproj").otherwise(".txt")
    path = F.concat(F.lit("/w/"), F.when(F.col("s_nationkey") % 2 == 0, "a").otherwise("B"), F.lit("/"), F.col("s_name"), ext)
    rank = F.create_map(*[F.lit(x) for kv in workspace.EXTENSIONS.items() for x in kv])[X.extension(path)]
    rows = m.raw("supplier").select(path.alias("path"), rank.alias("rank"), (s % 3).cast("int").alias("depth")).filter(workspace.is_supported(F.col("path")))
    return resolve.assign_ids(rows, "rank", "depth", F.upper(X.basename(F.col("path"))), "path", out="seq").select("path", "rank", "seq")


@query("mru", "select n_nationkey as id, array_to_string(list_concat([upper(n_name)], ['x', 'y']), ',') as recent from nation")
def mru(m):
    return m.raw("nation").select(F.col("n_nationkey").alias("id"), F.array_join(workspace.add_recent(F.array(F.lit("x"), F.lower("n_name"), F.lit("y")), F.upper("n_name")), ",").alias("recent"))


@query("catalog_names", "select s_suppkey as id, concat(s_name, '-', substr(sha256(concat('/w/', s_name, '.sln')), 1, 16), '.db') as name from supplier")
def catalog_names(m):
    return m.raw("supplier").select(F.col("s_suppkey").alias("id"), workspace.catalog_name(F.concat(F.lit("/w/"), F.col("s_name"), F.lit(".sln"))).alias("name"))


@query("health", "select event_id as id, case when event_id % 5 = 0 then 'Indexing' when event_id % 5 = 1 then 'Failed' when event_id % 5 = 2 then 'None' when user_id % 2 = 1 then 'Warnings' else 'Ready' end as health from events")
def health(m):
    e = F.col("event_id") % 5
    return m.raw("events").select(F.col("event_id").alias("id"), D.health(e == 0, e == 1, e != 2, F.col("user_id") % 2).alias("health"))


@query("project_cards", "select p.name, concat(count(s.id), ' symbols') as metric from projects p left join symbols s on s.project_id = p.id group by p.name", "projects", "symbols")
def project_cards(m):
    rows = explorer.projects_with_counts(m.projects, m.symbols)
    return rows.select("name", F.concat(F.replace(F.format_number("symbol_count", 0), F.lit(","), F.lit("")), F.lit(" symbols")).alias("metric"))


@query("breadcrumb", "select id, array_to_string(string_split(replace(file_path, '/src/', ''), '/'), '  ›  ') as trail from symbols", "symbols")
def breadcrumb(m):
    return m.symbols.select("id", D.breadcrumb(F.col("file_path"), F.lit("/src")).alias("trail"))


@query("local_time", "select event_id as id, strftime(ts, '%Y-%m-%d %H:%M') as shown from events")
def local_time(m):
    return m.raw("events").select(F.col("event_id").alias("id"), D.local_time(F.col("ts"), "UTC").alias("shown"))


@query("timestamp_codec", "select event_id as id, cast(ts as timestamp) as ts from events")
def timestamp_codec(m):
    return m.raw("events").select(F.col("event_id").alias("id"), F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("ts"))


@query("line_counts", "select page_id as id, cast(length(html) - length(replace(html, chr(10), '')) + 1 as bigint) as n from pages")
def line_counts(m):
    return m.raw("pages").select(F.col("page_id").alias("id"), X.line_count(F.col("html")).alias("n"))


@query("editor_command", "select id, concat('code -g ', file_path, ':', coalesce(line, 1)) as command from symbols", "symbols")
def editor_command(m):
    return m.symbols.select("id", D.editor_command(F.lit("code -g {file}:{line}"), F.col("file_path"), F.col("line")).alias("command"))


@query("tree_titles", "select id, case when coalesce(namespace, '') = '' then '<global namespace>' else namespace end as title from symbols", "symbols")
def tree_titles(m):
    return m.symbols.select("id", D.node_title(F.col("namespace")).alias("title"))


@query("kind_mapping", "select p_partkey as id, case p_partkey % 6 when 0 then 'Record' when 1 then 'Struct' when 2 then 'Constructor' when 3 then 'Method' when 4 then 'Property' end as kind from part where p_partkey % 6 <> 5")
def kind_mapping(m):
    p = F.col("p_partkey") % 6
    name = F.when(p < 2, "NamedType").when(p < 4, "Method").when(p == 4, "Property").otherwise("Parameter")
    sub = F.when(p < 2, "Struct").when(p == 2, "StaticConstructor").when(p == 3, "Conversion")
    rows = m.raw("part").select(F.col("p_partkey").alias("id"), M.map_kind(name, sub, p == 0).alias("kind"))
    return rows.filter(F.col("kind").isNotNull())


from strandline import queries_facts  # noqa: E402, F401  (registers its queries here)
