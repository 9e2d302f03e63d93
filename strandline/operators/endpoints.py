"""Endpoint lists, and the rules that turn bound facts into endpoints: routes, verbs, handlers, authorization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import schema
from strandline.functions import display as D
from strandline.functions import model as M
from strandline.functions import routes as R
from strandline.functions import text as X
from strandline.operators import explorer, resolve

# Framework types that make or bound a controller.
CONTROLLER_BASES = ("Microsoft.AspNetCore.Mvc.ControllerBase", "Microsoft.AspNetCore.Mvc.Controller")
AUTHORIZE_NAMES, ANONYMOUS_NAMES = ("AuthorizeAttribute",), ("AllowAnonymousAttribute",)


# ---- lists ---------------------------------------------------------------------------------------------------


def grouped_dependencies(dependencies: DataFrame) -> DataFrame:
    """(endpoint_id, dependencies): links in id order."""
    link = F.struct("pos", "symbol_id", "target_fqn", "target_display")
    return dependencies.groupBy("endpoint_id").agg(F.sort_array(F.collect_list(link)).alias("dependencies"))


def endpoint_list(endpoints: DataFrame, projects: DataFrame, dependencies: DataFrame, ordered: bool = True) -> DataFrame:
    """All endpoints with project name, decoded lists and their dependencies ([] where there are none). Unordered where another operator follows."""
    links = grouped_dependencies(dependencies)
    none = F.array().cast(links.schema["dependencies"].dataType)
    rows = (
        explorer.with_project(endpoints, projects)
        .withColumn("policies", X.split_list("policies"))
        .withColumn("roles", X.split_list("roles"))
        .join(links.withColumnRenamed("endpoint_id", "id"), "id", "left")
        .withColumn("dependencies", F.coalesce("dependencies", none))
    )
    return rows.orderBy(X.nocase("route"), "http_method", "id") if ordered else rows


def filtered(listed: DataFrame, project: str | None, text: str | None) -> DataFrame:
    rows = listed if project is None else listed.filter(F.col("project") == project)
    return rows.filter(explorer.matches(text, "route", "handler_display", "http_method"))


def auth_summary(listed: DataFrame) -> Column:
    return D.authorization_summary(listed["allows_anonymous"], listed["requires_auth"], listed["policies"], listed["roles"])


# ---- authorization -------------------------------------------------------------------------------------------


def read_authorization(attributes: DataFrame) -> DataFrame:
    """(owner_fqn, requires, anonymous, policies, roles) of each owner's own attributes, lists in attribute order without repeats."""
    a = attributes.filter(F.col("class_name").isin(*AUTHORIZE_NAMES, *ANONYMOUS_NAMES))
    allow = F.col("class_name").isin(*AUTHORIZE_NAMES)
    policy = F.filter(F.array(F.get("positional", F.lit(0)), F.col("named")["Policy"]), lambda x: F.coalesce(x, F.lit("")) != "")
    roles = F.when(allow, X.split_list(F.col("named")["Roles"])).otherwise(F.array().cast("array<string>"))
    per = a.select("owner_fqn", "ord", allow.alias("r"), (~allow).alias("n"), F.when(allow, policy).otherwise(F.array().cast("array<string>")).alias("p"), roles.alias("o"))
    got = per.groupBy("owner_fqn").agg(F.bool_or("r").alias("requires"), F.bool_or("n").alias("anonymous"), F.sort_array(F.collect_list(F.struct("ord", "p", "o"))).alias("l"))
    return got.select("owner_fqn", "requires", "anonymous", F.array_distinct(F.flatten("l.p")).alias("policies"), F.array_distinct(F.flatten("l.o")).alias("roles"))


def layered(type_list: Column, member_list: Column) -> Column:
    """Type entries, then member entries, without repeats."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(type_list, empty), F.coalesce(member_list, empty)))


def chain_authorization(chain: DataFrame) -> DataFrame:
    """(call_id, requires, anonymous, policies) from rows (call_id, ord, method, literals) of a map call's own chain."""
    req = F.col("method") == "RequireAuthorization"
    per = chain.filter(F.col("method").isin("RequireAuthorization", "AllowAnonymous")).select("call_id", "ord", req.alias("r"), F.when(req, F.col("literals")).otherwise(F.array().cast("array<string>")).alias("p"))
    got = per.groupBy("call_id").agg(F.bool_or("r").alias("requires"), F.bool_or(~F.col("r")).alias("anonymous"), F.sort_array(F.collect_list(F.struct("ord", "p"))).alias("l"))
    return got.select("call_id", "requires", "anonymous", F.array_distinct(F.flatten("l.p")).alias("policies"))


# ---- type chains ---------------------------------------------------------------------------------------------


def base_chain(types: DataFrame) -> DataFrame:
    """(fqn, base, distance): each type with itself and all its bases by pointer jumping: log2(depth) joins. A base that isn't a row ends its chain.
    Goes on until no jump is left; a chain that comes back to itself raises."""
    parent = types.select("fqn", F.col("base_fqn").alias("base")).filter(F.col("base").isNotNull()).withColumn("distance", F.lit(1))
    out = types.select("fqn", F.col("fqn").alias("base"), F.lit(0).alias("distance")).unionByName(parent)
    jump, rounds = parent, 0
    ahead = lambda rows: rows.alias("a").join(jump.alias("b"), F.col("a.base") == F.col("b.fqn")).select(F.col("a.fqn"), F.col("b.base"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
    while True:
        out, jump, rounds = out.unionByName(ahead(out)).groupBy("fqn", "base").agg(F.min("distance").alias("distance")), ahead(jump), rounds + 1
        if rounds % 3 == 0:  # deep chains: cut what would be computed again in each further round
            out, jump = resolve.cut(out), resolve.cut(jump)
        if jump.isEmpty():
            return out
        if rounds > 40:  # 2 ** 40 levels
            raise ValueError("a chain of bases comes back to itself")


def along_bases(rows: DataFrame, *values: str, last: bool = False) -> DataFrame:
    """rows (fqn, base_fqn, values) as (fqn, values): a value that is null comes from the nearest base that has it; with `last`, each value is that of the
    furthest base that is a row. Each type keeps one row, whose link leaps twice as far each round, so n types at depth d cost n rows in log2(d) joins.
    A base that isn't a row ends its chain; a chain that comes back to itself raises."""
    state, rounds = rows.groupBy("fqn").agg(F.max("base_fqn").alias("up"), *[F.max(v).alias(v) for v in values]), 0
    while True:
        above = state.select(F.col("fqn").alias("up"), F.col("up").alias("_up"), *[F.col(v).alias(f"_{v}") for v in values])
        both = [F.coalesce(f"_{v}", v) if last else F.coalesce(v, f"_{v}") for v in values]
        moved = state.filter(F.col("up").isNotNull()).join(above, "up", "left").select("fqn", F.col("_up").alias("up"), *[b.alias(v) for b, v in zip(both, values, strict=True)])
        state, rounds = state.filter(F.col("up").isNull()).unionByName(moved), rounds + 1
        if rounds % 3 == 0:
            state = resolve.cut(state)
        if state.filter(F.col("up").isNotNull()).isEmpty():
            return state.drop("up")
        if rounds > 40:  # 2 ** 40 levels
            raise ValueError("a chain of bases comes back to itself")


def nearest(chain: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(fqn, value) of the nearest type of the chain that has one; values: (owner_fqn, value)."""
    return chain.join(values.withColumnRenamed("owner_fqn", "base"), "base").groupBy("fqn").agg(F.min_by(value, "distance").alias(value))


def route_templates(attributes: DataFrame) -> DataFrame:
    """(owner_fqn, templates) of [Route] attributes, in order."""
    a = attributes.filter((F.col("class_name") == "RouteAttribute") & F.col("class_ns").startswith(R.MVC_NAMESPACE))
    t = F.coalesce(F.get("positional", F.lit(0)), F.lit(""))
    return a.groupBy("owner_fqn").agg(F.sort_array(F.collect_list(F.struct("ord", t.alias("t"))))["t"].alias("templates"))


def areas(attributes: DataFrame) -> DataFrame:
    """(owner_fqn, area): the first non-empty [Area] of each type."""
    t = F.get("positional", F.lit(0))
    a = attributes.filter((F.col("class_name") == "AreaAttribute") & (F.col("class_ns") == R.MVC_NAMESPACE) & (F.coalesce(t, F.lit("")) != ""))
    return a.groupBy("owner_fqn").agg(F.min_by(t, "ord").alias("area"))


def controllers(types: DataFrame, attributes: DataFrame) -> DataFrame:
    """Concrete classes that derive from a framework controller or carry [ApiController] themselves; rows of types have `derived`."""
    marked = attributes.filter(F.col("class_name") == "ApiControllerAttribute").select(F.col("owner_fqn").alias("fqn"), F.lit(True).alias("marked")).distinct()
    concrete = types.filter((F.col("type_kind") == "Class") & ~F.coalesce("is_abstract", F.lit(False)))
    return concrete.join(marked, "fqn", "left").filter(F.coalesce("derived", "marked", F.lit(False))).drop("marked")


def override_roots(methods: DataFrame) -> DataFrame:
    """(fqn, root): the method that an override finally overrides; itself where it overrides nothing."""
    links = methods.select("fqn", F.col("overridden_fqn").alias("base_fqn"), F.coalesce("overridden_fqn", "fqn").alias("root"))
    return along_bases(links, "root", last=True)


def actions(methods: DataFrame, attributes: DataFrame) -> DataFrame:
    """Public, declared, ordinary instance methods without [NonAction] whose override root isn't the framework's or object's."""
    non = attributes.filter(F.col("class_name") == "NonActionAttribute").select(F.col("owner_fqn").alias("fqn"))
    own = methods.filter((F.col("method_kind") == "Ordinary") & (F.col("accessibility") == "Public") & ~F.coalesce("is_static", F.lit(False)) & ~F.coalesce("is_implicit", F.lit(False)))
    rooted = own.join(non, "fqn", "left_anti").join(override_roots(methods), "fqn", "left")
    declaring = F.regexp_replace(F.regexp_replace("root", r"\(.*$", ""), r"\.[^.]*$", "")
    foreign = declaring.isin("System.Object", *CONTROLLER_BASES)
    return rooted.filter(~F.coalesce(foreign, F.lit(False)))


def verb_mappings(attributes: DataFrame) -> DataFrame:
    """(owner_fqn, mappings): (ord, verb, template?) of verb attributes, and of [Route] as ANY only where it is the first mapping."""
    verb = R.verb_of_attribute(F.col("class_name"), F.col("class_ns"))
    is_route = (F.col("class_name") == "RouteAttribute") & F.col("class_ns").startswith(R.MVC_NAMESPACE)
    rows = attributes.select("owner_fqn", "ord", F.when(is_route, "ANY").otherwise(verb).alias("verb"), is_route.alias("is_route"), F.get("positional", F.lit(0)).alias("template")).filter(F.col("verb").isNotNull())
    listed = rows.groupBy("owner_fqn").agg(F.sort_array(F.collect_list(F.struct("ord", "verb", "template", "is_route"))).alias("m"))
    return listed.select("owner_fqn", F.filter("m", lambda x, i: ~x["is_route"] | (i == 0)).alias("mappings"))


def controller_endpoints(types: DataFrame, methods: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per action, mapping, prefix and suffix: verb, route, handler and layered authorization."""
    own = route_templates(attributes)
    given = own.select(F.col("owner_fqn").alias("fqn"), F.col("templates").alias("prefixes"))
    placed = areas(attributes).withColumnRenamed("owner_fqn", "fqn")
    base = F.col("fqn").isin(*CONTROLLER_BASES) | F.coalesce(F.col("base_fqn").isin(*CONTROLLER_BASES), F.lit(False))
    inherited = along_bases(types.select("fqn", "base_fqn", F.when(base, True).alias("derived")).join(given, "fqn", "left").join(placed, "fqn", "left"), "derived", "prefixes", "area")
    ctl = controllers(types.join(inherited, "fqn"), attributes)
    auth = read_authorization(attributes)
    t_auth = auth.select(F.col("owner_fqn").alias("type_fqn"), *[F.col(c).alias(f"t_{c}") for c in ("requires", "anonymous", "policies", "roles")])
    m_auth = auth.select(F.col("owner_fqn").alias("fqn"), *[F.col(c).alias(f"m_{c}") for c in ("requires", "anonymous", "policies", "roles")])
    c = ctl.select(F.col("fqn").alias("type_fqn"), F.col("name").alias("controller"), "prefixes", "area")
    acts = (
        actions(methods, attributes)
        .select("fqn", "type_fqn", F.col("name").alias("action"), F.coalesce("display", "name").alias("display"))
        .join(c, "type_fqn")
        .join(verb_mappings(attributes).withColumnRenamed("owner_fqn", "fqn"), "fqn", "left")
        .join(own.select(F.col("owner_fqn").alias("fqn"), F.col("templates").alias("own_templates")), "fqn", "left")
        .join(t_auth, "type_fqn", "left")
        .join(m_auth, "fqn", "left")
    )
    has_prefix = F.coalesce(F.size("prefixes"), F.lit(0)) > 0
    mapping = "struct<ord:bigint,verb:string,template:string,is_route:boolean>"
    bare = F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.lit("ANY").alias("verb"), F.lit(None).cast("string").alias("template"), F.lit(False).alias("is_route"))).cast(f"array<{mapping}>")
    chosen = F.when(F.coalesce(F.size("mappings"), F.lit(0)) > 0, F.col("mappings")).when(has_prefix, bare).otherwise(F.array().cast(f"array<{mapping}>"))
    mapped = acts.withColumn("mapping", F.explode(chosen))
    suffixes = F.when(F.col("mapping.template").isNotNull(), F.array("mapping.template")).otherwise(F.col("own_templates"))
    full = mapped.withColumn("prefix", F.explode(R.or_empty(F.col("prefixes")))).withColumn("suffix", F.explode(R.or_empty(suffixes)))
    full = full.filter((F.length("prefix") > 0) | (F.length("suffix") > 0))
    put = lambda t: R.substitute_tokens(F.col(t), F.col("controller"), F.col("area"), F.col("action"))
    either = lambda a: F.coalesce(F.col(f"t_{a}"), F.lit(False)) | F.coalesce(F.col(f"m_{a}"), F.lit(False))
    return full.select(
        F.col("mapping.verb").alias("http_method"),
        R.combine(put("prefix"), put("suffix")).alias("route"),
        F.col("display").alias("handler_display"),
        F.col("fqn").alias("handler_fqn"),
        F.lit("ControllerAction").alias("kind"),
        either("requires").alias("requires_auth"),
        either("anonymous").alias("allows_anonymous"),
        layered(F.col("t_policies"), F.col("m_policies")).alias("policies"),
        layered(F.col("t_roles"), F.col("m_roles")).alias("roles"),
        F.lit("Exact").alias("provenance"),
    ).distinct()


# ---- minimal API ---------------------------------------------------------------------------------------------


def group_prefixes(groups: DataFrame, links: DataFrame | None = None, max_depth: int = schema.MAX_GROUP_DEPTH) -> DataFrame:
    """(node_id, prefix): literals of the MapGroup calls from the outermost receiver down, each behind one slash and as it is but for slashes at its ends.
    groups: (node_id, parent_id, is_map_group, literal); parent_id is the receiver, or the initialiser of the local that holds it. Groups with a literal
    and locals count, at most max_depth of them; links: (node_id, is_local) tells of other nodes whether they are locals or calls between, which
    are free. Without it all other nodes count."""
    group = F.coalesce("is_map_group", F.lit(False)) & F.col("literal").isNotNull()
    part = F.when(group, F.concat(F.lit("/"), F.btrim("literal", F.lit("/")))).otherwise(F.lit(""))
    nodes = groups.select("node_id", "parent_id", group.alias("group"), part.alias("part"))
    if links is None:
        counted, near = nodes, nodes.select("node_id", F.col("node_id").alias("first"))
    else:
        kinds = links.groupBy("node_id").agg(F.bool_or("is_local").alias("is_local"))
        nodes = nodes.join(kinds, "node_id", "left").withColumn("counts", F.col("group") | F.coalesce("is_local", F.lit(True)))
        # the nearest node that counts, over any number of free calls
        near = enclosing(nodes.select("node_id", "parent_id", F.when(F.col("counts"), F.col("node_id").cast("string")).alias("symbol_fqn")))
        near = near.select("node_id", F.col("source_fqn").cast("long").alias("first"))
        above = near.select(F.col("node_id").alias("parent_id"), F.col("first").alias("up_id"))
        counted = nodes.filter("counts").join(above, "parent_id", "left").select("node_id", F.col("up_id").alias("parent_id"), "part")
    up = counted.select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("next_id"), F.col("part").alias("up"))
    out = counted.select("node_id", "part", "parent_id")
    for _ in range(max_depth - 1):
        out = out.join(up, "parent_id", "left").select("node_id", F.concat(F.coalesce("up", F.lit("")), F.col("part")).alias("part"), F.col("next_id").alias("parent_id"))
    prefix = out.select(F.col("node_id").alias("first"), F.col("part").alias("prefix"))
    return near.join(prefix, "first").select("node_id", "prefix")


def map_call_endpoints(calls: DataFrame, groups: DataFrame, chain: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Endpoints of map calls with a literal route. A handler that isn't one known method is inline and Inferred; the document stays whole."""
    prefix = group_prefixes(groups, links).withColumnRenamed("node_id", "receiver_id")
    rows = calls.filter(R.is_map_call(F.col("map_name"), F.col("first_param_type")) & F.col("route").isNotNull()).join(prefix, "receiver_id", "left")
    handler = F.when(F.col("n_args") >= 2, F.col("handler_fqn"))
    out = rows.select(
        "call_id",
        R.verb_of_map(F.col("map_name")).alias("http_method"),
        R.normalise(F.concat(F.coalesce("prefix", F.lit("")), F.lit("/"), F.btrim("route", F.lit("/")))).alias("route"),
        F.when(handler.isNotNull(), F.col("handler_display")).otherwise("inline handler").alias("handler_display"),
        handler.alias("handler_fqn"),
        F.lit("MinimalApi").alias("kind"),
        F.when(handler.isNotNull(), "Exact").otherwise("Inferred").alias("provenance"),
    )
    if chain is None:
        return out
    empty = F.array().cast("array<string>")
    auth = chain_authorization(chain)
    return out.join(auth, "call_id", "left").select(*out.columns, F.coalesce("requires", F.lit(False)).alias("requires_auth"), F.coalesce("anonymous", F.lit(False)).alias("allows_anonymous"), F.coalesce("policies", empty).alias("policies"), empty.alias("roles"))


def overloaded_handlers(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """One Warning row per document with map calls whose handler is a method group of several overloads; candidates: (call_id, candidate_fqn)."""
    several = candidates.groupBy("call_id").agg(F.countDistinct("candidate_fqn").alias("n")).filter("n > 1")
    rows = calls.filter(F.col("handler_fqn").isNull()).join(several, "call_id").groupBy("document").agg(F.count("*").alias("n"))
    text = F.concat(F.lit("Handlers with several overloads count as unresolved in "), F.coalesce("document", F.lit("an unnamed document")), F.lit(": "), F.col("n").cast("string"))
    return rows.select(F.lit("Warning").alias("severity"), F.lit(None).cast("string").alias("project"), text.alias("message"))


def with_dependencies(endpoints: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endpoints with id, their dependency rows): inline handlers take the dependencies of their call; ids follow route, method and handler."""
    numbered = resolve.assign_ids(endpoints, "route", "http_method", "handler_display", "handler_fqn", "call_id")
    inline = numbered.filter(F.col("handler_fqn").isNull()).select("call_id", F.col("id").alias("endpoint_id"))
    return numbered, dependencies.join(inline, "call_id").select("endpoint_id", "pos", "target_fqn", "target_display")


def inline_dependencies(parameters: DataFrame, calls: DataFrame, cap: int = schema.MAX_DEPENDENCIES) -> DataFrame:
    """(call_id, pos, target_fqn, target_display): lambda parameter types, then exactly bound calls, first of each name, at most `cap` each."""
    both = parameters.select("call_id", F.struct(F.lit(0).alias("part"), "ord").alias("at"), "target_fqn", "target_display").unionByName(
        calls.filter(F.col("target_fqn").isNotNull()).select("call_id", F.struct(F.lit(1).alias("part"), "ord").alias("at"), "target_fqn", "target_display")
    )
    first = both.groupBy("call_id", "target_fqn").agg(F.min(F.struct("at", "target_display")).alias("f"))
    numbered = first.withColumn("pos", F.row_number().over(Window.partitionBy("call_id").orderBy("f.at", "target_fqn")))
    return numbered.filter(F.col("pos") <= cap).select("call_id", F.col("pos").cast("long").alias("pos"), "target_fqn", F.col("f.target_display").alias("target_display"))


# ---- symbols and edges from facts ----------------------------------------------------------------------------


def symbols_from_facts(raw: DataFrame) -> DataFrame:
    """Declared, mapped symbols with ids by project (upper-cased name), input order and name. Namespaces need no source location."""
    kind = M.map_kind(F.col("kind_name"), F.col("type_kind"), F.col("is_record"))
    rows = raw.withColumn("kind", kind).filter(F.col("kind").isNotNull() & ~F.coalesce("is_implicit", F.lit(False)) & ((F.col("kind") == "Namespace") | F.coalesce("in_source", F.lit(False))))
    shaped = rows.select("project", "ord", "kind", "name", "fqn", "display", X.null_if_empty(F.col("namespace")).alias("namespace"), "container_fqn", "file_path", M.one_based(F.col("line0")).alias("line"), M.one_based(F.col("column0")).alias("start_column"), M.accessibility_of(F.col("kind"), F.col("accessibility")).alias("accessibility"))
    return resolve.assign_ids(shaped, F.upper("project"), "project", "ord", "fqn")


def enclosing(spans: DataFrame) -> DataFrame:
    """(node_id, source_fqn): the nearest ancestor-or-self that is an indexed member, however far up. Links point over ever longer runs of nodes
    without a member, so each node keeps one row; nodes whose ancestors have none drop out. A cycle raises."""
    known = spans.filter(F.col("symbol_fqn").isNotNull()).select("node_id", F.col("symbol_fqn").alias("source_fqn"))
    open_ = spans.filter(F.col("symbol_fqn").isNull() & F.col("parent_id").isNotNull()).select("node_id", "parent_id")
    done, rounds = known, 0
    while True:
        at = done.select(F.col("node_id").alias("parent_id"), "source_fqn")
        found = open_.join(at, "parent_id").select("node_id", "source_fqn")
        left = open_.join(found.select("node_id"), "node_id", "left_anti")
        further = open_.select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("next"))
        # a parent without a member of its own passes on where it points; one that points nowhere ends the walk
        open_ = resolve.cut(left.join(further, "parent_id").select("node_id", F.col("next").alias("parent_id")))
        done, rounds = resolve.cut(done.unionByName(found)), rounds + 1
        if open_.isEmpty():
            return done
        if rounds > 64:  # 2 ** 64 levels
            raise ValueError("a chain of parents comes back to itself")




def call_edges(raw_calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Calls edges: bound target that is declared in source and indexed, not the caller itself; first of each pair wins."""
    target, provenance = M.bind(F.col("exact_fqn"), F.col("candidate_fqns"))
    bound = raw_calls.select("project", "source_fqn", "ord", target.alias("target_fqn"), provenance.alias("provenance")).filter(F.col("target_fqn").isNotNull() & (F.col("target_fqn") != F.col("source_fqn")))
    methods = targets.filter(F.col("kind").isin("Method", "Constructor")).groupBy(F.col("fqn").alias("target_fqn")).agg(F.min("display").alias("target_display"))
    edges = bound.join(methods, "target_fqn").withColumn("kind", F.lit("Calls"))
    return resolve.first_wins(edges, ("project", "source_fqn", "kind", "target_fqn"))


def implements_edges(pairs: DataFrame) -> DataFrame:
    """pairs: (type_fqn, interface_member_fqn, impl_fqn, impl_type_fqn, impl_in_source): only members the type itself declares."""
    own = pairs.filter((F.col("impl_type_fqn") == F.col("type_fqn")) & F.coalesce("impl_in_source", F.lit(False)))
    return own.select(F.col("impl_fqn").alias("source_fqn"), F.lit("Implements").alias("kind"), F.col("interface_member_fqn").alias("target_fqn"), F.lit("Exact").alias("provenance")).distinct()


def override_edges(methods: DataFrame) -> DataFrame:
    rows = methods.filter(F.col("overridden_fqn").isNotNull())
    return rows.select(F.col("fqn").alias("source_fqn"), F.lit("Overrides").alias("kind"), F.col("overridden_fqn").alias("target_fqn"), F.lit("Exact").alias("provenance"))
