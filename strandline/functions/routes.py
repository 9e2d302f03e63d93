"""Route algebra on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import text as X

# Map method -> verb.
MAP_METHODS = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH", "MapMethods": "ANY"}
ROUTING_ANCHOR = "Microsoft.AspNetCore.Routing.IEndpointRoute"
MVC_NAMESPACE = "Microsoft.AspNetCore.Mvc"


def normalise(route: Column) -> Column:
    return F.concat(F.lit("/"), F.btrim(route, F.lit("/")))


def combine(prefix: Column, suffix: Column) -> Column:
    """A suffix from / or ~/ replaces the prefix; otherwise both are joined by one slash."""
    rooted = suffix.startswith("/") | suffix.startswith("~/")
    joined = F.when(F.length(prefix) == 0, suffix).otherwise(F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"), suffix))
    return normalise(F.when(rooted, F.ltrim(suffix, F.lit("~"))).otherwise(joined))


def _literal_replacement(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\$])", r"\\$1")


def substitute_parameter(template: Column, name: str, value: Column) -> Column:
    """{name} or {name=default} becomes the value. Only the first '{name' counts: if a longer name or a constraint follows, nothing changes."""
    opening = "{" + name

    def cut(t: Column) -> Column:
        at = F.locate(opening, F.lower(t))
        after = F.substring(t, at + len(opening), F.length(t))
        close = F.locate("}", after)
        follows = F.substring(after, 1, 1)
        ok = (at > 0) & (close > 0) & follows.isin("}", "=") & value.isNotNull()
        return F.when(F.coalesce(ok, F.lit(False)), F.concat(F.substring(t, F.lit(1), at - 1), value, F.substring(after, close + 1, F.length(after)))).otherwise(t)

    return X.let(template, cut)


def substitute_tokens(template: Column, controller: Column, area: Column, action: Column) -> Column:
    """[controller], [area] and [action] in any case, all occurrences; then {area} and {action}, {controller}. A null value leaves its token."""
    out = template
    for name, value in (("controller", F.regexp_replace(controller, "(?<=.)Controller$|^Controller$", "")), ("area", area), ("action", action)):
        token = F.lit(rf"(?i)\[{name}\]")
        out = X.let(out, lambda t, token=token, value=value: F.when(value.isNotNull(), F.regexp_replace(t, token, _literal_replacement(value))).otherwise(t))
        out = substitute_parameter(out, name, value)
    return out


def verb_of_attribute(class_name: Column, class_ns: Column) -> Column:
    """Verb from an attribute class such as HttpGetAttribute; null for others."""
    verb = F.upper(F.regexp_extract(class_name, r"^Http(.+)Attribute$", 1))
    return F.when(class_ns.startswith(MVC_NAMESPACE) & (verb != ""), verb)


def verb_of_map(map_name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MAP_METHODS.items() for x in kv])[map_name]


def is_map_call(map_name: Column, first_param_type: Column) -> Column:
    return F.coalesce(verb_of_map(map_name).isNotNull() & first_param_type.startswith(ROUTING_ANCHOR), F.lit(False))


def or_empty(options: Column) -> Column:
    """An empty or null option list still gives one empty option."""
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, options).otherwise(F.array(F.lit("")))
