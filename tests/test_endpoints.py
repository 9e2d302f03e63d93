"""Route, controller and minimal-API rules on bound facts."""

from strandline.operators import endpoints as E
from strandline.schema import FACTS

MVC, BASE = "Microsoft.AspNetCore.Mvc", "Microsoft.AspNetCore.Mvc.ControllerBase"


def found(spark, types, methods, attributes):
    """types: (fqn, base, abstract); methods: (type, name, overridden); attributes: (owner, class, positional, named)."""
    t = spark.createDataFrame([(f, f.split(".")[-1], b, a, "Class") for f, b, a in types], FACTS["raw_types"])
    m = spark.createDataFrame([(f"{t_}.{n}()", t_, n, n, "Ordinary", "Public", False, False, o) for t_, n, o in methods], FACTS["raw_methods"])
    a = spark.createDataFrame([(o, i, c + "Attribute", MVC, p, n) for i, (o, c, p, n) in enumerate(attributes)], FACTS["raw_attributes"])
    return E.controller_endpoints(t, m, a).orderBy("route", "http_method").collect()


def routes(*a):
    return [f"{r['http_method']} {r['route']}" for r in found(*a)]


def test_plain_controller(spark):
    got = routes(spark, [("Api.UsersController", BASE, False)], [("Api.UsersController", "Get", None), ("Api.UsersController", "Add", None)],
                 [("Api.UsersController", "Route", ["api/[controller]"], {}), ("Api.UsersController.Get()", "HttpGet", ["{id}"], {}), ("Api.UsersController.Add()", "HttpPost", [], {})])
    assert got == ["POST /api/Users", "GET /api/Users/{id}"]


def test_inherited_and_own_routes(spark):
    types = [("B.Base", BASE, True), ("B.Mid", "B.Base", True), ("B.ParcelsController", "B.Mid", False), ("B.DirectController", "B.Mid", False)]
    methods = [("B.ParcelsController", "List", None), ("B.DirectController", "List", None)]
    attrs = [("B.Base", "Route", ["depot/v3/[controller]"], {}), ("B.DirectController", "Route", ["depot/v4/[controller]"], {}), ("B.ParcelsController.List()", "HttpGet", [], {}), ("B.DirectController.List()", "HttpGet", ["/up"], {})]
    assert routes(spark, types, methods, attrs) == ["GET /depot/v3/Parcels", "GET /up"]


def test_area_tokens_and_parameters(spark):
    c = "X.DeskController"
    types, methods = [(c, BASE, False)], [(c, "Show", None), (c, "Call", None)]
    assert routes(spark, types, methods, [(c, "Route", ["desk/{action=Show}/{ticket?}"], {})]) == ["ANY /desk/Call/{ticket?}", "ANY /desk/Show/{ticket?}"]
    assert routes(spark, types, methods[:1], [(c, "Route", ["[area]/kiosk/{slot:int}/[controller]"], {}), (c, "Area", ["halls"], {})]) == ["ANY /halls/kiosk/{slot:int}/Desk"]
    assert routes(spark, types, methods[:1], [(c, "Route", ["[area]/loose"], {})]) == ["ANY /[area]/loose"]
    assert routes(spark, types, methods[:1], [(c, "Route", ["x/{action:regex(^[0-9]+$)}"], {})]) == ["ANY /x/{action:regex(^[0-9]+$)}"]
    assert routes(spark, types, methods, []) == []


def test_actions_and_non_controllers(spark):
    c = "X.HomeController"
    types = [(c, BASE, False), ("X.Plain", None, False), ("X.Api", None, False)]
    methods = [(c, "Index", None), (c, "ToString", "System.Object.ToString()"), (c, "Skip", None), ("X.Plain", "Index", None), ("X.Api", "Go", None)]
    attrs = [(c, "Route", ["mixed"], {}), (f"{c}.Skip()", "NonAction", [], {}), ("X.Plain", "Route", ["p"], {}), ("X.Api", "ApiController", [], {}), ("X.Api", "Route", ["z"], {})]
    assert routes(spark, types, methods, attrs) == ["ANY /mixed", "ANY /z"]


def test_authorization_layers(spark):
    c = "X.AController"
    got = found(spark, [(c, BASE, False)], [(c, "Get", None)],
                [(c, "Route", ["a"], {}), (c, "Authorize", ["Managers"], {}), (f"{c}.Get()", "Authorize", [], {"Policy": "Elevated", "Roles": "ops, sre,"}), (f"{c}.Get()", "AllowAnonymous", [], {})])
    assert got[0]["policies"] == ["Managers", "Elevated"] and got[0]["roles"] == ["ops", "sre"] and got[0]["requires_auth"] and got[0]["allows_anonymous"]


def test_map_calls(spark):
    anchor = "Microsoft.AspNetCore.Routing.IEndpointRouteBuilder"
    calls = spark.createDataFrame(
        [(1, "d", "MapGet", anchor, "/ping", 2, "Api.Routes.Handle()", "Handle", None), (2, "d", "MapPost", anchor, "/echo", 2, None, None, None), (3, "d", "MapGet", anchor, None, 2, None, None, None), (4, "d", "MapGet", anchor, "/users", 2, None, None, 20), (5, "d", "MapGet", "Other", "/no", 2, None, None, None)],
        FACTS["raw_map_calls"],
    )
    groups = spark.createDataFrame([(10, None, True, "/api"), (15, 10, False, None), (20, 15, True, "/v1")], FACTS["raw_groups"])
    chain = spark.createDataFrame([(2, 1, "RequireAuthorization", ["Writers"])], "call_id long, ord long, method string, literals array<string>")
    got = {r["call_id"]: r for r in E.map_call_endpoints(calls, groups, chain).collect()}
    assert {k: (v["http_method"], v["route"], v["provenance"]) for k, v in got.items()} == {1: ("GET", "/ping", "Exact"), 2: ("POST", "/echo", "Inferred"), 4: ("GET", "/api/v1/users", "Inferred")}
    assert got[2]["policies"] == ["Writers"] and got[2]["requires_auth"] and not got[1]["requires_auth"]


def test_symbols_and_calls_from_facts(spark):
    raw = spark.createDataFrame(
        [("b", 1, "NamedType", "Struct", True, False, True, "R", "N.R", "R", "N", None, "/f.cs", 0, 4, "Public"), ("A", 1, "Method", "StaticConstructor", False, False, True, "C", "N.C", "C", "", None, None, None, None, "Private"), ("A", 2, "Method", "PropertyGet", False, False, True, "g", "N.g", "g", "N", None, None, None, None, None)],
        FACTS["raw_symbols"],
    )
    got = [(r["id"], r["kind"], r["namespace"], r["line"]) for r in E.symbols_from_facts(raw).orderBy("id").collect()]
    assert got == [(1, "Constructor", None, None), (2, "Record", "N", 1)]
    targets = spark.createDataFrame([("Method", "T", "T"), ("Property", "P", "P")], "kind string, fqn string, display string")
    calls = spark.createDataFrame([("A", "S", 1, None, ["T"]), ("A", "S", 2, "T", None), ("A", "S", 3, None, ["T", "U"]), ("A", "T", 4, "T", None), ("A", "S", 5, "P", None)], FACTS["raw_calls"])
    assert [(r["source_fqn"], r["target_fqn"], r["provenance"]) for r in E.call_edges(calls, targets).collect()] == [("S", "T", "Inferred")]
    spans = spark.createDataFrame([(1, None, "M"), (2, 1, None), (3, 2, None), (4, None, None)], FACTS["raw_spans"])
    assert {r["node_id"]: r["source_fqn"] for r in E.enclosing(spans).collect()} == {1: "M", 2: "M", 3: "M"}
