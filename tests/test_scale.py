"""Steps that must grow no faster than their input: repeated names, hubs, long documents."""

from strandline import queries
from strandline.operators import resolve, spans, trace
from strandline.schema import FACTS, STAGED_RELATIONS, TABLES
from strandline.sources import adapter


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def made(spark, folder, suppliers=4, parts=9):
    """A folder with the tables that symbols are made from."""
    tables = {
        "region": spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": spark.createDataFrame([(i, f"S{i}", 0) for i in range(suppliers)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": spark.createDataFrame([(i, f"p {i}", "T", i) for i in range(parts)], "p_partkey long, p_name string, p_type string, p_size int"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return adapter.Model(spark, str(folder))


def test_symbols_with_a_name_are_joined_by_key(spark, tmp_path):
    m = made(spark, tmp_path)
    named = m.symbols.filter("fqn is not null")
    plan = named._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["id"]: r["fqn"] for r in named.collect()}
    assert got == {i: f"R.S{i}" for i in range(4)} | {1_000_000 + i: f"R.S{i % 4}.p_{i}(T)" for i in range(9)}


def test_no_types_no_members(spark, tmp_path):
    assert made(spark, tmp_path, suppliers=0).symbols.count() == 0


def test_sql_of_symbols_stays(spark):
    assert "cross join n" in queries.ORACLE["callees"] and "cross join n" not in adapter.SPARK_SYMBOLS


def test_repeated_edges_of_repeated_names_merge_before_they_meet(spark):
    s = spark.createDataFrame([(i, "Method", n, f"X.{n}", n, 1, None, None, None, None, None, None) for i, n in enumerate("AAABBB", 1)], TABLES["symbols"])
    staged = spark.createDataFrame([(1, "X.A", "Calls", "X.B", "b", "Inferred")] * 4 + [(1, "X.A", "Calls", "X.B", "b", "Exact"), (1, "X.A", "Calls", "X.B", "c", "Exact")], STAGED_RELATIONS)
    merged = resolve.merge_edges(staged, s)
    assert {tuple(r) for r in merged.collect()} == {(i, "Calls", "X.B", "b", "Exact") for i in (1, 2, 3)}
    assert merged.count() == 3
    plan = optimized(merged)
    assert plan.index("Join ") < plan.rindex("Aggregate ")  # rows of one name merge below the join


def test_endpoints_that_enter_alike_share_a_walk(spark):
    s = spark.createDataFrame([(i, "Method", n, n, n, 1, None, None, None, None, None, None) for i, n in enumerate("ABC", 1)], TABLES["symbols"])
    r = resolve.resolve_edges(spark.createDataFrame([(1, "A", "Calls", "B", "B", "Exact"), (1, "C", "Implements", "B", "B", "Exact")], STAGED_RELATIONS), s)
    e = spark.createDataFrame([(i, "A" if i % 2 else None) for i in range(1, 7)], "id long, handler_fqn string")
    d = spark.createDataFrame([(i, p, x) for i in (2, 4) for p, x in ((2, 1), (1, 3))], "endpoint_id long, pos long, symbol_id long")
    walk = [(1, 0, "Entry", "Expanded"), (2, 1, "Calls", "Expanded"), (3, 2, "Implements", "Terminal")]
    other = [(3, 0, "Entry", "Terminal"), *walk[:2], (3, 2, "Implements", "Repeated")]
    for most in (trace.BROADCAST_EDGES, -1):
        steps = trace.trace(e, d, r, s, broadcast_edges=most)
        got = {}
        for x in steps.orderBy("endpoint_id", "seq").collect():
            got.setdefault(x["endpoint_id"], []).append((x["symbol_id"], x["depth"], x["step_kind"], x["step_end"]))
        assert got == {1: walk, 3: walk, 5: walk, 2: other, 4: other}
    plan = optimized(trace.trace(e, d, r, s))
    assert "Aggregate [entry" in plan[plan.index("MapInPandas") :]
    assert "Union" not in optimized(trace.edges(r))  # relations are read once for both kinds of edges


def test_a_long_document_is_not_one_tasks(spark, monkeypatch):
    monkeypatch.setattr(spans, "STRETCH", 200)
    found = [("f", i, 6000 - i, i, f"D{i}" if i % 3 else None, None) for i in range(40)]  # nested, over all stretches
    found += [("f", 100 + 10 * i, 106 + 10 * i, 100 + i, f"M{i}", None) for i in range(500)]
    places = [(at, "f", at) for at in range(6100)] + [(10_000 + i, "f", 3001) for i in range(1000)]

    def want(at):
        i = (at - 100) // 10
        if 0 <= i < 500 and (at - 100) % 10 < 6:
            return f"M{i}"
        return next((f"D{j}" for j in range(39, -1, -1) if j % 3 and j <= at < 6000 - j), None)

    got = spans.enclosing_spans(spark.createDataFrame(found, FACTS["raw_declarations"]), spark.createDataFrame(places, "node_id long, document string, at long"))
    assert {r["node_id"]: r["source_fqn"] for r in got.collect()} == {n: want(at) for n, _, at in places if want(at)}
    plan = optimized(got)
    assert "windowspecdefinition(document" not in plan and "windowspecdefinition(stretch" in plan


def test_rounds_go_by_level_and_keep_no_unfinished_walk(spark, monkeypatch):
    wide = 40
    kids = {1: [2 + i for i in range(wide)]} | {2 + i: [100 + 3 * i, 101 + 3 * i] for i in range(wide)} | {100 + 3 * i: [102 + 3 * i, 1] for i in range(wide)} | {101 + 3 * i: [2 + (i + 1) % wide] for i in range(wide)}
    ids = sorted({*kids, *(x for to in kids.values() for x in to)})
    s = spark.createDataFrame([(i, "Method", f"n{i:04}", f"n{i:04}", f"n{i:04}", 1, None, None, None, None, None, None) for i in ids], TABLES["symbols"])
    r = resolve.resolve_edges(spark.createDataFrame([(1, f"n{a:04}", "Calls", f"n{b:04}", "", "Exact") for a, to in kids.items() for b in to], STAGED_RELATIONS), s)
    e = spark.createDataFrame([(i, f"n{i:04}") for i in ids[:45]], "id long, handler_fqn string")
    d = spark.createDataFrame([], "endpoint_id long, pos long, symbol_id long")
    tables = []
    cut = resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda df: (tables.append(df.columns), cut(df))[1])
    for depth, steps in ((8, 400), (2, 50)):
        tables.clear()
        rounds = trace.trace(e, d, r, s, depth, steps, broadcast_edges=-1)
        assert len(tables) <= 6 + 2 * (depth + 4)  # a table of lists and one of walks a round
        assert not any("walk" in c for c in tables)
        assert sorted(map(tuple, rounds.collect())) == sorted(map(tuple, trace.trace(e, d, r, s, depth, steps).collect()))
