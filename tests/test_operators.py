import random

from pyspark.sql import functions as F

from loomspark.functions import naming
from loomspark.operators import graph, joins, phases, store
from loomspark.plans import recall
from loomspark.plans.projection import Graph
from loomspark.streaming import watch


def edges(spark, pairs, kind="Calls"):
    return spark.createDataFrame([(kind, a, b, c) for a, b, c in pairs], "kind string, from_id long, to_id long, confidence double")


def random_edges(seed, n=30, m=45):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def test_reach_components_against_plain_python(spark):
    pairs = random_edges(1)
    e = edges(spark, [(a, b, 1.0) for a, b in pairs])
    out = {}
    for s in range(30):
        level, seen = [s], {s: 0}
        while level:
            level = [b for x in level for a, b in pairs if a == x and b not in seen and not seen.update({b: seen[x] + 1})]
        out.update({(s, n): d for n, d in seen.items()})
    sources = spark.range(30)
    assert {(r.source, r.node): r.depth for r in graph.reach(e, sources, 40).collect()} == out
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.label for r in graph.components(e).collect()} == label


def test_best_products_stop_on_cycles_and_take_the_best_path(spark):
    e = edges(spark, [(2, 1, 0.5), (3, 2, 0.5), (3, 1, 0.2), (1, 3, 1.0)])
    got = {r.node: round(r.confidence, 6) for r in graph.best_products(e, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.25}


def test_best_products_equal_relaxation_on_random_graphs(spark):
    rng = random.Random(12)
    pairs = [(a, b, rng.choice([0.5, 0.7, 1.0])) for a, b in random_edges(12, 14, 26)]
    best = {(s, s): 1.0 for s in (0, 1, 2)}
    for _ in range(40):
        for (s, n), c in list(best.items()):
            for a, b, w in pairs:  # callers of n
                if b == n and c * w > best.get((s, a), 0) + 1e-12:
                    best[s, a] = c * w
    got = {(r.source, r.node): r.confidence for r in graph.best_products(edges(spark, pairs), spark.range(3)).collect()}
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1e-9 for k in best)


def test_propagate_keeps_direct_edges_and_skips_http(spark):
    e = edges(spark, [(2, 1, 0.7)]).union(edges(spark, [(1, 9, 0.8), (2, 8, 1.0)], "WritesDb")).union(edges(spark, [(1, 7, 1.0)], "CallsHttp"))
    got = [(r.kind, r.from_id, r.to_id, round(r.confidence, 6), r.sources) for r in graph.propagate(e, ["WritesDb", "CallsHttp"]).collect()]
    assert got == [("WritesDb", 2, 9, 0.56, [1])]


def test_paths_depth_fixpoint_lift(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 1, 1.0)])
    found = graph.simple_paths(e, spark.createDataFrame([(1, 3)], "a long, b long"), 4)
    assert [r.path for r in found.orderBy(F.size("path")).collect()] == [[1, 3], [1, 2, 3]]
    chain = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)])
    assert {r.node: r.depth for r in graph.longest_depth(chain).collect()} == {1: 0, 2: 1, 3: 2}
    grown = graph.fixpoint(spark.createDataFrame([(1,)], "x long"), lambda k: k.where("x < 5").select((F.col("x") + 1).alias("x")))
    assert sorted(r.x for r in grown.collect()) == [1, 2, 3, 4, 5]
    parents = spark.createDataFrame([(1, None, True), (2, 1, False), (3, 2, False), (4, None, True)], "node long, parent long, shown boolean")
    assert [tuple(r) for r in graph.lift(edges(spark, [(3, 4, 1.0), (2, 4, 1.0), (3, 2, 1.0)]), parents, F.col("shown")).collect()] == [(1, 4, 2)]


def test_empty_graphs(spark):
    e = edges(spark, [(1, 1, 1.0)]).where("false")
    assert graph.reach(e, spark.range(0), 3).isEmpty() and graph.components(e).isEmpty() and graph.closure(e).isEmpty()


def test_joins(spark):
    roots = spark.createDataFrame([("a/b", "1"), ("a", "2"), ("a/bc", "3")], "root string, value string")
    paths = spark.createDataFrame([("a/b/x",), ("a/bcd",), ("z",), (None,)], "path string")
    assert {r.path: r.value for r in joins.longest_prefix(paths, "path", roots, "root", "value").collect()} == {"a/b/x": "1", "a/bcd": "2", "z": None, None: None}
    names = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 3), (None, 4)], "name string, id long")
    assert [tuple(r) for r in joins.unique_or_null(names, "name", "id").collect()] == [("y", 3)]
    points = spark.createDataFrame([(1, "f", 5), (2, "g", 5)], "id long, file string, line int")
    spans = spark.createDataFrame([("f", 4, 6, "inner"), ("f", 1, 9, "outer"), ("f", 7, 9, "no")], "file string, a int, b int, label string")
    assert [tuple(r) for r in joins.enclosing(points, spans, "file", "line", "a", "b", "label", "id").collect()] == [(1, ["outer", "inner"])]


def test_store(spark):
    old = spark.createDataFrame([("k", 1)], "key string, v int")
    new = spark.createDataFrame([("k", 2), ("l", 3)], "key string, v int")
    assert {tuple(r) for r in store.apply_delta(old, new, ["key"], "first").collect()} == {("k", 1), ("l", 3)}
    assert {tuple(r) for r in store.apply_delta(old, new, ["key"], "last").collect()} == {("k", 2), ("l", 3)}
    e = edges(spark, [(1, 2, 1.0), (1, 3, 1.0)], "MapsTo").union(edges(spark, [(1, 2, 1.0)], "ReadsDb"))
    assert {(r.kind, r.to_id) for r in store.without_reads_covered_by(e).collect()} == {("MapsTo", 3), ("ReadsDb", 2)}


def test_phases(spark):
    sinks = spark.createDataFrame([(1, "f", "q"), (2, "f", "z")], "id long, owner string, var string")
    assigned = spark.createDataFrame([("f", "q", "'a' . $b"), ("f", "b", "$_GET['x']"), ("f", "z", "$z . 'c'")], "owner string, var string, rhs string")
    assert {tuple(r) for r in phases.tainted(sinks, assigned, r"\$_GET").collect()} == {(1, "tainted"), (2, "tainted_unknown")}
    tables = spark.createDataFrame([(1, "user"), (2, "Orders")], "id long, name string")
    schema = spark.createDataFrame([("users", ["a"]), ("orders", ["b", "c"])], "table string, columns array<string>")
    assert {tuple(r) for r in phases.columns_of_tables(tables, schema).collect()} == {(1, "a"), (2, "b"), (2, "c")}
    contracts = spark.createDataFrame([(1, 1, "frontend", "GET /a"), (2, 2, "backend", "ANY /a"), (3, 3, "backend", "GET /a"), (4, 1, "backend", "GET /a")], "id long, sub long, side string, name string")
    assert [tuple(r) for r in phases.bridge(contracts).collect()] == [(1, 3, 0)]


def test_bridge_moves_contracts_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(phases, "FRONT_CELL", 3)
    monkeypatch.setattr(phases, "BACK_ROW", 2)
    draw = random.Random(3)
    rows = [(i, draw.choice([None, 1, 2, 3]), draw.choice(["frontend", "backend", None]), draw.choice([None, "GET /a", "GET /a", "ANY /a", "RULE /a", "POST /b", "ANY /b", "GET /c", "x", "", "x"])) for i in range(200)]
    cut = lambda name: ((name.split(" ", 1) + [""])[:2] if name is not None else (None, None))
    met = set()
    for i, a, side, name in rows:
        for j, b, other, served in rows:
            (m, path), (method, there) = cut(name), cut(served)
            if (side, other) == ("frontend", "backend") and None not in (a, b, name, served) and a != b and path == there and (m == method or method in ("ANY", "RULE")):
                met.add((i, j, 0 if m == method else 1))
    best = {i: min(t for x, _, t in met if x == i) for i, _, _ in met}
    found = phases.bridge(spark.createDataFrame(rows, "id long, sub long, side string, name string"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in met if x[2] == best[x[0]]}
    # above the join that makes pairs nothing is shuffled
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    last = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan[plan.index("AdaptiveSparkPlan") :]
    pairs = next(i for i, x in enumerate(last.splitlines()) if "NOT (a#" in x)
    assert not any("Exchange" in x for x in last.splitlines()[:pairs])


def test_one_kind_needs_no_written_graph(spark):
    g = Graph(spark, "/root/testdata/sf0.001")
    asked = g._view("nodes", written=False).where("kind = 'HttpContract'")
    assert "lineitem" not in asked._jdf.queryExecution().optimizedPlan().toString() and "l_orderkey" not in asked._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(asked.collect()) == sorted(g.nodes.where("kind = 'HttpContract'").collect()) == sorted(g.nodes_of("HttpContract").collect())


def test_naming(spark):
    rows = spark.createDataFrame([("app\\model\\StoreOrder",), ("quiz",), ("box",), ("UserRights",), ("status",), ("day",), ("",)], "s string")
    got = [tuple(r) for r in rows.select(naming.snake_plural("s"), naming.singularize(naming.pluralize("s"))).collect()]
    assert [g[0] for g in got] == ["store_orders", "quizzes", "boxes", "user_rights", "statuses", "days", ""]
    assert [g[1] for g in got[1:3]] == ["quiz", "box"]
    one = spark.createDataFrame([(" eb_eb_order/:id?x=1",)], "s string")
    assert one.select(naming.normalize("s", [("strip_prefix", ["eb_"]), "strip_query", "param_wildcard", "leading_slash"])).first()[0] == "/order/:*"
    calls = spark.createDataFrame([("app\\Cache", "get"), ("MyCache", "get"), (None, "get")], "r string, m string")
    assert [r[0] for r in calls.select(naming.callee_matches("r", "m", "*Cache::{get, set}")).collect()] == [True, False, False]


def test_recall_terms_and_watch(spark):
    assert recall.terms_of("Where is the order table of the order?") == ["order", "table"]
    assert watch.poll_interval(10) == 2 and watch.poll_interval(10, 9) == 30
    listing = lambda *x: spark.createDataFrame(list(x), "path string, hash string")
    assert {tuple(r) for r in watch.snapshot_diff(listing(("a", "1"), ("b", "1")), listing(("b", "2"), ("c", "1"))).collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}
