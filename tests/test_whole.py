"""Queries over whole tables, against plain Python on the smallest tables."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.operators import graph
from loomspark.operators.kinds import CHAIN_EDGES, SEMANTIC_NODES
from loomspark.plans import registry
from loomspark.plans.projection import Graph

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def parts(spark):
    g = Graph(spark, DATA)
    nodes = {r.id: r for r in g.nodes.select("id", "kind", "name", "side", "sub").collect()}
    return nodes, [tuple(r) for r in g.edges.select("kind", "from_id", "to_id").collect()]


def ends(edges, kinds):
    out = defaultdict(set)
    for kind, a, b in edges:
        if kind in kinds:
            out[a].add(b)
    return out


def rows(spark, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, DATA).select(*columns).collect())


def test_edges_of_all_tables_and_methods(spark, parts):
    nodes, edges = parts
    own = {i for i, n in nodes.items() if n.kind in ("Table", "Method")}
    for name, at in (("out", 1), ("in", 2)):
        assert rows(spark, f"edges_{name}_of_tables_and_methods", "kind", "from_id", "to_id") == sorted(e for e in edges if e[at] in own)


def test_bridge_of_all_contracts(spark, parts):
    own = [(n.id, n.side, n.sub, re.sub(r"/\d+$", "", n.name)) for n in parts[0].values() if n.kind == "HttpContract"]
    true = sorted((f[0], b[0]) for f in own for b in own if f[1] == "frontend" and b[1] == "backend" and f[2] != b[2] and f[3] == b[3])
    assert rows(spark, "contract_bridge", "from_id", "to_id") == true


def test_reach_from_all_contracts(spark, parts):
    nodes, edges = parts
    step, true = ends(edges, CHAIN_EDGES), []
    for source in (i for i, n in nodes.items() if n.kind == "HttpContract"):
        depth, level = {source: 0}, {source}
        for d in range(1, 5):
            level = {b for a in level for b in step[a]} - depth.keys()
            depth.update(dict.fromkeys(level, d))
        true += [(source, node, d) for node, d in depth.items()]
    assert rows(spark, "reach_from_contracts", "source", "node", "depth") == sorted(true)


def test_simple_paths_of_all_contracts_to_eight_hops(spark, parts):
    edges = parts[1]
    step, true = ends(edges, ("HandledBy", "Calls")), []
    for a, handlers in ends(edges, ("HandledBy",)).items():
        b, found, level = max(handlers), [], [(a,)]
        for _ in range(8):
            level = [(*p, n) for p in level for n in step[p[-1]] if n not in p]
            found += sorted(p for p in level if p[-1] == b)
            level = [p for p in level if p[-1] != b]
        true += [(a, b, ">".join(map(str, p))) for p in found[:4]]
    assert max(p.count(">") for _, _, p in true) > 3
    assert rows(spark, "simple_paths", "a", "b", "path") == sorted(true)


def chain(spark, n):
    return spark.range(n).selectExpr("'Calls' AS kind", "id AS from_id", "id + 1 AS to_id", "1.0D AS confidence")


def test_closure_has_no_limit_and_least_depths(spark):
    found = {(r.source, r.node): r.depth for r in graph.closure(chain(spark, 210)).collect()}
    assert found == {(a, b): b - a for a in range(211) for b in range(a + 1, 211)}
    rng = random.Random(6)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(40)}
    true = {}
    for source in {a for a, _ in pairs}:
        depth, level, d = {source: 0}, {source}, 0
        while level := {b for a, b in pairs if a in level} - depth.keys():
            d += 1
            depth.update(dict.fromkeys(level, d))
        true |= {(source, node): d for node, d in depth.items() if d}
    edges = spark.createDataFrame([("Calls", a, b, 1.0) for a, b in pairs], "kind string, from_id long, to_id long, confidence double")
    assert {(r.source, r.node): r.depth for r in graph.closure(edges).collect()} == true


def test_propagation_reaches_every_caller(spark):
    write = spark.createDataFrame([("WritesDb", 67, 900, 0.5)], "kind string, from_id long, to_id long, confidence double")
    found = graph.propagate(chain(spark, 67).union(write), ["WritesDb"])
    assert sorted(r.from_id for r in found.collect()) == list(range(67))
    with pytest.raises(ValueError):
        graph.best_products(chain(spark, 2).withColumn("confidence", F.lit(1.5)), spark.range(1))


def test_longest_depth_has_no_limit_and_refuses_cycles(spark):
    assert {r.node: r.depth for r in graph.longest_depth(chain(spark, 67)).collect()} == {i: i for i in range(68)}
    with pytest.raises(ValueError, match="2 nodes"):
        graph.longest_depth(spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "from_id long, to_id long"))


def test_semantic_value_of_every_node(spark, parts):
    nodes, edges = parts
    out = ends(edges, CHAIN_EDGES)
    into = ends([(k, b, a) for k, a, b in edges], CHAIN_EDGES)
    true = []
    for centre in nodes:  # breadth first, as the reference walks
        ring, queue, found = {centre: 0} | {n: 1 for n in into[centre] if n != centre}, [centre, *(into[centre] - {centre})], set()
        for node in queue:
            if ring[node] < 3:
                found |= {n for n in out[node] if n in nodes and nodes[n].kind in SEMANTIC_NODES}
                queue += [n for n in out[node] if n not in ring]
                ring |= {n: ring[node] + 1 for n in out[node] if n not in ring}
        true.append((centre, len(found)))
    assert rows(spark, "semantic_value", "source", "value") == sorted(true)
