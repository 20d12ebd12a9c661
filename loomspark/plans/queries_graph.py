"""Queries of the iterative operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators.kinds import CHAIN_EDGES, SEMANTIC_NODES, sql_list
from .projection import Graph
from .registry import query


@query("neighbors_of_caches", "SELECT from_id AS source, to_id AS node, kind FROM edges WHERE from_id BETWEEN 4000000000 AND 4999999999 UNION ALL SELECT to_id, from_id, kind FROM edges WHERE to_id BETWEEN 4000000000 AND 4999999999")
def neighbors(g: Graph):
    return graph.neighbors(g.edges, g.nodes.where("kind IN ('Cache', 'Queue')"))


_STEP = f"s AS (SELECT from_id, to_id FROM edges WHERE kind IN ({sql_list(CHAIN_EDGES)}))"


@query("reach_from_contracts", f", {_STEP}, r(source, node, depth) AS (SELECT id, id, 0 FROM nodes WHERE kind = 'HttpContract' UNION SELECT source, to_id, depth + 1 FROM r JOIN s ON from_id = node WHERE depth < 4) SELECT source, node, min(depth) AS depth FROM r GROUP BY source, node")
def reach(g: Graph):
    own = g.edges.where(F.col("kind").isin(*CHAIN_EDGES))
    return graph.reach(own, g.nodes.where("kind = 'HttpContract'"), 4)


@query("subgraph_two_hops", f", {_STEP}, u AS (SELECT from_id, to_id FROM s UNION SELECT to_id, from_id FROM s), r(source, node, depth) AS (SELECT id, id, 0 FROM nodes WHERE kind = 'Cache' UNION SELECT source, to_id, depth + 1 FROM r JOIN u ON from_id = node WHERE depth < 2) SELECT source, node, min(depth) AS depth FROM r GROUP BY source, node")
def subgraph(g: Graph):
    return graph.reach(g.edges.where(F.col("kind").isin(*CHAIN_EDGES)), g.nodes.where("kind = 'Cache'"), 2, "both")


_CALL = "k AS (SELECT from_id, to_id, confidence FROM edges WHERE kind = 'Calls')"


@query("call_closure", f", {_CALL}, r(source, node, depth) AS (SELECT from_id, to_id, 1 FROM k UNION ALL SELECT source, to_id, depth + 1 FROM r JOIN k ON from_id = node) SELECT source, node, min(depth) AS depth FROM r GROUP BY source, node")
def call_closure(g: Graph):
    return graph.closure(g.edges.where("kind = 'Calls'"))


@query("propagate_effects", f", {_CALL}, seeds AS (SELECT kind, from_id AS source, to_id, confidence FROM edges WHERE kind IN ('WritesDb', 'PublishesTo')), r(source, node, c) AS (SELECT DISTINCT source, source, CAST(1 AS DOUBLE) FROM seeds UNION ALL SELECT source, k.from_id, c * confidence FROM r JOIN k ON k.to_id = node), p AS (SELECT source, node, max(c) AS c FROM r WHERE source <> node GROUP BY source, node) SELECT kind, node AS from_id, to_id, round(max(confidence * c), 6) AS confidence, count(DISTINCT source) AS sources FROM seeds JOIN p USING (source) WHERE (kind, node, to_id) NOT IN (SELECT (kind, from_id, to_id) FROM edges) GROUP BY kind, node, to_id")
def propagate(g: Graph):
    return graph.propagate(g.edges, ["WritesDb", "PublishesTo", "CallsHttp"]).select("kind", "from_id", "to_id", F.round("confidence", 6).alias("confidence"), F.size("sources").cast("long").alias("sources"))


@query("call_components", f", {_CALL}, u AS (SELECT from_id, to_id FROM k UNION SELECT to_id, from_id FROM k), r(node, label) AS (SELECT from_id, from_id FROM u UNION SELECT to_id, label FROM r JOIN u ON from_id = node) SELECT node, min(label) AS label FROM r GROUP BY node")
def call_components(g: Graph):
    return graph.components(g.edges.where("kind = 'Calls'"))


@query("call_longest_depth", f", {_CALL}, r(node, depth) AS (SELECT from_id, 0 FROM k UNION SELECT to_id, depth + 1 FROM r JOIN k ON from_id = node) SELECT node, max(depth) AS depth FROM r GROUP BY node")
def longest(g: Graph):
    return graph.longest_depth(g.edges.where("kind = 'Calls'"))


@query("simple_paths", ", e AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind IN ('HandledBy', 'Calls')), p AS (SELECT from_id AS a, max(to_id) AS b FROM edges WHERE kind = 'HandledBy' GROUP BY from_id), r(a, b, node, path) AS (SELECT a, b, a, [a] FROM p UNION ALL SELECT a, b, to_id, list_append(path, to_id) FROM r JOIN e ON from_id = node WHERE len(path) <= 8 AND node <> b AND NOT list_contains(path, to_id)), f AS (SELECT a, b, path, row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) AS place FROM r WHERE node = b AND len(path) > 1) SELECT a, b, array_to_string(path, '>') AS path FROM f WHERE place <= 4")
def paths(g: Graph):
    pairs = g.edges.where("kind = 'HandledBy'").groupBy(F.col("from_id").alias("a")).agg(F.max("to_id").alias("b"))
    found = graph.simple_paths(g.edges.where("kind IN ('HandledBy', 'Calls')"), pairs)
    return found.select("a", "b", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("follow_chain", ", h AS (SELECT from_id, min(to_id) AS m FROM edges WHERE kind = 'HandledBy' GROUP BY from_id), w AS (SELECT from_id, min(to_id) AS t FROM edges WHERE kind = 'WritesDb' GROUP BY from_id) SELECT h.from_id AS id, t AS \"end\" FROM h JOIN w ON w.from_id = m")
def follow(g: Graph):
    return graph.follow(g.edges, g.nodes.where("kind = 'HttpContract'"), ["HandledBy", "WritesDb"])


@query("fold_to_contracts", ", par AS (SELECT to_id AS node, min(from_id) AS parent FROM edges WHERE kind = 'HandledBy' GROUP BY to_id), top AS (SELECT id AS node, CASE WHEN kind = 'Method' THEN parent ELSE id END AS top FROM nodes LEFT JOIN par ON node = id) SELECT a.top AS from_id, b.top AS to_id, count(*) AS n FROM edges JOIN top a ON a.node = from_id JOIN top b ON b.node = to_id WHERE kind IN ('WritesDb', 'ReadsDb', 'Calls') AND a.top IS NOT NULL AND b.top IS NOT NULL AND a.top <> b.top GROUP BY 1, 2")
def fold(g: Graph):
    owner = g.edges.where("kind = 'HandledBy'").groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("parent"))
    parents = g.nodes.select("id", "kind").join(owner, "id", "left").select(F.col("id").alias("node"), "parent", "kind")
    return graph.lift(g.edges.where("kind IN ('WritesDb', 'ReadsDb', 'Calls')"), parents, F.col("kind") != "Method")


@query("semantic_value", f", {_STEP}, out AS (SELECT DISTINCT from_id AS source, to_id AS node FROM s), ring1 AS (SELECT source, node FROM out UNION SELECT node, source FROM out), ring2 AS (SELECT DISTINCT r.source, o.node FROM ring1 r JOIN out o ON o.source = r.node), ring3 AS (SELECT DISTINCT r.source, o.node FROM ring2 r JOIN out o ON o.source = r.node), f AS (SELECT source, node FROM out UNION SELECT * FROM ring2 UNION SELECT * FROM ring3), v AS (SELECT source, count(*) AS n FROM f WHERE node IN (SELECT id FROM nodes WHERE kind IN ({sql_list(SEMANTIC_NODES)})) GROUP BY source) SELECT id AS source, coalesce(n, 0) AS value FROM (SELECT DISTINCT id FROM nodes) LEFT JOIN v ON source = id")
def semantic_value(g: Graph):
    return graph.semantic_value(g.edges.where(F.col("kind").isin(*CHAIN_EDGES)), g.nodes, g.nodes.where(F.col("kind").isin(*SEMANTIC_NODES)))
