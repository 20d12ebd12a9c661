"""Queries of views, ranking and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import store, views
from ..operators.kinds import CHAIN_EDGES, SEMANTIC_EDGES, SEMANTIC_NODES, SEVERITY_RANK, sql_list
from . import knowledge, ranking
from .projection import Graph
from .queries_recall import _LEXICAL, TERMS, _hits
from .registry import query

_STEP = f"s AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind IN ({sql_list(CHAIN_EDGES)}))"
PERSPECTIVES = knowledge.load_perspectives("""
perspectives:
  - {id: api, center: HttpContract, side: backend, depth: 9}
  - {id: table, center: Table}
  - {id: page, center: Page}
""")


def _chain(g: Graph):
    return g.edges.where(F.col("kind").isin(*CHAIN_EDGES))


@query("view_candidates", f", {_STEP}, c AS (SELECT id, name FROM nodes WHERE kind = 'HttpContract' AND side = 'backend' AND contains(lower(name), 'list')), r1 AS (SELECT c.id AS source, to_id AS node FROM c JOIN s ON from_id = c.id UNION SELECT c.id, from_id FROM c JOIN s ON to_id = c.id), o AS (SELECT c.id AS source, to_id AS node FROM c JOIN s ON from_id = c.id), r2 AS (SELECT DISTINCT source, to_id AS node FROM r1 JOIN s ON from_id = node), r3 AS (SELECT DISTINCT source, to_id AS node FROM r2 JOIN s ON from_id = node), f AS (SELECT * FROM o UNION SELECT * FROM r2 UNION SELECT * FROM r3), v AS (SELECT source, count(*) AS n FROM f WHERE node IN (SELECT id FROM nodes WHERE kind IN ({sql_list(SEMANTIC_NODES)})) GROUP BY source) SELECT id, name, coalesce(n, 0) AS value FROM c LEFT JOIN v ON source = id ORDER BY value DESC, name, id LIMIT 50")
def view_candidates(g: Graph):
    return views.candidates(g.nodes, _chain(g), "HttpContract", "backend", "LIST")


@query("view_perspectives", "SELECT 'api' AS perspective, 'HttpContract' AS center, count(*) AS n FROM nodes WHERE kind = 'HttpContract' AND side = 'backend' UNION ALL SELECT 'table', 'Table', count(*) FROM nodes WHERE kind = 'Table' UNION ALL SELECT 'page', 'Page', 0")
def view_perspectives(g: Graph):
    return views.perspectives(g.nodes, PERSPECTIVES)


_DISCOVER = f", e AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind IN ('HandledBy', 'Calls', 'WritesDb', 'ReadsDb', 'PublishesTo')), ends AS (SELECT id FROM nodes WHERE kind IN ({sql_list(SEMANTIC_NODES)})), r(source, node, ring) AS (SELECT id, id, 0 FROM nodes WHERE kind = 'HttpContract' UNION SELECT source, to_id, ring + 1 FROM r JOIN e ON from_id = node WHERE ring < 4 AND (ring = 0 OR node NOT IN (SELECT id FROM ends))), d AS (SELECT source, node, min(ring) AS ring FROM r GROUP BY source, node)"


def _discovered(g: Graph):
    own = g.edges.where("kind IN ('HandledBy', 'Calls', 'WritesDb', 'ReadsDb', 'PublishesTo')")
    return views.discover(own, g.nodes, g.nodes.where("kind = 'HttpContract'"), PERSPECTIVES["table"].depth), own


@query("view_discover", f"{_DISCOVER} SELECT source, node, ring FROM d")
def view_discover(g: Graph):
    return _discovered(g)[0].select("source", "node", "ring")


@query("view_parents", f"{_DISCOVER} SELECT a.source, a.node, min(b.node) AS parent FROM d a JOIN d b ON a.source = b.source AND b.ring = a.ring - 1 JOIN e ON from_id = b.node AND to_id = a.node WHERE (b.ring = 0 OR b.node NOT IN (SELECT id FROM ends)) GROUP BY 1, 2")
def view_parents(g: Graph):
    return _discovered(g)[0].where("ring > 0").select("source", "node", "parent")


@query("view_access_modes", f"{_DISCOVER} SELECT a.source, a.node, CASE WHEN bool_or(x.kind IN ('WritesDb', 'PublishesTo')) THEN 'write' ELSE 'read' END AS mode FROM d a JOIN edges x ON x.to_id = a.node AND x.kind IN ('WritesDb', 'ReadsDb', 'PublishesTo') JOIN d b ON b.source = a.source AND b.node = x.from_id GROUP BY 1, 2")
def view_access_modes(g: Graph):
    return views.access_modes(*_discovered(g))


_FOLD = ", par AS (SELECT to_id AS node, min(from_id) AS parent FROM edges WHERE kind = 'HandledBy' GROUP BY to_id), top AS (SELECT id AS node, CASE WHEN kind = 'Method' THEN parent ELSE id END AS top FROM nodes LEFT JOIN par ON node = id), g AS (SELECT a.top AS from_id, kind, b.top AS to_id, count(*) AS n FROM edges JOIN top a ON a.node = from_id JOIN top b ON b.node = to_id WHERE kind IN ('WritesDb', 'ReadsDb', 'ReadsConfig') AND a.top IS NOT NULL AND b.top IS NOT NULL AND a.top <> b.top GROUP BY 1, 2, 3)"


def _folded(g: Graph):
    owner = g.edges.where("kind = 'HandledBy'").groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("parent"))
    parents = g.nodes.select("id", "kind").join(owner, "id", "left").select(F.col("id").alias("node"), "parent", "kind")
    return views.folded(g.edges.where("kind IN ('WritesDb', 'ReadsDb', 'ReadsConfig')"), parents, F.col("kind") != "Method", 1)


@query("view_folded", f"{_FOLD} SELECT from_id, kind, to_id, n FROM g QUALIFY row_number() OVER (PARTITION BY from_id, kind ORDER BY n DESC, to_id) <= 1")
def view_folded(g: Graph):
    return _folded(g)[0].drop("place")


@query("view_hidden", f"{_FOLD} SELECT from_id, kind, count(*) - 1 AS hidden FROM g GROUP BY 1, 2 HAVING count(*) > 1")
def view_hidden(g: Graph):
    return _folded(g)[1]


@query("view_orphans", f"{_FOLD} SELECT DISTINCT n AS node FROM (SELECT from_id AS n FROM edges WHERE kind IN ('WritesDb', 'ReadsDb', 'ReadsConfig') UNION SELECT to_id FROM edges WHERE kind IN ('WritesDb', 'ReadsDb', 'ReadsConfig')) WHERE n NOT IN (SELECT node FROM top WHERE top IS NOT NULL)")
def view_orphans(g: Graph):
    return _folded(g)[2]


@query("view_hidden_by_kind", "SELECT kind, count(*) AS n FROM nodes WHERE id % 3 > 0 AND id < 5000000000 GROUP BY kind")
def view_hidden_by_kind(g: Graph):
    own = g.nodes.where("id < 5000000000")
    return views.hidden_by_kind(own.select("id"), own.where("id % 3 = 0").select("id"), own)


@query("view_clusters", "SELECT CAST(category AS VARCHAR) AS key, count(*) OVER (PARTITION BY category) AS n, id AS sample FROM nodes WHERE kind = 'Method' QUALIFY row_number() OVER (PARTITION BY category ORDER BY id) <= 3")
def view_clusters(g: Graph):
    return views.clusters(g.nodes.where("kind = 'Method'"), "category").select("key", "n", "sample")


_DERIVED = "dv AS (SELECT h.from_id * 10 AS edge_id, h.from_id AS a, h.m AS b, w.to_id AS t FROM (SELECT from_id, min(to_id) AS m FROM edges WHERE kind = 'HandledBy' GROUP BY from_id) h JOIN (SELECT from_id, min(to_id) AS to_id FROM edges WHERE kind = 'WritesDb' GROUP BY from_id) w ON w.from_id = h.m)"


def _derived(g: Graph):
    least = lambda kind, a, b: g.edges.where(F.col("kind") == kind).groupBy(F.col("from_id").alias(a)).agg(F.min("to_id").alias(b))
    met = least("HandledBy", "a", "b").join(least("WritesDb", "b", "t"), "b")
    return met.select((F.col("a") * 10).alias("edge_id"), F.array("a", "b", "t").alias("path"), F.col("b").alias("last"), F.col("t").alias("to_id"))


@query("edge_evidence", f", {_DERIVED}, p AS (SELECT id AS node, 'f' || CAST(id % 7 AS VARCHAR) AS place FROM nodes WHERE id % 2 = 0), h AS (SELECT edge_id, 0 AS hop, a AS node FROM dv UNION ALL SELECT edge_id, 1, b FROM dv UNION ALL SELECT edge_id, 2, t FROM dv) SELECT edge_id, hop, h.node, place FROM h LEFT JOIN (SELECT node, min(place) AS place FROM p GROUP BY node) q ON q.node = h.node")
def edge_evidence(g: Graph):
    places = g.nodes.where("id % 2 = 0").select(F.col("id").alias("node"), F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("place"))
    return views.edge_evidence(g.edges, _derived(g), places)


@query("edge_contacts", f", {_DERIVED} SELECT edge_id, touch, exact FROM (SELECT edge_id, w.from_id AS touch, w.from_id = b AS exact, row_number() OVER (PARTITION BY edge_id ORDER BY (w.from_id = b) DESC, w.from_id) AS n FROM dv JOIN edges w ON w.kind = 'WritesDb' AND w.to_id = t) WHERE n = 1")
def edge_contacts(g: Graph):
    touches = g.edges.where("kind = 'WritesDb'").select(F.col("from_id").alias("touch_id"), F.col("from_id").alias("owner"), "to_id")
    return views.contacts(_derived(g).select("edge_id", "last", "to_id"), touches)


@query("inline_chains", f", {_DERIVED}, h AS (SELECT edge_id, 1 AS hop, a AS from_id, b AS to_id FROM dv UNION ALL SELECT edge_id, 2, b, t FROM dv) SELECT -row_number() OVER (ORDER BY edge_id, hop) AS id, edge_id, hop, h.from_id, h.to_id, CASE WHEN hop = 2 THEN 'w' || CAST(h.to_id % 10 AS VARCHAR) END AS place FROM h")
def inline_chains(g: Graph):
    hops = g.edges.where("kind = 'WritesDb'").select("from_id", "to_id", F.concat(F.lit("w"), (F.col("to_id") % 10).cast("string")).alias("place"))
    return views.inline_chains(_derived(g), hops)


@query("node_locations", ", r AS (SELECT id, 0 AS rank, 'syntax' AS origin, 's' || CAST(id % 5 AS VARCHAR) AS place FROM nodes WHERE kind = 'Table' UNION ALL SELECT to_id, 1, 'call', 's' || CAST(from_id % 9 AS VARCHAR) FROM edges WHERE kind IN ('WritesDb', 'ReadsDb')), f AS (SELECT id, place, arg_min(origin, rank) AS origin FROM r GROUP BY id, place) SELECT id, origin, place FROM f QUALIFY row_number() OVER (PARTITION BY id, origin ORDER BY place) <= 2")
def node_locations(g: Graph):
    text = lambda c, n: F.concat(F.lit("s"), (F.col(c) % n).cast("string")).alias("place")
    own = g.nodes.where("kind = 'Table'").select("id", text("id", 5))
    calls = g.edges.where("kind IN ('WritesDb', 'ReadsDb')").select(F.col("to_id").alias("id"), text("from_id", 9))
    return views.node_locations(own, calls, own.where("false"), 2)


_DIAGNOSTICS = "SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'resolve.missing' WHEN 'click' THEN 'check.hot' ELSE 'parse.' || event_type END AS code, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'critical' WHEN 'view' THEN 'warning' ELSE 'info' END AS severity, ts FROM events"


def _diagnostics(g: Graph):
    kind = F.col("event_type")
    code = F.when(kind == "error", "resolve.missing").when(kind == "click", "check.hot").otherwise(F.concat(F.lit("parse."), kind))
    severity = F.when(kind == "error", "error").when(kind == "purchase", "critical").when(kind == "view", "warning").otherwise("info")
    return g.table("events").select(F.col("event_id").alias("id"), code.alias("code"), severity.alias("severity"), "ts")


@query("unresolved_newest", f"SELECT id FROM (SELECT * FROM ({_DIAGNOSTICS}) ORDER BY id DESC LIMIT 500) WHERE code LIKE 'resolve.%' ORDER BY id DESC LIMIT 20", graph=False)
def unresolved(g: Graph):
    return views.unresolved(_diagnostics(g)).select("id")


@query("diagnostics_newest", f"SELECT id, code FROM ({_DIAGNOSTICS}) ORDER BY id DESC LIMIT 100", graph=False)
def diagnostics_newest(g: Graph):
    return store.newest(_diagnostics(g), 100).select("id", "code")


@query("violations_newest", f"SELECT id, severity FROM ({_DIAGNOSTICS}) WHERE code LIKE 'check.%' OR code LIKE 'parse.%' ORDER BY CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_RANK.items()) + " END, id DESC LIMIT 100", graph=False)
def violations_newest(g: Graph):
    return store.most_severe(_diagnostics(g).where("code like 'check.%' or code like 'parse.%'"), 100).select("id", "severity")


@query("diagnostic_codes", f"SELECT code, severity, count(*) AS n FROM ({_DIAGNOSTICS}) GROUP BY 1, 2", graph=False)
def diagnostic_codes(g: Graph):
    return store.severities(_diagnostics(g))[0]


@query("diagnostic_summary", f"SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM ({_DIAGNOSTICS}) WHERE code NOT LIKE 'check.%'", graph=False)
def diagnostic_summary(g: Graph):
    return store.severities(_diagnostics(g), without_prefix="check.")[1]


@query("diagnostics_cleared", f"SELECT id FROM ({_DIAGNOSTICS}) WHERE code NOT LIKE 'parse.%'", graph=False)
def diagnostics_cleared(g: Graph):
    return store.without_prefix(_diagnostics(g), "parse.").select("id")


@query("code_counts", f"SELECT code, count(*) AS n FROM ({_DIAGNOSTICS}) GROUP BY code ORDER BY n DESC, code", graph=False)
def code_counts(g: Graph):
    return store.code_counts(_diagnostics(g))


@query("count_nodes", "SELECT count(*) AS n FROM nodes WHERE kind = 'HttpContract' AND side = 'backend'")
def count_nodes(g: Graph):
    return store.count_nodes(g.nodes, "HttpContract", "backend")


@query("kinds_listed", "SELECT 'node' AS part, '' AS channel, kind FROM nodes GROUP BY kind UNION ALL SELECT 'edge', '', kind FROM edges GROUP BY kind UNION ALL SELECT 'annotation', channel, kind FROM marks GROUP BY channel, kind")
def kinds_listed(g: Graph):
    return store.kinds(g.nodes, g.edges, g.marks)


@query("recall_kinds", "SELECT DISTINCT kind FROM nodes WHERE kind NOT IN ('CallSite', 'Function')")
def recall_kinds(g: Graph):
    return store.recall_kinds(g.nodes, ["CallSite", "Function"])


@query("edges_of_project", "SELECT kind, from_id, to_id FROM edges WHERE from_id IN (SELECT id FROM nodes WHERE sub < 10) AND to_id IN (SELECT id FROM nodes WHERE sub < 10)")
def edges_of_project(g: Graph):
    return store.same_project(g.edges, g.nodes.where("sub < 10")).select("kind", "from_id", "to_id")


@query("project_reset", "SELECT id FROM nodes WHERE sub <> 3")
def project_reset(g: Graph):
    return store.replaced(g.nodes, g.nodes.where("false"), "sub", [3]).select("id")


@query("properties_merged", "SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'backend' END AS side, CASE WHEN id % 2 = 0 THEN '1' END AS extra FROM nodes WHERE kind = 'HttpContract' AND side = 'backend'")
def properties_merged(g: Graph):
    own = g.nodes.where("kind = 'HttpContract' AND side = 'backend'").select("id", "props")
    patch = own.where("id % 2 = 0").select("id", F.lit('{"side":"new","extra":1}').alias("props"))
    return store.merge_properties(own, patch).select("id", F.get_json_object("props", "$.side").alias("side"), F.get_json_object("props", "$.extra").alias("extra"))


@query("locations_appended", ", l AS (SELECT to_id AS id, 'f' || CAST(from_id % 11 AS VARCHAR) AS file, CAST(from_id % 4 AS BIGINT) AS line FROM edges WHERE kind IN ('WritesDb', 'ReadsDb')) SELECT DISTINCT id, file, line FROM l QUALIFY dense_rank() OVER (PARTITION BY id ORDER BY file, line) <= 2")
def locations_appended(g: Graph):
    rows = lambda kind: g.edges.where(F.col("kind") == kind).select(F.col("to_id").alias("id"), F.concat(F.lit("f"), (F.col("from_id") % 11).cast("string")).alias("file"), (F.col("from_id") % 4).alias("line"))
    return store.append_locations(rows("WritesDb"), rows("ReadsDb"), 2, oldest_first=False)


@query("wildcards_converged", ", c AS (SELECT id, sub, CASE WHEN id % 6 = 0 THEN 'ANY' ELSE string_split(name, ' ')[1] END AS m, regexp_extract(name, '^\\S* (/[a-z]+)', 1) AS path FROM nodes WHERE kind = 'HttpContract'), f AS (SELECT sub, path, min(id) AS first FROM c WHERE m NOT IN ('ANY', 'RULE') GROUP BY 1, 2) SELECT c.id, CASE WHEN m IN ('ANY', 'RULE') THEN coalesce(first, c.id) ELSE c.id END AS target FROM c LEFT JOIN f USING (sub, path)")
def wildcards_converged(g: Graph):
    method = F.when(F.col("id") % 6 == 0, "ANY").otherwise(naming.contract_parts("name")[0])
    own = g.nodes.where("kind = 'HttpContract'").select("id", F.col("sub").alias("scope"), method.alias("method"), F.regexp_extract("name", r"^\S* (/[a-z]+)", 1).alias("path"))
    return store.converge_wildcards(own)


# ranking

@query("recall_one_contract_a_name", f"{_LEXICAL}, n AS (SELECT h.id, regexp_replace(h.name, '/\\d+$', '') AS name, h.kind, h.score, side FROM hits h JOIN nodes ON nodes.id = h.id AND nodes.kind = h.kind WHERE h.kind IN ('HttpContract', 'Table')) SELECT id FROM n WHERE kind <> 'HttpContract' UNION ALL SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY name ORDER BY coalesce(side = 'backend', false) DESC, score DESC, id) AS p FROM n WHERE kind = 'HttpContract') WHERE p = 1")
def one_contract(g: Graph):
    hits = _hits(g).where("kind IN ('HttpContract', 'Table')").join(g.nodes.select("id", "side"), "id").withColumn("name", F.regexp_replace("name", r"/\d+$", ""))
    return ranking.one_contract_a_name(hits).select("id")


@query("recall_seeds", f"{_LEXICAL}, la AS (SELECT id, score FROM hits ORDER BY score DESC, id LIMIT 5), lb AS (SELECT id, score FROM (SELECT id, 100.0 - id % 89 AS score FROM nodes WHERE kind = 'Table') ORDER BY score DESC, id LIMIT 4) SELECT id, 'lexical' AS origin FROM la UNION ALL SELECT id, 'vector' FROM lb WHERE id NOT IN (SELECT id FROM la)")
def recall_seeds(g: Graph):
    vector = g.nodes.where("kind = 'Table'").select("id", (F.lit(100.0) - F.col("id") % 89).alias("score"))
    return ranking.merged_seeds(_hits(g), vector).select("id", "origin")


@query("recall_boosts", "SELECT id, round(CASE WHEN lower(name) = 'order_1' THEN 3.0 WHEN string_split(lower(name), '_')[1] = 'order' AND regexp_matches(name, '^order_') THEN CASE WHEN list_has_any(string_split(lower(name), '_'), ['get', '12']) THEN 2.2 WHEN starts_with(lower(name), 'order_1') THEN 1.6 ELSE 1.0 END ELSE 1.0 END, 6)::DOUBLE AS anchor, round(1 + 0.3 * least(greatest(id % 6 - 1, 0), 3), 6)::DOUBLE AS cohesion FROM nodes WHERE kind = 'Method'")
def recall_boosts(g: Graph):
    own = g.nodes.where("kind = 'Method'")
    return own.select("id", ranking.anchor(F.col("name"), ["order_1", "get", "12"]).alias("anchor"), F.round(ranking.cohesion(F.col("id") % 6), 6).alias("cohesion"))


@query("recall_concepts_and_noise", "SELECT id, round(CASE WHEN a + b = 0 THEN 1.0 ELSE 1.5 * pow(1.2, a + b - 1) END, 6) AS concept, round(CASE WHEN id % 3 = 0 THEN 0.3 ELSE 1.0 END * CASE WHEN lower(name) IN ('index') THEN 0.45 ELSE 1.0 END, 6)::DOUBLE AS noise FROM (SELECT id, name, regexp_matches(name, '(?i)an|blue')::INT AS a, regexp_matches(name, '(?i)red|er')::INT AS b FROM nodes WHERE kind = 'Table')")
def concepts(g: Graph):
    own = g.nodes.where("kind = 'Table'")
    path = F.when(F.col("id") % 3 == 0, "src/tests/a.php").otherwise("src/contest/a.php")
    return own.select("id", F.round(ranking.concept(F.col("name"), [["an", "blue"], ["red", "er"]]), 6).alias("concept"), F.round(ranking.noise(path, F.col("name")), 6).alias("noise"))


@query("recall_hub_decay", "SELECT to_id AS id, round(CASE WHEN count(*) * 9 <= 60 THEN 1.0 ELSE 0.4 + 0.6 * exp(-(count(*) * 9 - 60) / 200.0) END, 6)::DOUBLE AS decay FROM edges GROUP BY to_id")
def hub_decay(g: Graph):
    return g.edges.groupBy(F.col("to_id").alias("id")).agg((F.count("*") * 9).alias("n")).select("id", F.round(ranking.hub_decay(F.col("n")), 6).alias("decay"))


_FLOW = "h AS (SELECT id, (id % 100)::DOUBLE AS score FROM nodes WHERE kind = 'Method'), c AS (SELECT to_id AS id, count(*)::INT AS depth FROM edges WHERE kind = 'HandledBy' GROUP BY to_id), f AS (SELECT to_id AS id, count(*) * 30 AS fan FROM edges GROUP BY to_id)"


@query("recall_flow_order", f", {_FLOW} SELECT h.id, depth IS NOT NULL AS on_chain, coalesce(depth, 0) AS depth, round(score * CASE WHEN coalesce(fan, 0) <= 60 THEN 1.0 ELSE 0.4 + 0.6 * exp(-(fan - 60) / 200.0) END, 6) AS score FROM h LEFT JOIN c USING (id) LEFT JOIN f USING (id)")
def flow_order(g: Graph):
    hits = g.nodes.where("kind = 'Method'").select("id", (F.col("id") % 100).cast("double").alias("score"))
    chain = g.edges.where("kind = 'HandledBy'").groupBy(F.col("to_id").alias("id")).agg(F.count("*").cast("int").alias("depth"))
    fans = g.edges.groupBy(F.col("to_id").alias("id")).agg((F.count("*") * 30).alias("fan"))
    return ranking.flow_order(hits, chain, fans)


@query("recall_quality", f"{_LEXICAL}, t AS (SELECT score FROM hits ORDER BY score DESC, id LIMIT 2), x AS (SELECT count(*) AS hits, ({' + '.join(f'max(contains(lower(name), {chr(39)}{t}{chr(39)})::INT)' for t in TERMS)}) / 3 AS coverage, round(avg((({' + '.join(f'contains(lower(name), {chr(39)}{t}{chr(39)})::INT' for t in TERMS)}) >= 2)::INT), 6) AS cohesion, round((SELECT 1 - min(score) / max(score) FROM t), 6) AS gap FROM hits), y AS (SELECT *, round(0.65 * coverage + 0.35 * gap, 6) AS confidence FROM x) SELECT *, CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.35 THEN 'medium' ELSE 'low' END AS tier FROM y")
def recall_quality(g: Graph):
    return ranking.quality(_hits(g), TERMS)


@query("recall_bridge_terms", "SELECT token, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part WHERE contains(lower(p_type), 'a') OR contains(lower(p_type), 'steel')) WHERE length(token) > 2 GROUP BY token ORDER BY n DESC, token LIMIT 10", graph=False)
def bridge_terms(g: Graph):
    return ranking.bridge_terms(g.table("part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("key"), F.col("p_type").alias("text")), ["a", "STEEL"])


@query("recall_event_seeds", "SELECT id, (400 + 20 * sum(w))::DOUBLE AS score FROM (SELECT id, name FROM nodes WHERE kind IN ('Event', 'EventBus', 'Queue')) JOIN (VALUES ('er', 1.5), ('sign', 2.0), ('a', 0.25)) t(term, w) ON contains(lower(name), term) GROUP BY id ORDER BY score DESC, id LIMIT 10")
def event_seeds(g: Graph):
    idf = g.spark.createDataFrame([("er", 1.5), ("sign", 2.0), ("a", 0.25), ("x", 9.0)], "term string, idf double")
    return ranking.event_seeds(g.nodes, ["er", "sign", "a"], idf)


@query("recall_snippets", "SELECT doc_id AS id, array_to_string(string_split(text, chr(10))[1:4], '|') AS lines FROM (SELECT * FROM documents WHERE doc_id % 40 = 0 ORDER BY doc_id LIMIT 8) WHERE length(text) <= 131072", graph=False)
def snippets(g: Graph):
    own = g.table("documents").where("doc_id % 40 = 0")
    hits = own.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("line"), (-F.col("doc_id")).alias("score"))
    files = own.select(F.col("doc_id").cast("string").alias("path"), "text")
    return ranking.snippets(hits, files).select("id", F.array_join("lines", "|").alias("lines"))


@query("recall_vector_store", None, graph=False)
def vector_store(g: Graph):
    texts = g.table("part").select(F.col("p_name").alias("text"))
    empty = g.spark.createDataFrame([], "text_hash string, version string, dim int, v array<float>")
    return ranking.vector_store(empty, texts, "v1")


@query("semantic_edges_by_side", f"SELECT side, kind, count(*) AS n FROM edges JOIN (SELECT DISTINCT id, side FROM nodes WHERE kind = 'HttpContract') t ON id = to_id WHERE edges.kind NOT IN ({sql_list(SEMANTIC_EDGES)}) GROUP BY 1, 2")
def by_side(g: Graph):
    own = g.nodes.where("kind = 'HttpContract'").select(F.col("id").alias("to_id"), "side").distinct()
    return g.edges.where(~F.col("kind").isin(*SEMANTIC_EDGES)).join(own, "to_id").groupBy("side", "kind").agg(F.count("*").alias("n"))
