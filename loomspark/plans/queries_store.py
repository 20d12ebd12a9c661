"""Queries of storage, aggregation, windows, joins and naming functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import joins, store
from ..operators.kinds import CHAIN_EDGES, SEMANTIC_EDGES, sql_list
from ..operators.phases import bridge, external_in_loop, multi_write_without_tx
from ..streaming.watch import severity_counts, snapshot_diff
from .projection import Graph
from .registry import query


@query("scan_nodes_by_kind", "SELECT id, name FROM nodes WHERE (kind = 'Table' OR category = 'Table') AND name ILIKE '%an%' ORDER BY id LIMIT 50 OFFSET 10")
def scan_nodes(g: Graph):
    return store.query_nodes(g.nodes, "Table", "an", 50, 10).select("id", "name")


@query("multi_get_nodes", "SELECT id, kind, name FROM nodes WHERE id IN (SELECT to_id FROM edges WHERE kind = 'PublishesTo')")
def multi_get(g: Graph):
    return store.get_nodes(g.nodes, g.edges.where("kind = 'PublishesTo'").select(F.col("to_id").alias("id"))).select("id", "kind", "name")


@query("node_summaries", "SELECT id, kind, name, language, sub FROM nodes")
def node_summaries(g: Graph):
    return g.nodes.select("id", "kind", "name", "language", "sub")


for _d, _c in (("out", "from_id"), ("in", "to_id")):

    @query(f"edges_{_d}_of_tables_and_methods", f"SELECT kind, from_id, to_id FROM edges WHERE {_c} IN (SELECT id FROM nodes WHERE kind IN ('Table', 'Method'))")
    def edges_of(g: Graph, d=_d):
        return store.edges_of(g.edges, g.nodes.where("kind IN ('Table', 'Method')").select("id"), d).select("kind", "from_id", "to_id")


@query("chain_adjacency", f"SELECT node, direction, semantic, count(*) AS n FROM (SELECT from_id AS node, 'out' AS direction, kind IN ({sql_list(SEMANTIC_EDGES)}) AS semantic FROM edges WHERE kind IN ({sql_list(CHAIN_EDGES)}) UNION ALL SELECT to_id, 'in', kind IN ({sql_list(SEMANTIC_EDGES)}) FROM edges WHERE kind IN ({sql_list(CHAIN_EDGES)})) GROUP BY node, direction, semantic")
def chain_adjacency(g: Graph):
    return store.chain_adjacency(g.edges).groupBy("node", "direction", "semantic").agg(F.count("*").alias("n"))


@query("graph_stats", "SELECT 'node' AS part, kind AS key, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'annotation', channel, count(*) FROM marks GROUP BY channel UNION ALL SELECT 'category', category, count(*) FROM nodes WHERE category IS NOT NULL GROUP BY category")
def graph_stats(g: Graph):
    return store.stats(g.nodes, g.edges, g.marks)


@query("distinct_kinds", "SELECT DISTINCT channel, kind FROM marks")
def distinct_kinds(g: Graph):
    return g.marks.select("channel", "kind").distinct()


_CALLS = "c AS (SELECT id, CASE WHEN sub = 0 THEN -1 ELSE sub END AS sub, category AS callee, id IN (SELECT node_id FROM marks) AS covered FROM nodes WHERE kind = 'CallSite')"


def _coverage(g: Graph):
    calls = g.nodes.where("kind = 'CallSite'").select("id", F.when(F.col("sub") != 0, F.col("sub")).alias("sub"), F.col("category").alias("callee"))
    return store.coverage(calls, g.marks.select(F.col("node_id").alias("id")), 2)


@query("coverage_by_sub_project", f", {_CALLS} SELECT sub, count(*) AS total, count(*) FILTER (WHERE covered) AS covered, round(count(*) FILTER (WHERE covered) / count(*), 6) AS ratio FROM c GROUP BY sub")
def coverage(g: Graph):
    return _coverage(g)[0]


@query("coverage_top_uncovered", f", {_CALLS} SELECT sub, callee, count, place FROM (SELECT sub, callee, count, row_number() OVER (PARTITION BY sub ORDER BY count DESC, callee) AS place FROM (SELECT sub, callee, count(*) AS count FROM c WHERE NOT covered GROUP BY sub, callee)) WHERE place <= 2")
def uncovered(g: Graph):
    return _coverage(g)[1]


@query("merge_identities", "SELECT kind, name, min(id) AS id, count(*) AS merged FROM nodes WHERE kind = 'Table' GROUP BY kind, name")
def merge_identities(g: Graph):
    return store.merge_identities(g.nodes.where("kind = 'Table'")).select("kind", "name", "id", "merged")


@query("merge_identity_sources", "SELECT name, array_to_string(list_sort(list(id))[1:50], ',') AS sources FROM nodes WHERE kind = 'Table' GROUP BY name")
def merge_sources(g: Graph):
    return store.merge_identities(g.nodes.where("kind = 'Table'")).select("name", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("edges_insert_or_ignore", "SELECT kind, from_id, to_id, max(confidence) AS confidence FROM edges WHERE kind = 'ReadsDb' GROUP BY kind, from_id, to_id UNION ALL SELECT 'ReadsDb', from_id, to_id, CAST(0.5 AS DOUBLE) FROM edges w WHERE kind = 'WritesDb' AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.kind = 'ReadsDb' AND r.from_id = w.from_id AND r.to_id = w.to_id)")
def insert_or_ignore(g: Graph):
    new = g.edges.where("kind = 'WritesDb'").select(F.lit("ReadsDb").alias("kind"), "from_id", "to_id", F.lit(0.5).alias("confidence"))
    return store.apply_delta(g.edges.where("kind = 'ReadsDb'"), new, ["kind", "from_id", "to_id"], "first")


@query("multi_write_without_tx", "SELECT from_id AS node_id, count(DISTINCT to_id) AS tables FROM edges WHERE kind = 'WritesDb' AND from_id NOT IN (SELECT owner FROM calls JOIN marks ON id = node_id WHERE marks.kind = 'tx-marker') GROUP BY from_id HAVING count(DISTINCT to_id) >= 2")
def multi_write(g: Graph):
    inside = g.edges.where("kind = 'HasCallSite'").join(g.marks.where("kind = 'tx-marker'").withColumnRenamed("kind", "mark"), F.col("to_id") == F.col("node_id")).select(F.col("from_id").alias("node_id"))
    return multi_write_without_tx(g.edges, inside)


@query("external_calls_in_loop", "SELECT id FROM nodes WHERE kind = 'CallSite' AND in_loop AND category IN ('R', 'A')")
def external(g: Graph):
    names = g.spark.createDataFrame([("R",), ("A",)], "callee string")
    return external_in_loop(g.nodes.where("kind = 'CallSite'").withColumnRenamed("category", "callee"), names)


@query("contract_bridge", "SELECT f.id AS from_id, b.id AS to_id FROM nodes f JOIN nodes b ON f.kind = 'HttpContract' AND b.kind = 'HttpContract' AND f.side = 'frontend' AND b.side = 'backend' AND f.sub <> b.sub AND regexp_replace(f.name, '/\\d+$', '') = regexp_replace(b.name, '/\\d+$', '')")
def contract_bridge(g: Graph):
    own = g.nodes_of("HttpContract").select("id", "sub", "side", F.regexp_replace("name", r"/\d+$", "").alias("name"))
    return bridge(own).select("from_id", "to_id")


@query("fan_in_four_ways", f"SELECT to_id AS id, count(*) FILTER (WHERE kind IN ({sql_list(SEMANTIC_EDGES)})) AS semantic, count(*) AS every, count(DISTINCT from_id) FILTER (WHERE kind IN ({sql_list(SEMANTIC_EDGES)})) AS neighbours, least(count(*) FILTER (WHERE kind IN ({sql_list(CHAIN_EDGES)})), 20) AS chain FROM edges GROUP BY to_id")
def fan_in(g: Graph):
    semantic, chain = F.col("kind").isin(*SEMANTIC_EDGES), F.col("kind").isin(*CHAIN_EDGES)
    return g.edges.groupBy(F.col("to_id").alias("id")).agg(F.count_if(semantic).alias("semantic"), F.count("*").alias("every"), F.count_distinct(F.when(semantic, F.col("from_id"))).alias("neighbours"), F.least(F.count_if(chain), F.lit(20)).alias("chain"))


@query("fan_in_grades", "SELECT grade, count(*) AS n FROM (SELECT CASE WHEN count(*) >= 8 THEN 'high' WHEN count(*) >= 4 THEN 'medium' ELSE 'low' END AS grade FROM edges GROUP BY to_id) GROUP BY grade")
def fan_in_grades(g: Graph):
    n = g.edges.groupBy("to_id").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") >= 8, "high").when(F.col("n") >= 4, "medium").otherwise("low").alias("grade")).agg(F.count("*").alias("n"))


@query("matrix_with_totals", "SELECT coalesce(kind, '*') AS kind, coalesce(language, '*') AS language, count(*) AS n FROM nodes GROUP BY CUBE (kind, language)")
def matrix(g: Graph):
    return g.nodes.cube("kind", "language").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("language", F.lit("*")).alias("language"), "n")


@query("clusters_with_samples", "SELECT kind, sub, n, sample FROM (SELECT kind, sub, id AS sample, count(*) OVER (PARTITION BY kind, sub) AS n, row_number() OVER (PARTITION BY kind, sub ORDER BY id) AS place FROM nodes) WHERE place <= 3")
def clusters(g: Graph):
    few = joins.top_k(g.nodes, ["kind", "sub"], ["id"], 3).select("kind", "sub", F.col("id").alias("sample"))
    return few.join(g.nodes.groupBy("kind", "sub").agg(F.count("*").alias("n")), ["kind", "sub"])


@query("relation_summary", "SELECT node, direction, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, direction, kind) AS place FROM (SELECT to_id AS node, 'in' AS direction, kind, count(*) AS n FROM edges GROUP BY to_id, kind UNION ALL SELECT from_id, 'out', kind, count(*) FROM edges GROUP BY from_id, kind)) WHERE place <= 5")
def relation_summary(g: Graph):
    into = g.edges.groupBy(F.col("to_id").alias("node"), F.lit("in").alias("direction"), "kind").agg(F.count("*").alias("n"))
    out = g.edges.groupBy(F.col("from_id").alias("node"), F.lit("out").alias("direction"), "kind").agg(F.count("*").alias("n"))
    return joins.top_k(into.union(out), ["node"], [F.desc("n"), "direction", "kind"], 5).drop("place")


@query("containment_members", "SELECT from_id, to_id FROM (SELECT from_id, to_id, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS place FROM edges WHERE kind = 'HandledBy') WHERE place <= 6")
def containment(g: Graph):
    return joins.top_k(g.edges.where("kind = 'HandledBy'"), ["from_id"], ["to_id"], 6).select("from_id", "to_id")


@query("edges_dedup_first", "SELECT from_id, to_id, min(kind) AS kind FROM edges GROUP BY from_id, to_id")
def dedup_first(g: Graph):
    return joins.keep_first(g.edges, ["from_id", "to_id"], ["kind"]).select("from_id", "to_id", "kind")


@query("interleave_intents", "SELECT id, row_number() OVER (ORDER BY rn, kind, id) AS place FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn FROM nodes WHERE kind IN ('Table', 'Cache', 'Queue')) ORDER BY place LIMIT 30")
def interleave(g: Graph):
    few = joins.top_k(g.nodes.where("kind IN ('Table', 'Cache', 'Queue')"), ["kind"], ["id"], 30).withColumnRenamed("place", "rn").orderBy("rn", "kind", "id").limit(30)
    return few.select("id", F.row_number().over(Window.orderBy("rn", "kind", "id")).alias("place"))


@query("unique_short_names", "SELECT name, min(id) AS id FROM nodes WHERE kind IN ('Cache', 'Queue', 'Table') GROUP BY name HAVING count(DISTINCT id) = 1")
def unique_short(g: Graph):
    return joins.unique_or_null(g.nodes.where("kind IN ('Cache', 'Queue', 'Table')"), "name", "id")


@query("tiered_lookup", "SELECT n.id, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 END AS tier FROM nodes n LEFT JOIN (SELECT from_id, min(to_id) AS v FROM edges WHERE kind = 'WritesDb' GROUP BY from_id) a ON a.from_id = n.id LEFT JOIN (SELECT from_id, min(to_id) AS v FROM edges WHERE kind = 'ReadsDb' GROUP BY from_id) b ON b.from_id = n.id WHERE n.kind = 'Method'")
def tiered(g: Graph):
    first = lambda kind: g.edges.where(F.col("kind") == kind).groupBy("from_id").agg(F.min("to_id").alias("value"))
    return joins.tiered(g.nodes.where("kind = 'Method'"), [(F.col("id"), first("WritesDb"), "from_id"), (F.col("id"), first("ReadsDb"), "from_id")]).select("id", "value", "tier")


_ROOTS = "roots AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/]+)', 1) FROM pages WHERE page_id % 2 = 0)"


@query("longest_prefix_root", f"WITH {_ROOTS} SELECT url, max_by(root, length(root)) AS root FROM (SELECT DISTINCT url FROM pages) p JOIN roots ON root <> '' AND (url = root OR starts_with(url, root || '/')) GROUP BY url", graph=False)
def longest_prefix(g: Graph):
    pages = g.table("pages")
    host = pages.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("root"))
    deep = pages.where("page_id % 2 = 0").select(F.regexp_extract("url", "^(https?://[^/]+/[^/]+)", 1).alias("root"))
    roots = host.union(deep).where("root <> ''").distinct().withColumn("value", F.col("root"))
    found = joins.longest_prefix(pages.select("url").distinct(), "url", roots, "root", "value")
    return found.where("value is not null").select("url", F.col("value").alias("root"))


@query("enclosing_spans", "SELECT p.event_id, array_to_string(list(s.event_id ORDER BY s.event_id), ',') AS labels FROM events p JOIN events s ON p.user_id = s.user_id AND s.event_type = 'signup' AND p.event_type = 'click' AND p.event_id BETWEEN s.event_id AND s.event_id + 3000 GROUP BY p.event_id", graph=False)
def enclosing(g: Graph):
    events = g.table("events")
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 3000).alias("b"), F.col("event_id").alias("label"))
    found = joins.enclosing(events.where("event_type = 'click'"), spans, "user_id", "event_id", "a", "b", "label", "event_id")
    return found.select("event_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query("diagnostic_severities", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50) AS high FROM events GROUP BY event_type", graph=False)
def diagnostics(g: Graph):
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return g.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(k >= 50).alias("high"))


@query("severity_per_hour", "SELECT date_trunc('hour', ts) AS start, event_type AS severity, count(*) AS n FROM events GROUP BY 1, 2", graph=False)
def severity_per_hour(g: Graph):
    return severity_counts(g.table("events").select("ts", F.col("event_type").alias("severity")))


@query("snapshot_diff", "SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT CAST(page_id AS VARCHAR) AS p, md5(html) AS h FROM pages WHERE page_id % 5 <> 0) a FULL JOIN (SELECT CAST(page_id AS VARCHAR) AS p, md5(CASE WHEN page_id % 7 = 0 THEN url ELSE html END) AS h FROM pages WHERE page_id % 3 <> 0) b ON a.p = b.p WHERE a.h IS DISTINCT FROM b.h", graph=False)
def diff(g: Graph):
    pages = g.table("pages").withColumn("path", F.col("page_id").cast("string"))
    old = pages.where("page_id % 5 <> 0").select("path", F.md5("html").alias("hash"))
    new = pages.where("page_id % 3 <> 0").select("path", F.md5(F.when(F.col("page_id") % 7 == 0, F.col("url")).otherwise(F.col("html"))).alias("hash"))
    return snapshot_diff(old, new)


@query("file_language_counts", "SELECT lang, source, count(*) AS files, sum(n_chars) AS size FROM documents GROUP BY lang, source", graph=False)
def file_languages(g: Graph):
    return g.table("documents").groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"))


@query("missing_locales", "SELECT source, array_to_string(list_sort(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: NOT list_contains(l, x))), ',') AS missing FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY source)", graph=False)
def missing_locales(g: Graph):
    need = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "it")])
    return g.table("documents").groupBy("source").agg(F.collect_set("lang").alias("l")).select("source", F.array_join(F.array_sort(F.array_except(need, "l")), ",").alias("missing"))


_NAME = "regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Za-z0-9])([A-Z][a-z])', '\\1_\\2', 'g')"


@query("naming_snake", f"SELECT p_partkey, trim(lower({_NAME.format(c='c')}), '_') AS snake FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') AS c FROM part)", graph=False)
def naming_snake(g: Graph):
    camel = F.array_join(F.transform(F.split("p_name", " "), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1000))), "")
    return g.table("part").select("p_partkey", naming.to_snake(camel).alias("snake"))


@query("naming_plural", "SELECT w, CASE WHEN p THEN w WHEN regexp_matches(w, '(^|[^aeiou])y$') THEN w[:-2] || 'ies' WHEN regexp_matches(w, '[aeiou]z$') THEN w || 'zes' WHEN regexp_matches(w, '([sxz]|ch|sh)$') THEN w || 'es' ELSE w || 's' END AS plural, CASE WHEN regexp_matches(w, 'ies$') AND length(w) > 3 THEN w[:-4] || 'y' WHEN regexp_matches(w, 'zzes$') AND length(w) > 4 THEN w[:-4] WHEN regexp_matches(w, '([sxz]|ch|sh)es$') AND length(w) > 3 THEN w[:-3] WHEN regexp_matches(w, '[^s]s$') THEN w[:-2] ELSE w END AS singular FROM (SELECT w, regexp_matches(w, 'ies$') OR (length(w) > 3 AND regexp_matches(w, '([sxz]|ch|sh)es$')) OR (regexp_matches(w, 's$') AND NOT regexp_matches(w, '(ss|us|is)$')) AS p FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents WHERE lang = 'en'))", graph=False)
def naming_plural(g: Graph):
    words = g.table("documents").where("lang = 'en'").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))).alias("w")).distinct()
    return words.select("w", naming.pluralize("w").alias("plural"), naming.singularize("w").alias("singular"))


@query("naming_paths", "SELECT url, string_split(url, '?')[1] AS bare, CASE WHEN starts_with(url, '/') THEN url ELSE '/' || url END AS slashed, regexp_extract(url, '([^\\\\/:]*)$', 1) AS tail, regexp_extract(url, '([^\\\\/:.]*)$', 1) AS short FROM pages", graph=False)
def naming_paths(g: Graph):
    return g.table("pages").select("url", naming.strip_query("url").alias("bare"), naming.leading_slash("url").alias("slashed"), naming.strip_namespace("url").alias("tail"), naming.short_name("url").alias("short"))


@query("contract_parts", "SELECT id, string_split(name, ' ')[1] AS method, string_split(name, ' ')[2] AS path, string_split(name, ' ')[1] IN ('POST', 'PUT', 'PATCH', 'DELETE') AS writes FROM nodes WHERE kind = 'HttpContract'")
def contract_parts(g: Graph):
    method, path = naming.contract_parts("name")
    return g.nodes.where("kind = 'HttpContract'").select("id", method.alias("method"), path.alias("path"), naming.http_write(method).alias("writes"))
