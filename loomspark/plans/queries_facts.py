"""Queries of name resolution and naming over the fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import graph, phases, resolve
from .facts import Facts
from .projection import Graph
from .registry import facts_query, query

_M = "m AS (SELECT id, class || '::' || method AS fqn, class, method, class_id FROM methods)"


def _methods(f: Facts):
    return f.methods.withColumn("fqn", F.concat("class", F.lit("::"), "method"))


@facts_query("node_by_fqn", f", {_M} SELECT fqn, min(id) AS id FROM m GROUP BY fqn")
def node_by_fqn(f: Facts):
    return resolve.by_fqn(_methods(f))


@facts_query("call_owners", f", {_M}, c AS (SELECT s.id, s.file, CASE WHEN s.id % 5 = 0 THEN 'missing' ELSE m.fqn END AS owner_fqn, CASE WHEN s.id % 7 = 0 THEN 'none' ELSE m.class END AS owner_class FROM sites s JOIN m ON m.id = s.owner), l AS (SELECT k.file, m.fqn, min(m.id) AS v FROM m JOIN classes k ON k.id = m.class_id WHERE m.id % 2 = 0 GROUP BY 1, 2), g AS (SELECT fqn, min(id) AS v FROM (SELECT fqn, id FROM m UNION ALL SELECT fqn, id FROM classes) GROUP BY fqn), o AS (SELECT c.id, l.v AS a, g.v AS b, h.v AS d, 10000000000 + c.file AS e FROM c LEFT JOIN l ON l.file = c.file AND l.fqn = owner_fqn LEFT JOIN g ON g.fqn = owner_fqn LEFT JOIN g h ON h.fqn = owner_class) SELECT id, coalesce(a, b, d, e) AS node, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN d IS NOT NULL THEN 2 ELSE 3 END AS tier FROM o")
def call_owners(f: Facts):
    m = _methods(f)
    calls = f.sites.alias("s").join(m.alias("m"), F.col("s.owner") == F.col("m.id")).select("s.id", "s.file", F.when(F.col("s.id") % 5 == 0, "missing").otherwise(F.col("m.fqn")).alias("owner_fqn"), F.when(F.col("s.id") % 7 == 0, "none").otherwise(F.col("m.class")).alias("owner_class"))
    local = m.where("id % 2 = 0").join(f.classes.select(F.col("id").alias("class_id"), "file"), "class_id").select("file", "fqn", "id")
    files = f.classes.select("file", (F.lit(10_000_000_000) + F.col("file")).alias("id")).distinct()
    return resolve.call_owners(calls, local, m.select("fqn", "id").union(f.classes.select("fqn", "id")), files).select("id", "node", "tier")


_SHORT = "sh AS (SELECT lower(short) AS short, min(fqn) AS fqn FROM classes GROUP BY lower(short) HAVING count(DISTINCT fqn) = 1)"


@facts_query("imported_names", f", {_SHORT}, n AS (SELECT DISTINCT file, receiver AS name FROM sites WHERE receiver IS NOT NULL) SELECT n.file, n.name, coalesce(i.fqn, sh.fqn) AS fqn, CASE WHEN i.fqn IS NOT NULL THEN 0 WHEN sh.fqn IS NOT NULL THEN 1 END AS tier FROM n LEFT JOIN imports i ON i.file = n.file AND lower(i.alias) = lower(n.name) LEFT JOIN sh ON sh.short = lower(regexp_extract(n.name, '([^\\\\/:.]*)$', 1))")
def imported_names(f: Facts):
    return resolve.imported(f.sites.where("receiver is not null").select("file", F.col("receiver").alias("name")).distinct(), f.imports, f.classes)


@query("alias_lookup", "WITH a AS (SELECT 'svc' AS namespace, 'k' || CAST(s_suppkey % 40 AS VARCHAR) AS key, 'q' || CAST(s_suppkey % 3 AS VARCHAR) AS qualifier, s_suppkey AS node_id FROM supplier WHERE s_suppkey % 4 < 3), x AS (SELECT namespace, key, qualifier, max(node_id) AS v FROM a GROUP BY ALL), u AS (SELECT namespace, key, min(node_id) AS v FROM a GROUP BY ALL HAVING count(DISTINCT node_id) = 1), p AS (SELECT p_partkey AS id, 'svc' AS namespace, 'k' || CAST(p_partkey % 50 AS VARCHAR) AS key, 'q' || CAST(p_size % 4 AS VARCHAR) AS qualifier FROM part) SELECT id, coalesce(x.v, u.v) AS node, CASE WHEN x.v IS NOT NULL THEN 0 WHEN u.v IS NOT NULL THEN 1 END AS tier FROM p LEFT JOIN x USING (namespace, key, qualifier) LEFT JOIN u USING (namespace, key)", graph=False)
def alias_lookup(g: Graph):
    text = lambda c, n, p: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    aliases = g.table("supplier").where("s_suppkey % 4 < 3").select(F.lit("svc").alias("namespace"), text("s_suppkey", 40, "k").alias("key"), text("s_suppkey", 3, "q").alias("qualifier"), F.col("s_suppkey").alias("node_id"))
    asked = g.table("part").select(F.col("p_partkey").alias("id"), F.lit("svc").alias("namespace"), text("p_partkey", 50, "k").alias("key"), text("p_size", 4, "q").alias("qualifier"))
    return resolve.alias_lookup(asked, aliases).select("id", "node", "tier")


@facts_query("find_tables", ", t AS (SELECT row_number() OVER (ORDER BY key) AS id, CASE WHEN substr(key, 6) IN ('1', '2', '3') THEN upper(key) ELSE key END AS name FROM symbols WHERE table_name = 'schema'), a AS (SELECT DISTINCT arg0 AS key FROM sites WHERE arg0 IS NOT NULL), s AS (SELECT key, key AS spelling, 0 AS p FROM a UNION ALL SELECT key, regexp_replace(key, '^(eb_)+(.)', '\\2'), 1 FROM a), f AS (SELECT s.key, p AS rank, id FROM s JOIN t ON spelling = name UNION ALL SELECT s.key, p + 10, id FROM s JOIN t ON lower(spelling) = lower(name)) SELECT key, min(rank) AS rank, arg_min(id, rank) AS id FROM f GROUP BY key")
def find_tables(f: Facts):
    from pyspark.sql import Window

    own = f.symbols.where("table_name = 'schema'").select(F.row_number().over(Window.partitionBy("table_name").orderBy("key")).alias("id"), F.when(F.substring("key", 6, 9).isin("1", "2", "3"), F.upper("key")).otherwise(F.col("key")).alias("name"))
    return resolve.find_tables(f.sites.where("arg0 is not null").select(F.col("arg0").alias("key"), F.col("arg0").alias("name")).distinct(), own, ["eb_"])


_CHAIN = "ch(child, base, depth) AS (SELECT fqn, fqn, 0 FROM classes UNION ALL SELECT child, k.base, depth + 1 FROM ch JOIN classes k ON k.fqn = ch.base WHERE k.base IS NOT NULL AND depth < 20 AND k.base <> child)"


@facts_query("class_ancestors", f", {_CHAIN} SELECT child, base, depth FROM ch")
def class_ancestors(f: Facts):
    return resolve.ancestors(f.classes)


@facts_query("classes_below", f", {_CHAIN} SELECT DISTINCT child AS fqn FROM ch WHERE depth > 0 AND lower(base) LIKE '%c3'")
def classes_below(f: Facts):
    return resolve.has_supertype(f.classes, "C3")


_TYPED = f"{_SHORT}, o AS (SELECT s.*, k.fqn AS owner_fqn, k.base FROM sites s JOIN classes k ON k.id = s.owner_class), ty AS (SELECT o.id, o.owner, o.owner_fqn, o.method, CASE WHEN lower(receiver) IN ('this', 'self', 'static') THEN 'own' WHEN lower(receiver) = 'parent' THEN CASE WHEN base IS NOT NULL THEN 'base' END WHEN i.fqn IS NOT NULL THEN 'import' WHEN sh.fqn IS NOT NULL THEN 'short' END AS how, CASE WHEN lower(receiver) IN ('this', 'self', 'static') THEN owner_fqn WHEN lower(receiver) = 'parent' THEN base ELSE coalesce(i.fqn, sh.fqn) END AS fqn FROM o LEFT JOIN imports i ON i.file = o.file AND i.alias = receiver LEFT JOIN sh ON sh.short = lower(regexp_extract(receiver, '([^\\\\/:.]*)$', 1)))"


def _typed(f: Facts):
    return f.sites.join(f.classes.select(F.col("id").alias("owner_class"), F.col("fqn").alias("owner_fqn")), "owner_class").select("id", "owner", "file", "owner_fqn", "receiver", "method")


@facts_query("receiver_types", f", {_TYPED} SELECT id, how, fqn FROM ty")
def receiver_types(f: Facts):
    return resolve.receiver_types(_typed(f), f.classes, f.imports).select("id", "how", "fqn")


@facts_query("resolved_calls", f", {_TYPED}, {_CHAIN}, d AS (SELECT class, method, min(id) AS to_id FROM methods GROUP BY 1, 2), e AS (SELECT id, owner, how, arg_min(to_id, depth) AS to_id FROM ty JOIN ch ON child = ty.fqn JOIN d ON d.class = ch.base AND d.method = ty.method GROUP BY id, owner, how) SELECT owner AS from_id, to_id, max(CASE WHEN how IN ('own', 'base', 'full') THEN 1.0 ELSE 0.7 END)::DOUBLE AS confidence FROM e WHERE owner <> to_id GROUP BY 1, 2")
def resolved_calls(f: Facts):
    return resolve.resolved_calls(_typed(f), f.classes, f.imports, f.methods)


@query("controllers", "WITH k AS (SELECT 'app\\' || c_mktsegment || '\\controller\\v' || CAST(c_nationkey AS VARCHAR) || '\\User' || CAST(c_custkey % 300 AS VARCHAR) AS fqn FROM customer), a AS (SELECT p_partkey AS key, CASE p_partkey % 2 WHEN 0 THEN 'building' ELSE 'MACHINERY' END AS module, 'v' || CAST(p_size % 25 AS VARCHAR) || '/User' || CAST(p_partkey % 300 AS VARCHAR) AS name FROM part), m AS (SELECT key, fqn FROM a JOIN k ON lower(k.fqn) LIKE '%\\' || lower(replace(a.name, '/', '\\')) AND list_contains(string_split(lower(k.fqn), '\\'), lower(module))) SELECT key, min(fqn) AS fqn FROM m GROUP BY key HAVING count(DISTINCT fqn) = 1", graph=False)
def controllers(g: Graph):
    classes = g.table("customer").select(F.concat(F.lit("app\\"), "c_mktsegment", F.lit("\\controller\\v"), F.col("c_nationkey").cast("string"), F.lit("\\User"), (F.col("c_custkey") % 300).cast("string")).alias("fqn"))
    asked = g.table("part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, "building").otherwise("MACHINERY").alias("module"), F.concat(F.lit("v"), (F.col("p_size") % 25).cast("string"), F.lit("/User"), (F.col("p_partkey") % 300).cast("string")).alias("name"))
    return resolve.controllers(asked, classes)


@facts_query("same_line_args", " SELECT DISTINCT a.id, b.method, b.arg0 FROM sites a JOIN sites b ON a.file = b.file AND a.line = b.line AND a.owner = b.owner AND b.method = 'only' WHERE a.method <> 'only'")
def same_line_args(f: Facts):
    # the file of a chained call is its owner here: call sites of one nation share their lines by accident
    calls = f.sites.withColumn("place", F.concat_ws(":", "file", "owner")).select("id", F.col("place").alias("file"), "line", "method", "arg0")
    return resolve.same_line_args(calls, ["only"])


@facts_query("route_prefixes", ", g AS (SELECT s.id, array_to_string(list(p.label ORDER BY p.a, -p.b, p.label), '/') AS prefix FROM sites s JOIN (SELECT DISTINCT file, a, b, label FROM spans) p ON p.file = s.file AND s.line BETWEEN p.a AND p.b GROUP BY s.id) SELECT s.id, coalesce(prefix, '') AS prefix FROM sites s LEFT JOIN g USING (id)")
def route_prefixes(f: Facts):
    return resolve.route_prefixes(f.sites.select("id", "file", "line"), f.spans)


@facts_query("route_guards", " SELECT id, class, label FROM (SELECT s.id, p.class, p.label, row_number() OVER (PARTITION BY s.id, p.class ORDER BY p.a DESC, -p.b DESC, p.label DESC) AS n FROM sites s JOIN spans p ON p.file = s.file AND s.line BETWEEN p.a AND p.b) WHERE n = 1")
def route_guards(f: Facts):
    return resolve.guards_of(f.sites.select("id", "file", "line"), f.spans)


@query("declared_middleware", ", c AS (SELECT id, regexp_extract(name, '^\\S* (.*)$', 1) AS path FROM nodes WHERE kind = 'HttpContract'), d AS (SELECT 100 + r_regionkey AS id, CASE r_regionkey WHEN 0 THEN '' WHEN 1 THEN '/list' WHEN 2 THEN '/save' WHEN 3 THEN '/sav' ELSE '/find/7' END AS prefix FROM (SELECT DISTINCT sub AS r_regionkey FROM nodes WHERE sub < 5)) SELECT DISTINCT 'PassesThrough' AS kind, c.id AS from_id, d.id AS to_id FROM c JOIN d ON d.prefix = '' OR path = d.prefix OR starts_with(path, d.prefix || '/') WHERE NOT (c.id % 10 = 0 AND d.id = 100)")
def declared_middleware(g: Graph):
    contracts = g.nodes.where("kind = 'HttpContract'").select("id", naming.contract_parts("name")[1].alias("path"))
    key = F.col("sub")
    prefix = F.when(key == 0, "").when(key == 1, "/list").when(key == 2, "/save").when(key == 3, "/sav").otherwise("/find/7")
    declared = g.nodes.where("sub < 5").select("sub").distinct().select((key + 100).alias("id"), prefix.alias("prefix"))
    existing = contracts.where("id % 10 = 0").select(F.col("id").alias("from_id"), F.lit(100).cast("long").alias("to_id"))
    return resolve.declared_middleware(contracts, declared, existing)


@query("rows_of_sub_projects", "SELECT event_id FROM events WHERE user_id % 6 = 0 OR user_id % 6 IN (2, 4)", graph=False)
def rows_of_subs(g: Graph):
    rows = g.table("events").select("event_id", F.when(F.col("user_id") % 6 != 0, F.col("user_id") % 6).alias("sub"))
    return resolve.rows_of_subs(rows, [2, 4]).select("event_id")


@query("columns_of_tables_by_edges", "WITH h AS (SELECT 3000000000 + p_partkey AS from_id, 100 + p_size AS column_id FROM part WHERE p_partkey % 4 = 0 UNION SELECT c_custkey, 200 + c_nationkey FROM customer UNION SELECT c_custkey, 300 + c_custkey % 5 FROM customer), t AS (SELECT 3000000000 + p_partkey AS id FROM part), d AS (SELECT id AS table_id, column_id FROM t JOIN h ON id = from_id), m AS (SELECT c_custkey AS owner, 3000000000 + c_custkey AS table_id FROM customer WHERE c_custkey % 3 < 2) SELECT table_id, column_id FROM d UNION SELECT table_id, column_id FROM m JOIN h ON owner = from_id WHERE table_id IN (SELECT id FROM t) AND table_id NOT IN (SELECT table_id FROM d)", graph=False)
def columns_by_edges(g: Graph):
    part, customer = g.table("part"), g.table("customer")
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.cast("long").alias("from_id"), b.cast("long").alias("to_id"))
    key = F.col("c_custkey")
    edges = edge(part.where("p_partkey % 4 = 0"), "HasColumn", F.col("p_partkey") + 3_000_000_000, F.col("p_size") + 100).union(edge(customer, "HasColumn", key, F.col("c_nationkey") + 200)).union(edge(customer, "HasColumn", key, key % 5 + 300)).union(edge(customer.where("c_custkey % 3 < 2"), "MapsTo", key, key + 3_000_000_000))
    return resolve.columns_of(edges, part.select((F.col("p_partkey") + 3_000_000_000).alias("id")))


@facts_query("node_places", ", n AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE file END AS file_id, CASE WHEN id % 4 = 0 THEN NULL ELSE line END AS line, CASE id % 2 WHEN 0 THEN '/abs/a.php:7' ELSE 'src/b.php:9' END AS place FROM sites WHERE arg_count = 1) SELECT n.id, CASE WHEN file_id IS NOT NULL THEN '/root/p/' || c.path WHEN id % 2 = 0 THEN '/abs/a.php' ELSE '/root/p/src/b.php' END AS path, coalesce(line, CASE id % 2 WHEN 0 THEN 7 ELSE 9 END) AS line FROM n LEFT JOIN (SELECT file, path FROM configs) c ON c.file = file_id")
def node_places(f: Facts):
    nodes = f.sites.where("arg_count = 1").select("id", F.when(F.col("id") % 3 != 0, F.col("file")).alias("file_id"), F.when(F.col("id") % 4 != 0, F.col("line").cast("long")).alias("line"), F.when(F.col("id") % 2 == 0, "/abs/a.php:7").otherwise("src/b.php:9").alias("place"))
    return resolve.locations(nodes, f.configs.select("file", "path"), "/root/p")


@facts_query("unclaimed_classes", " SELECT id, fqn FROM classes WHERE id NOT IN (SELECT class_id FROM methods WHERE id % 9 = 0) AND fqn NOT IN (SELECT base FROM classes WHERE base IS NOT NULL AND id % 2 = 0)")
def unclaimed(f: Facts):
    edges = f.methods.where("id % 9 = 0").select(F.lit("HandledBy").alias("kind"), F.col("class_id").alias("to_id"))
    pending = f.classes.where("base is not null and id % 2 = 0").select(F.lit("HandledBy").alias("kind"), F.col("base").alias("target"))
    return resolve.unclaimed(f.classes.select("id", "fqn"), edges, pending, "HandledBy")


_FUNNEL = "asked AS (SELECT DISTINCT receiver AS key FROM sites WHERE receiver IS NOT NULL), l1 AS (SELECT alias AS key, min(fqn) AS value FROM imports WHERE file % 2 = 0 GROUP BY alias), l2 AS (SELECT alias AS key, min(fqn) AS value FROM imports GROUP BY alias), l4 AS (SELECT short AS key, min(fqn) AS value FROM classes GROUP BY short), bound AS (SELECT fqn AS key, min(base) AS value FROM classes WHERE base IS NOT NULL AND id % 2 = 0 GROUP BY fqn), r AS (SELECT key, coalesce(l1.value, l2.value, l4.value) AS v, CASE WHEN l1.value IS NOT NULL THEN 'binding' WHEN l2.value IS NOT NULL THEN 'alias' ELSE 'short' END AS layer FROM asked LEFT JOIN l1 USING (key) LEFT JOIN l2 USING (key) LEFT JOIN l4 USING (key)), res AS (SELECT r.key, coalesce(bound.value, v) AS value, layer, CASE layer WHEN 'binding' THEN 1.0 WHEN 'alias' THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM r LEFT JOIN bound ON bound.key = v WHERE v IS NOT NULL)"


def _funnel(f: Facts):
    asked = f.sites.where("receiver is not null").select(F.col("receiver").alias("key")).distinct()
    alias = f.imports.select(F.col("alias").alias("key"), F.col("fqn").alias("value"), "file")
    bound = f.classes.where("base is not null and id % 2 = 0").select(F.col("fqn").alias("key"), F.col("base").alias("value"))
    short = f.classes.select(F.col("short").alias("key"), F.col("fqn").alias("value"))
    return resolve.container_funnel(bound, [("binding", alias.where("file % 2 = 0"), 1.0), ("alias", alias, 0.9), ("short", short, 0.6)], asked)


@facts_query("container_funnel", f", {_FUNNEL} SELECT * FROM res")
def container_funnel(f: Facts):
    return _funnel(f)


@facts_query("resolution_edges", f", {_FUNNEL}, l AS (SELECT owner AS from_id, value, confidence FROM sites JOIN res ON receiver = key) SELECT from_id, min_id AS to_id, max(confidence) AS confidence FROM l JOIN (SELECT fqn, min(id) AS min_id FROM classes WHERE id % 3 > 0 GROUP BY fqn) ON fqn = value GROUP BY 1, 2")
def resolution_edges(f: Facts):
    links = f.sites.select(F.col("owner").alias("from_id"), F.col("receiver").alias("key")).join(_funnel(f), "key")
    return resolve.applied(links, f.classes.where("id % 3 > 0"))[0].drop("kind")


@facts_query("resolution_misses", f", {_FUNNEL} SELECT DISTINCT owner AS from_id, 'no node ' || value AS message FROM sites JOIN res ON receiver = key WHERE value NOT IN (SELECT fqn FROM classes WHERE id % 3 > 0)")
def resolution_misses(f: Facts):
    links = f.sites.select(F.col("owner").alias("from_id"), F.col("receiver").alias("key")).join(_funnel(f), "key")
    return resolve.applied(links, f.classes.where("id % 3 > 0"))[1].drop("code")


@facts_query("db_verbs", ", t AS (SELECT key AS name, CAST(regexp_extract(key, '(\\d+)', 1) AS BIGINT) AS id FROM symbols WHERE table_name = 'schema') SELECT DISTINCT CASE method WHEN 'get' THEN 'ReadsDb' ELSE 'WritesDb' END AS kind, owner AS from_id, t.id AS to_id FROM sites JOIN t ON t.name = replace(arg0, 'eb_', '') WHERE method IN ('get', 'set')")
def db_verbs(f: Facts):
    verbs = f.spark.createDataFrame([("GET", "ReadsDb"), ("set", "WritesDb")], "method string, kind string")
    tables = f.symbols.where("table_name = 'schema'").select(F.col("key").alias("name"), F.regexp_extract("key", r"(\d+)", 1).cast("long").alias("id"))
    return resolve.db_verbs(f.sites.select("owner", "method", F.replace("arg0", F.lit("eb_"), F.lit("")).alias("table")), verbs, tables)


@facts_query("tainted_sinks", ", t(id, owner, var, d, hit) AS (SELECT owner * 10 + 1, owner, 'v1', 0, false FROM (SELECT DISTINCT owner FROM assigns) UNION ALL SELECT t.id, t.owner, regexp_extract(a.rhs, '\\$(\\w+)', 1), d + 1, contains(a.rhs, '_GET') FROM t JOIN assigns a ON a.owner = t.owner AND a.var = t.var WHERE d < 4) SELECT id, CASE WHEN bool_or(hit) THEN 'tainted' ELSE 'tainted_unknown' END AS kind FROM t GROUP BY id")
def tainted_sinks(f: Facts):
    sinks = f.assigns.select("owner").distinct().select((F.col("owner") * 10 + 1).alias("id"), "owner", F.lit("v1").alias("var"))
    return phases.tainted(sinks, f.assigns, r"\$_GET")


@facts_query("schema_columns", ", s AS (SELECT key, ['id', 'c_' || value] AS columns FROM symbols WHERE table_name = 'schema'), t AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'PART_' || CAST(id % 60 AS VARCHAR) ELSE 'part_' || CAST(id % 60 AS VARCHAR) END AS name FROM classes), m AS (SELECT id, unnest(columns) AS col FROM t JOIN s ON s.key = lower(t.name)) SELECT DISTINCT id AS table_id, col AS \"column\" FROM m")
def schema_columns(f: Facts):
    schema = f.symbols.where("table_name = 'schema'").select(F.col("key").alias("table"), F.array(F.lit("id"), F.concat(F.lit("c_"), "value")).alias("columns"))
    name = F.concat(F.when(F.col("id") % 2 == 0, "PART_").otherwise("part_"), (F.col("id") % 60).cast("string"))
    return phases.columns_of_tables(f.classes.select("id", name.alias("name")), schema)


@facts_query("weak_sign_matches", ", c AS (SELECT owner, 'if (' || coalesce(min(method), 'x') || '() == $sign)' AS text FROM sites WHERE in_loop GROUP BY owner), m AS (SELECT c.owner, s.id, CASE WHEN contains(text, s.method) THEN 0 ELSE 1 END AS tier FROM c JOIN sites s ON s.owner = c.owner), b AS (SELECT owner, min(tier) AS tier FROM m GROUP BY owner) SELECT min(id) AS id, tier FROM m JOIN b USING (owner, tier) GROUP BY owner, tier")
def weak_sign_matches(f: Facts):
    compares = f.sites.where("in_loop").groupBy("owner").agg(F.concat(F.lit("if ("), F.min("method"), F.lit("() == $sign)")).alias("text"))
    return phases.weak_signs(compares, f.sites.select("id", "owner", F.col("method").alias("callee")))


@query("route_guard_edges", ", r AS (SELECT name, unnest(CASE WHEN id % 3 = 0 THEN ['auth', 'log'] ELSE ['log'] END) AS class FROM nodes WHERE kind = 'HttpContract' AND id % 4 > 0) SELECT 'PassesThrough' AS kind, n.id AS from_id, CASE class WHEN 'auth' THEN 1 ELSE 2 END AS to_id FROM nodes n JOIN r ON r.name = n.name WHERE n.kind = 'HttpContract'")
def route_guard_edges(g: Graph):
    contracts = g.nodes.where("kind = 'HttpContract'").select("id", "name")
    routes = contracts.where("id % 4 > 0").select("name", F.when(F.col("id") % 3 == 0, F.array(F.lit("auth"), F.lit("log"))).otherwise(F.array(F.lit("log"))).alias("guards"))
    return phases.guard_edges(contracts, routes, g.spark.createDataFrame([("auth", 1), ("log", 2)], "class string, id long"))


@query("maps_suppressed", "SELECT CASE WHEN from_id % 2 = 0 AND kind = 'WritesDb' THEN 'MapsTo' ELSE kind END AS kind, from_id, to_id FROM edges e WHERE kind IN ('WritesDb', 'ReadsDb') AND NOT (kind = 'WritesDb' AND from_id % 2 = 0 AND EXISTS (SELECT 1 FROM edges r WHERE r.kind = 'ReadsDb' AND r.from_id = e.from_id AND r.to_id = e.to_id))")
def maps_suppressed(g: Graph):
    from ..operators.store import without_reads_covered_by

    own = g.edges.where("kind IN ('WritesDb', 'ReadsDb')")
    return without_reads_covered_by(own.withColumn("kind", F.when((F.col("from_id") % 2 == 0) & (F.col("kind") == "WritesDb"), "MapsTo").otherwise(F.col("kind")))).select("kind", "from_id", "to_id")


@query("types_at_fixpoint", ", r(node) AS (SELECT to_id FROM edges WHERE kind = 'HandledBy' UNION SELECT to_id FROM r JOIN edges ON kind = 'Calls' AND from_id = node) SELECT node FROM r")
def types_at_fixpoint(g: Graph):
    calls = g.edges.where("kind = 'Calls'").select(F.col("from_id").alias("node"), "to_id")
    start = g.edges.where("kind = 'HandledBy'").select(F.col("to_id").alias("node"))
    return graph.fixpoint(start, lambda known: known.join(calls, "node").select(F.col("to_id").alias("node")), 100)


@facts_query("best_access_edges", " SELECT file AS layer, owner AS node, id AS edge_id FROM (SELECT *, row_number() OVER (PARTITION BY file, owner ORDER BY in_loop DESC, arg_count, line DESC, id) AS n FROM sites) WHERE n = 1")
def best_access(f: Facts):
    edges = f.sites.select(F.col("file").alias("layer"), F.col("owner").alias("node"), F.col("in_loop").alias("direct"), F.col("arg_count").alias("rank"), F.col("line").alias("strength"), F.col("id").alias("edge_id"))
    return resolve.best_access(edges).select("layer", "node", "edge_id")


@query("naming_steps", "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/+$', '') AS a, regexp_replace('/users/:id/' || CAST(page_id AS VARCHAR) || '/:x', '(^|/):[^/]*', '\\1:*', 'g') AS b, 'order_' || CAST(page_id AS VARCHAR) AS c, upper(string_split(url, '?')[1]) AS d FROM pages", graph=False)
def naming_steps(g: Graph):
    key = F.col("page_id").cast("string")
    return g.table("pages").select(
        "page_id", naming.normalize("url", [("strip_prefix", ["https://", "http://"]), ("replace", "//", "//")]).alias("a0"), naming.normalize(F.concat(F.lit(" /users/:id/"), key, F.lit("/:x?q=1 ")), ["strip_query", "param_wildcard"]).alias("b"),
        naming.strip_prefixes(F.concat(F.lit("eb_eb_order_"), key), ["eb_"]).alias("c"), naming.normalize("url", ["strip_query", "upper"]).alias("d"),
    ).select("page_id", F.regexp_replace("a0", "/+$", "").alias("a"), "b", "c", "d")


@query("naming_parts", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), ',') AS words, 'get,' || lower(string_split(p_name, ' ')[1]) AS humps FROM part", graph=False)
def naming_parts(g: Graph):
    first = F.split("p_name", " ")[0]
    hump = F.concat(F.lit("get"), F.upper(F.left(first, F.lit(1))), F.substring(first, 2, 99))
    return g.table("part").select("p_partkey", F.array_join(naming.action_words("p_name"), ",").alias("words"), F.array_join(naming.camel_words(hump), ",").alias("humps"))


@query("naming_owners", "SELECT o_orderkey, 'C' || CAST(o_custkey AS VARCHAR) AS cls, 'm' || CAST(o_orderkey AS VARCHAR) AS member, 'a/b' || CAST(o_custkey AS VARCHAR) AS controller, CASE WHEN o_orderkey % 2 = 0 THEN 'show' ELSE 'index' END AS action, 'src/f' || CAST(o_custkey AS VARCHAR) || '.php' AS path, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS BIGINT) END AS line, o_orderkey % 5 = 0 AS test FROM orders", graph=False)
def naming_owners(g: Graph):
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    full = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("C"), c, F.lit("::m"), o)).otherwise(F.concat(F.lit("C"), c, F.lit(".m"), o))
    handler = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("a/b"), c, F.lit("@show"))).otherwise(F.concat(F.lit("a/b"), c, F.lit("@index")))
    place = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("src/f"), c, F.lit(".php:"), o)).otherwise(F.concat(F.lit("src/f"), c, F.lit(".php")))
    test = naming.is_test_path(F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("a/tests/"), c)).otherwise(F.concat(F.lit("a/latest/"), c)))
    controller, action = naming.split_handler(handler)
    path, line = naming.split_file_line(place)
    return g.table("orders").select("o_orderkey", naming.owner_class(full).alias("cls"), naming.owner_member(full).alias("member"), controller.alias("controller"), action.alias("action"), path.alias("path"), line.alias("line"), test.alias("test"))


@facts_query("naming_types", " SELECT id, CASE WHEN id % 3 = 0 THEN base WHEN id % 3 = 1 THEN fqn ELSE 'app\\x\\' || short END AS full, 'app\\model\\c' || CAST(id AS VARCHAR) AS norm, replace(replace(replace(short || '_100%', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM classes")
def naming_types(f: Facts):
    own = f.classes
    name = F.when(F.col("id") % 3 == 1, F.concat(F.lit("\\"), "fqn")).otherwise(F.col("short"))
    given = F.when(F.col("id") % 3 == 0, F.col("base"))
    namespace = F.when((F.col("id") % 3 == 0) & F.col("base").isNull(), F.lit(None).cast("string")).otherwise("app\\x")
    found = naming.resolve_type(name, given, namespace)
    full = F.when((F.col("id") % 3 == 0) & F.col("base").isNull(), F.lit(None).cast("string")).otherwise(found)
    return own.select("id", full.alias("full"), naming.norm_class(F.concat(F.lit("\\"), "fqn", F.lit("::class"))).alias("norm"), naming.like_escape(F.concat("short", F.lit("_100%"))).alias("escaped"))


@facts_query("naming_variables", " SELECT owner, var, CASE WHEN starts_with(rhs, '$_') THEN '_GET' ELSE regexp_extract(rhs, '\\$(\\w+)', 1) END AS names, CASE WHEN starts_with(rhs, '$_') THEN '' ELSE ' . suffix' END AS bare, false AS sql FROM assigns")
def naming_variables(f: Facts):
    return f.assigns.select("owner", "var", F.array_join(naming.variable_names("rhs"), ",").alias("names"), naming.strip_variables("rhs").alias("bare"), naming.has_sql_word("rhs").alias("sql"))


@query("contract_writes", "SELECT id, string_split(name, ' ')[1] IN ('POST', 'PUT', 'PATCH', 'DELETE') AS by_method, regexp_matches(name, '/(delete|save)/') AS by_words FROM nodes WHERE kind = 'HttpContract'")
def contract_writes(g: Graph):
    method, path = naming.contract_parts("name")
    return g.nodes.where("kind = 'HttpContract'").select("id", naming.infer_write(method, path).alias("by_method"), naming.infer_write(F.lit("ANY"), path).alias("by_words"))
