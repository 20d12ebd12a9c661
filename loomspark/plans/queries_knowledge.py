"""Queries of knowledge rules: every selector, every predicate, bindings, merge strategies, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import knowledge
from .facts import Facts
from .knowledge import KnowledgeRule
from .projection import Graph
from .registry import facts_query, query

RULES_TEXT = """
rules:
  - id: cache-read
    select: {call: {callee: "*Cache::{get, only}"}}
    where: [{arg_starts_with: {arg: 0, prefix: key_}}]
    annotate: {channel: FkbMark, kind: cache-read, confidence: 0.8}
  - id: any-get
    select: {call: {callee: "get"}}
    annotate: {channel: FkbMark, kind: cache-read, confidence: 0.5}
  - id: table-name
    select: {call: {callee: "Db::name"}}
    where: [{in_symbol_table: {table: schema}}]
    synthesize: {node_kind: Table, identity: {arg: 0, normalize: [[strip_prefix, [eb_]]]}, link: {kind: ReadsDb, direction: incoming}, confidence: 0.9}
  - id: loop-set
    select: {call: {callee: "set"}}
    where: [{arg_count: 1}, {not: {arg_starts_with: {arg: 0, prefix: eb_}}}]
    annotate: {channel: Capability, kind: writes}
  - id: by-alias
    select: {call: {callee: "C7::only"}}
    annotate: {channel: FkbMark, kind: aliased}
"""
RULES = knowledge.load(RULES_TEXT, "own")


def _calls(f: Facts):
    calls = f.sites.withColumn("args", F.when(F.col("arg0").isNull(), F.array().cast("array<string>")).otherwise(F.array("arg0")))
    return knowledge.with_symbols(knowledge.with_imports(calls, f.imports), f.symbols, F.col("arg0"), ["eb_"])


_AL = "al AS (SELECT lower(alias) AS a, arg_min(fqn, struct_pack(f := file, q := fqn)) AS alias_fqn FROM imports GROUP BY 1), c AS (SELECT s.*, alias_fqn FROM sites s LEFT JOIN al ON a = lower(receiver))"
_CACHE = "(lower(receiver) = 'cache' OR regexp_matches(lower(receiver), '[\\\\/.:>$]cache$'))"
_C7 = "coalesce(lower(receiver) = 'c7' OR regexp_matches(lower(receiver), '[\\\\/.:>$]c7$') OR regexp_matches(lower(alias_fqn), '[\\\\/.:>$]c7$'), false)"
_M = f"mt AS (SELECT id, 'own.cache-read' AS rule_id FROM c WHERE {_CACHE} AND method IN ('get', 'only') AND starts_with(arg0, 'key_') UNION ALL SELECT id, 'own.any-get' FROM c WHERE method = 'get' UNION ALL SELECT id, 'own.table-name' FROM c WHERE receiver = 'Db' AND method = 'name' AND replace(arg0, 'eb_', '') IN (SELECT key FROM symbols WHERE table_name = 'schema') UNION ALL SELECT id, 'own.loop-set' FROM c WHERE method = 'set' AND arg0 IS NOT NULL AND NOT starts_with(arg0, 'eb_') UNION ALL SELECT id, 'own.by-alias' FROM c WHERE {_C7} AND method = 'only')"


def _matched(f: Facts):
    return knowledge.matches(_calls(f), RULES, "call")


@facts_query("knowledge_calls", f", {_AL}, {_M} SELECT * FROM mt")
def knowledge_calls(f: Facts):
    return _matched(f).select("id", "rule_id")


@facts_query("knowledge_annotations", f", {_AL}, {_M}, a AS (SELECT id AS node_id, CASE rule_id WHEN 'own.loop-set' THEN 'Capability' ELSE 'FkbMark' END AS channel, CASE rule_id WHEN 'own.loop-set' THEN 'writes' WHEN 'own.by-alias' THEN 'aliased' ELSE 'cache-read' END AS kind, CASE rule_id WHEN 'own.cache-read' THEN 0.8 WHEN 'own.any-get' THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, rule_id FROM mt WHERE rule_id <> 'own.table-name') SELECT node_id, channel, kind, confidence, rule_id FROM a QUALIFY row_number() OVER (PARTITION BY node_id, channel, kind ORDER BY confidence DESC, rule_id) = 1")
def knowledge_annotations(f: Facts):
    return knowledge.annotations(_matched(f), RULES)


@facts_query("knowledge_nodes", f", {_AL}, {_M} SELECT 'Table:' || CAST(sub AS VARCHAR) || ':' || replace(arg0, 'eb_', '') AS identity, min(id) AS id, count(*) AS merged FROM mt JOIN c USING (id) WHERE rule_id = 'own.table-name' GROUP BY 1")
def knowledge_nodes(f: Facts):
    rule = next(r for r in RULES if r.action == "synthesize")
    return knowledge.synthesized(_matched(f), rule)[0].select("identity", "id", "merged")


@facts_query("knowledge_links", f", {_AL}, {_M} SELECT DISTINCT 'ReadsDb' AS kind, id AS from_id, 'Table:' || CAST(sub AS VARCHAR) || ':' || replace(arg0, 'eb_', '') AS identity FROM mt JOIN c USING (id) WHERE rule_id = 'own.table-name'")
def knowledge_links(f: Facts):
    rule = next(r for r in RULES if r.action == "synthesize")
    return knowledge.synthesized(_matched(f), rule)[1].select("kind", "from_id", "identity")


@facts_query("knowledge_link_targets", " SELECT DISTINCT 'Calls' AS kind, s.id AS from_id, k.id AS to_id FROM sites s JOIN (SELECT short, min(id) AS id FROM classes GROUP BY short HAVING count(*) = 1) k ON k.short = s.receiver WHERE s.method = 'get'")
def knowledge_link_targets(f: Facts):
    rule = KnowledgeRule("l", "call", {"callee": "get"}, "link", {"kind": "Calls", "to": {"receiver_class": True}})
    own = knowledge.matches(f.sites.withColumn("alias_fqn", F.lit(None).cast("string")), [rule], "call")
    return knowledge.linked(own, rule, f.classes.select("id", F.col("short").alias("key")))


_INH = "ch(child, base, depth) AS (SELECT fqn, fqn, 0 FROM classes UNION ALL SELECT child, k.base, depth + 1 FROM ch JOIN classes k ON k.fqn = ch.base WHERE k.base IS NOT NULL AND depth < 20 AND k.base <> child)"


@facts_query("knowledge_inheritance", f", {_INH} SELECT DISTINCT child AS fqn FROM ch WHERE depth > 0 AND lower(base) LIKE '%\\c2'")
def knowledge_inheritance(f: Facts):
    from ..operators.resolve import ancestors

    bases = ancestors(f.classes).where("depth > 0").groupBy(F.col("child").alias("fqn")).agg(F.collect_list("base").alias("bases"))
    rule = KnowledgeRule("i", "inheritance", {"base": "C2"}, "annotate", {})
    return knowledge.matches(f.classes.select("fqn").distinct().join(bases, "fqn", "left"), [rule], "inheritance").select("fqn")


@facts_query("knowledge_config_entries", " SELECT file, key_path FROM configs WHERE (path = 'config/app.json' AND key_path LIKE 'section%.item.%') OR (path LIKE '%lang/de/text.json' AND json_array_length(value) >= 2)")
def knowledge_config_entries(f: Facts):
    rules = [KnowledgeRule("a", "config_entry", {"file": "config/app.json", "key_path": "section*.item.*"}, "annotate", {}), KnowledgeRule("b", "config_entry", {"file": "lang/{locale}/text.json"}, "annotate", {}, ({"entry_arity_gte": 2},))]
    return knowledge.matches(f.configs, rules, "config_entry").select("file", "key_path")


_NODE_PREDICATES = {
    "has_property": ({"has_property": "handler"}, "list_contains(json_keys(props), 'handler')"),
    "has_annotation": ({"has_annotation": {"kind": "pii"}}, "id IN (SELECT node_id FROM marks WHERE kind = 'pii')"),
    "has_annotation_case": ({"not": {"has_annotation": "PII"}}, "true"),
    "none_of_capability": ({"none_of_capability": ["Authentication"]}, "id NOT IN (SELECT node_id FROM marks WHERE channel = 'Capability' AND kind = 'Authentication')"),
    "fan_in_gte": ({"fan_in_gte": 3}, "id IN (SELECT to_id FROM edges GROUP BY to_id HAVING count(*) >= 3)"),
    "name_matches": ({"name_matches": "BUILDING/1"}, "contains(lower(coalesce(identity, name)), 'building/1')"),
    "property_is": ({"property_is": {"name": "side", "value": "backend"}}, "json_extract_string(props, '$.side') = 'backend'"),
    "property_is_bool": ({"property_is": {"name": "in_loop", "value": True}}, "json_extract_string(props, '$.in_loop') = 'true'"),
    "fqn_matches": ({"fqn_matches": "customer_1::"}, "contains(lower(coalesce(fqn, name)), 'customer_1::')"),
    "name_not_in": ({"name_not_in": ["EUROPE", "asia"]}, "lower(name) NOT IN ('europe', 'asia')"),
    "has_incoming": ({"has_incoming": "WritesDb"}, "id IN (SELECT to_id FROM edges WHERE kind = 'WritesDb')"),
    "not_claimed_by": ({"not_claimed_by": "HandledBy"}, "id NOT IN (SELECT to_id FROM edges WHERE kind = 'HandledBy')"),
}


def _enriched(g: Graph):
    into = g.edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("fan_in_all"), F.collect_set("kind").alias("in_kinds"))
    marks = g.marks.groupBy(F.col("node_id").alias("id")).agg(F.collect_set("kind").alias("mark_kinds"), F.collect_set(F.when(F.col("channel") == "Capability", F.col("kind"))).alias("capabilities"))
    return g.nodes.join(into, "id", "left").join(marks, "id", "left").withColumn("claimed_by", F.col("in_kinds"))


for _name, (_p, _sql) in _NODE_PREDICATES.items():

    @query(f"knowledge_where_{_name}", f"SELECT kind, count(*) AS n FROM nodes WHERE kind <> 'File' AND coalesce({_sql}, false) GROUP BY kind")
    def _(g: Graph, p=_p):
        return _enriched(g).where(knowledge.where_column(p)).groupBy("kind").agg(F.count("*").alias("n"))


@query("knowledge_nodes_by_kind", "SELECT id FROM nodes WHERE kind = 'Table' AND contains(lower(coalesce(identity, name)), 'an')")
def knowledge_nodes_by_kind(g: Graph):
    return knowledge.matches(g.nodes, [KnowledgeRule("n", "node", {"node_kind": "Table"}, "annotate", {}, ({"name_matches": "an"},))], "node").select("id")


@query("knowledge_columns_match", "SELECT id FROM nodes WHERE kind = 'Table' AND (id % 5 = 0 OR id % 7 = 0)")
def knowledge_columns_match(g: Graph):
    columns = F.when(F.col("id") % 5 == 0, F.array(F.lit("id"), F.lit("Mobile"))).when(F.col("id") % 7 == 0, F.array(F.lit("user_MOBILE"))).otherwise(F.array(F.lit("automobile")))
    return g.nodes.where("kind = 'Table'").withColumn("columns", columns).where(knowledge.where_column({"columns_match": {"table": "schema", "names": ["mobile"]}})).select("id")


@query("knowledge_has_missing", "SELECT source FROM documents GROUP BY source HAVING NOT list_has_all(list(DISTINCT lang), ['de', 'en', 'pt'])", graph=False)
def knowledge_has_missing(g: Graph):
    own = g.table("documents").groupBy("source").agg(F.collect_set("lang").alias("locales"))
    return own.where(knowledge.where_column({"has_missing": {"required": ["de", "en", "pt"], "value": True}})).select("source")


@facts_query("knowledge_expanded", " SELECT id, a AS action FROM (SELECT id, unnest(CASE WHEN arg_count = 1 THEN ['index', 'show'] WHEN arg_count = 2 THEN ['index', 'create'] ELSE ['index', 'create', 'show'] END) AS a FROM sites WHERE method = 'only')")
def knowledge_expanded(f: Facts):
    own = f.sites.where("method = 'only'")
    own = own.withColumn("only_args", F.when(F.col("arg_count") == 1, F.array(F.lit("show"), F.lit("index"), F.lit("x")))).withColumn("except_args", F.when(F.col("arg_count") == 2, F.array(F.lit("show"))))
    return knowledge.expanded(own, ["index", "create", "show"]).select("id", "action")


for _strategy, _sql in (
    ("max_by_kind", "QUALIFY row_number() OVER (PARTITION BY node_id, channel, kind ORDER BY confidence DESC, rule_id) = 1"),
    ("replace", "QUALIFY row_number() OVER (PARTITION BY node_id, channel ORDER BY rule_id DESC, kind) = 1"),
    ("coexist", ""), ("accumulate", "-- all"),
):

    @facts_query(f"merge_{_strategy}", " SELECT " + ("" if _strategy == "accumulate" else "DISTINCT ") + "node_id, channel, kind, confidence, rule_id FROM (SELECT owner AS node_id, CASE WHEN in_loop THEN 'a' ELSE 'b' END AS channel, method AS kind, (arg_count / 4.0)::DOUBLE AS confidence, 'r' || CAST(line AS VARCHAR) AS rule_id FROM sites) " + _sql.replace("-- all", ""))
    def _(f: Facts, strategy=_strategy):
        rows = f.sites.select(F.col("owner").alias("node_id"), F.when(F.col("in_loop"), "a").otherwise("b").alias("channel"), F.col("method").alias("kind"), (F.col("arg_count") / 4).alias("confidence"), F.concat(F.lit("r"), F.col("line").cast("string")).alias("rule_id"))
        return knowledge.merge_annotations(rows, strategy, "rule_id")


@query("detected_frameworks", "WITH e AS (SELECT DISTINCT o_custkey % 20 AS sub, 'manifest_dependency' AS kind, lower(o_orderpriority) AS name FROM orders UNION SELECT DISTINCT o_custkey % 20, 'call_exists', lower(o_orderstatus) FROM orders WHERE o_orderkey % 11 = 0), d AS (SELECT * FROM (VALUES ('manifest_dependency', '1-urgent', 'alpha', 0.9), ('manifest_dependency', '5-low', 'beta', 0.6), ('call_exists', 'p', 'beta', 0.8)) t(kind, name, framework, confidence)) SELECT sub, framework, max(confidence)::DOUBLE AS confidence FROM e JOIN d USING (kind, name) GROUP BY 1, 2", graph=False)
def detected_frameworks(g: Graph):
    orders = g.table("orders")
    sub = (F.col("o_custkey") % 20).alias("sub")
    evidence = orders.select(sub, F.lit("manifest_dependency").alias("kind"), F.col("o_orderpriority").alias("name")).union(orders.where("o_orderkey % 11 = 0").select(sub, F.lit("call_exists"), "o_orderstatus"))
    detectors = g.spark.createDataFrame([("manifest_dependency", "1-URGENT", "alpha", 0.9), ("manifest_dependency", "5-LOW", "beta", 0.6), ("call_exists", "P", "beta", 0.8)], "kind string, name string, framework string, confidence double")
    return knowledge.detect(evidence, detectors)


@facts_query("guards_by_spec", " SELECT DISTINCT file, line, g AS guard FROM (SELECT file, line, unnest(CASE WHEN method = 'only' THEN [arg0] WHEN method = 'get' THEN ['auth', 'log'] END) AS g FROM sites) WHERE g IS NOT NULL AND g <> ''")
def guards_by_spec(f: Facts):
    args = F.when(F.col("method") == "get", F.array(F.lit("/path"), F.lit("auth"), F.lit("log"), F.lit("handler"))).otherwise(F.array("arg0"))
    return knowledge.guards_by_spec(f.sites.withColumn("args", args), [knowledge.GuardSpec("chain", ("ONLY",)), knowledge.GuardSpec("positional", ("get",))])
