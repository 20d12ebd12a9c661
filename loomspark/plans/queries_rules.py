"""Queries of the rule engine: every shipped rule, every predicate, the report."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators.kinds import SEMANTIC_EDGES, SEVERITY_RANK, sql_list
from .projection import Graph
from .registry import query
from .rules import BY_ID, CACHE_NEVER_WRITTEN, RULES, Needs, Rule, check_graph, listed, parameter, predicate, report, rule_states, save, severity_rank, wide_facts

_SEMANTIC = sql_list(SEMANTIC_EDGES)
#: Per-node counts as the oracle sees them.
FANS = f"fi AS (SELECT to_id AS id, count(*) AS n FROM edges WHERE kind IN ({_SEMANTIC}) GROUP BY to_id), fo AS (SELECT from_id AS id, count(*) AS n FROM edges WHERE kind IN ({_SEMANTIC}) GROUP BY from_id)"


COLUMNS = ("side", "in_loop", "category", "language")


def sql_property(name: str) -> str:
    """A property's text: null where the key is absent."""
    if name in COLUMNS:
        return f"CAST(n.{name} AS VARCHAR)"
    return f"CASE WHEN list_contains(json_keys(n.props), '{name}') THEN coalesce(json_extract_string(n.props, '$.{name}'), 'null') END"


def sql_of(p: dict, params: dict) -> str:
    """A predicate in SQL over ``nodes n``: joins become subqueries, independent of the wide facts."""
    (kind, raw), = p.items()
    value = parameter(raw, params) if isinstance(raw, (str, int)) else raw
    quoted = "'" + str(value).lower().replace("'", "''") + "'"
    match kind:
        case "all_of":
            return "(" + " AND ".join(sql_of(x, params) for x in raw) + ")"
        case "any_of":
            return "(" + " OR ".join(sql_of(x, params) for x in raw) + ")"
        case "not":
            return f"NOT {sql_of(raw, params)}"
        case "kind_in":
            return f"lower(n.kind) IN ({sql_list([k.lower() for k in raw])})"
        case "name_contains":
            return f"contains(lower(n.name), {quoted})"
        case "name_starts_with":
            return f"starts_with(lower(n.name), {quoted})"
        case "fqn_contains":
            return f"coalesce(contains(lower(n.fqn), {quoted}), false)"
        case "identity_contains":
            return f"coalesce(contains(lower(n.identity), {quoted}), false)"
        case "text_contains":
            return f"contains(lower(concat_ws(chr(10), n.name, n.fqn, n.identity)), {quoted})"
        case "has_annotation":
            return f"n.id IN (SELECT node_id FROM marks WHERE lower(kind) = {quoted})"
        case "no_annotation":
            return f"n.id NOT IN (SELECT node_id FROM marks WHERE lower(kind) = {quoted})"
        case "no_capability":
            return f"n.id NOT IN (SELECT node_id FROM marks WHERE channel = 'Capability' AND kind IN ({sql_list(raw)}))"
        case "property_is":
            return f"coalesce(lower({sql_property(raw['name'])}) = '{str(raw['value']).lower()}', false)"
        case "property_contains":
            return f"coalesce(contains(lower({sql_property(raw['name'])}), '{raw['substring'].lower()}'), false)"
        case "property_missing":
            return f"{sql_property(raw)} IS NULL"
        case "fan_in_gte":
            return f"n.id IN (SELECT id FROM fi WHERE n >= {value})" if value > 0 else "true"
        case "fan_in_lte":
            return f"n.id NOT IN (SELECT id FROM fi WHERE n > {value})"
        case "fan_out_gte":
            return f"n.id IN (SELECT id FROM fo WHERE n >= {value})" if value > 0 else "true"
        case "no_incoming":
            return f"n.id NOT IN (SELECT to_id FROM edges WHERE lower(kind) = {quoted})"
        case "has_incoming":
            return f"n.id IN (SELECT to_id FROM edges WHERE lower(kind) = {quoted})"
        case "no_outgoing":
            return f"n.id NOT IN (SELECT from_id FROM edges WHERE lower(kind) = {quoted})"
        case "has_outgoing":
            return f"n.id IN (SELECT from_id FROM edges WHERE lower(kind) = {quoted})"
    raise ValueError(kind)


def rule_sql(rule: Rule, params: dict | None = None) -> str:
    """SELECT of a rule's node ids."""
    own = {**rule.params, **(params or {})}
    scope = [f"n.kind IN ({sql_list(rule.kinds)})"]
    if rule.languages:
        scope.append(f"n.language IN ({sql_list(rule.languages)})")
    if name := parameter(rule.name_contains, own):
        scope.append(f"contains(lower(n.name), '{name.lower()}')")
    return f"SELECT n.id FROM nodes n WHERE {' AND '.join([*scope, *(sql_of(p, own) for p in rule.when)])}"


def _check(g: Graph, config: dict | None = None, only: set[str] | None = None, rules=RULES):
    return check_graph(g.nodes, g.edges, g.marks, list(rules), config, only)


def required(rule: Rule) -> set[str]:
    """Edge and annotation kinds that the rule's text names, read off its printed form."""
    return {k.lower() for k in re.findall(r"'(?:no|has)_(?:incoming|outgoing|annotation)': '([^']+)'", str(rule.when))}


#: Rules with the thresholds that suit the small tables.
CONFIG = {"hot-table": {"min_fan_in": 4}, "config-read-hotspot": {"min_fan_in": 20}, "hotspot-method": {"min_fan_out": 3}, "pii-table-hot": {"min_fan_in": 2}}


def _register(rule: Rule) -> None:
    params = CONFIG.get(rule.id)

    @query("rule_" + rule.id.replace("-", "_"), f", {FANS} SELECT id AS node_id FROM ({rule_sql(rule, params)})")
    def _(g: Graph, rule=rule, params=params):
        return _check(g, {rule.id: params} if params else None, {rule.id}, [rule]).select("node_id")


for _rule in (*RULES, CACHE_NEVER_WRITTEN):
    _register(_rule)

PREDICATES = {
    "kind_in": {"kind_in": ["table", "CACHE"]}, "name_contains": {"name_contains": "Er"}, "name_starts_with": {"name_starts_with": "GET /l"}, "fqn_contains": {"fqn_contains": "CUSTOMER_1"},
    "identity_contains": {"identity_contains": "/building/"}, "text_contains": {"text_contains": "MACHINERY/1"}, "has_annotation": {"has_annotation": "PII"}, "no_annotation": {"no_annotation": "sink"},
    "property_is": {"property_is": {"name": "side", "value": "backend"}}, "property_contains": {"property_contains": {"name": "category", "substring": "Brand#1"}}, "property_missing": {"property_missing": "handler"}, "property_null": {"property_is": {"name": "note", "value": "NULL"}}, "property_number": {"property_is": {"name": "weight", "value": "3"}}, "property_column_missing": {"property_missing": "category"},
    "no_capability": {"no_capability": ["Authentication", "auth.optional"]}, "fan_in_gte": {"fan_in_gte": 2}, "fan_in_lte": {"fan_in_lte": 1}, "fan_out_gte": {"fan_out_gte": 2},
    "no_incoming": {"no_incoming": "HasCallSite"}, "has_incoming": {"has_incoming": "calls"}, "no_outgoing": {"no_outgoing": "Calls"}, "has_outgoing": {"has_outgoing": "WritesDb"},
    "combinators": {"any_of": [{"all_of": [{"kind_in": ["Table"]}, {"not": {"has_annotation": "pii"}}]}, {"fan_out_gte": 3}]},
}
for _name, _p in PREDICATES.items():

    @query(f"predicate_{_name}", f", {FANS} SELECT kind, count(*) AS n FROM nodes n WHERE {sql_of(_p, {})} GROUP BY kind")
    def _(g: Graph, p=_p):
        needs = Needs()
        needs.add(p, {})
        facts = wide_facts(g.nodes, g.edges, g.marks, needs)
        return facts.where(predicate(p, {}, set(facts.columns))).groupBy("kind").agg(F.count("*").alias("n"))


_ENABLED = [r for r in RULES if r.enabled]
_UNION = " UNION ALL ".join(f"SELECT '{r.id}' AS rule_id, '{r.severity}' AS severity, id AS node_id FROM ({rule_sql(r, CONFIG.get(r.id))})" for r in _ENABLED)


@query("check_all_rules", f", {FANS} {_UNION}")
def check_all(g: Graph):
    return _check(g, CONFIG).select("rule_id", "severity", "node_id")


@query("check_report", f", {FANS} SELECT rule_id, severity, count(*) AS count FROM ({_UNION}) GROUP BY rule_id, severity")
def check_report(g: Graph):
    return report(_check(g, CONFIG))


@query("check_by_severity", f", {FANS} SELECT severity, count(*) AS n FROM ({_UNION}) GROUP BY severity")
def check_by_severity(g: Graph):
    return _check(g, CONFIG).groupBy("severity").agg(F.count("*").alias("n"))


@query("check_messages", f", {FANS} SELECT id AS node_id, name || ' is used 4 times or more' AS message FROM nodes WHERE id IN ({rule_sql(BY_ID['hot-table'], CONFIG['hot-table'])})")
def check_messages(g: Graph):
    return _check(g, CONFIG, {"hot-table"}).select("node_id", "message")


_RANK = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_RANK.items()) + " END"


@query("violations_most_severe", f", {FANS} SELECT rule_id, node_id FROM ({_UNION}) ORDER BY {_RANK}, rule_id, node_id LIMIT 100")
def violations_most_severe(g: Graph):
    return _check(g, CONFIG).orderBy(severity_rank(), "rule_id", "node_id").limit(100).select("rule_id", "node_id")


@query("violations_listed", f", {FANS} SELECT rule_id, node_id, name FROM ({_UNION}) JOIN nodes ON id = node_id ORDER BY {_RANK}, rule_id, name, node_id LIMIT 200")
def violations_listed(g: Graph):
    return listed(_check(g, CONFIG), g.nodes, 200).select("rule_id", "node_id", "name")


@query("check_states", "SELECT id AS rule_id, CASE WHEN NOT enabled THEN 'disabled' WHEN languages <> '' AND NOT list_has_any(string_split(languages, ','), ['php', 'java']) THEN 'not_applicable' WHEN EXISTS (SELECT 1 FROM (SELECT unnest(string_split(need, ',')) AS k) WHERE k <> '' AND k NOT IN (SELECT lower(kind) FROM edges WHERE kind <> 'Emits' UNION SELECT lower(kind) FROM marks WHERE kind <> 'pii')) THEN 'unavailable' ELSE 'run' END AS state FROM (VALUES " + ", ".join(f"('{r.id}', {str(r.enabled).lower()}, '{','.join(r.languages)}', '{','.join(sorted(required(r)))}')" for r in RULES) + ") t(id, enabled, languages, need)")
def check_states(g: Graph):
    found = rule_states(RULES, g.edges.where("kind <> 'Emits'"), g.marks.where("kind <> 'pii'"), {"PHP", "java"}, set())
    return g.spark.createDataFrame(list(found.items()), "rule_id string, state string")


@query("check_saved", f", {FANS} SELECT rule_id, node_id FROM (SELECT 'hot-table' AS rule_id, id AS node_id FROM ({rule_sql(BY_ID['hot-table'], CONFIG['hot-table'])}) UNION ALL SELECT 'dead-table', id FROM ({rule_sql(BY_ID['dead-table'])}))")
def check_saved(g: Graph):
    old = _check(g, {"hot-table": {"min_fan_in": 2}}, {"hot-table", "dead-table"})
    return save(old, _check(g, CONFIG, {"hot-table"}), {"hot-table"}).select("rule_id", "node_id")
