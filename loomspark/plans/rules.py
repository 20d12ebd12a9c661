"""Compliance rules: predicates compiled to Columns, all rules answered in one pass over wide facts.

A rule is scope AND predicates over nodes; edges and annotations are first aggregated to one row per node (partial
aggregation, then one join on the node id), so the number of rules adds neither joins nor shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.kinds import SEMANTIC_EDGES, SEVERITY_RANK

Predicate = dict


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    kinds: tuple[str, ...]
    when: tuple[Predicate, ...]
    message: str = "{name}"
    params: dict = field(default_factory=dict)
    languages: tuple[str, ...] = ()
    enabled: bool = True
    name_contains: str = ""
    frameworks: tuple[str, ...] = ()


def parameter(value, params: dict):
    """``$key`` is a parameter (missing: 0 or empty), ``$$x`` the text ``$x``, a lone ``$`` itself."""
    if not isinstance(value, str) or not value.startswith("$") or value == "$":
        return value
    return value[1:] if value.startswith("$$") else params.get(value[1:])


def undeclared(rule: Rule) -> set[str]:
    """Parameters that a rule uses but does not declare: an error when rules are loaded."""
    used: set[str] = set()

    def walk(x):
        if isinstance(x, dict):
            for v in x.values():
                walk(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                walk(v)
        elif isinstance(x, str) and x.startswith("$") and x != "$" and not x.startswith("$$"):
            used.add(x[1:])

    walk(rule.when)
    walk(rule.name_contains)
    return used - rule.params.keys()


def _all(columns) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def _any(columns) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _has(array: str, value: str) -> Column:
    return F.array_contains(F.col(array), value.lower())


def _property(name: str, columns: set[str]) -> tuple[Column, Column]:
    """(text, present) of a property: a column of its own, else a key of the JSON object ``props``.

    A key that holds JSON null is present, with the text ``null``; other values have their JSON text.
    """
    if name in columns:
        return F.col(name).cast("string"), F.col(name).isNotNull()
    if "props" not in columns:
        return F.lit(None).cast("string"), F.lit(False)
    present = F.coalesce(F.array_contains(F.json_object_keys("props"), name), F.lit(False))
    return F.when(present, F.coalesce(F.get_json_object("props", f"$['{name}']"), F.lit("null"))), present


def predicate(p: Predicate, params: dict, columns: set[str]) -> Column:
    """A predicate as a two-valued Column: what is absent is false, never null.  Texts compare without case.

    ``columns`` are those of the facts; a property that is none of them is looked up in ``props``.
    """
    (kind, raw), = p.items()
    text = lambda v: str(parameter(v, params) if parameter(v, params) is not None else "").lower()
    number = lambda v: int(parameter(v, params) or 0)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c in columns else F.lit("")
    match kind:
        case "all_of":
            return _all(predicate(x, params, columns) for x in raw)
        case "any_of":
            return _any(predicate(x, params, columns) for x in raw)
        case "not":
            return ~predicate(raw, params, columns)
        case "kind_in":
            return F.lower("kind").isin([k.lower() for k in raw])
        case "name_contains":
            return F.contains(low("name"), F.lit(text(raw)))
        case "name_starts_with":
            return F.startswith(low("name"), F.lit(text(raw)))
        case "fqn_contains":
            return F.col("fqn").isNotNull() & F.contains(low("fqn"), F.lit(text(raw)))
        case "identity_contains":
            return F.col("identity").isNotNull() & F.contains(low("identity"), F.lit(text(raw))) if "identity" in columns else F.lit(False)
        case "text_contains":
            parts = [c for c in ("name", "fqn", "identity") if c in columns]
            return F.contains(F.lower(F.concat_ws("\n", *parts)), F.lit(text(raw)))
        case "has_annotation":
            return _has("mark_kinds", text(raw))
        case "no_annotation":
            return ~_has("mark_kinds", text(raw))
        case "no_capability":
            return ~F.arrays_overlap("capabilities", F.array(*[F.lit(k.lower()) for k in raw]))
        case "property_is":
            return F.coalesce(F.lower(_property(raw["name"], columns)[0]) == text(raw["value"]), F.lit(False))
        case "property_contains":
            return F.coalesce(F.contains(F.lower(_property(raw["name"], columns)[0]), F.lit(text(raw["substring"]))), F.lit(False))
        case "property_missing":
            return ~_property(raw, columns)[1]
        case "fan_in_gte":
            return F.col("fan_in") >= number(raw)
        case "fan_in_lte":
            return F.col("fan_in") <= number(raw)
        case "fan_out_gte":
            return F.col("fan_out") >= number(raw)
        case "no_incoming":
            return ~_has("in_kinds", text(raw))
        case "has_incoming":
            return _has("in_kinds", text(raw))
        case "no_outgoing":
            return ~_has("out_kinds", text(raw))
        case "has_outgoing":
            return _has("out_kinds", text(raw))
    raise ValueError(f"unknown predicate {kind}")


@dataclass
class Needs:
    """What predicates ask of the graph: kinds of incoming and outgoing edges and of annotations (lower case)."""

    into: set[str] = field(default_factory=set)
    out: set[str] = field(default_factory=set)
    marks: set[str] = field(default_factory=set)
    capabilities: set[str] = field(default_factory=set)

    def add(self, p: Predicate, params: dict) -> None:
        (kind, raw), = p.items()
        low = lambda v: str(parameter(v, params)).lower()
        semantic = {k.lower() for k in SEMANTIC_EDGES}
        match kind:
            case "all_of" | "any_of":
                for x in raw:
                    self.add(x, params)
            case "not":
                self.add(raw, params)
            case "no_incoming" | "has_incoming":
                self.into.add(low(raw))
            case "no_outgoing" | "has_outgoing":
                self.out.add(low(raw))
            case "fan_in_gte" | "fan_in_lte":
                self.into |= semantic
            case "fan_out_gte":
                self.out |= semantic
            case "has_annotation" | "no_annotation":
                self.marks.add(low(raw))
            case "no_capability":
                self.capabilities |= {k.lower() for k in raw}


def needs_of(rules: list[Rule], config: dict[str, dict] | None = None) -> Needs:
    out = Needs()
    for rule in rules:
        for p in rule.when:
            out.add(p, {**rule.params, **(config or {}).get(rule.id, {})})
    return out


def wide_facts(nodes: DataFrame, edges: DataFrame, marks: DataFrame, needs: Needs | None = None) -> DataFrame:
    """One row per node with fan-in and fan-out (semantic edges, counted), edge kinds and annotation kinds.

    Both directions and the annotations are one union that is aggregated once, map-side first: a hub's edges are
    counted where they are read, and the kinds collected are bounded by the vocabulary.  With ``needs`` only the
    edges and annotations that some predicate asks for are read; the other columns are then empty.
    """
    semantic = F.col("kind").isin(*SEMANTIC_EDGES).cast("long")
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    own = lambda kinds: edges if needs is None else edges.where(F.lower("kind").isin(*sorted(kinds)))
    parts = []
    if needs is None or needs.into:
        parts.append(own(needs and needs.into).select(F.col("to_id").alias("id"), semantic.alias("i"), zero.alias("o"), F.lower("kind").alias("ik"), none.alias("ok"), none.alias("mk"), none.alias("cap")))
    if needs is None or needs.out:
        parts.append(own(needs and needs.out).select(F.col("from_id").alias("id"), zero.alias("i"), semantic.alias("o"), none.alias("ik"), F.lower("kind").alias("ok"), none.alias("mk"), none.alias("cap")))
    if needs is None or needs.marks or needs.capabilities:
        used = marks if needs is None else marks.where(F.lower("kind").isin(*sorted(needs.marks | needs.capabilities)))
        parts.append(used.select(F.col("node_id").alias("id"), zero.alias("i"), zero.alias("o"), none.alias("ik"), none.alias("ok"), F.lower("kind").alias("mk"), F.when(F.col("channel") == "Capability", F.lower("kind")).alias("cap")))
    empty = F.array().cast("array<string>")
    arrays = ("in_kinds", "out_kinds", "mark_kinds", "capabilities")
    if not parts:
        return nodes.withColumns({"fan_in": zero, "fan_out": zero, **{c: empty for c in arrays}})
    facts = reduce(DataFrame.union, parts).groupBy("id").agg(
        F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.collect_set("ik").alias("in_kinds"), F.collect_set("ok").alias("out_kinds"), F.collect_set("mk").alias("mark_kinds"), F.collect_set("cap").alias("capabilities")
    )
    return nodes.join(facts, "id", "left").withColumns({**{c: F.coalesce(c, F.lit(0)) for c in ("fan_in", "fan_out")}, **{c: F.coalesce(c, empty) for c in arrays}})


def hit(rule: Rule, columns: set[str], config: dict | None = None) -> Column:
    params = {**rule.params, **(config or {})}
    scope = [F.lower("kind").isin([k.lower() for k in rule.kinds])]
    if rule.languages:
        scope.append(F.col("language").isin(*rule.languages))
    if name := parameter(rule.name_contains, params):
        scope.append(F.contains(F.lower("name"), F.lit(name.lower())))
    return _all([*scope, *(predicate(p, params, columns) for p in rule.when)])


def message(rule: Rule, columns: set[str], config: dict | None = None) -> Column:
    """The rule's message with ``{name} {kind} {fqn} {identity} {file} {line}`` of the node (absent: empty) and
    ``{param:key}``."""
    out = F.lit(rule.message)
    for key in ("name", "kind", "fqn", "identity", "file", "line"):
        if "{" + key + "}" in rule.message:
            out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(F.col(key).cast("string"), F.lit("")) if key in columns else F.lit(""))
    for key, value in {**rule.params, **(config or {})}.items():
        out = F.replace(out, F.lit("{param:" + key + "}"), F.lit(str(value)))
    return out


def chosen_rules(rules: list[Rule], config: dict[str, dict] | None = None, only: set[str] | None = None) -> list[Rule]:
    """The rules to run: those named by ``only`` even where disabled, else the enabled ones; undeclared parameters are
    an error."""
    for rule in rules:
        if missing := undeclared(rule):
            raise ValueError(f"{rule.id}: undeclared parameters {sorted(missing)}")
    return [r for r in rules if (r.id in only if only else (config or {}).get(r.id, {}).get("enabled", r.enabled))]


def check(facts: DataFrame, rules: list[Rule], config: dict[str, dict] | None = None, only: set[str] | None = None) -> DataFrame:
    """Violations (rule_id, severity, node_id, message) of all rules, in one scan of the facts.

    ``only`` names rules to run even where they are disabled; ``config`` overrides parameters and ``enabled``.
    """
    config, columns = config or {}, set(facts.columns)
    chosen = chosen_rules(rules, config, only)
    if not chosen:
        return facts.select(F.lit("").alias("rule_id"), F.lit("").alias("severity"), F.col("id").alias("node_id"), F.lit("").alias("message")).where("false")
    hits = [F.when(hit(r, columns, config.get(r.id)), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), message(r, columns, config.get(r.id)).alias("message"))) for r in chosen]
    found = facts.where(F.lower("kind").isin(*scope_of(chosen))).select("id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("hit"))
    return found.select("hit.rule_id", "hit.severity", F.col("id").alias("node_id"), "hit.message")


def scope_of(rules: list[Rule]) -> list[str]:
    """Node kinds in the scope of any rule, in lower case."""
    return sorted({k.lower() for r in rules for k in r.kinds})


def check_graph(nodes: DataFrame, edges: DataFrame, marks: DataFrame, rules: list[Rule], config: dict[str, dict] | None = None, only: set[str] | None = None) -> DataFrame:
    """``check`` over a graph: only the node, edge and annotation kinds that the chosen rules name are read."""
    chosen = chosen_rules(rules, config, only)
    own = nodes.where(F.lower("kind").isin(*scope_of(chosen)))
    return check(wide_facts(own, edges, marks, needs_of(chosen, config)), chosen, config, {r.id for r in chosen})


def rule_states(rules: list[Rule], edges: DataFrame, marks: DataFrame, languages: set[str], frameworks: set[str], config: dict[str, dict] | None = None, only: set[str] | None = None) -> dict[str, str]:
    """State of every rule before a check: ``run``, ``disabled``, ``not_applicable`` (no sub-project of its languages or
    frameworks) or ``unavailable`` (an edge or annotation kind that it names never occurs).  Only kinds are collected."""
    chosen = {r.id for r in chosen_rules(rules, config, only)}
    edge_kinds = {r.kind for r in edges.select("kind").distinct().collect()}
    seen = marks.select("channel", "kind").distinct().collect()
    mark_kinds, capabilities = {r.kind for r in seen}, any(r.channel == "Capability" for r in seen)

    def state(rule: Rule) -> str:
        if rule.id not in chosen:
            return "disabled"
        if not applies_to(rule, languages, frameworks):
            return "not_applicable"
        return "unavailable" if missing_requirements(rule, edge_kinds, mark_kinds, capabilities) else "run"

    return {r.id: state(r) for r in rules}


def applies_to(rule: Rule, languages: set[str], frameworks: set[str]) -> bool:
    """Whether any sub-project's language, and any framework, is one that the rule names; naming none admits all."""
    has = lambda own, given: not own or bool({x.lower() for x in own} & {x.lower() for x in given})
    return has(rule.languages, languages) and has(rule.frameworks, frameworks)


def missing_requirements(rule: Rule, edge_kinds: set[str], mark_kinds: set[str], capabilities: bool = True) -> set[str]:
    """Edge and annotation kinds that a rule names but the graph never holds: the rule is then unavailable.

    A rule on capabilities needs any annotation of that channel (``capabilities``)."""
    need: set[str] = set()
    edge_kinds, mark_kinds = {k.lower() for k in edge_kinds}, {k.lower() for k in mark_kinds}

    def walk(p):
        (kind, raw), = p.items()
        if kind in ("all_of", "any_of"):
            for x in raw:
                walk(x)
        elif kind == "not":
            walk(raw)
        elif kind in ("no_incoming", "has_incoming", "no_outgoing", "has_outgoing"):
            need.update({raw} if raw.lower() not in edge_kinds else ())
        elif kind in ("has_annotation", "no_annotation"):
            need.update({raw} if raw.lower() not in mark_kinds else ())
        elif kind == "no_capability" and not capabilities:
            need.add("Capability")

    for p in rule.when:
        walk(p)
    return need


def severity_rank(column: str = "severity") -> Column:
    return F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])[F.col(column)]


def report(violations: DataFrame) -> DataFrame:
    """Violations by rule, most severe first."""
    return violations.groupBy("rule_id", "severity").count().orderBy(severity_rank(), "rule_id")


def listed(violations: DataFrame, nodes: DataFrame, limit: int = 500) -> DataFrame:
    """Violations with their node's name: by severity, rule, name and id."""
    named = violations.join(nodes.select(F.col("id").alias("node_id"), "name"), "node_id", "left")
    return named.orderBy(severity_rank(), "rule_id", "name", "node_id").limit(limit)


def save(stored: DataFrame, violations: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Stored violations after a check: all are replaced, or with ``only`` those of the rules that ran.  The caller
    swaps the result in."""
    kept = stored.where("false") if only is None else stored.where(~F.col("rule_id").isin(*only)) if only else stored
    return kept.unionByName(violations)


WRITE_VERBS = ("delete", "remove", "destroy", "truncate", "insert", "reset", "purge", "clear", "wipe")
_WRITES = {"any_of": [{"identity_contains": f"{m} "} for m in ("post", "put", "patch", "delete")]}


def _marked(id: str, severity: str, mark: str, languages=(), kinds=("CallSite",)) -> Rule:
    return Rule(id, severity, kinds, ({"has_annotation": mark},), "{name}: " + mark, languages=languages)


# The shipped rule identifiers, severities, scopes and predicates.
RULES = [
    Rule("get-with-write-verb", "warning", ("HttpContract",), ({"name_starts_with": "get "}, {"any_of": [{"name_contains": v} for v in WRITE_VERBS]}), "{name} reads but is named like a write", {"name_filter": ""}, name_contains="$name_filter"),
    Rule("cache-never-written", "info", ("Cache",), ({"has_incoming": "ReadsCache"}, {"no_outgoing": "WritesCache"}), "{name} is read but never written"),
    Rule("hot-table", "info", ("Table",), ({"fan_in_gte": "$min_fan_in"},), "{name} is used {param:min_fan_in} times or more", {"min_fan_in": 50}),
    Rule("config-read-hotspot", "info", ("ConfigKey",), ({"fan_in_gte": "$min_fan_in"}, {"not": {"name_starts_with": "$$"}}), "{name} is read very often", {"min_fan_in": 50}),
    Rule("read-only-table", "info", ("Table",), ({"no_incoming": "WritesDb"}, {"has_incoming": "ReadsDb"}, {"fan_in_gte": 1}), "{name} is read but never written"),
    Rule("hotspot-method", "info", ("Method",), ({"fan_out_gte": "$min_fan_out"},), "{name} touches very much", {"min_fan_out": 20}),
    Rule("http-contract-handler-unresolved", "warning", ("HttpContract",), ({"no_outgoing": "HandledBy"}, {"not": {"property_missing": "handler"}}), "the handler of {name} is unresolved"),
    Rule("http-contract-without-handler", "warning", ("HttpContract",), ({"no_outgoing": "HandledBy"}, {"property_missing": "handler"}, {"property_is": {"name": "side", "value": "backend"}}), "{name} has no handler"),
    Rule("frontend-calls-missing-backend", "warning", ("HttpContract",), ({"has_incoming": "CallsHttp"}, {"no_outgoing": "HandledBy"}), "{name} is called but not served"),
    Rule("backend-endpoint-never-called", "info", ("HttpContract",), ({"has_outgoing": "HandledBy"}, {"no_incoming": "CallsHttp"}, {"not": {"property_is": {"name": "side", "value": "frontend"}}}), "{name} is served but never called"),
    Rule("dead-table", "info", ("Table",), ({"fan_in_lte": 0},), "{name} is never used"),
    Rule("write-only-table", "info", ("Table",), ({"no_incoming": "ReadsDb"}, {"has_incoming": "WritesDb"}, {"fan_in_gte": 1}), "{name} is written but never read"),
    *[_marked(f"{lang}-ext-call-in-loop", "warning", "ext-call-in-loop", (lang,)) for lang in ("php", "java", "python", "javascript")],
    _marked("multi-write-without-tx", "info", "multi-write-without-tx", kinds=("Method",)),
    Rule("pii-table-hot", "warning", ("Table",), ({"has_annotation": "pii"}, {"fan_in_gte": "$min_fan_in"}), "{name} holds personal data and is used often", {"min_fan_in": 3}),
    Rule("orphan-event", "info", ("Event",), ({"no_incoming": "Triggers"},), "{name} is never triggered"),
    Rule("orphan-queue", "info", ("Queue", "Topic"), ({"no_incoming": "PublishesTo"},), "{name} is never published to"),
    Rule("n1-query-in-loop", "info", ("CallSite",), ({"property_is": {"name": "in_loop", "value": "true"}}, {"has_annotation": "db-query"}, {"not": {"any_of": [{"fqn_contains": "migration"}, {"fqn_contains": "seeder"}]}}), "{name} queries in a loop", languages=("php",)),
    Rule("n1-write-in-loop", "info", ("CallSite",), ({"property_is": {"name": "in_loop", "value": "true"}}, {"has_annotation": "db-write"}, {"not": {"any_of": [{"fqn_contains": "migration"}, {"fqn_contains": "seeder"}]}}), "{name} writes in a loop", languages=("php",)),
    Rule("java-n1-query-in-loop", "info", ("CallSite",), ({"property_is": {"name": "in_loop", "value": "true"}}, {"has_annotation": "db-query"}), "{name} queries in a loop", languages=("java",)),
    Rule("java-n1-write-in-loop", "info", ("CallSite",), ({"property_is": {"name": "in_loop", "value": "true"}}, {"has_annotation": "db-write"}), "{name} writes in a loop", languages=("java",)),
    Rule("write-endpoint-without-auth", "warning", ("HttpContract",), (_WRITES, {"no_capability": ["Authentication"]}, {"no_annotation": "auth.public"}), "{name} writes without authentication", languages=("php",), enabled=False),
    Rule("write-endpoint-with-optional-auth", "warning", ("HttpContract",), (_WRITES, {"has_annotation": "auth.optional"}), "{name} writes with optional authentication", languages=("php",)),
    _marked("raw-sql-sink", "warning", "sink", ("php",)),
    _marked("pii-table-needs-review", "warning", "pii", kinds=("Table",)),
    _marked("sql-injection-raw", "critical", "tainted_raw", ("php",)),
    _marked("sql-injection-where-interp", "critical", "tainted_where", ("php",)),
    _marked("raw-sql-unknown-source", "warning", "tainted_raw_unknown", ("php",)),
    _marked("where-sql-unknown-source", "warning", "tainted_where_unknown", ("php",)),
    Rule(
        "cors-reflect-origin", "error", ("CallSite", "HeaderAssignment"),
        ({"any_of": [
            {"all_of": [{"name_contains": "header"}, {"property_contains": {"name": "snippet", "substring": "access-control-allow-origin"}}, {"property_contains": {"name": "snippet", "substring": "$"}}]},
            {"all_of": [{"property_is": {"name": "key", "value": "access-control-allow-origin"}}, {"property_contains": {"name": "rhs", "substring": "origin"}}]},
        ]},),
        "{name} answers with the request's own origin", languages=("php",),
    ),
    _marked("sign-compare-loose", "warning", "weak_sign_compare", ("php",)),
    _marked("sign-weak-hash", "info", "weak_sign_hash", ("php",)),
    Rule("eventbus-emitted-without-listener", "info", ("EventBus",), ({"has_incoming": "Emits"}, {"no_incoming": "ListensTo"}), "{name} has no listener"),
    Rule("eventbus-listened-without-emitter", "info", ("EventBus",), ({"has_incoming": "ListensTo"}, {"no_incoming": "Emits"}), "{name} has no emitter"),
    Rule("eventbus-orphan", "info", ("EventBus",), ({"no_incoming": "ListensTo"}, {"no_incoming": "Emits"}), "{name} is not used"),
]
BY_ID = {r.id: r for r in RULES}
# the corrected form of the cache rule: writes are edges into the cache
CACHE_NEVER_WRITTEN = Rule("cache-never-written-corrected", "info", ("Cache",), ({"has_incoming": "ReadsCache"}, {"no_incoming": "WritesCache"}), "{name} is read but never written")
