"""Knowledge rules: selectors and predicates over code records compiled to Columns, bindings to graph parts.

A rule selects records (calls, inheritances, configuration entries, nodes) and binds them: annotations, synthesised
nodes with links, or projected edges.  All rules of a family are answered in one scan of its records; what a predicate
needs from elsewhere (symbols, claims, ancestors) is joined to the records once, whatever the number of rules.

Texts of rules are YAML; unknown keys are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming

SELECTORS = {"call", "inheritance", "config_entry", "node"}
ACTIONS = {"annotate", "synthesize", "link", "project"}
STRATEGIES = ("max_by_kind", "coexist", "accumulate", "replace")


@dataclass(frozen=True)
class KnowledgeRule:
    id: str
    selector: str
    match: dict
    action: str
    bind: dict
    where: tuple[dict, ...] = field(default_factory=tuple)


def load(text: str, namespace: str = "") -> list[KnowledgeRule]:
    """Rules of a YAML text ``rules: [{id, select: {<selector>: {...}}, where: [...], <action>: {...}}]``.

    Unknown keys, selectors and actions are errors; ids get the namespace; of equal ids the last counts."""
    import yaml

    out: dict[str, KnowledgeRule] = {}
    document = yaml.safe_load(text) or {}
    if extra := document.keys() - {"rules", "id", "language", "detectors", "provides", "symbols"}:
        raise ValueError(f"unknown keys {sorted(extra)}")
    for raw in document.get("rules") or []:
        if extra := raw.keys() - ({"id", "select", "where"} | ACTIONS):
            raise ValueError(f"unknown keys {sorted(extra)}")
        (selector, match), = raw["select"].items()
        if selector not in SELECTORS or len(actions := ACTIONS & raw.keys()) != 1:
            raise ValueError(f"{raw['id']}: one selector of {sorted(SELECTORS)} and one action of {sorted(ACTIONS)}")
        (action,) = actions
        own = f"{namespace}.{raw['id']}" if namespace else raw["id"]
        out[own] = KnowledgeRule(own, selector, match, action, raw[action], tuple(raw.get("where") or ()))
    return list(out.values())


def _all(columns) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def selected(selector: str, match: dict) -> Column:
    """Records that a selector takes, as a two-valued Column.

    call: ``receiver``, ``method``, ``alias_fqn`` (what the file imports under the receiver's name, if anything);
    inheritance: ``bases`` (full names of all ancestors) and optionally ``props``; config_entry: ``path``, ``key_path``;
    node: ``kind``."""
    if selector == "call":
        pattern = match["callee"]
        return _true(naming.callee_matches("receiver", "method", pattern)) | _true(naming.callee_matches("alias_fqn", "method", pattern) & F.col("alias_fqn").isNotNull())
    if selector == "inheritance":
        want = match["base"].lower()
        below = F.exists("bases", lambda b: (F.lower(b) == want) | (F.lower(naming.short_name(b)) == want))
        return _true(below) & (where_column({"has_property": match["with_property"]}) if "with_property" in match else F.lit(True))
    if selector == "config_entry":
        return F.col("path").rlike(naming.wildcard(match.get("file", "*")).replace("^", "(?:^|.*/)", 1)) & F.col("key_path").rlike(naming.wildcard(match.get("key_path", "*")))
    return F.col("kind") == match["node_kind"]


def where_column(p: dict) -> Column:
    """A predicate over enriched records as a two-valued Column; kinds compare with case, texts without."""
    (kind, raw), = p.items()
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    match kind:
        case "has_property":
            return _true(F.array_contains(F.json_object_keys("props"), raw))
        case "in_symbol_table":
            return _true(F.array_contains("symbol_tables", raw["table"]))
        case "columns_match":
            names = [n.lower() for n in raw["names"]]
            return _true(F.exists("columns", lambda c: reduce(lambda a, b: a | b, [(F.lower(c) == n) | F.endswith(F.lower(c), F.lit("_" + n)) for n in names])))
        case "has_annotation":
            return _true(F.array_contains("mark_kinds", raw["kind"] if isinstance(raw, dict) else raw))
        case "none_of_capability":
            return ~_true(F.arrays_overlap("capabilities", F.array(*[F.lit(k) for k in raw])))
        case "has_missing":
            missing = F.size(F.array_except(F.array(*[F.lit(x) for x in raw["required"]]), F.coalesce("locales", F.array().cast("array<string>")))) > 0
            return missing if raw.get("value", True) else ~missing
        case "fan_in_gte":
            return _true(F.col("fan_in_all") >= int(raw))
        case "arg_count":
            return _true(F.size("args") == int(raw))
        case "name_matches":
            return F.contains(low(F.coalesce("identity", "name")), F.lit(raw.lower()))
        case "property_is":
            want = str(raw["value"]).lower() if isinstance(raw["value"], bool) else str(raw["value"])
            return _true(F.get_json_object("props", f"$['{raw['name']}']") == want)
        case "arg_starts_with":
            return _true(F.startswith(F.get("args", F.lit(int(raw["arg"]))), F.lit(raw["prefix"])))
        case "entry_arity_gte":
            return _true(F.json_array_length("value") >= int(raw))
        case "fqn_matches":
            return F.contains(low(F.coalesce("fqn", "name")), F.lit(raw.lower()))
        case "name_not_in":
            return ~low(F.col("name")).isin([n.lower() for n in raw])
        case "not_claimed_by":
            return ~_true(F.array_contains("claimed_by", raw))
        case "has_incoming":
            return _true(F.array_contains("in_kinds", raw))
        case "all_of":
            return _all(where_column(x) for x in raw)
        case "any_of":
            return reduce(lambda a, b: a | b, (where_column(x) for x in raw))
        case "not":
            return ~where_column(raw)
    raise ValueError(f"unknown predicate {kind}")


def with_imports(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls with ``alias_fqn``: what the receiver's name stands for in an import; of several imports of one name
    anywhere the smallest (file, fqn) counts."""
    table = imports.groupBy(F.lower("alias").alias("_alias")).agg(F.min(F.struct("file", "fqn"))["fqn"].alias("alias_fqn"))
    return calls.join(table, F.lower("receiver") == F.col("_alias"), "left").drop("_alias")


def with_symbols(records: DataFrame, symbols: DataFrame, key: Column, prefixes: list[str]) -> DataFrame:
    """Records with ``symbol_tables``: the tables that hold the key as it is or without prefixes."""
    held = symbols.groupBy("key").agg(F.sort_array(F.collect_set("table_name")).alias("_t")).withColumnRenamed("key", "_key")
    spelled = records.withColumn("_raw", key).withColumn("_bare", naming.strip_prefixes(key, prefixes))
    bare = held.select(F.col("_key").alias("_key2"), F.col("_t").alias("_t2"))
    met = spelled.join(held, F.col("_raw") == F.col("_key"), "left").join(bare, F.col("_bare") == F.col("_key2"), "left")
    empty = F.array().cast("array<string>")
    return met.withColumn("symbol_tables", F.array_union(F.coalesce("_t", empty), F.coalesce("_t2", empty))).drop("_raw", "_bare", "_key", "_key2", "_t", "_t2")


def matches(records: DataFrame, rules: list[KnowledgeRule], selector: str) -> DataFrame:
    """Records with ``rule_id``, once for each rule of the selector that takes them, in one scan."""
    own = [r for r in rules if r.selector == selector]
    hits = [F.when(_all([selected(r.selector, r.match), *(where_column(p) for p in r.where)]), F.lit(r.id)) for r in own]
    array = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")
    return records.withColumn("rule_id", F.explode(array))


def value(source: dict) -> Column:
    """A value source: one extractor, then ``default``, ``transform``, ``normalize``, ``reject_contains``.

    Extractors: arg, property, self (name), literal, method_name, receiver_class, owner_class, owner_member, entity,
    key_path, path_segment, file_stem, locale, entry_value, array_length, array_values (an array), path (several
    sources joined by ``join``)."""
    extract = {
        "arg": lambda v: F.get("args", F.lit(int(v))), "property": lambda v: F.get_json_object("props", f"$['{v}']"), "self": lambda v: F.col("name"), "literal": lambda v: F.lit(str(v)),
        "method_name": lambda v: F.col("method"), "receiver_class": lambda v: naming.short_name("receiver"), "owner_class": lambda v: naming.owner_class("owner_fqn"), "owner_member": lambda v: naming.owner_member("owner_fqn"),
        "entity": lambda v: F.col("entity"), "key_path": lambda v: F.col("key_path"), "path_segment": lambda v: F.get(F.split("path", "/"), F.lit(int(v))),
        "file_stem": lambda v: F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1), "locale": lambda v: F.regexp_extract("path", naming.wildcard(str(v)), 1), "entry_value": lambda v: F.get_json_object("value", "$"),
        "array_length": lambda v: F.json_array_length("value").cast("string"), "array_values": lambda v: F.from_json("value", "array<string>"),
        "path": lambda v: F.concat_ws(source.get("join", "/"), *[value(x) for x in v]),
    }
    found = [k for k in source if k in extract]
    if len(found) != 1:
        raise ValueError(f"one extractor, not {found}")
    out = extract[found[0]](source[found[0]])
    if found[0] != "array_values":
        if source.get("require_literal"):
            out = F.when(~out.rlike(r"[$({]"), out)
        out = F.coalesce(F.nullif(out, F.lit("")), F.lit(source["default"])) if "default" in source else F.nullif(out, F.lit(""))
        for step in source.get("transform", ()):
            out = naming.TRANSFORMS[step](out)
        if "normalize" in source:
            out = naming.normalize(out, source["normalize"])
        if "reject_contains" in source:
            out = F.when(~reduce(lambda a, b: a | b, [F.contains(out, F.lit(x)) for x in source["reject_contains"]]), out)
    return out


def annotations(matched: DataFrame, rules: list[KnowledgeRule], strategy: str = "max_by_kind") -> DataFrame:
    """(node_id, channel, kind, confidence, rule_id) of annotating rules; see ``merge_annotations``."""
    own = [r for r in rules if r.action == "annotate"]
    pick = lambda key, default: reduce(lambda out, r: F.when(F.col("rule_id") == r.id, F.lit(r.bind.get(key, default))).otherwise(out), own, F.lit(None))
    rows = matched.where(F.col("rule_id").isin([r.id for r in own])).select(F.col("id").alias("node_id"), pick("channel", "FkbMark").alias("channel"), pick("kind", "").alias("kind"), pick("confidence", 1.0).cast("double").alias("confidence"), "rule_id")
    return merge_annotations(rows, strategy, "rule_id")


def merge_annotations(rows: DataFrame, strategy: str, order: str) -> DataFrame:
    """Annotations (node_id, channel, kind, confidence, ``order``) merged: ``max_by_kind`` keeps the surest of a kind,
    ``replace`` the last of a channel, ``coexist`` and ``accumulate`` keep all (accumulate: repeated rows too)."""
    if strategy == "max_by_kind":
        place = Window.partitionBy("node_id", "channel", "kind").orderBy(F.desc("confidence"), order)
    elif strategy == "replace":
        place = Window.partitionBy("node_id", "channel").orderBy(F.desc(order), "kind")
    elif strategy == "coexist":
        return rows.distinct()
    elif strategy == "accumulate":
        return rows
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def synthesized(matched: DataFrame, rule: KnowledgeRule) -> tuple[DataFrame, DataFrame]:
    """Nodes (identity, kind, name, sub, id, confidence, merged) of a synthesising rule and links (kind, from_id, identity).

    ``bind``: node_kind, identity (a value source; several values of an array each make a node), scope (default: the
    sub-project, so equal endpoints of two sub-projects stay two nodes), link: {kind, direction: incoming|outgoing}.
    Nodes of one identity are merged: smallest id, largest confidence."""
    bind = rule.bind
    own = matched.where(F.col("rule_id") == rule.id)
    if "array_values" in bind["identity"]:
        own = own.withColumn("_name", F.explode(value(bind["identity"])))
    else:
        own = own.withColumn("_name", value(bind["identity"]))
    own = own.where("_name is not null").withColumn("identity", F.concat_ws(":", F.lit(bind["node_kind"]), F.coalesce(F.col("sub").cast("string"), F.lit("")), "_name"))
    nodes = own.groupBy("identity").agg(F.min("_name").alias("name"), F.min("sub").alias("sub"), F.min("id").alias("id"), F.lit(float(bind.get("confidence", 1.0))).alias("confidence"), F.count("*").alias("merged"))
    link = bind.get("link", {})
    links = own.select(F.lit(link.get("kind", "")).alias("kind"), F.col("id").alias("from_id"), "identity", F.lit(link.get("direction", "incoming")).alias("direction")).distinct()
    return nodes.withColumn("kind", F.lit(bind["node_kind"])), links.where("kind <> ''")


def linked(matched: DataFrame, rule: KnowledgeRule, targets: DataFrame) -> DataFrame:
    """Edges (kind, from_id, to_id) of a linking rule to targets (id, key) by ``bind``: {kind, to: value source,
    direction}; targets of ambiguous keys take no link."""
    own = matched.where(F.col("rule_id") == rule.id).select("id", value(rule.bind["to"]).alias("key")).where("key is not null")
    one = targets.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).where("_low = _high")
    met = own.join(one, "key")
    ends = ("_low", "id") if rule.bind.get("direction") == "outgoing_from_target" else ("id", "_low")
    return met.select(F.lit(rule.bind["kind"]).alias("kind"), F.col(ends[0]).alias("from_id"), F.col(ends[1]).alias("to_id")).distinct()


def expanded(matched: DataFrame, actions: list[str], only: str = "only_args", excepted: str = "except_args") -> DataFrame:
    """One row for each action of a record: all ``actions``, cut to the record's ``only`` array where it has one, without
    its ``except`` array."""
    every = F.array(*[F.lit(a) for a in actions])
    kept = F.when(F.col(only).isNotNull(), F.array_intersect(every, F.col(only))).otherwise(every)
    return matched.withColumn("action", F.explode(F.array_except(kept, F.coalesce(excepted, F.array().cast("array<string>")))))


def detect(evidence: DataFrame, detectors: DataFrame) -> DataFrame:
    """(sub, framework, confidence): evidence (sub, kind, name) against detectors (kind, name, framework, confidence);
    kinds: manifest_dependency, lock_dependency, file_exists, import_exists, call_exists.  The surest evidence counts."""
    own = detectors.select("kind", F.lower("name").alias("name"), "framework", "confidence")
    return evidence.select("sub", "kind", F.lower("name").alias("name")).distinct().join(own, ["kind", "name"]).groupBy("sub", "framework").agg(F.max("confidence").alias("confidence"))


def provided(frameworks: dict[str, float], provides: dict[str, list[str]], decay: float = 0.9) -> dict[str, float]:
    """Frameworks with all that they provide, directly or through others, each step ``decay`` times as sure."""
    known = dict(frameworks)
    queue = list(known)
    while queue:
        at = queue.pop()
        for other in provides.get(at, ()):
            if known[at] * decay > known.get(other, 0.0) + 1e-12:
                known[other] = known[at] * decay
                queue.append(other)
    return known


def environment(rule_languages: list[str], rule_frameworks: list[str], subs: list[dict]) -> bool:
    """Whether any sub-project's language and any sub-project's framework is named (none named: all)."""
    have = lambda key: {x.lower() for s in subs for x in ([s[key]] if isinstance(s[key], str) else s[key])}
    fits = lambda own, given: not own or bool({x.lower() for x in own} & given)
    return fits(rule_languages, have("language")) and fits(rule_frameworks, have("frameworks"))


def load_check_rules(text: str):
    """Check rules of a YAML text (unknown keys are ignored); of equal ids the last counts; undeclared parameters are an
    error."""
    import yaml

    from .rules import Rule, undeclared

    out = {}
    for raw in (yaml.safe_load(text) or {}).get("rules") or []:
        scope, params = raw.get("scope") or {}, raw.get("params") or {}
        rule = Rule(
            raw["id"], raw.get("severity", "warning"), tuple(scope.get("kinds") or ()), tuple(raw.get("when") or ()), raw.get("message", "{name}"),
            {k: v.get("default") if isinstance(v, dict) else v for k, v in params.items()}, tuple(raw.get("languages") or ()), raw.get("enabled", True), scope.get("name_contains", ""), tuple(raw.get("frameworks") or ()),
        )
        if missing := undeclared(rule):
            raise ValueError(f"{rule.id}: undeclared parameters {sorted(missing)}")
        out[rule.id] = rule
    return list(out.values())


@dataclass(frozen=True)
class Perspective:
    id: str
    center: str
    mode: str = "object"
    direction: str = "forward"
    depth: int = 4
    layers: tuple[str, ...] = ()
    side: str | None = None


def load_perspectives(text: str) -> dict[str, Perspective]:
    """Perspectives of a YAML text by id; depths are clamped to 1..6; of equal ids the last counts."""
    import yaml

    out = {}
    for raw in (yaml.safe_load(text) or {}).get("perspectives") or []:
        forward = raw["center"] in ("HttpContract", "Schedule")
        out[raw["id"]] = Perspective(raw["id"], raw["center"], raw.get("mode", "object"), raw.get("direction", "forward" if forward else "reverse"), min(6, max(1, int(raw.get("depth", 4)))), tuple(raw.get("layers") or ()), raw.get("side"))
    return out


def load_aliases(text: str) -> dict[str, list[str]]:
    """Project aliases of a JSON text {term: [other terms]}, lower case; a broken text has none."""
    import json

    try:
        raw = json.loads(text)
    except ValueError:
        return {}
    return {str(k).lower(): [str(x).lower() for x in (v if isinstance(v, list) else [v])] for k, v in raw.items()} if isinstance(raw, dict) else {}


_GUARD_CALL = re.compile(r"[\w\\]+")


@dataclass(frozen=True)
class GuardSpec:
    """How a stack attaches guards to routes: ``chain`` (a method on the route), ``positional`` (middle arguments),
    ``consumer`` (a class applies to listed routes) or ``decorator``."""

    style: str
    methods: tuple[str, ...]


def guards_by_spec(calls: DataFrame, specs: list[GuardSpec]) -> DataFrame:
    """(file, line, guard) that calls (file, line, method, args) attach; positional guards are the arguments between the
    first and the last."""
    out = []
    for spec in specs:
        own = calls.where(F.lower("method").isin([m.lower() for m in spec.methods]))
        if spec.style == "positional":
            guards = F.when(F.size("args") > 2, F.slice("args", 2, F.size("args") - 2)).otherwise(F.array().cast("array<string>"))
        elif spec.style in ("chain", "consumer", "decorator"):
            guards = F.col("args")
        else:
            raise ValueError(f"unknown style {spec.style}")
        out.append(own.select("file", "line", F.explode(guards).alias("guard")))
    return reduce(DataFrame.union, out).where("guard is not null and guard <> ''").distinct()
