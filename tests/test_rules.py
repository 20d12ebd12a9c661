import pytest

from loomspark.plans.rules import RULES, Rule, check, missing_requirements, parameter, undeclared, wide_facts

NODES = "id long, kind string, name string, fqn string, side string, has_handler boolean, in_loop boolean, category string, language string, sub long, snippet string, key string, rhs string"


def facts(spark, nodes, edges=(), marks=()):
    n = spark.createDataFrame([(*x, *[None] * (13 - len(x))) for x in nodes], NODES)
    e = spark.createDataFrame(list(edges), "kind string, from_id long, to_id long")
    m = spark.createDataFrame(list(marks), "node_id long, channel string, kind string")
    return wide_facts(n, e, m)


def hits(f, *rules, **config):
    return {(r.rule_id, r.node_id) for r in check(f, list(rules), config.get("config")).collect()}


def test_rules_are_complete_and_declared():
    assert len(RULES) == 38 and len({r.id for r in RULES}) == 38
    assert sum(r.enabled for r in RULES) == 37
    assert not any(undeclared(r) for r in RULES)


def test_parameters():
    assert parameter("$a", {"a": 3}) == 3 and parameter("$$a", {}) == "$a" and parameter("$", {}) == "$" and parameter("$b", {}) is None


def test_undeclared_parameter_is_an_error(spark):
    with pytest.raises(ValueError):
        check(facts(spark, [(1, "Table", "t")]), [Rule("x", "info", ("Table",), ({"fan_in_gte": "$n"},))])


def test_tables(spark):
    f = facts(spark, [(1, "Table", "user"), (2, "Table", "unused"), (3, "Table", "log")], [("ReadsDb", 9, 1), ("WritesDb", 9, 3)])
    by = {r.id: r for r in RULES}
    assert hits(f, by["read-only-table"], by["dead-table"], by["write-only-table"]) == {("read-only-table", 1), ("dead-table", 2), ("write-only-table", 3)}


def test_fan_in_counts_semantic_edges_only_and_texts_ignore_case(spark):
    f = facts(spark, [(1, "Table", "Orders", "A::B")], [("ReadsDb", 5, 1), ("Calls", 6, 1)], [(1, "FkbMark", "PII")])
    rule = lambda *p: Rule("r", "info", ("table",), p)
    assert hits(f, rule({"fan_in_lte": 1}, {"fan_in_gte": 1}, {"has_annotation": "pii"}, {"name_contains": "ORD"}, {"fqn_contains": "a::"}))
    assert not hits(f, rule({"fan_in_gte": 2})) and not hits(f, rule({"no_annotation": "Pii"}))


def test_absent_values_are_false_not_null(spark):
    f = facts(spark, [(1, "Method", None)])
    assert hits(f, Rule("r", "info", ("Method",), ({"not": {"name_contains": "x"}}, {"not": {"fqn_contains": "x"}}, {"property_missing": "side"}, {"no_incoming": "Calls"})))


def test_config_overrides_and_empty_inputs(spark):
    f = facts(spark, [(1, "Table", "t")], [("ReadsDb", 5, 1)])
    hot = next(r for r in RULES if r.id == "hot-table")
    assert not hits(f, hot) and hits(f, hot, config={"hot-table": {"min_fan_in": 1}})
    assert not hits(f, hot, config={"hot-table": {"min_fan_in": 1, "enabled": False}})
    assert not hits(facts(spark, []), *RULES)


def test_requirements():
    rule = next(r for r in RULES if r.id == "read-only-table")
    assert missing_requirements(rule, {"ReadsDb"}, set()) == {"WritesDb"}
