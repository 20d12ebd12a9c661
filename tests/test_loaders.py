import pytest

from loomspark.plans import knowledge, ranking
from loomspark.sources import code, loaders

CALLS = "id long, file string, line int, receiver string, method string, args array<string>"


def files(spark, **texts):
    return spark.createDataFrame([(path, bytearray(text.encode())) for path, text in texts.items()], "path string, content binary").withColumn("language", code.F.lit("x"))


def test_schema_of_scripts_and_calls(spark):
    scripts = files(spark, **{"a/in.sql": "CREATE TABLE `eb_user` (id int, name text);", "b/x.sql": "create table eb_user (id int, mail text)"})
    calls = spark.createDataFrame([(1, "f.php", 3, "Db", "NAME", ["order"]), (2, "f.php", 4, "Db", "name", ["not a table"]), (3, "f.php", 5, "X", "name", ["no"]), (4, "f.php", 6, "Db", "name", [])], CALLS)
    got = {r.table: (r.columns, r.sources) for r in loaders.load("db_schema", scripts, calls, [("db", "name")], ["eb_"]).collect()}
    assert got == {"user": (["id", "mail", "name"], ["a/in.sql", "b/x.sql"]), "order": ([], ["f.php:3"])}
    with pytest.raises(ValueError):
        loaders.load("nothing")


def test_config_keys_and_routes(spark):
    calls = spark.createDataFrame([(1, "f", 1, None, "Config", ["a.b"]), (2, "f", 2, None, "getConfigValue", ["a.b"]), (3, "f", 3, None, "config", ["two words"]), (4, "f", 4, None, "config", None)], CALLS)
    got = [tuple(r) for r in loaders.load("config_keys", calls, [{"name": "CONFIG", "storage": "file"}, {"suffix": "configvalue", "storage": "db", "mutable": True}]).collect()]
    assert got == [("a.b", "file", False)]
    routing = spark.createDataFrame([(1, "r", 5, "Route", "get", ["list/:id", "Order/list"]), (2, "r", 50, "Route", "post", ["/save", "Order/save"]), (3, "r", 6, "Route", "other", ["x"])], CALLS)
    groups = spark.createDataFrame([("r", 1, 10, "api"), ("r", 4, 9, "order")], "file string, a int, b int, label string")
    guards = spark.createDataFrame([("r", 1, 10, "auth", "x")], "file string, a int, b int, class string, label string")
    got = {r.key: (r.handler, r.guards) for r in loaders.load("routes", routing, groups, guards, {"get": "GET", "post": "POST"}, ["param_wildcard"]).collect()}
    assert got == {"GET /api/order/list/:*": ("Order/list", ["auth"]), "POST /save": ("Order/save", [])}


def test_middleware_migrations_nginx_locks(spark):
    own = files(spark, **{"c/middleware.php": "return ['auth' => AuthGuard::class, 'log' => 'app\\\\Log'];", "db/migrations/1.php": "Schema::create('user', function ($table) { $table->string('name'); $table->index('name'); });", "n/site.conf": "location /api { proxy_pass http://b; }"})
    imports = spark.createDataFrame([("c/middleware.php", "AuthGuard", "app\\http\\AuthGuard")], "file string, alias string, fqn string")
    assert dict(map(tuple, loaders.load("middleware_aliases", own, imports).select("alias", "class").collect()))["auth"] == "app\\http\\AuthGuard"
    assert [tuple(r) for r in loaders.load("declared_middleware", own).collect()] == [("c/middleware.php", "AuthGuard")]
    assert [tuple(r) for r in loaders.load("migrations", own).collect()] == [("user", ["name"])]
    assert [tuple(r)[1:] for r in loaders.load("nginx_config", own).collect()] == [("/api", "http://b")]
    assert loaders.lock_dependencies("package-lock.json", '{"packages": {"": {}, "node_modules/vue": {}}}') == ["vue"]
    assert loaders.lock_dependencies("Cargo.lock", '[[package]]\nname = "serde"\n') == ["serde"] and loaders.lock_dependencies("composer.lock", "[") == []


def test_globs_markers_registry(spark, tmp_path):
    import re

    pattern = re.compile(loaders.glob_pattern(["**/vendor/**", "*.min.js", "[broken"]))
    assert pattern.match("a/Vendor/b/c.php") and pattern.match("x/y.min.js") and not pattern.match("a/b.js")
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "package.json").write_text("{}")
    (tmp_path / "a" / "b" / "package.json").write_text("{}")
    assert [(r.name, r.depth) for r in loaders.markers(spark, str(tmp_path), ["package.json"], 1).collect()] == [("package.json", 1)]
    loaders.register_parser("lua", ("lua",), lambda path, text: [("file", path, "", None, 1)])
    assert loaders.language_of("x/a.LUA") == "lua" and loaders.parser_for("lua")("p", "")[0][1] == "p"
    del code.LANGUAGES["lua"]


def test_knowledge_texts():
    with pytest.raises(ValueError):
        knowledge.load("rules: [{id: a, select: {call: {callee: x}}, annotate: {kind: k}, other: 1}]")
    with pytest.raises(ValueError):
        knowledge.load("rules: [{id: a, select: {other: {}}, annotate: {kind: k}}]")
    rules = knowledge.load_check_rules("rules: [{id: r, scope: {kinds: [Table]}, when: [{fan_in_gte: $n}], params: {n: {default: 3}}, extra: 1}]")
    assert rules[0].params == {"n": 3}
    with pytest.raises(ValueError):
        knowledge.load_check_rules("rules: [{id: r, when: [{fan_in_gte: $n}]}]")
    assert knowledge.provided({"a": 1.0}, {"a": ["b"], "b": ["c", "a"]}) == {"a": 1.0, "b": 0.9, "c": pytest.approx(0.81)}
    assert knowledge.environment(["php"], [], [{"language": "PHP", "frameworks": []}]) and not knowledge.environment([], ["x"], [{"language": "php", "frameworks": ["y"]}])
    assert knowledge.load_perspectives("perspectives: [{id: p, center: Table, depth: 99}]")["p"].depth == 6
    assert knowledge.load_aliases('{"Pay": ["Payment"]}') == {"pay": ["payment"]} and knowledge.load_aliases("{") == {}


def test_questions():
    assert ranking.parse("Where is the order table of user_id?") == (["order", "table", "user_id"], ["Table"])
    assert ranking.segment("订单支付状态", {"订单"}) == ["订单", "支付", "付状", "状态"]
    assert ranking.split_intents("find orders; and also the cache") == ["find orders", "the cache"]
    assert ranking.intents("how does the event flow")["flow"] and ranking.expand_terms("Pay now", ["now"], {"pay": ["payment"]}) == ["now", "payment"]
    assert ranking.fnv1a(b"") == 0xCBF29CE484222325 and ranking.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    v = ranking.hashed_vector("createOrder order")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and ranking.hashed_vector("") == [0.0] * 256
    assert "1. **t** (Table, 9.0)" in ranking.markdown("q", [{"name": "t", "kind": "Table", "score": 9.0}]) and ranking.prompt_tokens("订单abcd") == 3
