from loomspark.sources import code
from loomspark.streaming import watch


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "x.py").write_text("import no")
    (tmp_path / "a.py").write_text("import os\nclass A(B):\n    def f(self):\n        os.remove('p')\n")
    (tmp_path / "b.php").write_text("<?php\nuse app\\X;\nclass C extends D {\n function go() { Db::name('user')->select(); }\n}\n")
    (tmp_path / "en.json").write_text('{"a": {"b": "text"}}')
    (tmp_path / "s.sql").write_text("CREATE TABLE `t` (id int, price decimal(10,2), PRIMARY KEY (id));")
    (tmp_path / "broken.py").write_text("def (")
    files = code.scan(spark, str(tmp_path))
    facts = {(r.family, r.name, r.owner, r.detail) for r in code.parse(files).collect()}
    assert {("class", "A", "", None), ("inherits", "B", "A", None), ("function", "f", "A", None), ("call", "os.remove", "A.f", "p")} <= facts
    assert {("class", "C", "", None), ("inherits", "D", "C", None), ("call", "Db::name", "C", "user"), ("import", "app\\X", "", None)} <= facts
    assert {("config", "a.b", "", "text"), ("column", "id", "t", None), ("column", "price", "t", None)} <= facts
    assert not any(f[1] == "no" for f in facts) and ("column", "PRIMARY", "t", None) not in facts
    assert [(r.key, r.texts) for r in code.i18n(files, r"(\w+)\.json$").collect()] == [("a.b", {"en": "text"})]


def test_manifests_and_configurations():
    assert code.manifest_dependencies("package.json", '{"dependencies": {"vue": "3"}, "devDependencies": {"x": "1"}}') == ["vue", "x"]
    assert code.manifest_dependencies("requirements.txt", "Django>=4\n# no\nflask\n") == ["django", "flask"]
    assert code.manifest_dependencies("Cargo.toml", '[dependencies]\nserde = "1"\n') == ["serde"]
    assert code.manifest_dependencies("package.json", "{") == []
    assert code.nginx_locations("location /api { proxy_pass http://b:1; }\nlocation / { root x; }") == [("/api", "http://b:1"), ("/", "")]
    assert code.mapper_statements('<mapper namespace="n"><select id="a"/></mapper>') == [("n", "a", "select")]


def test_watch_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("x = 1")
    seen = []
    watch.watch_files(spark, str(tmp_path / "in"), lambda df, i: seen.extend(r.path for r in df.select("path").collect()), str(tmp_path / "check"), once=True).awaitTermination(60)
    assert len(seen) == 1 and seen[0].endswith("a.py")
