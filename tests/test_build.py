import os
import random
import re

import pytest

from loomspark import service
from loomspark.sources import scopes

FILES = {
    "app/model/Base.php": "<?php\nnamespace app\\model;\nclass Base extends \\think\\Model {\n function log($x) { return config('app.name'); }\n}\n",
    "app/model/UserOrder.php": "<?php\nnamespace app\\model;\nclass UserOrder extends Base {\n}\n",
    "app/controller/User.php": """<?php
namespace app\\controller;
use app\\model\\UserOrder as Orders;
class User {
  private Mailer $mailer;
  public function index($id) {
    foreach ($this->ids($id) as $i) { Db::name('user')->where('id', $i)->find(); }
    $q = "where id=" . $_GET['id'];
    Db::query("select 1 $q");
    $o = new Orders();
    $o->log(1);
    return Orders::where('a', 1)->select();
  }
  private function ids($x) { Db::name('user')->update([]); Db::name('log')->insert([]); Cache::set('ids', 1); return helper($x); }
}
""",
    "app/controller/Mailer.php": "<?php\nnamespace app\\controller;\nclass Mailer { function send() { while (true) curl_exec($c); } }\n",
    "helper.php": "<?php\nfunction helper($x) { return $x; }\n",
    "route.php": "<?php\nRoute::get('user/:id', 'User/index');\nRoute::post('gone', [Missing::class, 'go']);\n",
    "web/api.js": "import axios from 'axios'\nimport { pick } from './pick'\nexport const load = async (id) => { return pick(await axios.get('/user/:id')) }\n",
    "web/pick.js": "export function pick(x) { return x }\n",
    "db.sql": "CREATE TABLE user (id int, name text);\nCREATE TABLE unused (id int);",
}


def test_a_source_tree_becomes_a_graph(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / "src" / os.path.dirname(name)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    engine = service.Engine(spark, f"file://{tmp_path}/projects")
    assert engine.build("p", str(tmp_path / "src")).where("part = 'node' and key = 'Class'").first().n == 4
    nodes = {r.id: r for r in engine.part("p", "nodes").collect()}
    assert len(nodes) == engine.part("p", "nodes").count()
    edges = engine.part("p", "edges").collect()
    assert all(e.from_id in nodes and e.to_id in nodes for e in edges)
    found = {(e.kind, nodes[e.from_id].name, nodes[e.to_id].name) for e in edges if e.kind not in ("HasCallSite", "Declares")}
    assert found == {
        ("Extends", "UserOrder", "Base"), ("MapsTo", "Base", "base"), ("MapsTo", "UserOrder", "user_order"),
        ("Calls", "index", "ids"), ("Calls", "index", "log"), ("Calls", "ids", "helper"), ("Calls", "load", "pick"),
        ("ReadsDb", "index", "user"), ("ReadsDb", "index", "user_order"), ("WritesDb", "ids", "user"), ("WritesDb", "ids", "log"),
        ("ReadsConfig", "log", "app.name"), ("WritesCache", "ids", "ids"), ("HasColumn", "user", "id"), ("HasColumn", "user", "name"),
        ("HasColumn", "unused", "id"), ("HandledBy", "GET /user/:*", "index"), ("CallsHttp", "load", "GET /user/:*"),
    }
    marks = {(nodes[m.node_id].name, m.kind) for m in engine.part("p", "marks").collect()}
    assert marks == {("Db::find", "db-query"), ("Orders::select", "db-query"), ("Db::update", "db-write"), ("Db::insert", "db-write"), ("Db::query", "sink"), ("Db::query", "tainted_raw"), ("curl_exec", "ext-call-in-loop"), ("ids", "multi-write-without-tx")}
    hits = {(r.rule_id, r.name) for r in engine.check("p").collect()}
    assert {("n1-query-in-loop", "Db::find"), ("sql-injection-raw", "Db::query"), ("dead-table", "unused"), ("http-contract-handler-unresolved", "POST /gone"), ("php-ext-call-in-loop", "curl_exec")} <= hits


def test_an_empty_tree_gives_an_empty_graph(spark, tmp_path):
    (tmp_path / "broken.py").write_text("def (")
    (tmp_path / "odd.php").write_text("<?php class { ) } function")
    engine = service.Engine(spark, f"file://{tmp_path}/projects")
    assert {(r.key, r.n) for r in engine.build("p", str(tmp_path)).collect()} == {("File", 2)}


def _calls(language, text):
    return {(r["owner"], r["receiver"], r["name"], tuple(r["args"]), bool(r["in_loop"])) for r in scopes.facts_of("a/b", language, text) if r["family"] == "call"}


def test_calls_know_their_scope():
    assert _calls("java", "package p; class A { Repo r; void f(int x) { for (int i : r.all()) { r.save(i, g(1)); } } }") == {("p.A::f", "r", "all", (), False), ("p.A::f", "r", "save", ("i", "g(1)"), True), ("p.A::f", None, "g", ("1",), True)}
    assert _calls("csharp", "namespace N { class C : D { int Go(Repo r) { while (true) r.Do(\"x\"); return 1; } } }") == {("N.C::Go", "r", "Do", ("x",), True)}
    assert _calls("rust", "struct S; impl<T> Run<T> for S { fn go<'a>(&'a self, b: &B) { for i in 0..3 { b.run(i); } S::new(); } }") == {("a.b.S::go", "b", "run", ("i",), True), ("a.b.S::go", "S", "new", (), False)}
    assert _calls("python", "class K:\n    def f(self, r):\n        for x in r.all():\n            r.table('u').find(x)\n") == {("a/b".replace("/", ".") + ".K::f", "r", "all", (), False), ("a.b.K::f", "r", "table", ("u",), True), ("a.b.K::f", "r", "find", ("x",), True)}
    assert _calls("javascript", "function go() { items.forEach(x => save(x)) }\nclass A { m() { /* no() */ return `no()` } }") == {("a.b.go", "items", "forEach", ("x => save(x)",), False), ("a.b.go", None, "save", ("x",), False)}


STACKS = {
    "a/Users.java": 'package a; @RestController @RequestMapping("/api") public class Users { @Autowired Repo r; @GetMapping({"/u/{id}", "/me"}) @PreAuthorize("hasRole(1)") public X one(@PathVariable int id) { return r.find(id); } @Delete("DELETE FROM t") int gone() { return 1; } @RequestMapping(value = "/u", method = {RequestMethod.POST, RequestMethod.PUT}) @PermitAll void add() {} }',
    "b/cats.ts": "@Controller('cats')\n@UseGuards(JwtGuard)\nexport class Cats { @Get(':id') one(@Param('id') id: string) { return id } @Post() make() { } }",
    "c/U.cs": 'namespace N { [Route("v1/[controller]")] public class DogsController : Base { [HttpPost("{id}")] [Authorize] public int Go(int[] a) { return go(a[0]); } [HttpGet] public int All() { return 1; } } }',
    "d/u.rs": '#[get("/r/{id}")]\nasync fn r_one(id: i32) -> R { go(id) }\n#[cfg(test)]\nfn other() {}\n',
    "e/U.php": "<?php\nnamespace e;\n#[Route('/s')]\nclass Shop { #[Route('/{id}', name: 'n', methods: ['POST'])] #[IsGranted('ROLE')] public function buy(): R { return 1; } }",
    "f/u.py": "from x import APIRouter\nr = APIRouter(prefix='/p')\n@r.get('/{id}')\n@login_required\ndef p_one(id): return go(id)\n@r.route('/many', methods=['PUT'])\ndef p_many(): pass\n@mock.patch('a.b')\ndef no(): pass\n",
    "web/r.js": "router.get('/m/:id', optionalAuth, show)\nfunction show() { }\n",
    "route.php": "<?php\nRoute::post('q/<id>', 'Shop@buy')->middleware(['Log', 'auth']);\n",
    "config/routes.rb": "Rails.application.routes.draw do\n  get '/rb/:id', to: 'big_users#show' # here\nend\n",
    "app/big.rb": "class BigUsersController < Base\n  def show\n    items.each do |x|\n      helper.save(x)\n    end\n    @log = Log.new\n    @log.line('a') if x\n  end\nend\nclass Log\n  def line(x)\n  end\nend\n",
}


def test_annotations_make_routes_and_guards(spark, tmp_path):
    for name, text in STACKS.items():
        (tmp_path / "src" / os.path.dirname(name)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    engine = service.Engine(spark, f"file://{tmp_path}/projects")
    engine.build("p", str(tmp_path / "src"))
    nodes = {r.id: r for r in engine.part("p", "nodes").collect()}
    edges = engine.part("p", "edges").collect()
    assert all(e.from_id in nodes and e.to_id in nodes for e in edges)
    pairs = lambda kind: {(nodes[e.from_id].name, nodes[e.to_id].name) for e in edges if e.kind == kind}
    assert pairs("HandledBy") == {
        ("GET /api/u/:*", "one"), ("GET /api/me", "one"), ("POST /api/u", "add"), ("PUT /api/u", "add"), ("GET /cats/:*", "one"), ("POST /cats", "make"),
        ("POST /v1/dogs/:*", "Go"), ("GET /v1/dogs", "All"), ("GET /r/:*", "r_one"), ("POST /s/:*", "buy"), ("GET /p/:*", "p_one"), ("PUT /p/many", "p_many"),
        ("GET /m/:*", "show"), ("POST /q/:*", "buy"), ("GET /rb/:*", "show"),
    }
    assert pairs("PassesThrough") == {
        ("GET /api/u/:*", "PreAuthorize"), ("GET /api/me", "PreAuthorize"), ("GET /cats/:*", "JwtGuard"), ("POST /cats", "JwtGuard"), ("POST /v1/dogs/:*", "Authorize"),
        ("POST /s/:*", "ROLE"), ("GET /p/:*", "login_required"), ("GET /m/:*", "optionalAuth"), ("POST /q/:*", "Log"), ("POST /q/:*", "auth"),
    }
    marks = {(nodes[m.node_id].name, m.kind) for m in engine.part("p", "marks").where("channel = 'Capability'").collect()}
    assert ("GET /m/:*", "auth.optional") in marks and ("POST /api/u", "auth.public") in marks and ("POST /q/:*", "Authentication") in marks
    assert ("show", "line") in pairs("Calls")
    hits = {(r.rule_id, r.name) for r in engine.check("p", {"write-endpoint-without-auth"}, {"write-endpoint-without-auth": {"enabled": True}}).collect()}
    assert ("write-endpoint-without-auth", "POST /q/:*") not in hits


def test_ruby_knows_scopes_and_loops():
    text = "module M\n  class A < B\n    def go(x) # no()\n      x.each do |i|\n        save(i, \"#{i} end\")\n      end\n      run unless x\n    end\n    def self.made\n      if a\n        A.new(1)\n      end\n    end\n  end\nend\n"
    assert _calls("ruby", text) == {("M.A::go", "x", "each", (), False), ("M.A::go", None, "save", ("i", "#{i} end"), True), ("M.A::made", "A", "new", ("1",), False)}
    assert scopes.facts_of("a.rb", "ruby", "") == [] and scopes.facts_of("a.rb", "ruby", "end\nend\ndef") == []


def test_odd_texts_are_no_error():
    pieces = ["class", "def", "end", "do", "|x|", "@A(", "[", "]", "(", ")", "{", "}", "#[", "'", '"', "x", "=", "a.b", "::", "<", ",", ";", "\n", "fn", "function", "if", "@interface", "=>", "impl", "for", "<?php", "use"]
    draw = random.Random(5)
    for _ in range(500):
        text = " ".join(draw.choices(pieces, k=draw.randint(1, 40)))
        for language in ("php", "javascript", "java", "csharp", "rust", "python", "ruby"):
            scopes.facts_of("a/b.x", language, text)
    assert [r["name"] for r in scopes.facts_of("a.rs", "rust", "impl <")] == ["impl"]


def _table(files, families=None, columns=tuple(scopes.COLUMNS)):
    batch = scopes._facts([(path, language, text.encode()) for path, language, text in files], "/", families, list(columns))
    return list(zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))


def test_files_that_differ_in_numbers_have_the_same_facts_as_parsed_alone():
    pieces = ["class", "new A1()", "$x1", "$x2", "$this->a1", "->", "go2(", "private B1 $a1;", "'12'", '"3', "%", "1.5", "0x1F", "@A1(", "[", "]", "(", ")", "{", "}", "#[", "=", "a1.b2", "::", "<", ",", ";", "\n", "function f1(A1 $x1)", "=>", "for", "<?php", "use a1\\B2;", "import {a1 as b2} from '../c1/d'", f"go({'1, ' * 60})"]
    draw, files = random.Random(7), []
    for _ in range(60):
        text = " ".join(draw.choices(pieces, k=draw.randint(1, 30)))
        for language in ("php", "javascript", "java", "csharp"):
            files += [(f"a{draw.randint(0, 20)}/b{k}.x", language, re.sub("[0-9]+", lambda m: draw.choice("1 2 12 007 12345678901".split()), text) if k else text) for k in range(4)]
    # a variable's type counts where the names are equal, not where they differ in numbers; long texts are cut alike
    files += [(f"v{n}.php", "php", f"<?php class A{n} {{ function f(B{n} $x{a}) {{ $x{b}->go({n}); }} }}") for n in range(3) for a in (1, 2) for b in (1, 2)]
    files += [(f"w{n}.php", "php", f"<?php go('{'a' * 180}', {n}, 'end');") for n in (1, 22, 333, 10**9)]
    scopes._SHAPES.clear()
    assert _table(files) == [tuple(r[c] for c in scopes.COLUMNS) for f in files for r in scopes.file_rows(*f)]
    assert any(isinstance(s, scopes._Shape) for s in scopes._SHAPES.values())
    own = [x for x in _table([files[-5]] * 3, ("call",), ("name", "typed"))]
    assert [dict(zip(scopes.COLUMNS, x))["typed"] for x in own] == ["B2"] * 3


def test_generated_files_are_parsed_once_a_shape(monkeypatch):
    seen, parse = [], scopes.facts_of
    monkeypatch.setattr(scopes, "facts_of", lambda *f: seen.append(f) or parse(*f))
    scopes._SHAPES.clear()
    rows = _table([(f"o/O{n}.php", "php", f"<?php class O{n} extends O{n // 3} {{ function go() {{ Db::name('t{n % 7}')->select(); }} }}") for n in range(300)])
    assert len(seen) <= 4 and len({r[0] for r in rows}) == 300


def test_sites_need_no_graph(spark, monkeypatch):
    from loomspark.plans import queries_source, registry

    monkeypatch.setattr(queries_source, "_BUILT", {})
    monkeypatch.setattr(queries_source, "stage", lambda df: pytest.fail("a stage is written"))
    assert registry.queries()["source_graph_sites"](spark, "/root/testdata/sf0.001").count() == 9


MORE = {
    "m/Kin.php": """<?php
namespace m;
use app\\model\\UserOrder;
use function m\\loose as Picked;
interface Held { }
class Kin extends Mid implements Held { function a() { $this->deep(); parent::deep(); self::own(); UserOrder::select(); Picked::own(); Other::own(); \\m\\Mid::own(); $this->nowhere(); } function own() { Db::name('User')->find(); $this->own(); } }
class Mid extends Top { function own() { Db::name('user')->find(); } }
class Top { function deep() { (new Ring())->turn(); $r = new Ring(); $r->turn(); $r->save(); } }
class Ring extends Gnir { }
class Gnir extends Ring { function go() { $this->turn(); } }
function loose($x) { Db::name('x')->find(); $k = new Kin(); $k->a(); }
class Other2 { public $a = 1; function select() { UserOrder::create([]); } }
""",
    "m/other.php": "<?php\nnamespace n;\nclass Other { function own() { } }\nclass Model1 { function find() { $this->find(); Model1::find(); Base::find(); } }\n",
}


def test_named_edges_are_those_of_the_graph(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomspark.plans import build

    texts = FILES | STACKS | MORE
    rows = [(path, {"php": "php", "js": "javascript", "ts": "javascript", "java": "java", "cs": "csharp", "rs": "rust", "py": "python", "rb": "ruby"}.get(path.rsplit(".", 1)[1]), text.encode()) for path, text in texts.items()]
    files = spark.createDataFrame([r for r in rows if r[1]], "path string, language string, content binary")
    schema = spark.createDataFrame([], "table string, columns array<string>")
    parts = build.graph_of(build.stage(scopes.parse(files, "")), schema)
    names = {n.id: n.name if n.kind == "Table" else n.fqn for n in parts["nodes"].where(F.col("kind").isin("Class", "Method", "Table")).collect()}
    wanted = {(e.kind, names[e.from_id], names[e.to_id]) for e in parts["edges"].where("kind in ('Extends', 'Calls', 'ReadsDb', 'WritesDb')").collect() if e.from_id in names and e.to_id in names}
    found = [tuple(r) for r in build.named_edges(lambda families, columns: scopes.parse(files, "", families, columns)).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    assert ("Calls", "m\\Kin::a", "m\\Top::deep") in wanted and ("WritesDb", "m\\Other2::select", "user_order") in wanted


def test_edges_write_no_whole_facts(spark, monkeypatch):
    from loomspark.plans import queries_source, registry

    monkeypatch.setattr(queries_source, "_BUILT", {})
    monkeypatch.setattr(queries_source, "graph_of", lambda *a: pytest.fail("the whole graph is built"))
    assert registry.queries()["source_graph_edges"](spark, "/root/testdata/sf0.001").count() > 0
