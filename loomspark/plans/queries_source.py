"""Queries of graphs that are built from source text: every order is written as a class of PHP, parsed and resolved.

A class extends the order of a third of its number (but for multiples of five), has the method ``step`` if its number is
even, reads or writes a table a line item, in a loop where the quantity is above 40, and runs the next order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from ..sources import scopes
from .build import SITE_COLUMNS, SITE_FAMILIES, call_sites, graph_of, named_edges
from .projection import Graph
from .registry import query

_BUILT: dict[tuple, dict[str, DataFrame]] = {}


def _files(g: Graph) -> DataFrame:
    """(path, language, content): one PHP file an order; at most seven lines of items each."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    # parsing costs far more than its few bytes say: every core gets a share; what is dealt out are keys, not texts
    deal = lambda df: df.repartition(max(int(g.spark.conf.get("spark.sql.shuffle.partitions")), g.spark.sparkContext.defaultParallelism), "o_orderkey")
    items = deal(g.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 50).alias("part"), (F.col("l_returnflag") == "R").alias("written"), (F.col("l_quantity") > 40).alias("many")))
    line = text("Db::name('part_", F.col("part"), "')->where('id', $i)->", F.when(F.col("written"), "update([])").otherwise("select()"), ";\n")
    line = F.when(F.col("many"), text("foreach ($ids as $i) { // each\n", line, "}\n")).otherwise(line)
    lines = items.groupBy("o_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("lines"))
    key = F.col("o_orderkey")
    up = F.when(key % 5 > 0, text(" extends O", F.floor(key / 3))).otherwise("")
    step = F.when(key % 2 == 0, text("  private function step() {\n    $x = new O", key + 1, "();\n    $x->run([1, 'a}']);\n  }\n")).otherwise("")
    body = text("<?php\nnamespace app\\model;\nclass O", key, up, " {\n  public function run(array $ids) {\n", F.coalesce("lines", F.lit("")), "    $this->step();\n  }\n", step, "}\n")
    return deal(g.table("orders").select("o_orderkey")).join(lines, "o_orderkey", "left").select(text("app/model/O", key, ".php").alias("path"), F.lit("php").alias("language"), body.cast("binary").alias("content"))


def _built(g: Graph) -> dict[str, DataFrame]:
    return _graph(g, "orders", _files)


def _graph(g: Graph, name: str, files) -> dict[str, DataFrame]:
    key = (name, g._state("edges"))
    if key not in _BUILT:
        schema = g.table("part").limit(0).select(F.lit("").alias("table"), F.array(F.lit("")).alias("columns"))
        _BUILT[key] = graph_of(stage(scopes.parse(files(g), "")), schema)
    return _BUILT[key]


_RUN, _CLASS = "'app\\model\\O' || CAST({} AS VARCHAR) || '::run'", "'app\\model\\O' || CAST({} AS VARCHAR)"
_EDGES = f"""
WITH RECURSIVE o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN CAST(floor(o_orderkey / 3) AS BIGINT) END AS want FROM orders),
up AS (SELECT o.k, b.k AS base FROM o LEFT JOIN o b ON b.k = o.want),
ch(k, here, depth) AS (SELECT k, k, 0 FROM o UNION ALL SELECT ch.k, up.base, depth + 1 FROM ch JOIN up ON up.k = ch.here WHERE up.base IS NOT NULL AND depth < 20),
near AS (SELECT k, arg_min(here, depth) AS here FROM ch WHERE here % 2 = 0 GROUP BY k)
SELECT 'Extends' AS kind, {_CLASS.format("k")} AS source, {_CLASS.format("base")} AS target FROM up WHERE base IS NOT NULL
UNION ALL SELECT 'Calls', {_RUN.format("k")}, {_CLASS.format("here")} || '::step' FROM near
UNION ALL SELECT 'Calls', {_CLASS.format("o.k")} || '::step', {_RUN.format("n.k")} FROM o JOIN o n ON n.k = o.k + 1 WHERE o.k % 2 = 0
UNION ALL SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 'WritesDb' ELSE 'ReadsDb' END, {_RUN.format("l_orderkey")}, 'part_' || CAST(l_partkey % 50 AS VARCHAR) FROM lineitem JOIN o ON o.k = l_orderkey"""


@query("source_graph_edges", _EDGES, graph=False)
def source_graph_edges(g: Graph):
    return named_edges(lambda families, columns: scopes.parse(_files(g), "", families, columns))


_MARKS = f"""
WITH i AS (SELECT l_orderkey, l_returnflag = 'R' AS w, l_quantity > 40 AS in_loop, l_partkey % 50 AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT {_RUN.format("l_orderkey")} AS method, CASE WHEN w THEN 'db-write' ELSE 'db-query' END AS kind, in_loop, count(*) AS n FROM i GROUP BY ALL
UNION ALL SELECT {_RUN.format("l_orderkey")}, 'multi-write-without-tx', false, 1 FROM i WHERE w GROUP BY l_orderkey HAVING count(DISTINCT t) >= 2"""


@query("source_graph_marks", _MARKS, graph=False)
def source_graph_marks(g: Graph):
    parts = _built(g)
    names = parts["nodes"].where("kind in ('CallSite', 'Method')").select(F.col("id").alias("node_id"), F.col("fqn").alias("method"), "in_loop")
    return parts["marks"].join(names, "node_id").groupBy("method", "kind", "in_loop").agg(F.count("*").alias("n"))


_SITES = """
SELECT kind, in_loop, count(*) AS n FROM (
  SELECT 'Db::name' AS kind, l_quantity > 40 AS in_loop FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT 'Db::where', l_quantity > 40 FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 'Db::update' ELSE 'Db::select' END, l_quantity > 40 FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT 'this::step', false FROM orders) t GROUP BY ALL"""


@query("source_graph_sites", _SITES, graph=False)
def source_graph_sites(g: Graph):
    # one pass over the files: neither the facts nor the graph are written
    sites = call_sites(scopes.parse(_files(g), "", SITE_FAMILIES, SITE_COLUMNS))
    own = sites.where("name like 'Db::%' or name = 'this::step'")
    return own.groupBy(F.col("name").alias("kind"), "in_loop").agg(F.count("*").alias("n"))


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _route_files(g: Graph) -> DataFrame:
    """(path, language, content): ten customers are a class (or a router) of Java, TypeScript, C# or Python in turn; each
    is a route below its own path, a write if its key divides by three, guarded if it divides by five."""
    k, j = F.col("c_custkey"), F.floor(F.col("c_custkey") / 10)
    turn, post, held = j % 4, k % 3 == 0, k % 5 == 0
    when = lambda get, write: F.when(post, write).otherwise(get)
    guard = lambda text: F.when(held, text).otherwise("")
    route = (
        F.when(turn == 0, _text("  @", when("Get", "Post"), 'Mapping("/{id}/c', k, '")\n', guard('  @PreAuthorize("x y")\n'), "  public int m", k, "() { return 1; }\n"))
        .when(turn == 1, _text("  @", when("Get", "Post"), "(':id/c", k, "')\n", guard("  @UseGuards(AuthGuard)\n"), "  m", k, "() { return 1 }\n"))
        .when(turn == 2, _text("  [Http", when("Get", "Post"), '("{id}/c', k, '")]\n', guard("  [Authorize]\n"), "  public int m", k, "() { return 1; }\n"))
        .otherwise(_text("@r.", when("get", "post"), "('/{id}/c", k, "')\n", guard("@login_required\n"), "def m", k, "(id):\n    return 1\n"))
    )
    made = g.table("customer").groupBy(j.alias("j")).agg(F.array_join(F.sort_array(F.collect_list(route)), "").alias("routes"))
    j, turn = F.col("j"), F.col("j") % 4
    head = F.when(turn == 0, _text('@RequestMapping("/g', j, '")\npublic class C', j, " {\n")).when(turn == 1, _text("@Controller('g", j, "')\nexport class C", j, " {\n"))
    head = head.when(turn == 2, _text('[Route("g', j, '")]\npublic class C', j, " {\n")).otherwise(_text("r = APIRouter(prefix='/g", j, "')\n"))
    content = F.concat(head, "routes", F.when(turn < 3, "}\n").otherwise("")).cast("binary")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (turn + 1).cast("int"))
    files = made.select(_text("web/c", j, pick(".java", ".ts", ".cs", ".py")).alias("path"), pick("java", "javascript", "csharp", "python").alias("language"), content.alias("content"))
    return files.repartition(g.spark.sparkContext.defaultParallelism, "path")


_ROUTES = """
WITH c AS (SELECT c_custkey AS k, CAST(floor(c_custkey / 10) AS BIGINT) AS j FROM customer),
r AS (SELECT k, j % 4 AS t, j, CASE WHEN k % 3 = 0 THEN 'POST' ELSE 'GET' END || ' /g' || CAST(j AS VARCHAR) || '/:*/c' || CAST(k AS VARCHAR) AS name FROM c)
SELECT 'HandledBy' AS kind, name AS source, CASE t WHEN 1 THEN 'web.c' || CAST(j AS VARCHAR) || '.' WHEN 3 THEN 'web.c' || CAST(j AS VARCHAR) || '.' ELSE '' END
  || CASE WHEN t < 3 THEN 'C' || CAST(j AS VARCHAR) || '::' ELSE '' END || 'm' || CAST(k AS VARCHAR) AS target FROM r
UNION ALL SELECT 'PassesThrough', name, CASE t WHEN 0 THEN 'PreAuthorize' WHEN 1 THEN 'AuthGuard' WHEN 2 THEN 'Authorize' ELSE 'login_required' END FROM r WHERE k % 5 = 0
UNION ALL SELECT 'Authentication', name, '' FROM r WHERE k % 5 = 0"""


@query("source_route_edges", _ROUTES, graph=False)
def source_route_edges(g: Graph):
    parts = _graph(g, "customers", _route_files)
    names = parts["nodes"].select("id", F.coalesce("fqn", "name").alias("label"))
    own = parts["edges"].where("kind in ('HandledBy', 'PassesThrough')").join(names.select(F.col("id").alias("from_id"), F.col("label").alias("source")), "from_id")
    own = own.join(names.select(F.col("id").alias("to_id"), F.col("label").alias("target")), "to_id").select("kind", "source", "target")
    asked = parts["marks"].where("channel = 'Capability'").join(names.withColumnRenamed("id", "node_id"), "node_id")
    return own.unionByName(asked.select("kind", F.col("label").alias("source"), F.lit("").alias("target")))
