"""Code facts as a projection of the driver's tables: call sites, classes, imports, assignments, symbols, spans.

Like ``projection.VIEWS`` these are SQL texts that Spark and the oracle engine both read; the operators that work on
facts get their input from them.  A class is a customer (one in five has no base, the others extend a smaller key), a
method an order, a call site a line item, a file a nation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators.staging import stage
from .projection import TABLES, Graph, filled

CLASSES = """
SELECT c_custkey AS id, 'app\\model\\C' || CAST(c_custkey AS VARCHAR(20)) AS fqn, 'C' || CAST(c_custkey % 400 AS VARCHAR(20)) AS short,
       CASE WHEN c_custkey % 5 > 0 AND c_custkey >= 5 THEN 'app\\model\\C' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR(20)) END AS base,
       c_nationkey AS file, CAST(c_nationkey % 3 AS BIGINT) AS sub
FROM {customer}"""

METHODS = """
SELECT 2000000000 + o_orderkey AS id, 'app\\model\\C' || CAST(o_custkey AS VARCHAR(20)) AS class, 'm' || CAST(o_orderkey % 12 AS VARCHAR(20)) AS method, o_custkey AS class_id
FROM {orders}"""

SITES = """
SELECT l_orderkey * 64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate) AS id,
       2000000000 + l_orderkey AS owner, o_custkey AS owner_class, c_nationkey AS file, l_linenumber * 10 AS line, CAST(c_nationkey % 3 AS BIGINT) AS sub,
       CASE l_partkey % 9 WHEN 0 THEN 'this' WHEN 1 THEN 'Db' WHEN 2 THEN 'app\\facade\\Cache' WHEN 3 THEN 'self' WHEN 4 THEN 'parent' WHEN 5 THEN 'Alias' || CAST(l_suppkey % 20 AS VARCHAR(20)) WHEN 6 THEN 'C' || CAST(l_partkey % 400 AS VARCHAR(20)) WHEN 7 THEN 'MyCache' END AS receiver,
       CASE l_suppkey % 6 WHEN 0 THEN 'get' WHEN 1 THEN 'set' WHEN 2 THEN 'name' WHEN 3 THEN 'only' ELSE 'm' || CAST(l_partkey % 12 AS VARCHAR(20)) END AS method,
       CASE WHEN l_linenumber % 4 = 0 THEN 'key_' || l_returnflag WHEN l_linenumber % 4 = 1 THEN 'eb_part_' || CAST(l_partkey % 50 AS VARCHAR(20)) WHEN l_linenumber % 4 = 2 THEN 'free text' END AS arg0,
       l_linenumber % 4 AS arg_count, l_quantity > 40 AS in_loop
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey"""

IMPORTS = """
SELECT n_nationkey AS file, 'Alias' || CAST(s_suppkey % 20 AS VARCHAR(20)) AS alias, min('app\\model\\C' || CAST(s_suppkey AS VARCHAR(20))) AS fqn
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_nationkey, s_suppkey % 20"""

ASSIGNS = """
SELECT 2000000000 + l_orderkey AS owner, 'v' || CAST(l_linenumber AS VARCHAR(20)) AS var,
       CASE WHEN min(l_quantity) < 6 THEN '$_GET[x]' ELSE '$v' || CAST(l_linenumber % 7 + 1 AS VARCHAR(20)) || ' . suffix' END AS rhs
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

SYMBOLS = """
SELECT 'schema' AS table_name, 'part_' || CAST(p_partkey % 50 AS VARCHAR(20)) AS key, min(p_brand) AS value FROM {part} GROUP BY p_partkey % 50
UNION ALL SELECT 'config', 'key_' || o_orderstatus, min(o_orderpriority) FROM {orders} GROUP BY o_orderstatus"""

SPANS = """
SELECT n_nationkey AS file, CAST(n_regionkey * 10 AS BIGINT) AS a, CAST(n_regionkey * 10 + n_nationkey % 60 AS BIGINT) AS b, 'g' || CAST(n_nationkey AS VARCHAR(20)) AS label, 'outer' AS class FROM {nation}
UNION ALL SELECT n_nationkey, 0, 90, 'api', 'outer' FROM {nation}
UNION ALL SELECT n_nationkey, 20, 40, 'v' || CAST(n_nationkey % 4 AS VARCHAR(20)), 'inner' FROM {nation}"""

CONFIGS = """
SELECT n_nationkey AS file, 'config/' || CASE n_nationkey % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'route' ELSE 'lang/de/text' END || '.json' AS path,
       'section' || CAST(n_regionkey AS VARCHAR(20)) || '.item.' || n_name AS key_path, CASE WHEN n_nationkey % 4 = 0 THEN '["a","b","c"]' ELSE '"' || n_name || '"' END AS value
FROM {nation}"""

FACTS = {"classes": CLASSES, "methods": METHODS, "sites": SITES, "imports": IMPORTS, "assigns": ASSIGNS, "symbols": SYMBOLS, "spans": SPANS, "configs": CONFIGS}


def facts_oracle(body: str) -> str:
    """SQL of the oracle engine: the fact views, each computed once, then ``body``."""
    views = ", ".join(f"{name} AS MATERIALIZED ({filled(text, {t: t for t in TABLES})})" for name, text in FACTS.items())
    return f"WITH RECURSIVE {views} {body}"


class Facts(Graph):
    """Fact tables over one folder of tables; call sites, which need a window over all line items, are written once."""

    _sites: dict[tuple, DataFrame] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)

    def _fact(self, name: str) -> DataFrame:
        text = FACTS[name]
        used = [t for t in TABLES if "{" + t + "}" in text]
        for t in used:
            self.table(t).createOrReplaceTempView(f"projected_{t}")
        # Spark reads a backslash in a literal as an escape, the oracle engine does not
        return self.spark.sql(filled(text, {t: f"projected_{t}" for t in used}).replace("\\", "\\\\").replace("VARCHAR(20)", "STRING"))

    @cached_property
    def sites(self) -> DataFrame:
        key = ("sites", *self._state("calls"))
        if key not in self._sites:
            self._sites[key] = stage(self._fact("sites"))
        return self._sites[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name in FACTS:
            return self._fact(name)
        raise AttributeError(name)
