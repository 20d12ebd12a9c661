"""The code graph as a projection of the driver's tables.

``VIEWS`` are SQL texts that Spark and the oracle engine both read; a name in braces is a table.  Node ids are
segmented: a kind's offset plus the row's key.

The views are written once for each folder of tables, partitioned by kind, and read pruned by every query after that:
a rule on tables neither scans nor shuffles call sites.  A changed table gives a new copy.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import new_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

CALLS = """
SELECT 5000000000 + l_orderkey * 64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate) AS id,
       2000000000 + l_orderkey AS owner, l_quantity AS quantity, CAST(round(l_discount * 100) AS BIGINT) AS discount,
       CAST(round(l_tax * 100) AS BIGINT) AS tax, l_returnflag AS flag
FROM {lineitem}"""

NODES = """
SELECT id, kind, CASE WHEN kind = 'CallSite' AND id % 11 = 0 THEN 'header_' ELSE '' END || name AS name, fqn, identity, side, in_loop, category, language, sub,
       CASE kind
       WHEN 'HttpContract' THEN '{"side":"' || side || '"' || CASE WHEN handler THEN ',"handler":"serve_' || category || '"' ELSE '' END || CASE WHEN id % 9 = 0 THEN ',"note":null' ELSE '' END || ',"weight":' || CAST(id % 4 AS VARCHAR(20)) || '}'
       WHEN 'Table' THEN '{"brand":"' || category || '"}'
       WHEN 'CallSite' THEN '{"in_loop":' || CASE WHEN in_loop THEN 'true' ELSE 'false' END || CASE WHEN id % 11 = 0 THEN ',"snippet":"header(Access-Control-Allow-Origin: . $origin)"' ELSE '' END || '}'
       WHEN 'HeaderAssignment' THEN '{"seen":true' || CASE WHEN id % 2 = 0 THEN ',"key":"Access-Control-Allow-Origin"' ELSE '' END || CASE WHEN id % 3 = 0 THEN ',"rhs":"request()->header(origin)"' ELSE '' END || '}' END AS props
FROM (SELECT 1000000000 + c_custkey AS id, 'HttpContract' AS kind,
       CASE c_custkey % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'PATCH' ELSE 'DELETE' END || ' /' ||
       CASE c_custkey % 7 WHEN 0 THEN 'list' WHEN 1 THEN 'delete' WHEN 2 THEN 'reset' WHEN 3 THEN 'show' WHEN 4 THEN 'clear' WHEN 5 THEN 'save' ELSE 'find' END || '/' || CAST(c_custkey AS VARCHAR(20)) AS name,
       CAST(NULL AS VARCHAR(200)) AS fqn,
       CASE c_custkey % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'PATCH' ELSE 'DELETE' END || ' /' || c_mktsegment || '/' || CAST(c_custkey AS VARCHAR(20)) AS identity,
       CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'frontend' ELSE 'backend' END AS side,
       c_acctbal >= 0 AS handler, false AS in_loop, c_mktsegment AS category, CASE WHEN c_nationkey < 13 THEN 'php' ELSE 'javascript' END AS language, CAST(c_nationkey AS BIGINT) AS sub
FROM {customer}
UNION ALL SELECT 2000000000 + o_orderkey, 'Method', 'order_' || CAST(o_orderkey AS VARCHAR(20)), 'customer_' || CAST(o_custkey AS VARCHAR(20)) || '::order_' || CAST(o_orderkey AS VARCHAR(20)), NULL, NULL, false, false, o_orderpriority, 'php', o_custkey % 25 FROM {orders}
UNION ALL SELECT 3000000000 + p_partkey, 'Table', p_name, NULL, 'table ' || p_name, NULL, false, false, p_brand, 'sql', p_partkey % 25 FROM {part}
UNION ALL SELECT 4000000000 + s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Cache' ELSE 'Queue' END, s_name, NULL, 'store ' || s_name, NULL, false, false, NULL, 'php', CAST(s_nationkey AS BIGINT) FROM {supplier}
UNION ALL SELECT id, 'CallSite', 'call_' || CAST(id AS VARCHAR(20)), 'order_' || CAST(owner - 2000000000 AS VARCHAR(20)), NULL, NULL, false, quantity > 40, flag, CASE id % 4 WHEN 0 THEN 'php' WHEN 1 THEN 'java' WHEN 2 THEN 'python' ELSE 'javascript' END, owner % 25 FROM calls
UNION ALL SELECT DISTINCT 6000000000 + user_id, 'Function', 'user_' || CAST(user_id AS VARCHAR(20)), NULL, NULL, NULL, false, false, NULL, 'javascript', user_id % 25 FROM {events}
UNION ALL SELECT 7000000000 + n_nationkey, 'ConfigKey', n_name, NULL, NULL, NULL, false, false, NULL, 'php', CAST(n_nationkey AS BIGINT) FROM {nation}
UNION ALL SELECT 8000000000 + r_regionkey, 'EventBus', r_name, NULL, NULL, NULL, false, false, NULL, 'javascript', CAST(0 AS BIGINT) FROM {region}
UNION ALL SELECT DISTINCT 9000000000 + length(event_type), 'Event', event_type, NULL, NULL, NULL, false, false, NULL, 'php', CAST(0 AS BIGINT) FROM {events}
UNION ALL SELECT 9500000000 + n_nationkey, 'HeaderAssignment', n_name, NULL, NULL, NULL, false, false, NULL, 'php', CAST(n_nationkey AS BIGINT) FROM {nation}) t"""

EDGES = """
SELECT 'HandledBy' AS kind, 1000000000 + o_custkey AS from_id, 2000000000 + o_orderkey AS to_id, CAST(1.0 AS DOUBLE) AS confidence FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
UNION ALL SELECT 'HasCallSite', owner, id, CAST(1.0 AS DOUBLE) FROM calls
UNION ALL SELECT DISTINCT 'WritesDb', 2000000000 + l_orderkey, 3000000000 + l_partkey, CAST(0.9 AS DOUBLE) FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity >= 46
UNION ALL SELECT DISTINCT 'ReadsDb', 2000000000 + l_orderkey, 3000000000 + l_partkey, CAST(0.8 AS DOUBLE) FROM {lineitem} WHERE l_returnflag = 'N' AND l_quantity <= 4
UNION ALL SELECT DISTINCT 'ReadsCache', 2000000000 + l_orderkey, 4000000000 + l_suppkey, CAST(0.9 AS DOUBLE) FROM {lineitem} WHERE l_returnflag = 'A' AND l_quantity >= 50 AND l_suppkey % 2 = 0
UNION ALL SELECT DISTINCT 'WritesCache', 2000000000 + l_orderkey, 4000000000 + l_suppkey, CAST(0.9 AS DOUBLE) FROM {lineitem} WHERE l_returnflag = 'A' AND l_quantity <= 1 AND l_suppkey % 6 = 0
UNION ALL SELECT DISTINCT 'PublishesTo', 2000000000 + l_orderkey, 4000000000 + l_suppkey, CAST(0.9 AS DOUBLE) FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity <= 1 AND l_suppkey % 4 = 1
UNION ALL SELECT 'ReadsConfig', 2000000000 + o_orderkey, 7000000000 + o_custkey % 25, CAST(0.9 AS DOUBLE) FROM {orders} WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT 'Emits', 2000000000 + o_orderkey, 8000000000 + o_orderkey % 3, CAST(1.0 AS DOUBLE) FROM {orders} WHERE o_orderkey % 97 = 0
UNION ALL SELECT 'ListensTo', 2000000000 + o_orderkey, 8000000000 + o_orderkey % 3 + 1, CAST(1.0 AS DOUBLE) FROM {orders} WHERE o_orderkey % 101 = 0
UNION ALL SELECT DISTINCT 'Triggers', 6000000000 + user_id, 9000000000 + length(event_type), CAST(1.0 AS DOUBLE) FROM {events} WHERE event_type IN ('signup', 'click') AND event_id % 10 = 0
UNION ALL SELECT 'Calls', id, next, confidence FROM (SELECT 2000000000 + o_orderkey AS id, 2000000000 + lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next, CASE WHEN o_orderpriority = '5-LOW' THEN CAST(0.7 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS confidence FROM {orders}) t WHERE next IS NOT NULL
UNION ALL SELECT DISTINCT 'CallsHttp', 6000000000 + user_id, 1000000000 + c_custkey, CAST(1.0 AS DOUBLE) FROM {events} JOIN {customer} ON c_custkey = user_id * 10 WHERE event_type = 'click'"""

MARKS = """
SELECT 3000000000 + p_partkey AS node_id, 'FkbMark' AS channel, 'pii' AS kind FROM {part} WHERE p_size <= 5
UNION ALL SELECT 1000000000 + c_custkey, 'Capability', 'Authentication' FROM {customer} WHERE c_acctbal BETWEEN 0 AND 5000
UNION ALL SELECT 1000000000 + c_custkey, 'Capability', 'auth.optional' FROM {customer} WHERE c_acctbal > 9000
UNION ALL SELECT id, 'Taint', 'sink' FROM calls WHERE discount >= 10
UNION ALL SELECT id, 'Taint', 'tainted_raw' FROM calls WHERE discount >= 10 AND tax >= 8
UNION ALL SELECT id, 'Taint', 'tainted_raw_unknown' FROM calls WHERE discount >= 10 AND tax = 7
UNION ALL SELECT id, 'Taint', 'tainted_where' FROM calls WHERE discount = 9 AND tax >= 8
UNION ALL SELECT id, 'Taint', 'tainted_where_unknown' FROM calls WHERE discount = 9 AND tax = 7
UNION ALL SELECT id, 'Sign', 'weak_sign_compare' FROM calls WHERE tax = 0 AND quantity <= 1
UNION ALL SELECT id, 'Sign', 'weak_sign_hash' FROM calls WHERE tax = 1 AND quantity <= 1
UNION ALL SELECT id, 'External', 'ext-call-in-loop' FROM calls WHERE quantity > 48
UNION ALL SELECT id, 'DbQuery', 'db-query' FROM calls WHERE flag = 'N' AND discount <= 2
UNION ALL SELECT id, 'DbQuery', 'db-write' FROM calls WHERE flag = 'R' AND discount <= 2
UNION ALL SELECT 2000000000 + l_orderkey, 'Tx', 'multi-write-without-tx' FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity >= 46 GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) >= 2
UNION ALL SELECT id, 'Tx', 'tx-marker' FROM calls WHERE tax >= 8 AND quantity >= 46"""

VIEWS = {"calls": CALLS, "nodes": NODES, "edges": EDGES, "marks": MARKS}


#: Columns of the written parts; ``kind`` (``channel`` of annotations: with it) prunes folders.
SCHEMAS = {
    "calls": "id long, owner long, quantity double, discount long, tax long, flag string",
    "nodes": "id long, kind string, name string, fqn string, identity string, side string, in_loop boolean, category string, language string, sub long, props string",
    "edges": "kind string, from_id long, to_id long, confidence double",
    "marks": "node_id long, channel string, kind string",
}


def oracle(body: str) -> str:
    """SQL of the oracle engine: the projection's views, each computed once, then ``body``."""
    views = ", ".join(f"{name} AS MATERIALIZED ({filled(text, {t: t for t in TABLES})})" for name, text in VIEWS.items())
    return f"WITH RECURSIVE {views} {body}"


def filled(text: str, names: dict[str, str]) -> str:
    """``text`` with the table names in braces replaced; other braces stay."""
    for name, other in names.items():
        text = text.replace("{" + name + "}", other)
    return text


class Graph:
    """The graph's parts as DataFrames over one folder of tables."""

    _written: dict[tuple, str] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str, written: bool = True) -> DataFrame:
        text = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        if " calls" in text:
            used["calls"] = self.calls if written else self._view("calls")
            text = text.replace("FROM calls", "FROM {calls}")
        types = {f.split()[0]: f.split()[1] for f in SCHEMAS[name].split(", ")}
        text = filled(text.replace("VARCHAR(20)", "STRING").replace("VARCHAR(200)", "STRING"), {t: f"projected_{t}" for t in used})
        for t, df in used.items():
            df.createOrReplaceTempView(f"projected_{t}")
        found = self.spark.sql(text)
        return found.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])

    def _state(self, name: str) -> tuple:
        """Sizes and times of the tables that a part is made from."""
        context, state = self.spark.sparkContext, []
        text = VIEWS[name] + (CALLS if " calls" in VIEWS[name] else "")
        for t in TABLES:
            if "{" + t + "}" in text:
                path = context._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{t}.parquet")
                files = path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path)
                state.append((t, *sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))
        return (context.applicationId, self.sf_dir, name, *state)

    def _write(self, name: str) -> None:
        key, schema = self._state(name), SCHEMAS[name]
        if key not in self._written:
            path = f"{new_folder(self.spark)}/{name}"
            writer = self._view(name).write
            (writer.partitionBy("kind") if "kind string" in schema else writer).parquet(path)
            self._written[key] = path

    def _part(self, name: str) -> DataFrame:
        if name == "calls":
            self._write(name)
        elif self._state(name) not in self._written:
            self._write("calls")
            with ThreadPoolExecutor(3) as pool:  # small jobs side by side; the driver only submits them
                list(pool.map(self._write, ("nodes", "edges", "marks")))
        schema = SCHEMAS[name]
        return self.spark.read.schema(schema).parquet(self._written[self._state(name)]).select(*[f.split()[0] for f in schema.split(", ")])

    def nodes_of(self, kind: str) -> DataFrame:
        """Nodes of one kind; where the graph is not written yet, straight from that kind's own tables."""
        nodes = self.nodes if self._state("nodes") in self._written else self._view("nodes", written=False)
        return nodes.where(F.col("kind") == kind)

    @cached_property
    def calls(self) -> DataFrame:
        return self._part("calls")

    @cached_property
    def nodes(self) -> DataFrame:
        return self._part("nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return self._part("edges")

    @cached_property
    def marks(self) -> DataFrame:
        return self._part("marks")
