"""Graph storage: scans, endpoint fetches, statistics, coverage, and the delta sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kinds import CHAIN_EDGES, SEMANTIC_EDGES, SEVERITY_RANK


def query_nodes(nodes: DataFrame, kind: str | None = None, name_contains: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Nodes by kind (or category) and name pattern, in order of id.  ``_`` and ``%`` of the term are wildcards."""
    if kind:
        nodes = nodes.where((F.col("kind") == kind) | F.coalesce(F.col("category") == kind, F.lit(False)))
    if name_contains:
        nodes = nodes.where(F.col("name").ilike(f"%{name_contains}%"))
    return nodes.orderBy("id").offset(offset).limit(limit)


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def edges_of(edges: DataFrame, ids: DataFrame, direction: str) -> DataFrame:
    """Edges that start (``out``) or end (``in``) at any of ``ids``."""
    column = "from_id" if direction == "out" else "to_id"
    return edges.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_semi")


def chain_adjacency(edges: DataFrame) -> DataFrame:
    """(node, other, direction, semantic) over chain edges, both ways."""
    own = edges.where(F.col("kind").isin(*CHAIN_EDGES)).withColumn("semantic", F.col("kind").isin(*SEMANTIC_EDGES))
    out = own.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), F.lit("out").alias("direction"), "semantic")
    return out.union(own.select("to_id", "from_id", F.lit("in"), "semantic"))


def stats(nodes: DataFrame, edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(part, key, n): counts of nodes, edges and annotations by kind, and of nodes by category."""
    return (
        nodes.groupBy("kind").count().select(F.lit("node").alias("part"), F.col("kind").alias("key"), F.col("count").alias("n"))
        .union(edges.groupBy("kind").count().select(F.lit("edge"), "kind", "count"))
        .union(marks.groupBy("channel").count().select(F.lit("annotation"), "channel", "count"))
        .union(nodes.where("category is not null").groupBy("category").count().select(F.lit("category"), "category", "count"))
    )


def coverage(calls: DataFrame, covered: DataFrame, top: int = 25) -> tuple[DataFrame, DataFrame]:
    """Per sub-project (null: -1) total, covered and ratio of call sites (id, sub, callee); and the most frequent
    uncovered callees of each."""
    flagged = calls.join(covered.select("id", F.lit(True).alias("_c")).distinct(), "id", "left").withColumn("covered", F.coalesce("_c", F.lit(False))).withColumn("sub", F.coalesce("sub", F.lit(-1)))
    sums = flagged.groupBy("sub").agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"))
    sums = sums.withColumn("ratio", F.round(F.col("covered") / F.col("total"), 6))
    missed = flagged.where("not covered").groupBy("sub", "callee").count()
    place = F.row_number().over(Window.partitionBy("sub").orderBy(F.desc("count"), "callee"))
    return sums, missed.withColumn("place", place).where(F.col("place") <= top)


def apply_delta(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "first") -> DataFrame:
    """Union by key: ``first`` keeps what is stored (edges: insert or ignore), ``last`` what arrives (aliases, symbols:
    replace).  The result is written beside the old table and swapped in by the caller."""
    rank = F.lit(0 if keep == "first" else 1)
    both = old.withColumn("_age", rank).unionByName(new.withColumn("_age", 1 - rank))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_age"))
    return both.withColumn("_n", place).where("_n = 1").drop("_n", "_age")


def merge_identities(nodes: DataFrame, most_sources: int = 50) -> DataFrame:
    """One node per (kind, name): first id, largest confidence, number of merged rows, and up to ``most_sources``
    smallest source ids (that limit is the operator's own).  Ids are ranked map-side before the shuffle."""
    key = ["kind", "name"]
    sums = nodes.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("merged"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    few = nodes.select(*key, "id").withColumn("_n", place).where(F.col("_n") <= most_sources).groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("sources"))
    return sums.join(few, key)


def without_reads_covered_by(edges: DataFrame) -> DataFrame:
    """MapsTo edges stay only where no ReadsDb or WritesDb joins the same pair."""
    direct = edges.where("kind IN ('ReadsDb', 'WritesDb')").select("from_id", "to_id")
    maps = edges.where("kind = 'MapsTo'").join(direct, ["from_id", "to_id"], "left_anti")
    return edges.where("kind <> 'MapsTo'").unionByName(maps.select(*edges.columns))


def write_graph(parts: dict[str, DataFrame], path: str) -> None:
    """Write nodes, edges and annotations, nodes partitioned by kind for pruning."""
    for name, df in parts.items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy("kind") if "kind" in df.columns else writer).parquet(f"{path}/{name}")


def export_json(parts: dict[str, DataFrame], path: str) -> None:
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def newest(diagnostics: DataFrame, limit: int) -> DataFrame:
    return diagnostics.orderBy(F.desc("id")).limit(limit)


def most_severe(violations: DataFrame, limit: int) -> DataFrame:
    """Violations (severity, id) by severity, the newest first."""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])[F.col("severity")]
    return violations.orderBy(rank, F.desc("id")).limit(limit)


def severities(diagnostics: DataFrame, prefix: str | None = None, without_prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts by (code, severity), and one row with a count for each severity, of the codes with or without a prefix."""
    own = diagnostics.where(F.startswith("code", F.lit(prefix))) if prefix else diagnostics
    own = own.where(~F.startswith("code", F.lit(without_prefix))) if without_prefix else own
    return own.groupBy("code", "severity").agg(F.count("*").alias("n")), own.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])


def without_prefix(diagnostics: DataFrame, prefix: str) -> DataFrame:
    """Diagnostics whose code does not begin with a prefix; the caller swaps the result in."""
    return diagnostics.where(~F.startswith("code", F.lit(prefix)))


def code_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def count_nodes(nodes: DataFrame, kind: str | None = None, side: str | None = None) -> DataFrame:
    own = nodes.where(F.col("kind") == kind) if kind else nodes
    return (own.where(F.col("side") == side) if side else own).agg(F.count("*").alias("n"))


def kinds(nodes: DataFrame, edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(part, channel, kind): the kinds that occur; channels of annotations."""
    one = lambda df, part: df.select(F.lit(part).alias("part"), F.lit("").alias("channel"), "kind").distinct()
    return one(nodes, "node").union(one(edges, "edge")).union(marks.select(F.lit("annotation").alias("part"), "channel", "kind").distinct())


def recall_kinds(nodes: DataFrame, excluded: list[str]) -> DataFrame:
    return nodes.where(~F.col("kind").isin(*excluded)).select("kind").distinct()


def same_project(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the project's nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def replaced(old: DataFrame, new: DataFrame, key: str, values: list) -> DataFrame:
    """Rows with those of the given keys (a project, a sub-project) replaced by ``new``; nothing new: a reset."""
    return old.where(~F.coalesce(F.col(key).isin(*values), F.lit(False))).unionByName(new)


def merge_properties(old: DataFrame, patch: DataFrame) -> DataFrame:
    """(id, props): JSON objects merged at the top level, the patch's values last; several patches of one node apply in
    order of their text."""
    both = old.select("id", "props", F.lit(0).alias("age")).union(patch.select("id", "props", F.lit(1)))
    pairs = both.select("id", "age", "props", F.explode_outer(F.json_object_keys("props")).alias("k"))
    raw = F.to_json(F.variant_get(F.parse_json("props"), "$", "map<string,variant>")[F.col("k")])
    last = pairs.where("k is not null").groupBy("id", "k").agg(F.max_by(raw, F.struct("age", "props")).alias("v"))
    own = last.groupBy("id").agg(F.array_sort(F.collect_list(F.concat(F.to_json(F.struct(F.col("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("k")))) - 6), F.lit(":"), "v"))).alias("x"))
    ids = old.select("id").distinct()
    return ids.join(own, "id", "left").select("id", F.concat(F.lit("{"), F.coalesce(F.array_join("x", ","), F.lit("")), F.lit("}")).alias("props"))


def append_locations(old: DataFrame, new: DataFrame, most: int = 50, oldest_first: bool = True) -> DataFrame:
    """(id, file, line): places of both tables, each once, at most ``most`` a node: stored ones first (or all alike),
    then by file and line."""
    age = F.lit(0 if oldest_first else 1)
    both = old.select("id", "file", "line", age.alias("age")).union(new.select("id", "file", "line", F.lit(1)))
    once = both.groupBy("id", "file", "line").agg(F.min("age").alias("age"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("age", "file", "line"))
    return once.withColumn("_n", place).where(F.col("_n") <= most).select("id", "file", "line")


def converge_wildcards(contracts: DataFrame) -> DataFrame:
    """(id, target): contracts (id, scope, method, path) of method ``ANY`` or ``RULE`` join the first concrete contract of
    their scope and path; the others, and those without one, stay themselves."""
    wild = F.col("method").isin("ANY", "RULE")
    first = contracts.where(~wild).groupBy("scope", "path").agg(F.min("id").alias("first"))
    met = contracts.join(first, ["scope", "path"], "left")
    return met.select("id", F.when(wild, F.coalesce("first", "id")).otherwise(F.col("id")).alias("target"))
