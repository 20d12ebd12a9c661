"""Enrichment phases: pure functions from graph parts to new edges or annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SQL_WORDS = r"(?i)\b(select|insert|update|delete|where|from|set|values)\b"


def multi_write_without_tx(edges: DataFrame, marked_methods: DataFrame) -> DataFrame:
    """(node_id, tables): methods that write two tables or more directly, none of their calls inside a transaction."""
    writes = edges.where("kind = 'WritesDb'").groupBy(F.col("from_id").alias("node_id")).agg(F.count_distinct("to_id").alias("tables"))
    return writes.where("tables >= 2").join(marked_methods.select("node_id").distinct(), "node_id", "left_anti")


def external_in_loop(calls: DataFrame, external: DataFrame) -> DataFrame:
    """Call sites (id, callee, in_loop) in loops whose callee is an external call (callee)."""
    return calls.where("in_loop").join(external.select("callee").distinct(), "callee", "left_semi").select("id")


def weak_signs(compares: DataFrame, calls: DataFrame) -> DataFrame:
    """Loose comparisons matched to the call whose text they hold, else to any call of the same function.

    compares (owner, text), calls (id, owner, callee); (id, tier): tier 0 by text, 1 by function.
    """
    met = compares.join(calls, "owner").withColumn("tier", F.when(F.contains("text", "callee"), 0).otherwise(1))
    best = met.groupBy("owner", "text").agg(F.min(F.struct("tier", "id")).alias("best"))
    return best.select("best.id", "best.tier").distinct()


def tainted(sinks: DataFrame, assignments: DataFrame, sources: str, depth: int = 4) -> DataFrame:
    """Trace a sink's variables back through assignments of the same function, at most ``depth`` steps.

    sinks (id, owner, var), assignments (owner, var, rhs); ``sources`` is a pattern of user input.  (id, kind):
    ``tainted`` where a source is reached, else ``tainted_unknown``.
    """
    at = sinks.select("id", "owner", "var", F.array("var").alias("seen"))
    hits = None
    for _ in range(depth):
        step = at.join(assignments, ["owner", "var"])
        found = step.where(F.col("rhs").rlike(sources)).select("id")
        hits = found if hits is None else hits.union(found)
        names = F.array_distinct(F.regexp_extract_all("rhs", F.lit(r"\$(\w+)"), F.lit(1)))
        at = step.select("id", "owner", F.explode(names).alias("next"), "seen").where(~F.array_contains("seen", F.col("next"))).select("id", "owner", F.col("next").alias("var"), F.concat("seen", F.array("next")).alias("seen"))
    hits = hits.distinct().withColumn("hit", F.lit(True))
    return sinks.select("id").distinct().join(hits, "id", "left").select("id", F.when(F.col("hit"), "tainted").otherwise("tainted_unknown").alias("kind"))


def guard_edges(contracts: DataFrame, routes: DataFrame, guards: DataFrame) -> DataFrame:
    """PassesThrough edges: contracts (id, name) meet routes (name, guards array); guards (class, id)."""
    return contracts.join(routes.select("name", F.explode("guards").alias("class")), "name").join(guards.select("class", F.col("id").alias("to_id")), "class").select(F.lit("PassesThrough").alias("kind"), F.col("id").alias("from_id"), "to_id").distinct()


#: Cells of the grid in which ``bridge`` pairs contracts: front ends a cell, and back ends a row.
FRONT_CELL, BACK_ROW = 1024, 4096


def bridge(contracts: DataFrame) -> DataFrame:
    """Same identity in different sub-projects: (from_id, to_id, tier); wildcard methods (``ANY``, ``RULE``) only
    where no exact partner exists.  contracts (id, sub, side, name); front end to back end.

    Whether an exact partner exists is told by the sub-projects of each identity, so only contracts are shuffled: back
    ends as arrays of ids, once for each cell of front ends that they meet.  Pairs are made last, and never moved."""
    own = contracts.withColumn("method", F.substring_index("name", " ", 1)).withColumn("path", F.regexp_extract("name", r"^\S* (.*)$", 1))
    front = own.where("side = 'frontend' and sub is not null and path is not null").select(F.col("id").alias("from_id"), F.col("sub").alias("a"), "path", "method")
    back = own.where("side = 'backend' and sub is not null and path is not null").select(F.col("id").alias("to_id"), F.col("sub").alias("b"), "path", "method")
    groups = back.groupBy("path", "method", "b").agg(F.count("*").alias("n"))
    subs = groups.groupBy("path", "method").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    asked = front.join(subs, ["path", "method"], "left").withColumn("exact", F.coalesce((F.col("low") != F.col("a")) | (F.col("high") != F.col("a")), F.lit(False)))
    exact = asked.groupBy("from_id").agg(F.max("exact").alias("exact"))
    want = F.when(F.col("exact"), F.array("method")).otherwise(F.array(F.lit("ANY"), F.lit("RULE")))
    asked = asked.drop("exact").join(exact, "from_id").select("from_id", "a", "path", F.explode(want).alias("method"), F.when(F.col("exact"), 0).otherwise(1).alias("tier"))
    cells = asked.groupBy("path", "method").agg(F.ceil(F.count("*") / FRONT_CELL).alias("cells"))
    asked = asked.join(cells, ["path", "method"]).withColumn("cell", F.pmod(F.xxhash64("from_id"), "cells"))
    part = F.pmod(F.xxhash64("to_id"), F.ceil(F.col("n") / BACK_ROW))
    rows = back.join(groups, ["path", "method", "b"]).groupBy("path", "method", "b", part.alias("part")).agg(F.collect_list("to_id").alias("to_ids"))
    rows = rows.join(cells, ["path", "method"]).select("path", "method", "b", "to_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"))
    # a few contracts make many pairs: the parts are not joined into fewer by their size
    spark = contracts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = ["path", "method", "cell"]
    met = asked.select("from_id", "a", "tier", *keys).repartition(parts, *keys).join(rows.repartition(parts, *keys), keys).where("a <> b")
    return met.select("from_id", F.explode("to_ids").alias("to_id"), "tier")


def columns_of_tables(tables: DataFrame, schema: DataFrame) -> DataFrame:
    """(table_id, column): HasColumn from a schema (table, columns) by name, else by name with ``s``."""
    owned = schema.select(F.lower("table").alias("t"), "columns")
    one = tables.select("id", F.lower("name").alias("t")).join(owned, "t", "left")
    many = one.where("columns is null").select("id", F.concat("t", F.lit("s")).alias("t")).join(owned, "t")
    return one.where("columns is not null").select("id", "columns").union(many.select("id", "columns")).select(F.col("id").alias("table_id"), F.explode("columns").alias("column")).distinct()


def resolve_calls(calls: DataFrame, methods: DataFrame, supers: DataFrame, max_depth: int = 20) -> DataFrame:
    """Calls (id, class, method) to the nearest definition (class, method, node) up the chain of supers (child, base,
    depth as by ``closure``; depth 0 is the class itself): (id, node, confidence)."""
    own = supers.where(F.col("depth") <= max_depth).select(F.col("child").alias("class"), "base", "depth")
    found = calls.join(own, "class").join(methods.select(F.col("class").alias("base"), "method", "node"), ["base", "method"])
    return found.groupBy("id").agg(F.min(F.struct("depth", "node")).alias("best")).select("id", "best.node", F.when(F.col("best.depth") == 0, 1.0).otherwise(0.7).alias("confidence"))
