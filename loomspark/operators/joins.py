"""Join shapes the graph phases need: tiers, unique-or-null lookups, longest prefixes, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_or_null(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where a key has exactly one distinct value; ambiguous keys are absent."""
    own = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return own.where("_low = _high").select(key, F.col("_low").alias(value))


def tiered(left: DataFrame, tiers: list[tuple[Column, DataFrame, str]]) -> DataFrame:
    """Left joins in order of tiers (key of the left, lookup (key, value), lookup's key); adds value and tier of the first
    that answers.  Lookups are unique by key, so rows are neither lost nor repeated."""
    out, values = left, []
    for i, (key, lookup, name) in enumerate(tiers):
        other = lookup.select(F.col(name).alias(f"_k{i}"), F.col("value").alias(f"_v{i}"))
        out = out.join(other, key == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        values.append(f"_v{i}")
    tier = F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(i)) for i, v in enumerate(values)])
    return out.withColumn("value", F.coalesce(*values)).withColumn("tier", tier).drop(*values)


def longest_prefix(paths: DataFrame, path: str, roots: DataFrame, root: str, value: str) -> DataFrame:
    """Each path with the value of its most specific root (whole segments; ties: the largest value); null if none.

    A path is exploded into its own ancestors, which are then matched by equality: the work is the depth of a path,
    whatever the number of roots, and no row meets every root.
    """
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    owned = roots.groupBy(F.col(root).alias("_root")).agg(F.max(value).alias(value))
    found = paths.select(path, F.explode(F.array_distinct(ancestors)).alias("_root")).distinct().join(owned, "_root")
    best = found.groupBy(path).agg(F.max_by(value, F.length("_root")).alias(value))
    return paths.join(best, path, "left")


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, label: str, point_id: str) -> DataFrame:
    """(point_id, labels): labels of all spans of the same key around a point, outermost first (start, -end, label)."""
    near = points.alias("p").join(spans.alias("s"), (F.col(f"p.{key}") == F.col(f"s.{key}")) & F.col(f"p.{at}").between(F.col(f"s.{start}"), F.col(f"s.{end}")))
    own = near.groupBy(F.col(f"p.{point_id}").alias(point_id)).agg(F.array_sort(F.collect_list(F.struct(F.col(f"s.{start}").alias("a"), (-F.col(f"s.{end}")).alias("b"), F.col(f"s.{label}").alias("label")))).alias("_x"))
    return own.select(point_id, F.transform("_x", lambda x: x["label"]).alias("labels"))


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key with their place; limited per task before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
