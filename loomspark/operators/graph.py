"""Iterative graph operators: every round is one join of the frontier with the edges, then an anti join with what is
known; rounds are written, so a lost executor costs one round.  Only emptiness tests reach the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import drop, stage


#: Rounds of improved pairs that lie side by side before they are written as one table.
COMPACT = 6
#: Hops of a round of best products.
HOPS = 4


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """(source, node, kind) one hop from ``nodes`` (id): ``out``, ``in`` or ``both``."""
    out = edges.select(F.col("from_id").alias("source"), F.col("to_id").alias("node"), "kind")
    into = edges.select(F.col("to_id").alias("source"), F.col("from_id").alias("node"), "kind")
    both = {"out": out, "in": into, "both": out.union(into)}[direction]
    return both.join(nodes.select(F.col("id").alias("source")).distinct(), "source", "left_semi")


def reach(edges: DataFrame, sources: DataFrame, max_depth: int, direction: str = "out") -> DataFrame:
    """(source, node, depth): breadth-first levels from every source (id) at once; depth 0 is the source itself."""
    step = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next"))
    if direction == "in":
        step = edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("next"))
    elif direction == "both":
        step = step.union(edges.select("to_id", "from_id"))
    step = stage(step.distinct())
    known = stage(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier = known
    for depth in range(1, max_depth + 1):
        found = frontier.join(step, "node").select("source", F.col("next").alias("node")).distinct()
        frontier = stage(found.join(known, ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def closure(edges: DataFrame) -> DataFrame:
    """(source, node, depth) of the transitive closure over all starting nodes, without depth 0.

    Depths double: a pair at depth d above ``half`` is one at depth ``half`` exactly and one of at most ``half``.
    """
    pairs = edges.select(F.col("from_id").alias("source"), F.col("to_id").alias("node")).where("source <> node").distinct()
    known, half = stage(pairs.withColumn("depth", F.lit(1))), 1
    while True:
        on = known.select(F.col("source").alias("node"), F.col("node").alias("next"), F.col("depth").alias("more"))
        found = known.where(F.col("depth") == half).select("source", "node").join(on, "node").where("source <> next")
        found = found.groupBy("source", F.col("next").alias("node")).agg((F.min("more") + half).alias("depth"))
        new = stage(found.join(known, ["source", "node"], "left_anti"))
        if new.isEmpty():
            return known
        known, half = known.unionByName(new), 2 * half


def best_products(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, confidence): the largest product of confidences over reverse paths (callers) from each source.

    Semi-naive: only pairs that improved in a round are joined in the next; confidences are at most 1, so it ends.
    Greater ones are refused, for a cycle of them has no largest product.
    """
    if not edges.where("confidence > 1").isEmpty():
        raise ValueError("confidences above 1 have no largest product on a cycle")
    step = stage(edges.groupBy(F.col("to_id").alias("node"), F.col("from_id").alias("next")).agg(F.max("confidence").alias("c")))
    start = stage(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("confidence")).distinct())
    parts, frontier = [start], start
    while True:
        # several hops without a barrier; only pairs that the last of them improves go on, the others went on already
        layer, layers = frontier, []
        for hop in range(HOPS):
            layer = layer.join(step, "node").groupBy("source", F.col("next").alias("node")).agg(F.max(F.col("confidence") * F.col("c")).alias("confidence"))
            layers.append(layer.withColumn("tail", F.when(F.lit(hop == HOPS - 1), F.col("confidence"))))
        found = reduce(DataFrame.unionByName, layers).groupBy("source", "node").agg(F.max("confidence").alias("new"), F.max("tail").alias("tail"))
        known = reduce(DataFrame.unionByName, parts).groupBy("source", "node").agg(F.max("confidence").alias("confidence"))
        better = found.join(known, ["source", "node"], "left").where("confidence IS NULL OR new > confidence + 1e-12")
        improved = stage(better.select("source", "node", F.col("new").alias("confidence"), F.coalesce(F.col("tail") > F.coalesce("confidence", F.lit(0.0)) + 1e-12, F.lit(False)).alias("open")))
        if improved.isEmpty():
            return known
        frontier = improved.where("open").drop("open")
        parts.append(improved.drop("open"))
        if len(parts) > COMPACT:
            whole = stage(reduce(DataFrame.unionByName, parts).groupBy("source", "node").agg(F.max("confidence").alias("confidence")))
            parts = [whole]  # the older parts are removed with the application's folder: the frontier reads the last


def propagate(edges: DataFrame, kinds: list[str], skip: tuple[str, ...] = ("CallsHttp",)) -> DataFrame:
    """Edges that callers inherit: (kind, from_id, to_id, confidence, sources) for every edge of ``kinds`` copied to
    all callers of its start, with the best path confidence; an edge that exists already is not repeated."""
    seeds = edges.where(F.col("kind").isin(*[k for k in kinds if k not in skip]))
    paths = best_products(edges.where("kind = 'Calls'"), seeds.select(F.col("from_id").alias("id"))).where("source <> node")
    found = seeds.select("kind", F.col("from_id").alias("source"), "to_id", F.col("confidence").alias("seed")).join(paths, "source")
    copied = found.groupBy("kind", F.col("node").alias("from_id"), "to_id").agg(F.max(F.col("seed") * F.col("confidence")).alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"))
    return copied.join(edges.select("kind", "from_id", "to_id"), ["kind", "from_id", "to_id"], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each connected component, by minimum labels and pointer jumping."""
    both = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"))
    both = stage(both.union(both.select("other", "node")).distinct())
    labels = stage(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stage(lower.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        done = new.where("was <> label").isEmpty()
        drop(labels)
        labels = new.select("node", "label")
        labels._stage = new._stage
        if done:
            return labels


def semantic_value(edges: DataFrame, centres: DataFrame, semantic: DataFrame) -> DataFrame:
    """(source, value) for every centre (id): ``semantic`` nodes (id) at the end of an edge from the centre, from its
    neighbours either way, or from those one step further out.  Without the reference's budget of 400 nodes."""
    step = stage(edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next")).distinct())
    own = centres.select(F.col("id").alias("source")).distinct()
    out = step.select(F.col("node").alias("source"), F.col("next").alias("node")).join(own, "source", "left_semi")
    into = step.select(F.col("next").alias("source"), "node").join(own, "source", "left_semi")
    second = stage(out.union(into).distinct().join(step, "node").select("source", F.col("next").alias("node")).distinct())
    third = second.join(step, "node").select("source", F.col("next").alias("node"))
    found = out.union(second).union(third).join(semantic.select(F.col("id").alias("node")).distinct(), "node", "left_semi").distinct()
    return own.join(found.groupBy("source").agg(F.count("*").alias("value")), "source", "left").select("source", F.coalesce("value", F.lit(0)).alias("value"))


def longest_depth(edges: DataFrame) -> DataFrame:
    """(node, depth): edges on the longest path that ends at a node.

    Nodes without an open incoming edge are taken round by round; a node's round is its depth.  Raises where nodes are
    left that all have one: on a cycle, or behind it, no path is the longest.
    """
    step = stage(edges.select("from_id", "to_id").distinct())
    into = step.groupBy(F.col("to_id").alias("node")).agg(F.count("*").alias("open"))
    nodes = step.select(F.col("from_id").alias("node")).union(step.select("to_id")).distinct()
    left = stage(nodes.join(into, "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open")))
    known, depth = left.where("false").select("node", F.lit(0).alias("depth")), 0
    while True:
        taken = left.where("open = 0").select("node", F.lit(depth).alias("depth"))
        if taken.isEmpty():
            break
        known = stage(known.unionByName(taken))
        less = taken.join(step, taken.node == step.from_id).groupBy(F.col("to_id").alias("node")).agg(F.count("*").alias("less"))
        rest = left.where("open > 0").join(less, "node", "left")
        left, depth = stage(rest.select("node", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"))), depth + 1
    if not left.isEmpty():
        raise ValueError(f"no longest path: {left.count()} nodes lie on a cycle or behind one, such as {left.first().node}")
    return known


def simple_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 8, per_pair: int = 4, blocked: DataFrame | None = None) -> DataFrame:
    """(a, b, path): up to ``per_pair`` shortest simple paths from a to b, by array order among equal lengths.

    ``blocked`` nodes (id) may end a path but not lie inside it.
    """
    step = stage(edges.select("from_id", "to_id").distinct())
    frontier = pairs.select("a", "b", F.array("a").alias("path"))
    done = None
    for _ in range(max_hops):
        last = F.element_at("path", -1)
        longer = frontier.join(step, last == step.from_id).where(~F.array_contains("path", F.col("to_id"))).select("a", "b", F.concat("path", F.array("to_id")).alias("path"))
        longer = stage(longer)
        ended = longer.where(F.element_at("path", -1) == F.col("b"))
        done = ended if done is None else done.unionByName(ended)
        frontier = longer.where(F.element_at("path", -1) != F.col("b"))
        if blocked is not None:
            frontier = frontier.join(blocked.select(F.col("id").alias("_b")), F.element_at("path", -1) == F.col("_b"), "left_anti")
        if frontier.isEmpty():
            break
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.size("path"), "path"))
    return done.withColumn("place", place).where(F.col("place") <= per_pair).drop("place")


def fixpoint(start: DataFrame, grow, max_rounds: int = 16) -> DataFrame:
    """Rows of ``start`` and all that ``grow`` derives from what is known, until nothing new appears.

    Raises where ``max_rounds`` rounds leave something new."""
    known = stage(start.distinct())
    for _ in range(max_rounds):
        new = stage(grow(known).distinct().join(known, known.columns, "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise ValueError(f"no fixpoint within {max_rounds} rounds")


def follow(edges: DataFrame, nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Follow a chain of edge kinds, the first edge (smallest end) at each hop; (id, end)."""
    at = nodes.select("id", F.col("id").alias("end"))
    for kind in kinds:
        first = edges.where(F.col("kind") == kind).groupBy("from_id").agg(F.min("to_id").alias("next"))
        at = at.join(first, at.end == first.from_id).select("id", F.col("next").alias("end"))
    return at


def lift(edges: DataFrame, parents: DataFrame, visible: Column) -> DataFrame:
    """Fold edges to the nearest visible ancestors: ends that are hidden are replaced by their parent until visible;
    (from_id, to_id, n) grouped, without loops.  ``parents`` has (node, parent, and the columns of ``visible``).

    Pointer jumping: a hidden node's pointer doubles its reach each round, so the rounds grow with the logarithm of the
    depth.  Nodes without a visible ancestor (hidden roots, cycles of hidden nodes) have no place; their edges go.
    """
    top = tops(parents, visible)
    lifted = edges.join(top.select(F.col("node").alias("from_id"), F.col("top").alias("f")), "from_id").join(top.select(F.col("node").alias("to_id"), F.col("top").alias("t")), "to_id")
    return lifted.where("f <> t").groupBy(F.col("f").alias("from_id"), F.col("t").alias("to_id")).agg(F.count("*").alias("n"))


def tops(parents: DataFrame, visible: Column) -> DataFrame:
    """(node, top): the node itself where visible, else its nearest visible ancestor; nodes without one are absent."""
    chain = parents.select("node", "parent", visible.alias("shown"))
    at = stage(chain.select("node", F.when(F.col("shown"), F.col("node")).alias("top"), F.when(~F.col("shown"), F.col("parent")).alias("up")))
    total = at.where("up IS NOT NULL").count()
    reach = 1
    while reach <= total and not at.where("top IS NULL AND up IS NOT NULL").isEmpty():
        above = at.select(F.col("node").alias("up"), F.col("top").alias("up_top"), F.col("up").alias("further"))
        new = stage(at.join(above, "up", "left").select("node", F.coalesce("top", "up_top").alias("top"), F.when(F.coalesce("top", "up_top").isNull(), F.col("further")).alias("up")))
        drop(at)
        at, reach = new, 2 * reach
    return at.where("top IS NOT NULL").select("node", "top")
