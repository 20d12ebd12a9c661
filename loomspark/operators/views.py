"""Views of the graph: candidates, layered discovery, folding with caps, evidence and locations.

Discovery is breadth-first from all centres at once; a layer is one join.  Caps are windows with stated orders, applied
after the whole result is known, and what they hide is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import semantic_value, tops
from .joins import keep_first, top_k
from .kinds import SEMANTIC_NODES, SEVERITY_RANK
from .staging import stage


def candidates(nodes: DataFrame, edges: DataFrame, kind: str, side: str | None = None, term: str | None = None, limit: int = 50) -> DataFrame:
    """(id, name, value): centres of a kind by the number of semantic nodes near them, then by name and id."""
    own = nodes.where(F.col("kind") == kind)
    if side is not None:
        own = own.where(F.coalesce(F.col("side") == side, F.lit(True)))
    if term:
        own = own.where(F.contains(F.lower("name"), F.lit(term.lower())))
    scored = semantic_value(edges, own, nodes.where(F.col("kind").isin(*SEMANTIC_NODES)))
    return own.join(scored, own.id == scored.source).select("id", "name", "value").orderBy(F.desc("value"), "name", "id").limit(limit)


def perspectives(nodes: DataFrame, views: dict) -> DataFrame:
    """(perspective, center, n): every perspective with the number of its possible centres."""
    counts = nodes.groupBy("kind", "side").count()
    rows = nodes.sparkSession.createDataFrame([(p.id, p.center, p.side) for p in views.values()], "perspective string, center string, wanted string")
    met = rows.join(counts, (rows.center == counts.kind) & (rows.wanted.isNull() | counts.side.isNull() | (rows.wanted == counts.side)), "left")
    return met.groupBy("perspective", "center").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))


def discover(edges: DataFrame, nodes: DataFrame, centres: DataFrame, depth: int = 4, direction: str = "forward", closed: DataFrame | None = None) -> DataFrame:
    """(source, node, ring, parent, kind): layers around every centre (id); the parent is the smallest node, and the
    smallest kind, that leads to a node in its ring.

    Semantic nodes end a path; nodes of ``closed`` sub-projects (sub) are reached but not expanded; depth is clamped to
    1..6.  ``reverse`` follows edges against their direction."""
    depth = min(6, max(1, depth))
    step = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next"), F.col("kind").alias("via"))
    if direction == "reverse":
        step = edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("next"), F.col("kind").alias("via"))
    own = nodes.select(F.col("id").alias("node"), F.col("kind").isin(*SEMANTIC_NODES).alias("ends"), "sub").groupBy("node").agg(F.max("ends").alias("ends"), F.min("sub").alias("sub"))
    if closed is not None:
        own = own.join(closed.select("sub", F.lit(True).alias("library")).distinct(), "sub", "left").select("node", (F.col("ends") | F.coalesce("library", F.lit(False))).alias("ends"))
    open_ = own.where("not ends").select("node")
    step = stage(step.distinct())
    at = stage(centres.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("ring"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("kind")).distinct())
    known = at
    for ring in range(1, depth + 1):
        # a centre is expanded whatever its kind
        grown = at if ring == 1 else at.join(open_, "node", "left_semi")
        found = grown.select("source", "node").join(step, "node").groupBy("source", F.col("next").alias("node")).agg(F.min(F.struct("node", "via")).alias("by"))
        at = stage(found.join(known, ["source", "node"], "left_anti").select("source", "node", F.lit(ring).alias("ring"), F.col("by.node").alias("parent"), F.col("by.via").alias("kind")))
        if at.isEmpty():
            break
        known = known.unionByName(at)
    return known


def access_modes(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, node, mode): ``write`` where any edge between a ring and the next writes, else ``read``; other kinds of
    edges give no mode.  Modes of semantic nodes are those of all their edges from discovered nodes."""
    mode = F.when(F.col("kind").isin("WritesDb", "WritesCache", "Mutates", "PublishesTo", "Emits"), 1).when(F.col("kind").isin("ReadsDb", "ReadsCache", "ReadsConfig", "ListensTo"), 0)
    reads = edges.withColumn("m", mode).where("m is not null").select("from_id", "to_id", "m")
    start = found.select("source", F.col("node").alias("from_id"))
    met = start.join(reads, "from_id").join(found.select("source", F.col("node").alias("to_id")), ["source", "to_id"])
    return met.groupBy("source", F.col("to_id").alias("node")).agg(F.when(F.max("m") == 1, "write").otherwise("read").alias("mode"))


def folded(edges: DataFrame, parents: DataFrame, visible: Column, cap: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges lifted to the nearest visible ancestors: (from_id, kind, to_id, n, place) with at most ``cap`` targets for
    each (start, kind), the most frequent first; (from_id, kind, hidden): how many targets the cap hides; (node):
    orphans, hidden ends without a visible ancestor."""
    top = stage(tops(parents, visible))
    lifted = edges.join(top.select(F.col("node").alias("from_id"), F.col("top").alias("f")), "from_id").join(top.select(F.col("node").alias("to_id"), F.col("top").alias("t")), "to_id")
    grouped = stage(lifted.where("f <> t").groupBy(F.col("f").alias("from_id"), "kind", F.col("t").alias("to_id")).agg(F.count("*").alias("n")))
    kept = top_k(grouped, ["from_id", "kind"], [F.desc("n"), "to_id"], cap)
    hidden = grouped.groupBy("from_id", "kind").agg((F.count("*") - cap).alias("hidden")).where("hidden > 0")
    ends = edges.select(F.col("from_id").alias("node")).union(edges.select("to_id")).distinct()
    return kept, hidden, ends.join(top, "node", "left_anti")


def hidden_by_kind(found: DataFrame, shown: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, n): nodes (id) that were found but are not shown, by kind."""
    return found.join(shown, "id", "left_anti").join(nodes.select("id", "kind"), "id").groupBy("kind").agg(F.count("*").alias("n"))


def clusters(nodes: DataFrame, key: str, samples: int = 3) -> DataFrame:
    """(key, n, sample, place): nodes by a column, with the first ``samples`` ids of each group."""
    few = top_k(nodes.withColumn("key", F.col(key).cast("string")), ["key"], ["id"], samples).select("key", F.col("id").alias("sample"), "place")
    return few.join(nodes.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")), "key")


def edge_evidence(edges: DataFrame, derived: DataFrame, places: DataFrame) -> DataFrame:
    """(edge_id, hop, node, place): the chain behind derived edges (edge_id, path: array of nodes), with the first place
    (node, place) of each hop; hops without a place keep null."""
    first = places.groupBy("node").agg(F.min("place").alias("place"))
    hops = derived.select("edge_id", F.posexplode("path").alias("hop", "node"))
    return hops.join(first, "node", "left").select("edge_id", "hop", "node", "place")


def contacts(paths: DataFrame, touches: DataFrame) -> DataFrame:
    """(edge_id, touch, exact): for derived edges (edge_id, last, to_id) the evidence of contact (touch_id, owner, to_id):
    a touch of the path's last node itself before one of the same target, then the smallest id."""
    met = paths.join(touches, "to_id").withColumn("exact", F.col("owner") == F.col("last"))
    return keep_first(met, ["edge_id"], [F.desc("exact"), "touch_id"]).select("edge_id", F.col("touch_id").alias("touch"), "exact")


def node_locations(own: DataFrame, occurrences: DataFrame, symbols: DataFrame, most: int = 20) -> DataFrame:
    """(id, origin, place): a node's own places, those of calls that name it, those of symbol tables (id, place each), at
    most ``most`` of each origin, in order of place; a place that two origins name counts for the first."""
    rows = own.select("id", F.lit(0).alias("rank"), F.lit("syntax").alias("origin"), "place")
    rows = rows.unionByName(occurrences.select("id", F.lit(1).alias("rank"), F.lit("call").alias("origin"), "place"))
    rows = rows.unionByName(symbols.select("id", F.lit(2).alias("rank"), F.lit("symbol").alias("origin"), "place"))
    first = rows.groupBy("id", "place").agg(F.min(F.struct("rank", "origin")).alias("o")).select("id", "o.origin", "place")
    named = first.withColumnRenamed("place", "at")
    return top_k(named, ["id", "origin"], ["at"], most).select("id", "origin", F.col("at").alias("place"))


def inline_chains(derived: DataFrame, hops: DataFrame) -> DataFrame:
    """Synthetic edges (id -1, -2, ...) along derived edges (edge_id, path): (id, edge_id, hop, from_id, to_id, place), the
    place being that of the hop's own edge (from_id, to_id, place; the smallest), null where it has none."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("hop"), F.element_at("path", i).alias("from_id"), F.element_at("path", i + 1).alias("to_id")))
    own = derived.where(F.size("path") > 1).select("edge_id", F.explode(pairs).alias("p")).select("edge_id", "p.*")
    first = hops.groupBy("from_id", "to_id").agg(F.min("place").alias("place"))
    met = own.join(first, ["from_id", "to_id"], "left")
    # numbers follow edge and hop: a running sum of path lengths, so only one row an edge is ordered
    sizes = derived.where(F.size("path") > 1).groupBy("edge_id").agg((F.max(F.size("path")) - 1).alias("n"))
    before = _running(sizes)
    return met.join(before, "edge_id").select((-(F.col("before") + F.col("hop"))).alias("id"), "edge_id", "hop", "from_id", "to_id", "place")


def _running(sizes: DataFrame) -> DataFrame:
    """(edge_id, before): the sum of ``n`` over all smaller edge ids, by blocks: a window in each block of ids and one
    over the blocks' sums, so no task takes all rows."""
    from pyspark.sql import Window

    blocked = sizes.withColumn("b", F.floor(F.col("edge_id") / 4096))
    inner = F.sum("n").over(Window.partitionBy("b").orderBy("edge_id")) - F.col("n")
    sums = blocked.groupBy("b").agg(F.sum("n").alias("s"))
    start = F.sum("s").over(Window.orderBy("b")) - F.col("s")
    return blocked.withColumn("inner", inner).join(sums.select("b", start.alias("start")), "b").select("edge_id", (F.col("start") + F.col("inner")).alias("before"))


def unresolved(diagnostics: DataFrame, last: int = 500, most: int = 20) -> DataFrame:
    """The newest ``most`` unresolved diagnostics among the ``last`` newest ones."""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])[F.col("severity")]
    recent = diagnostics.orderBy(F.desc("id")).limit(last)
    return recent.where("code like 'resolve.%'").withColumn("rank", rank).orderBy(F.desc("id")).limit(most)
