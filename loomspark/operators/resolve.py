"""Name resolution over code facts: tiers of equality joins that reject what is ambiguous.

All lookups are unique by key before they are joined, so no join repeats a call site, and a hub class costs a row a
call.  Confidences are those of the tier that answers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming
from .joins import keep_first, tiered, unique_or_null
from .staging import stage

#: Receivers that stand for the class itself, and for its base.
OWN, BASE = ("this", "self", "static", "$this"), ("parent", "super")


def by_fqn(nodes: DataFrame) -> DataFrame:
    """(fqn, id): the first node (smallest id) of every full name."""
    return nodes.where("fqn is not null").groupBy("fqn").agg(F.min("id").alias("id"))


def short_names(classes: DataFrame) -> DataFrame:
    """(short, fqn) in lower case where a short name belongs to one class only."""
    return unique_or_null(classes.select(F.lower("short").alias("short"), "fqn"), "short", "fqn")


def call_owners(calls: DataFrame, local: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Calls (id, file, owner_fqn, owner_class) with their owner node: the file's own declaration of that name, else any
    node of that full name, else the class's node, else the file's; ``tier`` 0 to 3 says which."""
    own = local.groupBy("file", "fqn").agg(F.min("id").alias("value")).select(F.concat_ws("\x00", "file", "fqn").alias("k"), "value")
    named = by_fqn(nodes).select(F.col("fqn").alias("k"), F.col("id").alias("value"))
    file_nodes = files.groupBy("file").agg(F.min("id").alias("value")).select(F.col("file").cast("string").alias("k"), "value")
    found = tiered(calls, [(F.concat_ws("\x00", "file", "owner_fqn"), own, "k"), (F.col("owner_fqn"), named, "k"), (F.col("owner_class"), named, "k"), (F.col("file").cast("string"), file_nodes, "k")])
    return found.withColumnRenamed("value", "node")


def imported(names: DataFrame, imports: DataFrame, classes: DataFrame) -> DataFrame:
    """names (file, name) with fqn: by the file's imports, else by a short name that is unique; else null."""
    alias = imports.groupBy("file", F.lower("alias").alias("alias")).agg(F.min("fqn").alias("value"))
    alias = alias.select(F.concat_ws("\x00", "file", "alias").alias("k"), "value")
    short = short_names(classes).select(F.col("short").alias("k"), F.col("fqn").alias("value"))
    low = F.lower(naming.short_name("name"))
    return tiered(names, [(F.concat_ws("\x00", "file", F.lower("name")), alias, "k"), (low, short, "k")]).withColumnRenamed("value", "fqn")


def alias_lookup(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked (namespace, key, qualifier) with node: the exact alias, else the only node of (namespace, key)."""
    join = lambda *c: F.concat_ws("\x00", *c)
    exact = aliases.groupBy(join("namespace", "key", "qualifier").alias("k")).agg(F.max("node_id").alias("value"))
    loose = unique_or_null(aliases.select(join("namespace", "key").alias("k"), F.col("node_id").alias("value")), "k", "value")
    return tiered(asked, [(join("namespace", "key", "qualifier"), exact, "k"), (join("namespace", "key"), loose, "k")]).withColumnRenamed("value", "node")


def table_candidates(name: Column, prefixes: list[str]) -> Column:
    """Spellings under which a table is looked up, best first: as written, without prefix, in snake case, its plural."""
    bare = naming.strip_prefixes(name, prefixes)
    return F.array(name, bare, naming.to_snake(bare), naming.pluralize(naming.to_snake(bare)))


def find_tables(asked: DataFrame, tables: DataFrame, prefixes: list[str]) -> DataFrame:
    """asked (key, name) to tables (id, name): the first candidate that is a table, exactly before without case."""
    spelled = asked.select("key", F.posexplode(table_candidates(F.col("name"), prefixes)).alias("place", "spelling"))
    exact = tables.groupBy("name").agg(F.min("id").alias("id"))
    loose = tables.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("id"))
    found = spelled.join(exact, spelled.spelling == exact.name).select("key", F.col("place").alias("rank"), "id")
    found = found.union(spelled.join(loose, F.lower("spelling") == F.col("low")).select("key", F.col("place") + 10, "id"))
    return found.groupBy("key").agg(F.min(F.struct("rank", "id")).alias("best")).select("key", "best.id", "best.rank")


def ancestors(classes: DataFrame, deepest: int = 20) -> DataFrame:
    """(child, base, depth): every class with itself (0) and its bases up to ``deepest`` (the operator's own limit).

    A class has one base, so each round is one join and adds at most one row a class; cycles end there."""
    step = stage(classes.where("base is not null").groupBy("fqn").agg(F.min("base").alias("up")))
    at = stage(classes.select(F.col("fqn").alias("child"), F.col("fqn").alias("base"), F.lit(0).alias("depth")).distinct())
    known = at
    for depth in range(1, deepest + 1):
        at = stage(at.join(step, at.base == step.fqn).where("up <> child").select("child", F.col("up").alias("base"), F.lit(depth).alias("depth")))
        if at.isEmpty():
            break
        known = known.unionByName(at)
    return known


def has_supertype(classes: DataFrame, base: str, deepest: int = 200) -> DataFrame:
    """(fqn) of the classes below ``base`` (whole name or short name), at any depth up to ``deepest``."""
    want = base.lower()
    step = classes.where("base is not null").select("fqn", F.col("base").alias("up"))
    first = (F.lower("up") == want) | (F.lower(naming.short_name("up")) == want)
    at = stage(step.where(first).select("fqn").distinct())
    known = at
    if at.isEmpty():
        return known
    step = stage(step.distinct())
    for _ in range(deepest):
        new = step.join(at.select(F.col("fqn").alias("up")), "up", "left_semi").select("fqn").distinct()
        at = stage(new.join(known, "fqn", "left_anti"))
        if at.isEmpty():
            break
        known = known.unionByName(at)
    return known


def receiver_types(calls: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (id, file, owner_fqn, receiver) with the receiver's class ``fqn`` and ``how``: the owner itself, its base,
    a full name, an import of the file, a unique short name; null where none answers."""
    base = classes.groupBy(F.col("fqn").alias("owner_fqn")).agg(F.min("base").alias("base"))
    full = classes.select(F.col("fqn").alias("receiver")).distinct().withColumn("is_class", F.lit(True))
    own = calls.join(base, "owner_fqn", "left").join(full, "receiver", "left")
    low = F.lower("receiver")
    found = imported(own.withColumn("name", F.col("receiver")), imports, classes).withColumnRenamed("fqn", "looked_up")
    how = F.when(low.isin(*OWN), "own").when(low.isin(*BASE), F.when(F.col("base").isNotNull(), "base")).when(F.col("is_class"), "full").when(F.col("tier") == 0, "import").when(F.col("tier") == 1, "short")
    fqn = F.when(low.isin(*OWN), F.col("owner_fqn")).when(low.isin(*BASE), F.col("base")).when(F.col("is_class"), F.col("receiver")).otherwise(F.col("looked_up"))
    return found.select(*calls.columns, fqn.alias("fqn"), how.alias("how"))


def resolved_calls(calls: DataFrame, classes: DataFrame, imports: DataFrame, methods: DataFrame) -> DataFrame:
    """``Calls`` edges (from_id, to_id, confidence): calls (id, owner, file, owner_fqn, receiver, method) to the nearest
    definition of the method in the receiver's class or its bases; 1.0 where the class is known by name, 0.7 where by
    the receiver's import or short name; one edge for each pair, the surest."""
    typed = receiver_types(calls, classes, imports).where("fqn is not null")
    defined = methods.groupBy("class", F.lower("method").alias("m")).agg(F.min("id").alias("to_id"))
    chain = ancestors(classes).select(F.col("child").alias("fqn"), F.col("base").alias("class"), "depth")
    met = typed.select("id", "owner", "how", "fqn", F.lower("method").alias("m")).join(chain, "fqn").join(defined, ["class", "m"])
    best = met.groupBy("id", "owner", "how").agg(F.min(F.struct("depth", "to_id")).alias("best"))
    sure = F.when(F.col("how").isin("own", "base", "full"), 1.0).otherwise(0.7)
    found = best.select(F.col("owner").alias("from_id"), F.col("best.to_id").alias("to_id"), sure.alias("confidence")).where("from_id <> to_id")
    return found.groupBy("from_id", "to_id").agg(F.max("confidence").alias("confidence"))


def nearest(asked: DataFrame, first: DataFrame, methods: DataFrame, columns: list[str], deepest: int = 20) -> DataFrame:
    """asked (columns, called, here) with ``target``: the method (here, called, target) of the class ``here`` or else of
    its nearest base (first: here, up) up to ``deepest``; calls that none answers are absent.  Each round only the calls
    without an answer climb."""
    at, found = asked.withColumn("began", F.col("here")), []
    for depth in range(deepest + 1):
        met = stage(at.join(methods, ["here", "called"], "left"))
        found.append(met.where("target is not null").select(*columns, "target"))
        if depth == deepest or met.where("target is null").isEmpty():
            break
        at = met.where("target is null").drop("target").join(first, "here").where("up <> began").select(*columns, F.col("up").alias("here"), "began")
    return reduce(DataFrame.unionByName, found)


def controllers(asked: DataFrame, classes: DataFrame, layer: str = "controller") -> DataFrame:
    """asked (key, module, name) to the class ``<namespace>\\module\\layer\\...\\Name``; ambiguous names are absent.

    Short names are joined by equality; module, layer and tail are then tested on the split name."""
    own = classes.withColumn("parts", F.split(F.lower("fqn"), r"\\")).withColumn("low", F.lower(naming.short_name("fqn")))
    met = asked.withColumn("low", F.lower(naming.short_name(F.replace("name", F.lit("/"), F.lit("\\"))))).join(own.select("low", "parts", "fqn"), "low")
    tail = F.split(F.lower(F.replace("name", F.lit("/"), F.lit("\\"))), r"\\")
    fits = F.array_contains("parts", F.lower("module")) & F.array_contains("parts", F.lit(layer)) & (F.slice("parts", F.size("parts") - F.size(tail) + 1, F.size(tail)) == tail)
    return unique_or_null(met.where(fits).select("key", "fqn"), "key", "fqn")


def same_line_args(calls: DataFrame, chained: list[str]) -> DataFrame:
    """(id, method, arg0) for calls (id, file, line, method, arg0): the calls named ``chained`` on a call's own line."""
    own = calls.select("id", "file", "line", F.col("method").alias("own"))
    other = calls.where(F.col("method").isin(*chained)).select("file", "line", F.col("id").alias("other"), "method", "arg0")
    return own.where(~F.col("own").isin(*chained)).join(other, ["file", "line"]).select("id", "method", "arg0").distinct()


def route_prefixes(points: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, prefix): labels of all groups (file, a, b, label) around a point (id, file, line), outermost first, joined
    with slashes; points outside all groups have an empty prefix."""
    near = points.join(groups, "file").where(F.col("line").between(F.col("a"), F.col("b")))
    joined = near.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("a", (-F.col("b")).alias("z"), "label"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["label"]), "/")
    return points.select("id").distinct().join(joined.select("id", text.alias("prefix")), "id", "left").select("id", F.coalesce("prefix", F.lit("")).alias("prefix"))


def guards_of(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """(id, class, label): guards (file, a, b, class, label) of all scopes around a point; of one class the innermost
    argument counts."""
    near = points.join(scopes, "file").where(F.col("line").between(F.col("a"), F.col("b")))
    return near.groupBy("id", "class").agg(F.max_by("label", F.struct("a", -F.col("b"), "label")).alias("label"))


def declared_middleware(contracts: DataFrame, declared: DataFrame, existing: DataFrame) -> DataFrame:
    """PassesThrough edges of declared middleware (id, prefix; an empty prefix is for all) to contracts (id, path) whose
    path holds the prefix as whole leading segments, but for pairs that have an edge (from_id, to_id).

    A path is exploded into its leading parts, so prefixes meet by equality, not each with each."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    own = contracts.select(F.col("id").alias("from_id"), F.explode(F.array_distinct(heads)).alias("prefix"))
    asked = declared.select(F.col("id").alias("to_id"), F.when(F.col("prefix") == "", "/").otherwise(F.col("prefix")).alias("prefix"))
    found = own.join(asked, "prefix").select(F.lit("PassesThrough").alias("kind"), "from_id", "to_id").distinct()
    return found.join(existing.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").select("kind", "from_id", "to_id")


def rows_of_subs(rows: DataFrame, subs: list[int] | None) -> DataFrame:
    """Rows of the chosen sub-projects and those that belong to none; all where nothing is chosen."""
    return rows if subs is None else rows.where(F.col("sub").isNull() | F.col("sub").isin(*subs))


def columns_of(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, column_id): HasColumn of a table itself, else of the classes that map to it."""
    has = edges.where("kind = 'HasColumn'").select("from_id", F.col("to_id").alias("column_id"))
    direct = tables.select(F.col("id").alias("table_id")).join(has, F.col("table_id") == has.from_id).select("table_id", "column_id")
    maps = edges.where("kind = 'MapsTo'").select(F.col("from_id").alias("owner"), F.col("to_id").alias("table_id"))
    through = maps.join(tables.select(F.col("id").alias("table_id")), "table_id", "left_semi").join(has, maps.owner == has.from_id).select("table_id", "column_id")
    return direct.union(through.join(direct, "table_id", "left_anti")).distinct()


def locations(nodes: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(id, path, line): a node's own file and line, else the first of its recorded places (``place``: path:line); paths
    are put below ``root`` unless they are absolute."""
    own = nodes.join(files.select(F.col("file").alias("file_id"), "path"), "file_id", "left")
    path = F.coalesce("path", F.regexp_extract("place", r"^(.*):\d+$", 1))
    line = F.coalesce("line", F.try_to_number(F.nullif(F.regexp_extract("place", r":(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("long"))
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    return own.select("id", F.when(path != "", full).alias("path"), line.alias("line"))


def unclaimed(nodes: DataFrame, edges: DataFrame, pending: DataFrame, kind: str) -> DataFrame:
    """Nodes (id, fqn) that neither an edge of ``kind`` reaches nor a pending link (kind, target name) claims."""
    free = nodes.join(edges.where(F.col("kind") == kind).select(F.col("to_id").alias("id")), "id", "left_anti")
    return free.join(pending.where(F.col("kind") == kind).select(F.col("target").alias("fqn")), "fqn", "left_anti")


def container_funnel(bindings: DataFrame, lookups: list[tuple[str, DataFrame, float]], asked: DataFrame) -> DataFrame:
    """asked (key) resolved by the first layer that answers: ``lookups`` are (layer, (key, value), confidence) in order;
    a value that is itself bound (bindings: key, value) is replaced by what it is bound to.  (key, value, layer,
    confidence); keys that no layer knows are absent."""
    found = None
    for i, (layer, table, confidence) in enumerate(lookups):
        own = table.groupBy("key").agg(F.min("value").alias("value")).select("key", "value", F.lit(i).alias("rank"), F.lit(layer).alias("layer"), F.lit(confidence).alias("confidence"))
        found = own if found is None else found.unionByName(own)
    best = found.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.struct("rank", "value", "layer", "confidence")).alias("b")).select("key", "b.value", "b.layer", "b.confidence")
    bound = bindings.groupBy(F.col("key").alias("value")).agg(F.min("value").alias("to"))
    return best.join(bound, "value", "left").select("key", F.coalesce("to", "value").alias("value"), "layer", "confidence")


def applied(resolved: DataFrame, nodes: DataFrame, kind: str = "ResolvesTo") -> tuple[DataFrame, DataFrame]:
    """Edges (kind, from_id, to_id, confidence) of resolved links (from_id, value, confidence) to nodes (id, fqn), and
    diagnostics (from_id, code, message) for values that no node has."""
    met = resolved.join(by_fqn(nodes).select(F.col("fqn").alias("value"), F.col("id").alias("to_id")), "value", "left")
    edges = met.where("to_id is not null").groupBy("from_id", "to_id").agg(F.max("confidence").alias("confidence")).select(F.lit(kind).alias("kind"), "from_id", "to_id", "confidence")
    missed = met.where("to_id is null").select("from_id", F.lit("resolve.missing").alias("code"), F.concat(F.lit("no node "), "value").alias("message")).distinct()
    return edges, missed


def db_verbs(calls: DataFrame, verbs: DataFrame, tables: DataFrame) -> DataFrame:
    """(kind, from_id, to_id) for calls (owner, method, table): ``ReadsDb`` or ``WritesDb`` by verbs (method, kind)."""
    named = verbs.groupBy(F.lower("method").alias("m")).agg(F.max("kind").alias("kind"))
    met = calls.select("owner", F.lower("method").alias("m"), F.lower("table").alias("t")).join(F.broadcast(named), "m")
    own = tables.groupBy(F.lower("name").alias("t")).agg(F.min("id").alias("to_id"))
    return met.join(own, "t").select("kind", F.col("owner").alias("from_id"), "to_id").distinct()


def best_access(edges: DataFrame) -> DataFrame:
    """One access edge for each (layer, node): direct before inherited, then by rank, strength and the smaller id."""
    return keep_first(edges, ["layer", "node"], [F.desc("direct"), "rank", F.desc("strength"), "edge_id"])


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; ties by all other columns."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *rest))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")

