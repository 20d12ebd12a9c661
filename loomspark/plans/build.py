"""From source text to a graph: facts of ``sources.scopes`` to nodes, edges and annotations.

Ids are hashes of (kind, full name) or (file, place), so an owner, a class, a table or a contract is found by computing
its id: only names that may mean several things (receivers, bases, handlers) are joined, over lookups that are unique
by key.  Two names that hash alike would be one node; below a thousand million nodes that is unlikely (about 5 %).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import phases, resolve
from ..operators.joins import tiered, unique_or_null
from ..operators.staging import stage
from ..sources import code, loaders, scopes
from .projection import SCHEMAS


@dataclass(frozen=True)
class Stack:
    """What the calls of a project's frameworks mean; patterns are ``Receiver::method`` (see ``callee_matches``)."""

    tables: tuple[str, ...] = ("Db::{name,table}", "DB::table", "*::from")
    reads: tuple[str, ...] = ("select", "find", "first", "get", "value", "column", "count", "sum", "all", "paginate", "exists")
    writes: tuple[str, ...] = ("insert", "insertgetid", "insertall", "update", "delete", "save", "create", "destroy", "inc", "dec", "setfield")
    models: tuple[str, ...] = ("Model",)
    prefixes: tuple[str, ...] = ()
    routes: tuple[str, ...] = ("Route", "router", "app")
    verbs: tuple[str, ...] = ("get", "post", "put", "patch", "delete")
    clients: tuple[str, ...] = ("axios", "http", "$http", "request")
    external: tuple[str, ...] = ("curl_exec", "file_get_contents", "fetch", "axios::*", "requests::*", "HttpClient::*", "RestTemplate::*")
    raw: tuple[str, ...] = ("Db::{query,execute}", "DB::{select,statement,raw}", "*::{whereRaw,orderRaw,fieldRaw}")
    transactions: tuple[str, ...] = ("starttrans", "begintransaction", "transaction")
    sources: str = r"\$_(GET|POST|REQUEST|COOKIE|SERVER)\b|\binput\s*\(|request\s*\(\s*\)|->(param|get|post|input)\s*\("
    # names of annotations and decorators that make a method a route, with their verb (``ANY`` reads it from the arguments)
    route_marks: tuple[tuple[str, str], ...] = (
        *[(f"{v}mapping", v.upper()) for v in ("get", "post", "put", "patch", "delete")], *[(f"http{v}", v.upper()) for v in ("get", "post", "put", "patch", "delete")],
        *[(v, v.upper()) for v in ("get", "post", "put", "patch", "delete")], ("requestmapping", "ANY"), ("route", "ANY"), ("all", "ANY"),
    )
    class_prefixes: tuple[str, ...] = ("requestmapping", "controller", "route")
    guard_marks: tuple[str, ...] = ("preauthorize", "secured", "rolesallowed", "authorize", "useguards", "isgranted", "login_required", "jwt_required", "permission_required")
    public_marks: tuple[str, ...] = ("allowanonymous", "permitall", "public")
    guard_calls: tuple[str, ...] = ("middleware",)
    authentication: str = r"(?i)auth|login|token|jwt|permission|grant|secured|role"
    # (pattern, node kind, edge kind) of calls whose first argument is a literal name
    named: tuple[tuple[str, str, str], ...] = (
        ("config", "ConfigKey", "ReadsConfig"), ("env", "ConfigKey", "ReadsConfig"), ("Config::get", "ConfigKey", "ReadsConfig"),
        ("Cache::{get,has,remember}", "Cache", "ReadsCache"), ("Cache::{set,put,forget,delete,rm}", "Cache", "WritesCache"),
        ("event", "Event", "Triggers"), ("Event::{trigger,dispatch}", "Event", "Triggers"), ("Queue::{push,later}", "Queue", "PublishesTo"),
        ("$emit", "EventBus", "Emits"), ("bus::emit", "EventBus", "Emits"), ("$on", "EventBus", "ListensTo"), ("bus::on", "EventBus", "ListensTo"),
    )


def node_id(kind: str, *key) -> Column:
    """A node's id: kinds that may stand for each other (all classes; methods and functions) share a first word."""
    return F.xxhash64(F.lit(kind), *key).bitwiseAND(F.lit((1 << 63) - 1))


def _key(*columns) -> Column:
    return F.concat_ws("\x00", *columns)


def _any(columns) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _calls_any(receiver: Column, method: Column, patterns) -> Column:
    """Whether a call is one of the patterns; a pattern without receiver asks for a call without one."""
    return _any(naming.callee_matches(receiver, method, p) & (F.lit(True) if "::" in p else receiver.isNull()) for p in patterns)


class Resolver:
    """Names of one project: its facts and the lookups over them."""

    def __init__(self, facts: DataFrame, stack: Stack):
        self.facts, self.stack = facts, stack
        of = lambda family: facts.where(F.col("family") == family)
        self.classes = of("class").groupBy("fqn").agg(F.min("detail").alias("kind"), F.min("name").alias("short"), F.min("path").alias("file"), F.min("language").alias("language"), F.min_by("line", F.struct("path", "line")).alias("line"))
        self.functions = of("function").groupBy("fqn").agg(F.min("cls").alias("class"), F.min("name").alias("name"), F.min("path").alias("file"), F.min("language").alias("language"), F.min_by("line", F.struct("path", "line")).alias("line"))
        known = self.classes.select("fqn").union(self.functions.select("fqn"))
        # imports of names that the project does not declare would only hide a unique short name
        self.imports = of("import").select(F.col("path").alias("file"), F.col("name").alias("alias"), "fqn").join(known, "fqn", "left_semi")

    def class_of(self, names: DataFrame, staged: bool = False) -> DataFrame:
        """names (file, space, name, ...) with ``fqn`` and ``tier``: 0 by an import, 1 in the own namespace, 2 by the
        full name, 3 by a unique short name; null where none answers.  ``staged``: what the first two answer is written,
        and only the rest meets the others."""
        alias = self.imports.groupBy(_key("file", F.lower("alias")).alias("k")).agg(F.min("fqn").alias("value"))
        full = self.classes.select(F.col("fqn").alias("k"), F.col("fqn").alias("value"))
        short = resolve.short_names(self.classes).select(F.col("short").alias("k"), F.col("fqn").alias("value"))
        bare = F.regexp_replace("name", r"^\\+", "")
        space = F.coalesce("space", F.lit(""))
        near = F.when(space != "", F.concat(space, bare)).otherwise(bare)
        tiers = [(_key("file", F.lower(bare)), alias, "k"), (near, full, "k"), (bare, full, "k"), (F.lower(naming.short_name(bare)), short, "k")]
        if not staged:
            return tiered(names, tiers).withColumnRenamed("value", "fqn")
        near = stage(tiered(names, tiers[:2]))
        rest = tiered(near.where("value is null").drop("value", "tier"), tiers[2:]).withColumn("tier", F.col("tier") + 2)
        return near.where("value is not null").unionByName(rest).withColumnRenamed("value", "fqn")

    def bases(self, staged: bool = False) -> DataFrame:
        """(file, cls, name, seq, fqn): bases and interfaces in the order written, with their class if it is known."""
        own = self.facts.where("family = 'inherits'").select(F.col("path").alias("file"), "cls", "name", "seq", F.regexp_extract("cls", r"^(.*[\\.])[^\\.]*$", 1).alias("space"))
        return self.class_of(own, staged).drop("space", "tier")

    def calls(self) -> DataFrame:
        """Call sites with their owner's id and their receiver: a variable or field is replaced by its type, which the
        parser has found in the same file."""
        c = self.facts.where("family = 'call'")
        made = (F.col("language") == "python") & F.col("receiver").isNull() & F.col("name").rlike("^[A-Z]")  # a class is called
        builder = F.when(F.col("language") == "php", "__construct").when(F.col("language") == "javascript", "constructor").when(F.col("language").isin("java", "csharp"), naming.short_name("receiver")).when(F.col("language") == "python", "__init__").otherwise("new")
        implicit = F.when(F.col("receiver").isNull() & F.col("cls").isNotNull() & F.col("language").isin("java", "csharp"), "this")
        owner = F.when(F.col("owner").isNotNull(), node_id("function", "owner")).when(F.col("cls").isNotNull(), node_id("class", "cls")).otherwise(node_id("file", "path"))
        return c.select(
            node_id("call", "path", "seq").alias("id"), owner.alias("owner"), F.col("owner").alias("owner_name"), F.col("cls").alias("owner_fqn"), F.col("path").alias("file"), "language", "line", "in_loop", "args", "chain", "chain_args",
            F.coalesce("typed", F.when(made, F.col("name")), "receiver", implicit).alias("receiver"),
            F.when((F.col("name") == "new") | made, builder).otherwise(F.col("name")).alias("method"), F.col("detail").alias("text"),
        )

    def typed(self, calls: DataFrame) -> DataFrame:
        """calls with ``target``, the receiver's class where it is a class of the project, and ``sure``: not by the short
        name alone.  Receivers that stand for the owner itself stay as they are."""
        names = calls.where("receiver is not null").select("file", "receiver", F.regexp_extract(F.coalesce("owner_fqn", F.lit("")), r"^(.*[\\.])[^\\.]*$", 1).alias("space")).distinct()
        found = self.class_of(names.withColumn("name", F.col("receiver"))).where(F.col("fqn").isNotNull() & ~F.lower("receiver").isin(*resolve.OWN, *resolve.BASE))
        found = found.select(F.col("file").alias("_f"), F.col("receiver").alias("_r"), F.col("space").alias("_s"), F.col("fqn").alias("target"), (F.col("tier") < 3).alias("sure"))
        space = F.regexp_extract(F.coalesce("owner_fqn", F.lit("")), r"^(.*[\\.])[^\\.]*$", 1)
        return calls.join(found, (F.col("file") == F.col("_f")) & (F.col("receiver") == F.col("_r")) & (space == F.col("_s")), "left").drop("_f", "_r", "_s")

    def called(self, calls: DataFrame, bases: DataFrame) -> DataFrame:
        """Calls edges (from_id, to_id, confidence): methods up the receiver's bases, and plain functions: of the same
        file, imported, or of a unique name (0.7)."""
        first = bases.where("fqn is not null").groupBy(F.col("cls").alias("fqn")).agg(F.min_by("fqn", F.struct("seq", "file")).alias("base"))
        classes = self.classes.select("fqn", "short").join(first, "fqn", "left")
        methods = self.functions.where("class is not null").select(node_id("function", "fqn").alias("id"), "class", F.col("name").alias("method"))
        asked = calls.where("receiver is not null").select("id", "owner", "file", "owner_fqn", F.when(F.col("sure"), F.col("target")).otherwise(F.col("receiver")).alias("receiver"), "method")
        through = resolve.resolved_calls(asked, classes, self.imports, methods)
        plain = self.functions.where("class is null")
        same = plain.groupBy(_key("file", "name").alias("k")).agg(F.min("fqn").alias("value"))
        alias = self.imports.join(plain.select("fqn"), "fqn", "left_semi").groupBy(_key("file", "alias").alias("k")).agg(F.min("fqn").alias("value"))
        only = unique_or_null(plain.select("name", "fqn"), "name", "fqn").select(F.col("name").alias("k"), F.col("fqn").alias("value"))
        met = tiered(calls.where("receiver is null"), [(_key("file", "method"), same, "k"), (_key("file", "method"), alias, "k"), (F.col("method"), only, "k")]).where("value is not null")
        direct = met.select(F.col("owner").alias("from_id"), node_id("function", "value").alias("to_id"), F.when(F.col("tier") < 2, 1.0).otherwise(0.7).alias("confidence")).where("from_id <> to_id")
        return through.unionByName(direct).groupBy("from_id", "to_id").agg(F.max("confidence").alias("confidence"))


#: What ``call_sites`` reads of the facts, which are those of calls.
SITE_FAMILIES, SITE_COLUMNS = ("call",), ("language", "family", "name", "cls", "receiver", "in_loop", "typed")


def call_sites(facts: DataFrame) -> DataFrame:
    """(name, in_loop) of the CallSite nodes that ``graph_of`` makes: no other fact and no join is needed for these."""
    return Resolver(facts, Stack()).calls().select(_site_name().alias("name"), "in_loop")


def _site_name() -> Column:
    return F.concat_ws("::", "receiver", "method")


def _written_table(stack: Stack) -> Column:
    """The table that a call's chain names, without its prefix; null where it names none."""
    named = F.filter(F.arrays_zip("chain", "chain_args"), lambda x: _any(naming.callee_matches(F.col("receiver"), x["chain"], p) for p in stack.tables))
    literal = F.filter(F.transform(named, lambda x: x["chain_args"]), lambda x: x.rlike(r"^[\w.]+$"))
    return naming.strip_prefixes(F.get(literal, F.lit(0)), list(stack.prefixes))


def table_calls(calls: DataFrame, models: DataFrame, stack: Stack) -> DataFrame:
    """(id, owner, table, writes): calls that end in a reading or writing verb of a table that their chain names, or of a
    model class (fqn, table)."""
    verb = F.lower("method")
    own = calls.where(verb.isin(*stack.reads, *stack.writes)).withColumn("written", _written_table(stack))
    met = own.join(models.select(F.col("fqn").alias("target"), F.col("table").alias("model_table")), "target", "left")
    return met.select("id", "owner", F.coalesce("written", "model_table").alias("table"), verb.isin(*stack.writes).alias("writes")).where("table is not null and table <> ''")


def _models(classes: DataFrame, bases: DataFrame, stack: Stack) -> DataFrame:
    """(fqn, table) of the classes below a model class."""
    up = bases.select(F.col("cls").alias("fqn"), F.coalesce("fqn", F.regexp_replace("name", r"^\\+", "")).alias("base"))
    below = reduce(lambda a, b: a.union(b), [resolve.has_supertype(up, m) for m in stack.models]).distinct()
    return classes.join(below, "fqn", "left_semi").select("fqn", naming.to_snake("short").alias("table"))


def named_edges(parse, stack: Stack = Stack()) -> DataFrame:
    """(kind, source, target): the edges Extends, Calls, ReadsDb and WritesDb between classes, methods and tables that
    ``graph_of`` makes of the same facts (no schema), by names.  ``parse`` (families, columns) gives the facts.

    Declarations are written, then of the calls those that may be such an edge: their method's name is declared, or they
    end in a verb of tables.  What a receiver itself tells is not looked up, and a call climbs to a base only as long as
    no method answers, so no call meets all ancestors of its class."""
    declared = stage(parse(("class", "function", "inherits", "import"), ("path", "language", "seq", "family", "name", "fqn", "cls", "detail", "line")))
    r = Resolver(declared, stack)
    r.classes, r.functions, r.imports = stage(r.classes), stage(r.functions), stage(r.imports)
    bases = stage(r.bases(staged=True))
    models = stage(_models(r.classes, bases, stack))
    methods = r.functions.where("class is not null").groupBy(F.col("class").alias("here"), F.lower("name").alias("called")).agg(F.min_by("fqn", node_id("function", "fqn")).alias("target"))
    verb = F.lower("method")
    calls = Resolver(parse(("call",), ("path", "language", "family", "name", "owner", "cls", "receiver", "chain", "chain_args", "typed")), stack).calls()
    calls = calls.where("receiver is not null and (owner_name is not null or owner_fqn is not null)").withColumn("called", verb)
    known = stage(declared.where("family = 'function' and cls is not null").select(F.lower("name").alias("called"), F.lit(True).alias("known")).distinct())
    access = verb.isin(*stack.reads, *stack.writes)
    calls = calls.join(known, "called", "left").where(F.col("known") | access)
    calls = stage(calls.select("file", "owner_name", "owner_fqn", "receiver", "called", "known", F.when(access, verb.isin(*stack.writes)).alias("writes"), F.when(access, _written_table(stack)).alias("table")))

    space = F.regexp_extract(F.coalesce("owner_fqn", F.lit("")), r"^(.*[\\.])[^\\.]*$", 1)
    low = F.lower("receiver")
    loose = calls.where((F.col("known") | F.col("table").isNull()) & ~low.isin(*resolve.OWN, *resolve.BASE)).withColumn("space", space)
    # a call of a table verb whose chain names no table needs its class only if there are models
    loose = loose if not models.isEmpty() else loose.where("known")
    met = r.class_of(loose.select("file", "space", "receiver", F.col("receiver").alias("name")).distinct(), staged=True).where("fqn is not null").select("file", "space", "receiver", F.col("fqn").alias("here"), F.col("tier"))
    typed = stage(loose.join(met, ["file", "space", "receiver"]))

    asked = ["owner_name", "owner_fqn", "called"]
    first = stage(bases.where("fqn is not null").groupBy(F.col("cls").alias("here")).agg(F.min_by("fqn", F.struct("seq", "file")).alias("up")))
    held = calls.where("known and owner_fqn is not null")
    # an import may name a function: what its class is then, is looked up as for any other name
    classes = r.classes.select("fqn", "short").join(first.select(F.col("here").alias("fqn"), F.col("up").alias("base")), "fqn", "left")
    imported = typed.where("known and tier = 0").select(*asked, "file", F.col("here").alias("receiver"))
    at = held.where(low.isin(*resolve.OWN)).select(*asked, F.col("owner_fqn").alias("here"))
    at = at.union(held.where(low.isin(*resolve.BASE)).join(first.withColumnRenamed("here", "owner_fqn"), "owner_fqn").select(*asked, F.col("up").alias("here")))
    at = at.union(typed.where("known and tier > 0").select(*asked, "here"))
    at = at.union(resolve.receiver_types(imported, classes, r.imports).where("fqn is not null").select(*asked, F.col("fqn").alias("here")))
    hits = resolve.nearest(at.distinct(), first, methods, asked)

    tables = calls.where("writes is not null").select("owner_name", "owner_fqn", "writes", "table").where("table is not null")
    modelled = typed.where("writes is not null and table is null").join(models.select(F.col("fqn").alias("here"), F.col("table").alias("t")), "here").select("owner_name", "owner_fqn", "writes", F.col("t").alias("table"))
    tables = stage(tables.union(modelled).where("table <> ''").distinct())
    spelled = stage(tables.select("table").union(models.select("table")).groupBy(F.lower("table").alias("low")).agg(F.min("table").alias("target")))
    tables = tables.withColumn("low", F.lower("table")).join(spelled, "low").select("owner_name", "owner_fqn", F.when(F.col("writes"), "WritesDb").otherwise("ReadsDb").alias("kind"), "target")
    found = tables.unionByName(hits.select("owner_name", "owner_fqn", F.lit("Calls").alias("kind"), "target").where("owner_name is null or owner_name <> target"))
    # owners are methods, or classes where a call stands in none; functions and interfaces are other kinds
    functions = stage(r.functions.where("class is null").select(F.col("fqn").alias("source")))
    others = stage(r.classes.where("kind <> 'Class'").select(F.col("fqn").alias("source")))
    inside = found.where("owner_name is not null").select("kind", F.col("owner_name").alias("source"), "target").join(functions, "source", "left_anti").distinct()
    beside = found.where("owner_name is null").select("kind", F.col("owner_fqn").alias("source"), "target").join(others, "source", "left_anti").distinct()
    extends = bases.where("fqn is not null and fqn <> cls").select(F.lit("Extends").alias("kind"), F.col("cls").alias("source"), F.col("fqn").alias("target")).distinct()
    extends = extends.join(others, "source", "left_anti").join(others.withColumnRenamed("source", "target"), "target", "left_anti")
    return reduce(DataFrame.unionByName, [inside, beside, extends]).select("kind", "source", "target")


def _path(written: Column) -> Column:
    """A route's path as part of a contract's name: parameters of any notation become ``:*``."""
    plain = F.regexp_replace(written, r"\$?\{[^}/]*\}|<[^>/]*>", ":*")
    return F.regexp_replace(naming.normalize(plain, ["strip_query", "param_wildcard", "leading_slash", "collapse_slashes"]), r"(?<=.)/$", "")


def annotated(facts: DataFrame, classes: DataFrame, stack: Stack) -> DataFrame:
    """Routes (name, to, cls, language) of annotated methods and decorated functions: each path of the annotation below
    each path at the class, or below the prefix of the object whose decorator it is.  Paths with blanks are no routes; in
    Python and Rust a path begins with a slash or is empty."""
    notes = facts.where("family = 'annotation'").withColumn("mark", F.lower("name"))
    plain = F.filter("args", lambda a: ~a.rlike(r"^\w+\s*[=:](?!=)") | a.rlike(r"^(?:value|path)\s*[=:]"))
    first = F.regexp_replace(F.coalesce(F.get(plain, F.lit(0)), F.lit("")), r"^(?:value|path)\s*[=:]\s*", "")
    several = F.regexp_extract_all(first, F.lit("[\"']([^\"']*)[\"']"), F.lit(1))
    paths = F.explode(F.when(first.rlike("[\"']"), several).otherwise(F.array(first))).alias("path")
    given = F.array_join(F.filter("args", lambda a: a.rlike(r"^methods?\s*[=:]")), " ")
    verbs = F.array_distinct(F.regexp_extract_all(F.upper(given), F.lit(r"\b(GET|POST|PUT|PATCH|DELETE)\b"), F.lit(1)))
    fixed = reduce(lambda w, x: w.when(F.col("mark") == x[0], x[1]), stack.route_marks, F)
    alone = F.when((F.col("language") == "python") & (F.col("mark") == "route"), "GET").otherwise("ANY")
    own = notes.where(F.col("mark").isin(*[m for m, _ in stack.route_marks]) & (F.col("detail") == "function") & ((F.col("language") != "python") | F.col("receiver").isNotNull()))
    own = own.select("path", "receiver", F.col("owner").alias("to"), "cls", "language", F.when(F.size(verbs) > 0, verbs).otherwise(F.array(F.when(fixed != "ANY", fixed).otherwise(alone))).alias("verbs"), paths.alias("own"))
    own = own.where(F.col("own").rlike(r"^\S*$") & (~F.col("language").isin("python", "rust") | F.col("own").rlike("^(?:/|$)")))
    at_class = notes.where(F.col("mark").isin(*stack.class_prefixes) & (F.col("detail") == "class") & ~((F.col("language") == "java") & (F.col("mark") != "requestmapping"))).select("cls", paths.alias("prefix")).where(F.col("prefix").rlike(r"^\S*$"))
    objects = facts.where("family = 'assign' and language = 'python'").select("path", F.col("name").alias("receiver"), F.regexp_extract("detail", r"\b(?:url_)?prefix\s*=\s*['\"]([^'\"]*)['\"]", 1).alias("below")).where("below <> ''").groupBy("path", "receiver").agg(F.min("below").alias("below"))
    met = own.join(at_class, "cls", "left").join(objects, ["path", "receiver"], "left").join(classes.select(F.col("fqn").alias("cls"), "short"), "cls", "left")
    full = F.concat_ws("/", "prefix", "below", F.nullif("own", F.lit("")))
    full = F.replace(full, F.lit("[controller]"), F.coalesce(F.regexp_replace(F.lower("short"), "controller$", ""), F.lit("[controller]")))
    full = F.replace(full, F.lit("[action]"), F.lower(naming.owner_member("to")))
    return met.select(F.explode("verbs").alias("verb"), _path(full).alias("path"), "to", "cls", "language").select(F.concat_ws(" ", "verb", "path").alias("name"), "to", "cls", "language").distinct()


def guarded(calls: DataFrame, facts: DataFrame, marked: DataFrame, stack: Stack) -> DataFrame:
    """(contract, guard) of what requests pass: annotations at a route's method or its class (``marked`` as ``annotated``
    gives it), calls chained to a route, and arguments between path and handler; a guard '' says that none is asked."""
    notes = facts.where("family = 'annotation'").withColumn("mark", F.lower("name"))
    named = F.filter("args", lambda a: a.rlike(r"^[\w\\.]+$"))
    guard = F.when(F.col("mark").isin(*stack.public_marks), F.array(F.lit(""))).when(F.size(named) > 0, named).otherwise(F.array("name"))
    held = notes.where(F.col("mark").isin(*stack.guard_marks, *stack.public_marks)).select(F.coalesce("owner", "cls").alias("at"), F.explode(guard).alias("guard"))
    noted = marked.select("name", F.col("to").alias("at")).union(marked.where("cls is not null").select("name", F.col("cls").alias("at"))).join(held, "at").select("name", "guard")
    on = F.lower(naming.short_name(F.regexp_replace("receiver", "->", "."))).isin(*[n.lower() for n in stack.routes])
    verb = lambda x: F.lower(x).isin(*stack.verbs, "any", "rule")
    step = F.get(F.filter(F.arrays_zip("chain", "chain_args"), lambda x: verb(x["chain"])), F.lit(0))
    words = lambda a: F.filter(F.flatten(F.transform(a, lambda x: F.split(F.regexp_replace(x, r"^\[|\]$|['\"\s]|::class", ""), ","))), lambda x: x.rlike(r"^[\w\\.:-]+$"))
    chained = calls.where(on & F.lower("method").isin(*stack.guard_calls)).withColumn("step", step).where("step is not null")
    chained = chained.select(F.concat_ws(" ", F.upper("step.chain"), _path(F.col("step.chain_args"))).alias("name"), F.explode(words(F.col("args"))).alias("guard"))
    between = calls.where(on & verb(F.col("method")) & (F.col("language") == "javascript") & (F.size("args") > 2))
    between = between.select(F.concat_ws(" ", F.upper("method"), _path(F.get("args", F.lit(0)))).alias("name"), F.explode(words(F.slice("args", 2, F.size("args") - 2))).alias("guard"))
    return noted.union(chained).union(between).select(F.col("name").alias("contract"), F.regexp_replace("guard", r"^\\+", "").alias("guard")).distinct()


def contracts(calls: DataFrame, stack: Stack) -> tuple[DataFrame, DataFrame]:
    """Routes (name, handler, file, language) that the project serves by calls and requests (name, owner) that it sends;
    names are ``METHOD /path`` with parameters as wildcards.  In a Ruby route file commands without receiver are routes."""
    path = _path(F.get("args", F.lit(0)))
    verb = F.upper("method")
    literal = F.get("args", F.lit(0)).rlike(r"^[\w/:{}<>.?=&$-]+$")
    on = lambda names: F.lower(naming.short_name(F.regexp_replace("receiver", "->", "."))).isin(*[n.lower() for n in names])
    command = (F.col("language") == "ruby") & F.col("receiver").isNull() & F.col("file").rlike(r"(?:^|/)routes(?:/[^/]+)?\.rb$")
    served = calls.where(literal & (F.coalesce(on(stack.routes), F.lit(False)) | command) & F.lower("method").isin(*stack.verbs, "any", "rule") & (F.size("args") > 1))
    last = F.when(F.col("language") == "javascript", F.element_at("args", -1)).otherwise(F.get("args", F.lit(1)))
    handler = F.when(command, F.concat_ws("Controller@", F.transform(F.split(F.regexp_replace(last, r"^(?:to:|=>)\s*|['\"\s]", ""), "#"), lambda x, i: F.when(i == 0, F.replace(F.initcap(F.replace(x, F.lit("_"), F.lit(" "))), F.lit(" "))).otherwise(x)))).otherwise(last)
    own = served.select(F.concat_ws(" ", verb, path).alias("name"), handler.alias("handler"), "file", "language", "id")
    routed = own.groupBy("name").agg(F.min_by(F.struct("handler", "file", "language"), "id").alias("x")).select("name", "x.*")
    plain = F.col("receiver").isNull() & (F.col("method") == "fetch")
    sent = calls.where(literal & (plain | (on(stack.clients) & F.lower("method").isin(*stack.verbs))) & F.col("language").isin("javascript"))
    return routed, sent.select(F.concat_ws(" ", F.when(plain, "GET").otherwise(verb), path).alias("name"), "owner").distinct()


def handled(routes: DataFrame, r: Resolver) -> DataFrame:
    """HandledBy edges: a handler ``Controller@action``, ``[Controller::class, 'action']`` or a plain function's name."""
    text = F.regexp_replace(F.regexp_replace("handler", r"^\[\s*|\s*\]$|['\"]", ""), r"::class\s*,\s*", "@")
    controller, action = naming.split_handler(text)
    own = routes.select("name", "file", F.lit("").alias("space"), text.alias("plain"), controller.alias("cls"), F.lower(action).alias("action"))
    met = r.class_of(own.withColumnRenamed("name", "contract").withColumn("name", naming.short_name("cls")))
    methods = r.functions.where("class is not null").groupBy(F.col("class").alias("fqn"), F.lower("name").alias("action")).agg(F.min(F.col("fqn")).alias("to"))
    there = met.join(methods, ["fqn", "action"]).select("contract", "to")
    only = unique_or_null(r.functions.where("class is null").select("name", "fqn"), "name", "fqn").select(F.col("name").alias("plain"), F.col("fqn").alias("to"))
    loose = met.join(only, "plain").select("contract", "to").join(there.select("contract"), "contract", "left_anti")
    return there.union(loose).select(node_id("contract", "contract").alias("from_id"), node_id("function", "to").alias("to_id"))


def graph_of(facts: DataFrame, schema: DataFrame, stack: Stack = Stack()) -> dict[str, DataFrame]:
    """nodes, edges and marks of facts and of a schema (table, columns).  ``facts`` is read many times: stage it."""
    r = Resolver(facts, stack)
    bases = stage(r.bases())
    calls = stage(r.typed(r.calls()))
    models = _models(r.classes, bases, stack)
    access = stage(table_calls(calls, models, stack))
    routes, sent = contracts(calls, stack)
    served = stage(routes)
    marked = stage(annotated(facts, r.classes, stack))
    guards = stage(guarded(calls, facts, marked, stack))
    literal = F.get("args", F.lit(0))
    named = F.array_compact(F.array(*[F.when(_calls_any(F.col("receiver"), F.col("method"), [p]), F.struct(F.lit(k).alias("node_kind"), F.lit(e).alias("kind"))) for p, k, e in stack.named]))
    things = calls.where(literal.rlike(r"^[\w.:/-]+$")).select("owner", literal.alias("name"), F.explode(named).alias("x")).select("owner", "name", "x.*").distinct()
    known = served.select("name").union(marked.select("name")).distinct()
    passed = guards.where("guard <> ''").join(known, guards.contract == known.name, "left_semi")
    things = things.unionByName(passed.select(node_id("contract", "contract").alias("owner"), F.col("guard").alias("name"), F.lit("Middleware").alias("node_kind"), F.lit("PassesThrough").alias("kind")))

    columns = {f.split()[0]: f.split()[1] for f in SCHEMAS["nodes"].split(", ")}

    def nodes(df: DataFrame, kind, **fields) -> DataFrame:
        given = {"kind": F.lit(kind) if isinstance(kind, str) else kind, "in_loop": F.lit(False)} | fields
        return df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    at = F.to_json(F.struct(F.col("file").alias("path"), "line"))
    columns_of = schema.select(F.lower("table").alias("table"), F.explode("columns").alias("column")).distinct()
    tables = schema.select("table").union(access.select("table")).union(models.select("table")).groupBy(F.lower("table").alias("low")).agg(F.min("table").alias("table"))
    both = served.select("name", F.lit(True).alias("back"), F.nullif("handler", F.lit("")).alias("handler"), "language")
    both = both.unionByName(marked.select("name", F.lit(True).alias("back"), F.col("to").alias("handler"), "language"))
    both = both.unionByName(sent.select("name", F.lit(False).alias("back"), F.lit(None).cast("string").alias("handler"), F.lit(None).cast("string").alias("language")))
    both = both.groupBy("name").agg(F.max("back").alias("back"), F.max("handler").alias("handler"), F.min("language").alias("language"))
    side = F.when(F.col("back"), "backend").otherwise("frontend")
    parts = [
        nodes(facts.where("family = 'file'"), "File", id=node_id("file", "path"), name=F.col("name"), fqn=F.col("path"), language=F.col("language")),
        nodes(r.classes, F.col("kind"), id=node_id("class", "fqn"), name=F.col("short"), fqn=F.col("fqn"), language=F.col("language"), props=at),
        nodes(r.functions, F.when(F.col("class").isNotNull(), "Method").otherwise("Function"), id=node_id("function", "fqn"), name=F.col("name"), fqn=F.col("fqn"), language=F.col("language"), props=at),
        nodes(calls, "CallSite", id=F.col("id"), name=_site_name(), fqn=F.col("owner_name"), language=F.col("language"), in_loop=F.col("in_loop"), props=F.to_json(F.struct("in_loop", F.col("text").alias("snippet"), F.col("file").alias("path"), "line"))),
        nodes(tables, "Table", id=node_id("table", "low"), name=F.col("table"), identity=F.concat(F.lit("table "), "low"), language=F.lit("sql")),
        nodes(columns_of, "Column", id=node_id("column", "table", "column"), name=F.col("column"), fqn=F.concat_ws(".", "table", "column"), language=F.lit("sql")),
        nodes(both, "HttpContract", id=node_id("contract", "name"), name=F.col("name"), identity=F.col("name"), side=side, language=F.coalesce("language", F.lit("javascript")), props=F.to_json(F.struct(side.alias("side"), "handler"))),
        nodes(things.select("node_kind", "name").distinct(), F.col("node_kind"), id=node_id("thing", "node_kind", "name"), name=F.col("name")),
    ]

    def edges(df: DataFrame, kind, start: Column, end: Column, sure=1.0) -> DataFrame:
        return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), start.alias("from_id"), end.alias("to_id"), (F.lit(sure) if isinstance(sure, float) else sure).cast("double").alias("confidence"))

    table = node_id("table", F.lower("table"))
    links = [
        edges(r.classes, "Declares", node_id("file", "file"), node_id("class", "fqn")),
        edges(r.functions, "Declares", F.when(F.col("class").isNotNull(), node_id("class", "class")).otherwise(node_id("file", "file")), node_id("function", "fqn")),
        edges(bases.where("fqn is not null and fqn <> cls"), "Extends", node_id("class", "cls"), node_id("class", "fqn")),
        edges(calls, "HasCallSite", F.col("owner"), F.col("id")),
        edges(r.called(calls, bases), "Calls", F.col("from_id"), F.col("to_id"), F.col("confidence")),
        edges(access, F.when(F.col("writes"), "WritesDb").otherwise("ReadsDb"), F.col("owner"), table, 0.9),
        edges(models, "MapsTo", node_id("class", "fqn"), table, 0.9),
        edges(columns_of, "HasColumn", table, node_id("column", "table", "column")),
        edges(handled(served, r), "HandledBy", F.col("from_id"), F.col("to_id")),
        edges(marked, "HandledBy", node_id("contract", "name"), node_id("function", "to")),
        edges(sent, "CallsHttp", F.col("owner"), node_id("contract", "name")),
        edges(things, F.col("kind"), F.col("owner"), node_id("thing", "node_kind", "name"), 0.9),
    ]
    all_edges = stage(reduce(DataFrame.unionByName, links).groupBy("kind", "from_id", "to_id").agg(F.max("confidence").alias("confidence")))
    return {"nodes": reduce(DataFrame.unionByName, parts), "edges": all_edges, "marks": marks_of(calls, access, all_edges, facts, guards.join(known, guards.contract == known.name, "left_semi"), stack)}


def marks_of(calls: DataFrame, access: DataFrame, edges: DataFrame, facts: DataFrame, guards: DataFrame, stack: Stack) -> DataFrame:
    """Annotations: what guards of contracts ask for, queries and writes, external calls in loops, raw statements with the origin of their variables,
    transactions and methods that write several tables without one."""
    hit = lambda patterns: _calls_any(F.col("receiver"), F.col("method"), patterns)
    mark = lambda df, channel, kind, node="id": df.select(F.col(node).alias("node_id"), F.lit(channel).alias("channel"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))
    raw = calls.where(hit(stack.raw) & (F.size("args") > 0)).withColumn("text", F.get("args", F.lit(0)))
    variables = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\$(\w+)"), F.lit(1)))
    loose = raw.where(F.size(variables) > 0)
    straight = loose.where(F.col("text").rlike(stack.sources)).select("id")
    traced = loose.join(straight, "id", "left_anti").where("owner_name is not null").select("id", F.col("owner_name").alias("owner"), F.explode(variables).alias("var"))
    given = facts.where("family = 'assign' and owner is not null").select("owner", F.col("name").alias("var"), F.col("detail").alias("rhs"))
    traced = phases.tainted(traced, given, stack.sources).groupBy("id").agg(F.min("kind").alias("kind"))
    taint = traced.unionByName(straight.withColumn("kind", F.lit("tainted")))
    tx = calls.where(F.lower("method").isin(*stack.transactions))
    several = phases.multi_write_without_tx(edges, tx.select(F.col("owner").alias("node_id")))
    asked = guards.where((F.col("guard") == "") | F.col("guard").rlike(stack.authentication)).withColumn("id", node_id("contract", "contract"))
    rows = [
        mark(access, "DbQuery", F.when(F.col("writes"), "db-write").otherwise("db-query")),
        mark(calls.where(F.col("in_loop") & hit(stack.external)), "External", "ext-call-in-loop"),
        mark(raw.where(F.size(variables) > 0), "Taint", "sink"),
        mark(taint, "Taint", F.when(F.col("kind") == "tainted", "tainted_raw").otherwise("tainted_raw_unknown")),
        mark(tx, "Tx", "tx-marker"),
        mark(several, "Tx", "multi-write-without-tx", "node_id"),
        mark(asked, "Capability", F.when(F.col("guard") == "", "auth.public").when(F.col("guard").rlike("(?i)optional"), "auth.optional").otherwise("Authentication")),
    ]
    return reduce(DataFrame.unionByName, rows).distinct()


def build(spark: SparkSession, root: str, stack: Stack = Stack()) -> dict[str, DataFrame]:
    """The graph of the source tree below ``root``."""
    files = code.scan(spark, root)
    made = code.parse(files.where("language = 'sql'")).where("family = 'column'").groupBy(F.col("owner").alias("table")).agg(F.sort_array(F.collect_set("name")).alias("columns"))
    moved = loaders.migrations(files)
    schema = made.unionByName(moved).select(naming.strip_prefixes("table", list(stack.prefixes)).alias("table"), "columns")
    return graph_of(stage(scopes.parse(files, root)), stage(schema), stack)
