"""Loaders of project resources over parsed files and calls, and the registries of parsers and loaders.

Calls are rows (file, line, receiver, method, args array<string>); files are rows (path, content).  Everything that one
file decides runs in one Arrow pass without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from .code import LANGUAGES, create_tables, nginx_locations, parse

_PARSERS: dict[str, Callable] = {}
_LOADERS: dict[str, Callable] = {}


def register_parser(language: str, extensions: tuple[str, ...], parser: Callable[[str, str], list[tuple]]) -> None:
    """Add a parser ``(path, text) -> [(family, name, owner, detail, line)]`` for a language and its extensions."""
    LANGUAGES.update(dict.fromkeys(extensions, language))
    _PARSERS[language] = parser


def parser_for(language: str) -> Callable | None:
    return _PARSERS.get(language)


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def loader(name: str):
    """Register a loader under a name; ``load`` finds it there."""

    def add(f: Callable) -> Callable:
        _LOADERS[name] = f
        return f

    return add


def load(name: str, *args, **kwargs) -> DataFrame:
    if name not in _LOADERS:
        raise ValueError(f"unknown loader {name}; known: {sorted(_LOADERS)}")
    return _LOADERS[name](*args, **kwargs)


def glob_pattern(globs: list[str]) -> str:
    """One case-insensitive regular expression for globs (``**``, ``*``, ``?``); broken ones are left out."""
    parts = []
    for g in globs:
        if g.count("[") != g.count("]"):
            continue
        body = re.escape(g).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        parts.append(body)
    return "(?i)(?:^|.*/)(?:" + "|".join(parts) + ")$" if parts else "(?!)"


def markers(spark: SparkSession, root: str, names: list[str], depth: int = 4) -> DataFrame:
    """(path, name, depth) of marker files at most ``depth`` folders below ``root``, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root.rstrip("/")) + "/", "")
    own = files.select("path", F.substring_index("path", "/", -1).alias("name"), (F.size(F.split(inside, "/")) - 1).alias("depth"))
    return own.where(F.col("name").isin(*names) & (F.col("depth") <= depth)).orderBy("path")


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, hash): of the content, and of path and size where there is none to read."""
    return files.select("path", F.when(F.col("content").isNotNull(), F.sha2("content", 256)).otherwise(F.sha2(F.concat_ws(":", "path", F.col("size").cast("string")).cast("binary"), 256)).alias("hash"))


@loader("file")
def file_entries(files: DataFrame, path: str, key_path: str = "") -> DataFrame:
    """(key, value) of one configuration file, below ``key_path``."""
    own = parse(files.where(F.endswith("path", F.lit(path)))).where("family = 'config'").select(F.col("name").alias("key"), F.col("detail").alias("value"))
    if not key_path:
        return own
    return own.where(F.startswith("key", F.lit(key_path + "."))).select(F.substring("key", len(key_path) + 2, 10_000).alias("key"), "value")


@loader("inline")
def inline(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """(key, value) of constant rows; values are JSON texts."""
    return spark.createDataFrame([(str(r["key"]), json.dumps(r.get("value"))) for r in rows], "key string, value string")


@loader("db_schema")
def db_schema(files: DataFrame, calls: DataFrame, naming_calls: list[tuple[str, str]], prefixes: list[str], most_sources: int = 50) -> DataFrame:
    """(table, columns, sources): tables of SQL scripts, without prefixes, and those that the first argument of a call
    (receiver, method) names; the smallest ``most_sources`` places of each (the operator's own limit)."""

    def run(batches):
        for b in batches:
            rows = [(p, t, c) for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t, c in create_tables((x or b"").decode("utf-8", "replace"))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.string(), pa.list_(pa.string())))], names=["source", "table", "columns"])

    made = files.where(F.endswith("path", F.lit(".sql"))).select("path", "content").mapInArrow(run, "source string, table string, columns array<string>")
    wanted = F.lit(False)
    for receiver, method in naming_calls:
        wanted = wanted | ((F.lower("receiver") == receiver.lower()) & (F.lower("method") == method.lower()))
    named = calls.where(wanted & F.get("args", F.lit(0)).rlike(r"^\w+$")).select(F.concat_ws(":", "file", "line").alias("source"), F.get("args", F.lit(0)).alias("table"), F.array().cast("array<string>").alias("columns"))
    rows = made.unionByName(named).withColumn("table", naming.strip_prefixes("table", prefixes))
    columns = rows.select("table", F.explode_outer("columns").alias("c")).groupBy("table").agg(F.sort_array(F.collect_set("c")).alias("columns"))
    from ..operators.joins import top_k

    few = top_k(rows.select("table", "source").distinct(), ["table"], ["source"], most_sources).groupBy("table").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    return columns.join(few, "table")


@loader("config_keys")
def config_keys(calls: DataFrame, accessors: list[dict]) -> DataFrame:
    """(key, storage, mutable): literal first arguments without a space of accessors {name | suffix, storage, mutable};
    names compare without case, of several accessors of a key the first counts."""
    rows = None
    for i, a in enumerate(accessors):
        low = F.lower("method")
        hit = low == a["name"].lower() if "name" in a else F.endswith(low, F.lit(a["suffix"].lower()))
        own = calls.where(hit).select(F.get("args", F.lit(0)).alias("key"), F.lit(i).alias("rank"), F.lit(a.get("storage", "config")).alias("storage"), F.lit(bool(a.get("mutable"))).alias("mutable"))
        rows = own if rows is None else rows.unionByName(own)
    own = rows.where("key is not null and key <> '' and not contains(key, ' ')")
    return own.groupBy("key").agg(F.min(F.struct("rank", "storage", "mutable")).alias("x")).select("key", "x.storage", "x.mutable")


def _text_rows(files: DataFrame, pattern: str, find: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            rows = [(p, *r) for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in find((x or b"").decode("utf-8", "replace"))]
            yield pa.record_batch([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * len(names))], names=names)

    return files.where(F.col("path").rlike(pattern)).select("path", "content").mapInArrow(run, schema)


def middleware_of(text: str) -> list[tuple[str, str]]:
    """(alias, class) of array entries ``'alias' => Class::class`` or ``'alias' => 'Class'``."""
    return [(m[1], m[2].lstrip("\\")) for m in re.finditer(r"['\"]([\w.:-]+)['\"]\s*=>\s*\[?\s*(?:['\"])?([\w\\]+)(?:::class|['\"])", text)]


@loader("middleware_aliases")
def middleware_aliases(files: DataFrame, imports: DataFrame, pattern: str = r"(?i)middleware[^/]*\.php$|Kernel\.php$") -> DataFrame:
    """(alias, class): guard names of configuration files, classes in full by the file's imports (file, alias, fqn)."""
    rows = _text_rows(files, pattern, middleware_of, "path string, alias string, class string")
    known = imports.select(F.col("file").alias("path"), F.lower("alias").alias("low"), "fqn").groupBy("path", "low").agg(F.min("fqn").alias("fqn"))
    met = rows.withColumn("low", F.lower("class")).join(known, ["path", "low"], "left")
    return met.groupBy("alias").agg(F.min(F.coalesce("fqn", "class")).alias("class"))


@loader("declared_middleware")
def declared(files: DataFrame, pattern: str = r"(?i)middleware\.php$") -> DataFrame:
    """(path, class): classes that a file declares for all its application's routes."""
    return _text_rows(files, pattern, lambda t: [(c.lstrip("\\"),) for c in re.findall(r"([\w\\]+)::class", t)], "path string, class string").distinct()


@loader("routes")
def routes(calls: DataFrame, groups: DataFrame, guards: DataFrame, methods: dict[str, str], steps: list) -> DataFrame:
    """(key, handler, guards): routing calls by ``methods`` (call to HTTP method); the path is normalised, put below the
    groups (file, a, b, label) around its line and normalised again; guards (file, a, b, class, label) likewise."""
    from ..operators.resolve import guards_of, route_prefixes

    verb = F.create_map(*[F.lit(x) for pair in methods.items() for x in pair])
    own = calls.where(F.lower("method").isin(*methods) & (F.size("args") > 0)).select("id", "file", "line", verb[F.lower("method")].alias("verb"), F.get("args", F.lit(0)).alias("path"), F.get("args", F.lit(1)).alias("handler"))
    prefix, around = route_prefixes(own, groups), guards_of(own, guards).groupBy("id").agg(F.sort_array(F.collect_set("class")).alias("guards"))
    full = naming.normalize(F.concat_ws("/", F.nullif("prefix", F.lit("")), naming.normalize("path", [*steps, "trim_slashes"])), [*steps, "leading_slash", "collapse_slashes"])
    met = own.join(prefix, "id").join(around, "id", "left").select(F.concat_ws(" ", "verb", full).alias("key"), "handler", F.coalesce("guards", F.array().cast("array<string>")).alias("guards"), "id")
    return met.groupBy("key").agg(F.min(F.struct("id", "handler", "guards")).alias("x")).select("key", "x.handler", "x.guards")


@loader("nginx_config")
def nginx(files: DataFrame, pattern: str = r"\.conf$") -> DataFrame:
    """(path, location, target) of server configurations."""
    return _text_rows(files, pattern, nginx_locations, "path string, location string, target string")


def migration_columns(text: str) -> list[tuple[str, str]]:
    """(table, column) of migrations: ``Schema::create('t', ... $table->type('c'))`` and ``$this->table('t')->addColumn('c')``."""
    out: list[tuple[str, str]] = []
    heads = list(re.finditer(r"(?:Schema::(?:create|table)|->table)\s*\(\s*['\"](\w+)['\"]", text))
    for m, end in zip(heads, [*(h.start() for h in heads[1:]), len(text)]):
        body = text[m.end() : end]
        out += [(m[1], c) for c in re.findall(r"\$table->(?!index|unique|primary|foreign|drop)\w+\s*\(\s*['\"](\w+)['\"]|", body) if c]
        out += [(m[1], c) for c in re.findall(r"->addColumn\s*\(\s*['\"](\w+)['\"]", body)]
    return out


@loader("migrations")
def migrations(files: DataFrame, pattern: str = r"(?i)migrations?/[^/]+\.php$") -> DataFrame:
    """(table, columns) of migration files, columns of all files of a table together."""
    rows = _text_rows(files, pattern, migration_columns, "path string, table string, column string")
    return rows.groupBy("table").agg(F.sort_array(F.collect_set("column")).alias("columns"))


def lock_dependencies(name: str, text: str) -> list[str]:
    """Locked package names of a lock file, by its file name."""
    name = name.rsplit("/", 1)[-1].lower()
    try:
        if name == "composer.lock":
            data = json.loads(text)
            return sorted({p["name"] for k in ("packages", "packages-dev") for p in data.get(k) or []})
        if name == "package-lock.json":
            data = json.loads(text)
            return sorted({k.rsplit("node_modules/", 1)[-1] for k in data.get("packages", {}) if k} | set(data.get("dependencies", {})))
        if name in ("cargo.lock", "poetry.lock"):
            import tomllib

            return sorted({p["name"] for p in tomllib.loads(text).get("package", [])})
        if name == "pipfile.lock":
            data = json.loads(text)
            return sorted({p for k in ("default", "develop") for p in data.get(k, {})})
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    if name == "yarn.lock":
        return sorted({m[1] for m in re.finditer(r'(?m)^"?(@?[^@"\s]+)@', text)})
    return []
