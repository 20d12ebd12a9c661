"""Source trees as DataFrames: file scans and parsers."""

from __future__ import annotations

import ast
import json
import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of the languages that are read.
LANGUAGES = {"php": "php", "js": "javascript", "ts": "javascript", "vue": "javascript", "jsx": "javascript", "tsx": "javascript", "java": "java", "py": "python", "rs": "rust", "rb": "ruby", "cs": "csharp", "json": "json", "xml": "xml", "sql": "sql"}
EXCLUDED = ("node_modules", "vendor", "dist", "build", "target", ".git", "__pycache__")
LARGEST = 4 << 20
FACTS = "path string, language string, family string, name string, owner string, detail string, line int"


def scan(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, largest: int = LARGEST) -> DataFrame:
    """path, language, size, content, hash of all files of a known language below ``root``."""
    skip = "(?i)/(" + "|".join(re.escape(x) for x in excluded) + ")/"
    extension = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = files.where((F.col("length") <= largest) & ~F.col("path").rlike(skip)).withColumn("language", language).where("language is not null")
    return kept.select("path", "language", F.col("length").alias("size"), "content", F.sha2("content", 256).alias("hash"))


def _python(text: str) -> list[tuple]:
    out: list[tuple] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out

    def walk(node, owner):
        for child in ast.iter_child_nodes(node):
            here = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                here = f"{owner}.{child.name}" if owner else child.name
                out.append(("class" if isinstance(child, ast.ClassDef) else "function", child.name, owner, None, child.lineno))
                if isinstance(child, ast.ClassDef):
                    out.extend(("inherits", ast.unparse(base), here, None, child.lineno) for base in child.bases)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                module = getattr(child, "module", None) or ""
                out.extend(("import", a.name, owner, module, child.lineno) for a in child.names)
            elif isinstance(child, ast.Call):
                first = ast.literal_eval(child.args[0]) if child.args and isinstance(child.args[0], ast.Constant) else None
                out.append(("call", ast.unparse(child.func), owner, None if first is None else str(first), child.lineno))
            elif isinstance(child, ast.Assign):
                out.extend(("assign", ast.unparse(t), owner, ast.unparse(child.value), child.lineno) for t in child.targets)
            walk(child, here)

    walk(tree, "")
    return out


# Regular front ends: declarations, imports, inheritance and calls, without a grammar.
_COMMON_CALL = r"(?P<call>[A-Za-z_$][\w$\\.]*(?:(?:->|::|\.)[A-Za-z_]\w*)*)\s*\("
_PATTERNS = {
    "php": r"class\s+(?P<class>\w+)(?:\s+extends\s+(?P<base>[\w\\]+))?|function\s+(?P<function>\w+)|^\s*use\s+(?P<import>[\w\\]+)|",
    "javascript": r"class\s+(?P<class>\w+)(?:\s+extends\s+(?P<base>[\w.]+))?|function\s+(?P<function>\w+)|import\s[^;\n]*?from\s+['\"](?P<import>[^'\"]+)|",
    "java": r"(?:class|interface)\s+(?P<class>\w+)(?:\s+extends\s+(?P<base>[\w.]+))?|(?:public|private|protected)\s[\w<>\[\], ]+\s(?P<function>\w+)\s*(?=\()|^\s*import\s+(?P<import>[\w.]+)|",
    "rust": r"(?:struct|enum|trait)\s+(?P<class>\w+)|fn\s+(?P<function>\w+)|^\s*use\s+(?P<import>[\w:]+)|impl\s+(?P<base>\w+)\s+for|",
    "ruby": r"class\s+(?P<class>\w+)(?:\s*<\s*(?P<base>[\w:]+))?|def\s+(?P<function>\w+)|require\s+['\"](?P<import>[^'\"]+)|",
    "csharp": r"(?:class|interface)\s+(?P<class>\w+)(?:\s*:\s*(?P<base>[\w.]+))?|(?:public|private|protected)\s[\w<>\[\], ]+\s(?P<function>\w+)\s*(?=\()|^\s*using\s+(?P<import>[\w.]+)|",
}
_FRONT = {k: re.compile(v + _COMMON_CALL, re.M) for k, v in _PATTERNS.items()}
_NOT_CALLS = frozenset("if for foreach while switch catch return function elseif match array list isset empty fn sizeof typeof new".split())


def _regular(text: str, language: str) -> list[tuple]:
    out, owner, line, at = [], "", 1, 0
    for m in _FRONT[language].finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        got = m.groupdict()
        if got.get("class"):
            owner = got["class"]
            out.append(("class", owner, "", None, line))
        if got.get("base"):
            out.append(("inherits", got["base"], owner, None, line))
        if got.get("function"):
            out.append(("function", got["function"], owner, None, line))
        if got.get("import"):
            out.append(("import", got["import"], owner, None, line))
        if got.get("call") and got["call"].lower() not in _NOT_CALLS:
            first = re.match(r"\s*(['\"])(.*?)\1", text[m.end() : m.end() + 300], re.S)
            out.append(("call", got["call"], owner, first[2] if first else None, line))
    return out


def json_entries(text: str) -> list[tuple[str, str]]:
    """(key path, value) of every leaf of a JSON text; nothing for a broken text."""
    out: list[tuple[str, str]] = []

    def walk(x, path):
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}" if path else k)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}.{i}" if path else str(i))
        else:
            out.append((path, x if isinstance(x, str) else json.dumps(x)))

    try:
        walk(json.loads(text), "")
    except ValueError:
        return []
    return out


def create_tables(text: str) -> list[tuple[str, list[str]]]:
    """(table, columns) of every CREATE TABLE, by pairing parentheses."""
    out = []
    for m in re.finditer(r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\(", text):
        depth, start, parts = 1, m.end(), []
        for i in range(m.end(), len(text)):
            c = text[i]
            depth += (c == "(") - (c == ")")
            if depth == 0 or (c == "," and depth == 1):
                parts.append(text[start:i])
                start = i + 1
            if depth == 0:
                break
        names = [n[1] for p in parts if (n := re.match(r"\s*[`\"\[]?(\w+)[`\"\]]?\s+\S", p)) and n[1].lower() not in ("primary", "key", "unique", "index", "constraint", "foreign", "check", "fulltext")]
        out.append((m[1].split(".")[-1], names))
    return out


def mapper_statements(text: str) -> list[tuple[str, str, str]]:
    """(namespace, id, verb) of the statements of a mapper XML."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []
    if root.tag != "mapper":
        return []
    return [(root.get("namespace", ""), x.get("id", ""), x.tag) for x in root if x.tag in ("select", "insert", "update", "delete")]


def manifest_dependencies(name: str, text: str) -> list[str]:
    """Dependency names of a manifest or lock file, by its file name."""
    name = name.rsplit("/", 1)[-1].lower()
    if name in ("package.json", "composer.json"):
        try:
            data = json.loads(text)
        except ValueError:
            return []
        keys = ("dependencies", "devDependencies", "require", "require-dev")
        return sorted({d for k in keys if isinstance(data.get(k), dict) for d in data[k]})
    if name == "composer.lock":
        try:
            return sorted({p["name"] for p in json.loads(text).get("packages", [])})
        except (ValueError, KeyError):
            return []
    if name.startswith("requirements") and name.endswith(".txt"):
        return sorted({m[0].lower() for m in (re.match(r"[A-Za-z0-9._-]+", x.strip()) for x in text.splitlines()) if m})
    if name == "pom.xml":
        return sorted(set(re.findall(r"<artifactId>\s*([\w.-]+)\s*</artifactId>", text)))
    if name.endswith((".gradle", ".gradle.kts")):
        return sorted(set(re.findall(r"['\"][\w.-]+:([\w.-]+):", text)))
    if name in ("cargo.toml", "pyproject.toml", "pipfile"):
        import tomllib

        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return []
        own = [*data.get("dependencies", {}), *data.get("packages", {}), *(re.match(r"[\w.-]+", d)[0] for d in data.get("project", {}).get("dependencies", []))]
        return sorted({d.lower() for d in own})
    return []


def nginx_locations(text: str) -> list[tuple[str, str]]:
    """(location, proxy target or empty) of a server configuration."""
    return [(m[1], (re.search(r"proxy_pass\s+([^;\s]+)", m[2]) or ["", ""])[1]) for m in re.finditer(r"location\s+(?:[=~^*]+\s*)?(\S+)\s*\{([^}]*)\}", text)]


def facts_of(path: str, language: str, text: str) -> list[tuple]:
    """(family, name, owner, detail, line) of one file."""
    if language == "python":
        return _python(text)
    if language in _FRONT:
        return _regular(text, language)
    if language == "json":
        return [("config", k, "", v, 0) for k, v in json_entries(text)]
    if language == "sql":
        return [("column", c, t, None, 0) for t, cs in create_tables(text) for c in cs]
    if language == "xml":
        return [("statement", i, ns, verb, 0) for ns, i, verb in mapper_statements(text)]
    return []


def parse(files: DataFrame) -> DataFrame:
    """One row per fact of every file; files of more than one language go through one Arrow pass, no shuffle."""

    def run(batches):
        names = [x.split()[0] for x in FACTS.split(", ")]
        types = [pa.string()] * 6 + [pa.int32()]
        for b in batches:
            rows = []
            for path, language, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows += [(path, language, *f) for f in facts_of(path, language, (content or b"").decode("utf-8", "replace"))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    return files.select("path", "language", "content").mapInArrow(run, FACTS)


def i18n(files: DataFrame, locale: str) -> DataFrame:
    """(key, texts): JSON texts of all locales merged per key; ``locale`` is a pattern whose first group names it."""
    own = parse(files.where("language = 'json'")).select(F.regexp_extract("path", locale, 1).alias("locale"), F.col("name").alias("key"), F.col("detail").alias("text")).where("locale <> ''")
    last = own.groupBy("key", "locale").agg(F.max("text").alias("text"))
    return last.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locale", "text")))).alias("texts"))


def detect_frameworks(dependencies: DataFrame, detectors: DataFrame) -> DataFrame:
    """(sub, framework, confidence): dependencies (sub, name) against detectors (name, framework, confidence)."""
    return dependencies.join(detectors, "name").groupBy("sub", "framework").agg(F.max("confidence").alias("confidence"))
