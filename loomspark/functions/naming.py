"""Naming functions as Columns: normalisation steps, identifiers, plural forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_prefixes(s, prefixes: list[str]) -> Column:
    """Remove prefixes, repeatedly, but never the whole text."""
    if not prefixes:
        return _c(s)
    return F.regexp_replace(_c(s), "^(?:" + "|".join(re.escape(p) for p in prefixes) + ")+(?=.)", "")


def leading_slash(s) -> Column:
    return F.when(F.startswith(_c(s), F.lit("/")), _c(s)).otherwise(F.concat(F.lit("/"), _c(s)))


def strip_query(s) -> Column:
    return F.substring_index(_c(s), "?", 1)


def param_wildcard(s) -> Column:
    """Path segments that begin with a colon become ``:*``."""
    return F.regexp_replace(_c(s), r"(^|/):[^/]*", "$1:*")


def strip_namespace(s) -> Column:
    return F.regexp_extract(_c(s), r"([^\\/:]*)$", 1)


def short_name(s) -> Column:
    return F.regexp_extract(_c(s), r"([^\\/:.]*)$", 1)


def to_snake(s) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(_c(s), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[A-Z][a-z])", "_")), "^_+|_+$", "")


def _sibilant(s: Column) -> Column:
    return s.rlike("(?:[sxz]|ch|sh)$")


def singularize(s) -> Column:
    s = _c(s)
    n = F.length(s)
    stem = F.left(s, n - 2)
    return (
        F.when(s.rlike("ies$") & (n > 3), F.concat(F.left(s, n - 3), F.lit("y")))
        .when(s.rlike("zzes$") & (n > 4), F.left(s, n - 3))
        .when(s.rlike("es$") & (n > 3) & _sibilant(stem), stem)
        .when(s.rlike("s$") & ~s.rlike("ss$") & (n > 1), F.left(s, n - 1))
        .otherwise(s)
    )


def pluralize(s) -> Column:
    s = _c(s)
    n = F.length(s)
    plural = s.rlike("ies$") | (s.rlike("es$") & (n > 3) & _sibilant(F.left(s, n - 2))) | (s.rlike("s$") & ~s.rlike("(?:ss|us|is)$"))
    return (
        F.when((n == 0) | plural, s)
        .when(s.rlike("(?:^|[^aeiou])y$"), F.concat(F.left(s, n - 1), F.lit("ies")))
        .when(s.rlike("(?i)[aeiou]z$"), F.concat(s, F.lit("zes")))
        .when(_sibilant(s), F.concat(s, F.lit("es")))
        .otherwise(F.concat(s, F.lit("s")))
    )


def snake_plural(s) -> Column:
    return pluralize(to_snake(strip_namespace(s)))


def class_to_topic(s) -> Column:
    return to_snake(strip_namespace(s))


def ident_tokens(s) -> Column:
    """Lower-case parts of an identifier: camel humps, acronyms, separators."""
    parts = F.split(_c(s), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+")
    return F.filter(F.transform(parts, F.lower), lambda x: x != "")


def contract_parts(s) -> tuple[Column, Column]:
    """Method and path of a contract name ``METHOD /path``."""
    return F.substring_index(_c(s), " ", 1), F.regexp_extract(_c(s), r"^\S* (.*)$", 1)


STEPS = {"lower": lambda s: F.lower(s), "upper": lambda s: F.upper(s), "trim": lambda s: F.trim(s), "leading_slash": leading_slash, "strip_query": strip_query, "param_wildcard": param_wildcard, "strip_namespace": strip_namespace, "short_name": short_name, "singularize": singularize, "snake_plural": snake_plural}


def normalize(s, steps: list) -> Column:
    """Trim, then apply steps in order: a name of ``STEPS``, ("strip_prefix", [...]) or ("replace", from, to)."""
    out = F.trim(_c(s))
    for step in steps:
        if isinstance(step, str):
            out = STEPS[step](out)
        elif step[0] == "strip_prefix":
            out = strip_prefixes(out, step[1])
        elif step[0] == "replace":
            out = F.replace(out, F.lit(step[1]), F.lit(step[2]))
        else:
            raise ValueError(f"unknown step {step[0]}")
    return out


def wildcard(pattern: str) -> str:
    """A regular expression for a path with ``*`` (no slash), ``{locale}`` (captured) and literal text."""
    out = re.escape(pattern).replace(r"\{locale\}", "([^/]+)").replace(r"\*", "[^/]*")
    return f"^{out}$"


def callee_matches(receiver, method, pattern: str) -> Column:
    """``Recv::meth``: receivers match whole or behind a separator (a leading ``*`` is dropped), without case; several
    methods stand in braces, ``*`` is any method; a pattern without receiver matches the method alone."""
    head, _, tail = pattern.rpartition("::") if "::" in pattern else pattern.rpartition("->")
    methods = [m.strip().lower() for m in tail.strip("{}").split(",")]
    column = F.lower(_c(method))
    own = F.lit(True) if methods == ["*"] else column.isin(*methods)
    if not head:
        return own
    want = head.lstrip("*").lower()
    low = F.lower(_c(receiver))
    return own & F.coalesce((low == want) | low.rlike(rf"[\\/.:>$]{re.escape(want)}$"), F.lit(False))


def http_write(method) -> Column:
    return F.upper(_c(method)).isin("POST", "PUT", "PATCH", "DELETE")


# Transforms of value sources, in the order in which a rule lists them.
TRANSFORMS = {"strip_namespace": strip_namespace, "snake": to_snake, "snake_plural": snake_plural, "class_to_topic": class_to_topic, "lower": lambda s: F.lower(s), "upper": lambda s: F.upper(s)}


def upper_camel_parts(s) -> Column:
    """Parts at every capital letter and separator, as written: ``HTTPServer`` gives one part a capital."""
    return F.filter(F.split(_c(s), r"(?=[A-Z])|[^A-Za-z0-9]+"), lambda x: x != "")


def camel_words(s) -> Column:
    """Lower-case parts where a small letter or digit meets a capital; acronyms stay whole; no other separators."""
    return F.transform(F.split(_c(s), r"(?<=[a-z0-9])(?=[A-Z])"), F.lower)


def identifier_words(s) -> Column:
    """Lower-case parts at humps, separators and where letters meet digits; parts of one character go."""
    parts = F.split(_c(s), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|[^A-Za-z0-9]+")
    return F.filter(F.transform(parts, F.lower), lambda x: F.length(x) > 1)


def action_words(s) -> Column:
    """Lower-case words of a path or name, at separators and humps."""
    return F.filter(F.transform(F.split(_c(s), r"(?<=[a-z])(?=[A-Z])|[/_\-.: ]+"), F.lower), lambda x: x != "")


def like_escape(s) -> Column:
    """The text with ``\\``, ``%`` and ``_`` escaped, to stand in a LIKE pattern for itself."""
    return F.regexp_replace(_c(s), r"([\\%_])", r"\\$1")


def fqn_variants(s) -> Column:
    """Spellings of a full name: as written, with doubled separators collapsed, without the leading one."""
    once = F.regexp_replace(_c(s), r"\\\\+", r"\\")
    return F.array_distinct(F.array(_c(s), once, F.regexp_replace(once, r"^\\+", "")))


def resolve_type(name, imported, namespace) -> Column:
    """A type name in full: a leading separator makes it absolute, an import names it, a qualified name stays, a bare
    one stands in the file's namespace."""
    n = _c(name)
    joined = F.when(F.coalesce(F.length(_c(namespace)), F.lit(0)) > 0, F.concat(_c(namespace), F.lit("\\"), n)).otherwise(n)
    return F.when(n.startswith("\\"), F.regexp_replace(n, r"^\\+", "")).when(_c(imported).isNotNull(), _c(imported)).when(F.contains(n, F.lit("\\")), n).otherwise(joined)


def owner_class(s) -> Column:
    """The class part of ``Class::member``, or of ``a.b.member``; null without a separator."""
    n = _c(s)
    return F.when(F.contains(n, F.lit("::")), F.substring_index(n, "::", 1)).when(F.contains(n, F.lit(".")), F.regexp_extract(n, r"^(.*)\.[^.]*$", 1))


def owner_member(s) -> Column:
    """The member part of ``Class::member``, or of ``a.b.member``; the whole text without a separator."""
    n = _c(s)
    return F.when(F.contains(n, F.lit("::")), F.substring_index(n, "::", -1)).otherwise(F.substring_index(n, ".", -1))


def split_handler(s) -> tuple[Column, Column]:
    """Controller and action of ``Controller@action``, ``Controller::action`` or ``controller/action``; without a
    separator the action is ``index``."""
    n = F.regexp_replace(_c(s), "::|@", "/")
    has = F.contains(n, F.lit("/"))
    return F.when(has, F.regexp_extract(n, r"^(.*)/[^/]*$", 1)).otherwise(n), F.when(has, F.substring_index(n, "/", -1)).otherwise(F.lit("index"))


def route_app_segment(s) -> Column:
    """The first segment of a path, without parameters."""
    return F.nullif(F.regexp_extract(_c(s), r"^/?([^/:{?]*)", 1), F.lit(""))


def norm_class(s) -> Column:
    """A class reference in one spelling: no ``::class``, no quotes, no leading separator, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(_c(s)), r"""::class$|^['"]|['"]$""", ""), r"^\\+", ""))


def short_callee(s) -> Column:
    """The member that a callee names, behind ``::``, ``->`` or ``.``."""
    return F.regexp_extract(_c(s), r"([^:>.]*)$", 1)


def _path(s) -> Column:
    return F.lower(F.replace(_c(s), F.lit("\\"), F.lit("/")))


def is_test_path(s) -> Column:
    return F.coalesce(_path(s).rlike(r"(?:^|/)(?:tests?|__tests__|specs?|fixtures?)/|(?:[._-]test|[._-]spec|^test_|/test_)[^/]*$"), F.lit(False))


def is_generated_path(s) -> Column:
    return F.coalesce(_path(s).rlike(r"(?:^|/)(?:generated|dist|build|vendor|node_modules)/|\.(?:min|generated|g)\.[a-z]+$|\.pb\.go$"), F.lit(False))


GENERIC_METHODS = ("index", "list", "get", "set", "save", "create", "update", "delete", "read", "add", "edit", "find", "all", "count", "init", "run", "handle", "execute")


def is_generic_method(s) -> Column:
    return F.coalesce(F.lower(_c(s)).isin(*GENERIC_METHODS), F.lit(False))


def is_criteria_method(s) -> Column:
    """Builders of conditions such as ``andNameEqualTo``."""
    return F.coalesce(_c(s).rlike(r"^(?:and|or)[A-Z]\w*(?:EqualTo|GreaterThan|LessThan|Like|In|NotIn|Between|IsNull|IsNotNull)\w*$"), F.lit(False))


def is_identifier(s) -> Column:
    """One word of letters, digits and underscores that is not all small letters."""
    return F.coalesce(_c(s).rlike(r"^[A-Za-z_]\w*$") & ~_c(s).rlike("^[a-z]+$"), F.lit(False))


WRITE_WORDS = ("add", "create", "delete", "edit", "insert", "modify", "post", "remove", "save", "send", "set", "submit", "update", "upload")


def infer_write(method, path) -> Column:
    """Whether a contract writes: by its method, and where that is ``ANY`` or ``RULE`` by the words of its path."""
    words = F.arrays_overlap(action_words(path), F.array(*[F.lit(w) for w in WRITE_WORDS]))
    return F.when(F.upper(_c(method)).isin("ANY", "RULE", "*"), words).otherwise(http_write(method))


def variable_names(s) -> Column:
    """Distinct names of ``$variables`` of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(_c(s), F.lit(r"\$(\w+)"), F.lit(1)))


def has_sql_word(s) -> Column:
    return F.coalesce(_c(s).rlike(r"(?i)\b(?:select|insert|update|delete|where|from|set|values|join)\b"), F.lit(False))


def strip_variables(s) -> Column:
    return F.regexp_replace(_c(s), r"\{?\$\w+(?:->\w+|\[[^\]]*\])*\}?", "")


def split_file_line(s) -> tuple[Column, Column]:
    """Path and line of ``path:line``; without a line the whole text and null."""
    n = _c(s)
    has = n.rlike(r":\d+$")
    return F.when(has, F.regexp_extract(n, r"^(.*):\d+$", 1)).otherwise(n), F.when(has, F.regexp_extract(n, r":(\d+)$", 1).cast("long"))


STEPS |= {"snake": to_snake, "pluralize": pluralize, "class_to_topic": class_to_topic, "trim_slashes": lambda s: F.regexp_replace(s, "^/+|/+$", ""), "collapse_slashes": lambda s: F.regexp_replace(s, "/+", "/"), "strip_extension": lambda s: F.regexp_replace(s, r"\.[A-Za-z0-9]{1,5}$", "")}
