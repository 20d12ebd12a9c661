"""Recall around the scores: question analysis, alias expansion, boosts, seeds, ranking, quality, context text.

Question analysis runs on the driver over one question; everything over nodes is a Column or a join.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..operators.kinds import FLOW_EDGES
from .recall import STOP_WORDS

# Words that hint at node kinds.
HINTS = {"table": "Table", "api": "HttpContract", "endpoint": "HttpContract", "route": "HttpContract", "config": "ConfigKey", "event": "Event", "queue": "Queue", "cache": "Cache", "page": "Page", "schedule": "Schedule", "topic": "Topic"}
EVENT_WORDS = ("when", "after", "trigger", "listener", "event", "hook", "notify")
ACTION_WORDS = ("how", "implement", "calculate", "compute", "create", "update", "process", "handle", "generate", "send")
FLOW_WORDS = ("flow", "process", "chain", "step", "sequence", "lifecycle", "through")
CONFIG_WORDS = ("config", "setting", "value", "default", "threshold", "switch")


def is_cjk(c: str) -> bool:
    return "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "぀" <= c <= "ヿ" or "가" <= c <= "힯"


def cjk_runs(text: str) -> list[str]:
    """Runs of characters of scripts without spaces."""
    out, run = [], ""
    for c in text:
        if is_cjk(c):
            run += c
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


def segment(run: str, words: set[str], longest: int = 6) -> list[str]:
    """Longest known words from the left; what lies between gives bigrams of neighbouring unknown characters."""
    out, unknown, i = [], "", 0

    def flush():
        nonlocal unknown
        out.extend([unknown] if len(unknown) == 1 else [unknown[j : j + 2] for j in range(len(unknown) - 1)])
        unknown = ""

    while i < len(run):
        for n in range(min(longest, len(run) - i), 1, -1):
            if run[i : i + n] in words:
                flush()
                out.append(run[i : i + n])
                i += n
                break
        else:
            unknown += run[i]
            i += 1
    flush()
    return out


def parse(question: str, words: set[str] = frozenset()) -> tuple[list[str], list[str]]:
    """Distinct terms of a question, without stop words, and the node kinds that its words hint at."""
    terms: list[str] = []
    for word in re.findall(r"[^\W_]+(?:[_.\-/][^\W_]+)*", question.lower()):
        if any(map(is_cjk, word)):
            for run in cjk_runs(word):
                terms += segment(run, words)
            terms += [x for x in re.split("[぀-鿿豈-﫿가-힯]+", word) if x]
        else:
            terms.append(word)
    hints = list(dict.fromkeys(HINTS[t.removesuffix("s")] for t in terms if t.removesuffix("s") in HINTS))
    return list(dict.fromkeys(t for t in terms if t not in STOP_WORDS)), hints


def split_intents(question: str) -> list[str]:
    """Parts of a question that joins several: at line ends, semicolons and ``and also``/``as well as``; empty parts go."""
    parts = re.split(r"[\n;；]+|\band also\b|\bas well as\b|(?<=\?)\s+", question)
    return [p.strip() for p in parts if p.strip()]


def intents(question: str) -> dict[str, bool]:
    """Which kinds of intent a question's words show."""
    own = set(re.findall(r"\w+", question.lower()))
    has = lambda words: any(w in own or w + "s" in own for w in words)
    return {"event": has(EVENT_WORDS), "action": has(ACTION_WORDS), "flow": has(FLOW_WORDS), "config_value": has(CONFIG_WORDS)}


def expand_terms(question: str, terms: list[str], aliases: dict[str, list[str]]) -> list[str]:
    """Terms with the aliases whose key occurs in the question."""
    low = question.lower()
    return list(dict.fromkeys([*terms, *(t for key, more in aliases.items() if key in low for t in more)]))


def bridge_terms(texts: DataFrame, question_terms: list[str], most: int = 10) -> DataFrame:
    """(token, n): identifier tokens of the keys whose translated text (key, text) holds a term, most frequent first."""
    held = F.lit(False)
    for t in question_terms:
        held = held | F.contains(F.lower("text"), F.lit(t.lower()))
    tokens = texts.where(held).select(F.explode(F.array_distinct(naming.ident_tokens("key"))).alias("token"))
    return tokens.where(F.length("token") > 2).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)


def cohesion(groups: Column) -> Column:
    """1, and 0.3 more for each further group of terms a node meets, up to three."""
    return 1 + 0.3 * F.least(F.greatest(groups - 1, F.lit(0)), F.lit(3))


def anchor(name: Column, terms: list[str]) -> Column:
    """3.0 where the name is a term, 2.2 where one of its tokens is, 1.6 where it begins with one, else 1."""
    low, tokens = F.lower(name), naming.ident_tokens(name)
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    begins = F.exists(wanted, lambda t: F.startswith(low, t))
    return F.when(F.array_contains(wanted, low), 3.0).when(F.arrays_overlap(tokens, wanted), 2.2).when(begins, 1.6).otherwise(1.0)


def concept(text: Column, clusters: list[list[str]]) -> Column:
    """1.5 for the first cluster of words that a text touches, 1.2 for each other."""
    touched = sum((F.when(F.coalesce(text.rlike("(?i)" + "|".join(map(re.escape, c))), F.lit(False)), 1).otherwise(0) for c in clusters), F.lit(0))
    return F.when(touched == 0, 1.0).otherwise(1.5 * F.pow(F.lit(1.2), touched - 1))


def noise(path: Column, name: Column) -> Column:
    """What test and generated files and everyday methods keep of their score."""
    return F.when(naming.is_test_path(path), 0.3).otherwise(1.0) * F.when(naming.is_generated_path(path), 0.55).otherwise(1.0) * F.when(naming.is_generic_method(name), 0.45).otherwise(1.0)


def hub_decay(fan: Column) -> Column:
    """1 up to 60 edges; beyond, falling to 0.4."""
    return F.when(fan <= 60, 1.0).otherwise(0.4 + 0.6 * F.exp(-(fan - 60) / 200.0))


def merged_seeds(lexical: DataFrame, vector: DataFrame, top_lexical: int = 5, top_vector: int = 4) -> DataFrame:
    """(id, score, origin): the best lexical hits and the best vector hits; a node of both is lexical."""
    a = lexical.orderBy(F.desc("score"), "id").limit(top_lexical).select("id", "score", F.lit("lexical").alias("origin"))
    b = vector.orderBy(F.desc("score"), "id").limit(top_vector).select("id", "score", F.lit("vector").alias("origin"))
    return a.unionByName(b.join(a, "id", "left_anti"))


def event_seeds(nodes: DataFrame, terms: list[str], idf: DataFrame, floor: float = 400.0, most: int = 10) -> DataFrame:
    """(id, score): event nodes that hold a term, at ``floor`` plus 20 times the idf of what they hold."""
    own = nodes.where(F.col("kind").isin("Event", "EventBus", "Topic", "Queue"))
    met = own.join(F.broadcast(idf.where(F.col("term").isin(terms))), F.contains(F.lower("name"), F.col("term")))
    return met.groupBy("id").agg((floor + 20 * F.sum(F.coalesce("idf", F.lit(0.0)))).alias("score")).orderBy(F.desc("score"), "id").limit(most)


def one_contract_a_name(hits: DataFrame) -> DataFrame:
    """Of the contracts of one name the back end's, then the best scored; other nodes stay."""
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(F.coalesce(F.col("side") == "backend", F.lit(False))), F.desc("score"), "id"))
    contracts = hits.where("kind = 'HttpContract'").withColumn("_n", place).where("_n = 1").drop("_n")
    return hits.where("kind <> 'HttpContract'").unionByName(contracts)


def flow_order(hits: DataFrame, chain: DataFrame, fans: DataFrame) -> DataFrame:
    """hits (id, score) in order of flow: those on the chain (id, depth) first, by depth, then by score after hub decay."""
    own = hits.join(chain, "id", "left").join(fans.select("id", "fan"), "id", "left")
    decayed = F.col("score") * hub_decay(F.coalesce("fan", F.lit(0)))
    return own.select("id", F.col("depth").isNotNull().alias("on_chain"), F.coalesce("depth", F.lit(0)).alias("depth"), F.round(decayed, 6).alias("score")).orderBy(F.desc("on_chain"), "depth", F.desc("score"), "id")


def flow_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Flow edges between hits (id)."""
    own = edges.where(F.col("kind").isin(*FLOW_EDGES))
    return own.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")


def quality(hits: DataFrame, terms: list[str]) -> DataFrame:
    """One row: coverage (share of terms that some hit's name holds), gap (1 - second / first score), cohesion (share of
    hits that hold two terms or more), confidence = 0.65 coverage + 0.35 gap, tier (high from 0.6, medium from 0.35)."""
    held = [F.contains(F.lower("name"), F.lit(t.lower())) for t in terms]
    place = hits.orderBy(F.desc("score"), "id").limit(2).agg(F.max("score").alias("first"), F.min("score").alias("second"), F.count("*").alias("n"))
    count = sum((F.when(h, 1).otherwise(0) for h in held), F.lit(0))
    sums = hits.agg(sum((F.coalesce(F.max(h.cast("int")), F.lit(0)) for h in held), F.lit(0)).alias("covered"), F.coalesce(F.avg((count >= 2).cast("double")), F.lit(0.0)).alias("cohesion"), F.count("*").alias("hits"))
    both = sums.join(F.broadcast(place), F.lit(True))  # one row each
    gap = F.when(F.col("hits") == 0, 0.0).when(F.col("n") < 2, 1.0).otherwise(1 - F.try_divide("second", "first"))
    out = both.select("hits", (F.col("covered") / max(1, len(terms))).alias("coverage"), F.round(F.coalesce(gap, F.lit(0.0)), 6).alias("gap"), F.round("cohesion", 6).alias("cohesion"))
    out = out.withColumn("confidence", F.round(0.65 * F.col("coverage") + 0.35 * F.col("gap"), 6))
    return out.withColumn("tier", F.when(F.col("confidence") >= 0.6, "high").when(F.col("confidence") >= 0.35, "medium").otherwise("low"))


def worst(qualities: DataFrame) -> DataFrame:
    """Quality of several intents: the worst tier and the least confidence."""
    rank = F.when(F.col("tier") == "low", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    return qualities.agg(F.min("confidence").alias("confidence"), F.min_by("tier", rank).alias("tier"))


def snippets(hits: DataFrame, files: DataFrame, before: int = 2, after: int = 3, most_files: int = 8, most_bytes: int = 128 << 10) -> DataFrame:
    """(id, path, first, lines): the lines around a hit (id, path, line, score) from files (path, text), for the hits of
    the best ``most_files`` files of up to ``most_bytes``."""
    best = hits.groupBy("path").agg(F.max("score").alias("top")).orderBy(F.desc("top"), "path").limit(most_files)
    own = hits.join(best, "path", "left_semi").join(files.where(F.length("text") <= most_bytes), "path")
    lines, first = F.split("text", "\n"), F.greatest(F.col("line") - before, F.lit(1))
    return own.select("id", "path", first.cast("int").alias("first"), F.slice(lines, first.cast("int"), (F.col("line") + after - first + 1).cast("int")).alias("lines"))


def markdown(question: str, hits: list, quality_row=None) -> str:
    """The context text of the listed hits (name, kind, score and, where present, path, line, relations, lines)."""
    out = [f"# {question.strip()}", ""]
    if quality_row is not None:
        out += [f"confidence: {quality_row['confidence']:.2f} ({quality_row['tier']})", ""]
    for i, h in enumerate(hits, 1):
        h = h.asDict() if hasattr(h, "asDict") else dict(h)
        out.append(f"{i}. **{h['name']}** ({h['kind']}, {h['score']:.1f})")
        if h.get("path"):
            out.append(f"   - {h['path']}:{h.get('line') or 1}")
        if h.get("relations"):
            out.append(f"   - {h['relations']}")
        if h.get("lines"):
            out += ["   ```", *(f"   {x}" for x in h["lines"]), "   ```"]
    return "\n".join(out) + "\n"


def prompt_tokens(text: str) -> int:
    """A rough number of tokens: a CJK character is one, four other characters are one."""
    cjk = sum(map(is_cjk, text))
    return cjk + math.ceil((len(text) - cjk) / 4)


# Fixed values of the 64-bit FNV-1a hash.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = FNV_START
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def hashed_vector(text: str, dim: int = 256) -> list[float]:
    """A unit vector of signed feature counts: words, their parts and character trigrams."""
    out = [0.0] * dim
    words = re.findall(r"[^\W_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text or "").lower())
    features = [f"w:{w}" for w in words] + [f"t:{w[i : i + 3]}" for w in words for i in range(len(w) - 2)] + [f"b:{a} {b}" for a, b in zip(words, words[1:])]
    for f in features:
        h = fnv1a(f.encode())
        out[h % dim] += 1.0 if (h >> 63) & 1 else -1.0
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


def embed(texts: DataFrame, dim: int = 256, encoder=hashed_vector) -> DataFrame:
    """texts (id, text) with ``v``: vectors by an encoder function, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: encoder(t, dim))

    return texts.withColumn("v", run("text"))


def vector_store(stored: DataFrame, texts: DataFrame, version: str, dim: int = 256, encoder=hashed_vector) -> DataFrame:
    """The stored vectors (text_hash, version, dim, v) of a version with those of texts (text) that it lacks; vectors of
    other versions or dimensions go.  The caller swaps the result in."""
    kept = stored.where((F.col("version") == version) & (F.col("dim") == dim))
    asked = texts.select(F.sha2("text", 256).alias("text_hash"), "text").dropDuplicates(["text_hash"])
    missing = asked.join(kept.select("text_hash"), "text_hash", "left_anti")
    made = embed(missing, dim, encoder).select("text_hash", F.lit(version).alias("version"), F.lit(dim).alias("dim"), "v")
    return kept.select("text_hash", "version", "dim", "v").unionByName(made)


def warm_up_order(nodes: DataFrame) -> DataFrame:
    """Nodes (id, kind, text) in the order of encoding: kind priority, then shorter texts, then id."""
    rank = F.when(F.col("kind").isin("HttpContract", "Table"), 0).when(F.col("kind").isin("Event", "Queue", "Topic", "ConfigKey"), 1).when(F.col("kind").isin("Method", "Function"), 2).otherwise(3)
    return nodes.withColumn("rank", rank).orderBy("rank", F.length("text"), "id")
