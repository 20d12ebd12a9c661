"""Hybrid recall: lexical and vector scores, seeds, expansion with decay, ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.kinds import CHAIN_EDGES
from ..operators.staging import stage

# Weights of node kinds, by default and for questions after an implementation.
KIND_WEIGHT = {**dict.fromkeys(("Table", "HttpContract", "Event", "Queue", "Cache", "Topic", "Schedule"), 1.4), **dict.fromkeys(("ConfigKey", "I18nKey", "Page", "EventBus"), 1.2), **dict.fromkeys(("Class", "Interface", "Trait", "Enum"), 1.1), **dict.fromkeys(("Method", "Function"), 1.0)}
ACTION_WEIGHT = {**dict.fromkeys(("Method", "Function"), 1.5), **dict.fromkeys(("Class", "Interface", "Trait", "Enum"), 1.3), "Table": 1.4, **dict.fromkeys(("ConfigKey", "I18nKey", "Page", "EventBus"), 1.2), **dict.fromkeys(("HttpContract", "Event", "Queue", "Topic", "Cache", "Schedule"), 0.7)}
STOP_WORDS = frozenset("a an and are by do does for from how in is of on or the to what where which who with".split())


def terms_of(question: str) -> list[str]:
    """Distinct lower-case words of a question without stop words."""
    return list(dict.fromkeys(w for w in re.findall(r"\w+", question.lower()) if w not in STOP_WORDS))


def weight(action: bool = False) -> Column:
    table, other = (ACTION_WEIGHT, 0.9) if action else (KIND_WEIGHT, 0.8)
    out = F.lit(other)
    for value in sorted(set(table.values())):
        out = F.when(F.col("kind").isin(*[k for k, v in table.items() if v == value]), F.lit(value)).otherwise(out)
    return out


def chain_fan_in(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind").isin(*CHAIN_EDGES)).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("chain_in"))


def lexical(nodes: DataFrame, edges: DataFrame, terms: list[str], hints: tuple[str, ...] = (), action: bool = False) -> DataFrame:
    """(id, name, kind, score): per term the best of whole name 100, prefix 70, inside 50, identity 45, full name 35;
    half as much again for two terms; kind weight; 30 for a hinted kind; 0.4 per incoming chain edge up to 20.

    Scores are Columns over one scan; only nodes that match meet the edges."""
    low = F.lower("name")
    fqn = F.lower(F.coalesce("fqn", F.lit("")))
    best = []
    for t in (F.lit(t.lower()) for t in terms):
        by_name = F.when(low == t, 100.0).when(F.startswith(low, t), 70.0).when(F.contains(low, t), 50.0).otherwise(0.0)
        by_fqn = F.when(F.contains(fqn, t), 35.0).otherwise(0.0)
        best.append(F.greatest(by_name, by_fqn))
    total = sum(best[1:], best[0])
    matched = sum((F.when(b > 0, 1).otherwise(0) for b in best[1:]), F.when(best[0] > 0, 1).otherwise(0))
    hit = nodes.withColumn("raw", total * F.when(matched >= 2, 1.5).otherwise(1.0)).where("raw > 0")
    scored = hit.withColumn("score", F.col("raw") * weight(action) + (F.when(F.col("kind").isin(*hints), 30.0).otherwise(0.0) if hints else F.lit(0.0)))
    fan = chain_fan_in(edges.join(hit.select(F.col("id").alias("to_id")), "to_id", "left_semi"))
    return scored.join(fan, "id", "left").select("id", "name", "kind", F.round(F.col("score") + F.least(F.coalesce("chain_in", F.lit(0)), F.lit(20)) * 0.4, 6).alias("score"))


def cosine(a: str | Column, b: str | Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_scores(vectors: DataFrame, query: list[float], least: float = 0.3, scale: float = 200.0) -> DataFrame:
    """(id, score): cosine times ``scale`` where it reaches ``least``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("c", cosine("v", q)).where(F.col("c") >= least).select("id", F.round(F.col("c") * scale, 6).alias("score"))


def best_hits(hits: DataFrame, limit: int = 10, per_name: int = 2) -> DataFrame:
    """Highest scores first (ties: smaller id), at most ``per_name`` of one name."""
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "id"))
    return hits.withColumn("_n", place).where(F.col("_n") <= per_name).drop("_n").orderBy(F.desc("score"), "id").limit(limit)


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, decay: float = 0.5) -> DataFrame:
    """(id, score, hop): neighbours of seeds (id, score) over chain edges, the score decaying by hop; the best score
    of each node, seeds included at hop 0."""
    own = edges.where(F.col("kind").isin(*CHAIN_EDGES))
    step = own.select(F.col("from_id").alias("id"), F.col("to_id").alias("next")).union(own.select("to_id", "from_id")).distinct()
    step = stage(step)
    known = stage(seeds.select("id", "score", F.lit(0).alias("hop")))
    frontier = known
    for hop in range(1, hops + 1):
        found = frontier.join(step, "id").groupBy(F.col("next").alias("id")).agg((F.max("score") * decay).alias("score"))
        frontier = stage(found.join(known.select("id").distinct(), "id", "left_anti").withColumn("hop", F.lit(hop)))
        known = known.unionByName(frontier)
    return known


def idf(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df, idf): nodes whose name holds a term, and ln(N / df); one scan for all terms."""
    counts = nodes.agg(F.count("*").alias("n"), *[F.count_if(F.contains(F.lower("name"), F.lit(t.lower()))).alias(f"t{i}") for i, t in enumerate(terms)])
    return counts.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)])).alias("x")).select("x.term", "x.df", F.round(F.when(F.col("x.df") > 0, F.ln(F.col("n") / F.col("x.df"))), 6).alias("idf"))
