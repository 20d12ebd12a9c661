"""Queries of recall: lexical and vector scores, seeds, expansion, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.kinds import CHAIN_EDGES, sql_list
from . import recall
from .projection import Graph
from .registry import query

TERMS = ["order_1", "get", "an"]


def _best(t: str) -> str:
    return f"greatest(CASE WHEN lower(name) = '{t}' THEN 100.0 WHEN starts_with(lower(name), '{t}') THEN 70.0 WHEN contains(lower(name), '{t}') THEN 50.0 ELSE 0.0 END, CASE WHEN contains(lower(coalesce(fqn, '')), '{t}') THEN 35.0 ELSE 0.0 END)"


_WEIGHT = "CASE WHEN kind IN ('Table', 'HttpContract', 'Event', 'Queue', 'Cache', 'Topic', 'Schedule') THEN 1.4 WHEN kind IN ('ConfigKey', 'I18nKey', 'Page', 'EventBus') THEN 1.2 WHEN kind IN ('Class', 'Interface', 'Trait', 'Enum') THEN 1.1 WHEN kind IN ('Method', 'Function') THEN 1.0 ELSE 0.8 END"
_LEXICAL = f", b AS (SELECT id, name, kind, {', '.join(f'CAST({_best(t)} AS DOUBLE) AS s{i}' for i, t in enumerate(TERMS))} FROM nodes), fan AS (SELECT to_id, count(*) AS n FROM edges WHERE kind IN ({sql_list(CHAIN_EDGES)}) GROUP BY to_id), hits AS (SELECT b.id, name, kind, CAST(round((s0 + s1 + s2) * (CASE WHEN (s0 > 0)::INT + (s1 > 0)::INT + (s2 > 0)::INT >= 2 THEN 1.5 ELSE 1.0 END) * {_WEIGHT} + CASE WHEN kind = 'Table' THEN 30 ELSE 0 END + least(coalesce(n, 0), 20) * 0.4, 6) AS DOUBLE) AS score FROM b LEFT JOIN fan ON to_id = b.id WHERE s0 + s1 + s2 > 0)"


def _hits(g: Graph):
    return recall.lexical(g.nodes, g.edges, TERMS, ("Table",))


@query("recall_lexical", f"{_LEXICAL} SELECT id, name, kind, score FROM hits")
def lexical(g: Graph):
    return _hits(g)


@query("recall_best_hits", f"{_LEXICAL} SELECT id, name, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS place FROM hits) WHERE place <= 2 ORDER BY score DESC, id LIMIT 10")
def best(g: Graph):
    return recall.best_hits(_hits(g))


@query("recall_idf", "SELECT term, df, CASE WHEN df > 0 THEN round(ln(n / df), 6) END AS idf FROM (SELECT count(*) AS n FROM nodes), (" + " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) FILTER (WHERE contains(lower(name), '{t}')) AS df FROM nodes" for t in TERMS) + ")")
def idf(g: Graph):
    return recall.idf(g.nodes, TERMS)


@query("recall_vector", "SELECT v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) * 200, 4) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.1", graph=False)
def vector(g: Graph):
    vectors = g.table("embeddings")
    asked = vectors.where("vec_id = 7").select("embedding").first().embedding
    return recall.vector_scores(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), asked, 0.1).select("id", F.round("score", 4).alias("score"))


_SEEDS = "seeds AS (SELECT id, score FROM hits ORDER BY score DESC, id LIMIT 5)"


@query("recall_expand", f"{_LEXICAL}, {_SEEDS}, s AS (SELECT from_id, to_id FROM edges WHERE kind IN ({sql_list(CHAIN_EDGES)}) UNION SELECT to_id, from_id FROM edges WHERE kind IN ({sql_list(CHAIN_EDGES)})), h1 AS (SELECT to_id AS id, max(score) * 0.5 AS score FROM seeds JOIN s ON from_id = id WHERE to_id NOT IN (SELECT id FROM seeds) GROUP BY to_id), h2 AS (SELECT to_id AS id, max(score) * 0.5 AS score FROM h1 JOIN s ON from_id = id WHERE to_id NOT IN (SELECT id FROM seeds UNION SELECT id FROM h1) GROUP BY to_id) SELECT id, round(score, 4) AS score, 0 AS hop FROM seeds UNION ALL SELECT id, round(score, 4), 1 FROM h1 UNION ALL SELECT id, round(score, 4), 2 FROM h2")
def expand(g: Graph):
    seeds = _hits(g).orderBy(F.desc("score"), "id").limit(5).select("id", "score")
    return recall.expand(seeds, g.edges).select("id", F.round("score", 4).alias("score"), "hop")
