"""Toxicity: expected severity by cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import ordinal


def graded(rows: list) -> list:
    """Severity grades 0, 1, 2 from texts labelled 0 or 1: a labelled text is severe (2) where it has more of the
    terms that mark labelled texts than the median labelled text."""
    toxic = [set(ordinal.term_tokens(r.text)[0]) for r in rows if r.grade]
    other: Counter = Counter()
    for r in rows:
        if not r.grade:
            other.update(set(ordinal.term_tokens(r.text)[0]))
    seen: Counter = Counter()
    for words in toxic:
        seen.update(words)
    clean = sum(1 for r in rows if not r.grade)
    marks = {w for w, n in seen.items() if n >= 5 and n * max(1, clean) > 8 * (other[w] + 1) * max(1, len(toxic))}
    amounts = iter([len(words & marks) for words in toxic])
    sizes = sorted(len(words & marks) for words in toxic)
    middle = sizes[len(sizes) // 2] if sizes else 0
    return [Row(text=r.text, grade=(2 if next(amounts) > middle else 1) if r.grade else 0) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, per_grade: int = ordinal.SAMPLE_PER_GRADE) -> ordinal.OrdinalModel | None:
    """Fit from ``labels`` (doc_id, toxic 0/1) on a bounded sample of labelled documents."""
    rows = ordinal.sample(docs, labels.select("doc_id", F.col("toxic").alias("grade")), per_grade)
    return ordinal.fit(graded(rows), ordinal.TERMS)


def severity(docs: DataFrame, model: ordinal.OrdinalModel | None, threshold: float = 0.75) -> DataFrame:
    """Per document: doc_id, expected_severity, p_toxic (P(severity >= 1)), p_severe (P(severity >= 2)), toxic.

    Null and empty texts score as texts without words; a null ``doc_id`` stays null; repeated rows score alike;
    an empty table gives no row; other columns are ignored; without labels of both kinds scores are null, toxic false.
    """
    out = ordinal.score(docs, model)
    p = F.try_element_at("tails", F.lit(1))
    return out.select("doc_id", F.col("expected").alias("expected_severity"), p.alias("p_toxic"), F.coalesce(F.try_element_at("tails", F.lit(2)), F.when(p.isNotNull(), F.lit(0.0))).alias("p_severe"), F.coalesce(p >= threshold, F.lit(False)).alias("toxic"))
