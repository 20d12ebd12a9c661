"""Quality classifier: cumulative-link ordinal regression on graded ratings over hashed text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal
from .common import filtered


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from ``labels``: 0 poor, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, per_grade: int = ordinal.SAMPLE_PER_GRADE) -> ordinal.OrdinalModel | None:
    """Fit from rated documents on a bounded sample."""
    return ordinal.fit(ordinal.sample(docs, ratings(labels), per_grade), ordinal.STYLE)


def grade(docs: DataFrame, model: ordinal.OrdinalModel | None, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, expected_grade, p_usable (P(grade >= 1)), p_good (P(grade >= 2)), keep.

    ``keep`` selects documents that are more likely usable than poor.  Null and empty texts score as texts without
    words; a null ``doc_id`` stays null; repeated rows score alike; an empty table gives no row; other columns are
    ignored; without ratings of two grades scores are null and everything is kept.
    """
    out = ordinal.score(docs, model)
    p = F.try_element_at("tails", F.lit(1))
    return out.select("doc_id", F.col("expected").alias("expected_grade"), p.alias("p_usable"), F.try_element_at("tails", F.lit(2)).alias("p_good"), F.coalesce(p >= threshold, F.lit(True)).alias("keep"))


def keep(docs: DataFrame, model: ordinal.OrdinalModel | None, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns as they are, that ``grade`` keeps."""
    if model is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda texts: (shipped.value.tails(shipped.value.raw(texts))[:, 0] >= threshold).tolist())
