"""A second look at candidates by any scorer of pairs of texts.

A scorer is given as something that makes it, called once a task, where a model would be loaded; it then scores batches of pairs.
The order is by score, then by the place that the candidate had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def rescored(pairs: DataFrame, make: Callable[[], Scorer], limit: int | None = None, threshold: float | None = None) -> DataFrame:
    """pairs (query_id, query, doc_id, text, place) as query_id, doc_id, place, score, second (from 1): the place by score. Candidates under
    threshold, and those beyond limit, are left out. Null texts are empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make()
        for queries, texts in batches:
            yield pd.Series(scorer(queries.tolist(), texts.tolist()), dtype="float64")

    told = pairs.select("query_id", "doc_id", "place", score(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit(""))).alias("score"))
    kept = told if threshold is None else told.filter(F.col("score") >= threshold)
    ranked = kept.withColumn("second", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place", "doc_id")))
    return ranked if limit is None else ranked.filter(F.col("second") <= limit)


def shared_words() -> Scorer:
    """Shared distinct words over all distinct words of the two texts."""

    def scores(queries: Sequence[str], texts: Sequence[str]) -> list[float]:
        sets = [(set(q.lower().split()), set(t.lower().split())) for q, t in zip(queries, texts)]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]

    return scores
