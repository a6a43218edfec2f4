"""Queries given as SQL text: one text for Spark and DuckDB where the dialects agree, else one for each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnsift.session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """Run text over the tables that it names, as temporary views."""
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in names:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


def pairs(texts: dict[str, str | tuple[str, str]]) -> tuple[dict, dict[str, str]]:
    """queries and oracle texts of {key: text or (Spark text, DuckDB text)}."""
    both = {k: (v, v) if isinstance(v, str) else v for k, v in texts.items()}
    return {k: sql_query(v[0]) for k, v in both.items()}, {k: v[1] for k, v in both.items()}
