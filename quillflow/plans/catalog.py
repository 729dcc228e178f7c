"""All queries of the retrieval operators, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audits, compose, corpus, evaluation, retrieval


def _plain(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with whole numbers as bigint and others as double, as the SQL gives them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
        return df.select(*[F.col(f"`{c}`").cast(kinds[t]).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in df.dtypes])

    return run


PARTS = (retrieval, corpus, evaluation, audits, compose)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _plain(q) for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
