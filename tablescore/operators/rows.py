"""Rows of tables as rows of a DataFrame: a table function, called from a lateral join or from SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import grid
from .scoring import FAILURES

NAME = "table_rows"


@F.udtf(returnType="row_index int, cells array<string>", useArrow=False)
class TableRows:
    """(row_index, cells) of each span-expanded row of an HTML text; none of a null or of one whose grid cannot be built.
    Without Arrow, as it would make a batch of each single text."""

    def eval(self, html: str) -> Iterator[tuple[int, list[str]]]:
        try:
            rows = [] if html is None else grid(html)
        except FAILURES:
            rows = []
        yield from enumerate(rows)


def register(spark: SparkSession, name: str = NAME) -> None:
    """For SQL: select ... from t, lateral table_rows(t.html)."""
    spark.udtf.register(name, TableRows)


def table_rows(df: DataFrame, html: str) -> DataFrame:
    """df with a row for each row of the tables in a column; rows of df without any are left out."""
    return df.lateralJoin(TableRows(F.col(html).outer()))
