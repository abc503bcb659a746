"""Tables of a database over JDBC, in partitions that the database answers side by side.

A table is cut by ranges of a whole-number column. The bounds of the column are asked of the
database (a pushed aggregate, one row), every range is a predicate of its own, and what a query filters and selects goes to the
database too. The first range also takes the nulls, so no row is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Partitions of a table; each is one connection.
PARTITIONS = 8


def ranges(column: str, least: int | None, most: int | None, n: int = PARTITIONS) -> list[str]:
    """Predicates that every row meets exactly one of; one for all where there are no bounds."""
    if least is None:
        return ["1 = 1"]
    n = max(1, min(n, most - least + 1))
    cuts = [least + (most - least + 1) * k // n for k in range(1, n)]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def table(spark: SparkSession, url: str, name: str, column: str | None = None, n: int = PARTITIONS, **properties: str) -> DataFrame:
    """A table of the database; with a column in n ranges of it."""
    if column is None:
        return spark.read.jdbc(url, name, properties=properties)
    found = spark.read.jdbc(url, name, properties=properties).agg(F.min(column), F.max(column)).first()
    return spark.read.jdbc(url, name, predicates=ranges(column, found[0], found[1], n), properties=properties)


def save(df: DataFrame, url: str, name: str, mode: str = "append", **properties: str) -> None:
    """Rows into a table; each partition is a transaction of its own, so a key in the table should refuse what a repeated task writes again."""
    df.write.jdbc(url, name, mode, properties=properties)
