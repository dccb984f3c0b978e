"""The query catalogue: a Spark function and, where SQL can state it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DIGITS = 9  # doubles are compared after rounding: engines add them in different orders


def rounded(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.round(F.col(c).cast("double"), DIGITS) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] = ()):
    """Register a query; ``doubles`` names the columns that the SQL side rounds."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(spark, sf_dir))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            cells = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}" for c in doubles)
            SQL[name] = f"SELECT * REPLACE ({cells}) FROM ({sql})" if doubles else sql
        return build

    return register
