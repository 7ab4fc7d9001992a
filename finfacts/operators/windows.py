"""Window operators over an entity's ordered periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(entity: str = "entity_id", period: str = "period_end") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(period)


def trailing(columns: Sequence[str], n: int = 4, w: WindowSpec | None = None, suffix: str = "_ttm") -> dict[str, Column]:
    """Sums of the last n rows, and how many there are."""
    frame = (w or ordered()).rowsBetween(1 - n, 0)
    return {f"{c}{suffix}": F.sum(c).over(frame) for c in columns} | {"quarters_in_window": F.count(F.lit(1)).over(frame)}


def two_point_average(column: str, w: WindowSpec | None = None) -> Column:
    return (F.col(column) + F.lag(column).over(w or ordered())).cast("double") / 2


def last_n_weighted(column: str, n: int = 20, w: WindowSpec | None = None) -> tuple[Column, Column, Column]:
    """Over the last n rows, the newest first: plain sum, sum weighted n, n - 1, ..., and the number of rows. Missing values are 0."""
    history = F.reverse(F.collect_list(F.coalesce(F.col(column), F.lit(0)).cast("decimal(28,4)")).over((w or ordered()).rowsBetween(1 - n, 0)))
    zero = F.lit(0).cast("decimal(38,4)")
    weighted = F.transform(history, lambda x, i: (x * (n - i)).cast("decimal(38,4)"))
    add = lambda a, x: (a + x).cast("decimal(38,4)")
    return F.aggregate(history, zero, add), F.aggregate(weighted, zero, add), F.size(history)


def first_in_bucket(df: DataFrame, entity: str, date: str, grain: str) -> DataFrame:
    """An entity's first row of each month, quarter or year."""
    w = Window.partitionBy(entity, F.date_trunc(grain, F.col(date))).orderBy(date)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"__n <= {n}").drop("__n")


def islands(df: DataFrame, keys: Sequence[str], order: str, label: str) -> DataFrame:
    """Numbers runs of rows with the same label."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.lag(label).over(w).eqNullSafe(F.col(label)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w)).drop("__new")


def discrete_from_ytd(column: str, entity: str, fiscal_year: str, quarter: str) -> Column:
    """A quarter's own value from year-to-date values."""
    before = F.lag(column).over(Window.partitionBy(entity, fiscal_year).orderBy(quarter))
    return F.when(F.col(quarter) == 1, F.col(column)).otherwise(F.col(column) - before)
