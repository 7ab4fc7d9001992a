"""As-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity(df: DataFrame, entity: str, known: str, tie: str) -> DataFrame:
    """Adds valid_from, valid_to: a row holds from its day until the next one's; of rows of one day the last by tie holds."""
    w = Window.partitionBy(entity).orderBy(known, tie)
    return df.withColumn("valid_from", F.col(known)).withColumn("valid_to", F.lead(known).over(w)).where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))


def asof_join(left: DataFrame, right: DataFrame, entity: str, date: str, known: str, tie: str) -> DataFrame:
    """Each left row with the latest right row known on its date (none: nulls).

    One shuffle by entity: both sides are stacked, sorted by (entity, day, side), and the last right row is carried
    forward. No pair of rows is formed that isn't in the result, however many right rows an entity has.
    """
    columns = [c for c in right.columns if c != entity]
    packed = F.struct(*[F.col(c) for c in columns])
    empty = F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType)
    a = left.select(F.col(entity), F.col(date).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.struct(*left.columns).alias("__l"), empty.alias("__r"))
    b = right.select(F.col(entity), F.col(known).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), packed.alias("__r"))
    w = Window.partitionBy(entity).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return found.select("__l.*", "__r.*")


def carry_forward(left: DataFrame, right: DataFrame, entity: str, date: str, right_date: str, value: str) -> DataFrame:
    """left with the latest right value whose date is not after its own."""
    small = right.select(entity, F.col(right_date).alias("__known"), F.col(value))
    return asof_join(left, small, entity, date, "__known", "__known").drop("__known")
