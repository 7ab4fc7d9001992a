"""Helpers that the corpus operators share: scratch tables in the shared folder, text defaults."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no shared folder, on a single machine only (tests, bench).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: The white space that every contract of this package means: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only if executors are threads of the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder, dropped when the operator has its result.

    A written table cuts the lineage: a lost executor costs the running tasks, not the stages behind them. What a returned
    DataFrame still reads is deleted when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/finfacts-{uuid.uuid4().hex}"
        self.names: list[str] = []
        self.count = 0

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, name: str) -> str:
        if not self.count:
            fs, root = self._fs(self.root)
            fs.mkdirs(root)
            fs.deleteOnExit(root)
        self.names.append(f"{self.root}/{self.count}-{name}")
        self.count += 1
        return self.names[-1]

    def table(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Write df and return the table's reader."""
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *but: str) -> None:
        for path in [n for n in self.names if n not in but]:
            fs, p = self._fs(path)
            fs.delete(p, True)
            self.names.remove(path)

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write the result, drop all other tables, return the result's reader."""
        out = self.table(df, name)
        self.drop(self.names[-1])
        return out


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
