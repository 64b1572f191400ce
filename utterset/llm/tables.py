"""Reading the given tables and writing intermediate ones in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it again:
    what follows neither recomputes it nor depends on the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with more columns, name=type."""
    more = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its columns of these names (in any case), which an operator adds itself."""
    return df.drop(*[c for c in df.columns if c.lower() in names])
