"""Load and store the canonical tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from docfields.schemas import TABLES


def read_tables(
    spark: SparkSession, directory: str, names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """Read the canonical tables below ``directory`` with their declared schemas (no inference)."""
    return {
        name: spark.read.schema(TABLES[name]).parquet(f"{directory}/{name}")
        for name in (names or TABLES)
    }


def read_jdbc_table(
    spark: SparkSession, url: str, name: str, partition_column: str,
    lower: int, upper: int, partitions: int, **options: str,
) -> DataFrame:
    """Read one table from a relational store in ``partitions`` parallel range slices."""
    reader = (
        spark.read.format("jdbc").option("url", url).option("dbtable", name)
        .option("partitionColumn", partition_column)
        .option("lowerBound", str(lower)).option("upperBound", str(upper))
        .option("numPartitions", str(partitions))
    )
    return reader.options(**options).load()


def write_table(df: DataFrame, directory: str, name: str, partition_by: list[str] | None = None) -> None:
    """Overwrite one canonical table as Parquet."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{directory}/{name}")
