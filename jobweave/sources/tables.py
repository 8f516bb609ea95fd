"""Catalog tables and JDBC tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """A database table; with a numeric column and its bounds it is read in parallel."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties
    )


def read_source_tables(
    spark: SparkSession, url: str, properties: dict[str, str], split: dict[str, dict] | None = None
) -> dict[str, DataFrame]:
    """The four tables the warehouse path starts from.

    ``split`` gives for a table how it is read in parallel: ``column``, ``lower``, ``upper``, ``partitions``.
    """
    names = ("jobs", "users", "interactions", "report_static_source")
    return {t: read_jdbc(spark, url, t, properties, **(split or {}).get(t, {})) for t in names}


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "overwrite") -> None:
    df.write.jdbc(url, table, mode=mode, properties=properties)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """A catalog table; with a path it is an external one."""
    writer = df.write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def table_path(spark: SparkSession, name: str) -> str:
    """Folder of a saved table."""
    rows = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'")
    return rows.first()["data_type"]


def load_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
