"""Readers: explicit schemas, renames and column selection pushed to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaplate.functions.text import recode
from seaplate.sources.schemas import CATCH
from seaplate.vocab import FLEET_RENAMES


def read_table(spark: SparkSession, path: str, schema: str, file_format: str = "parquet") -> DataFrame:
    """A table with a known schema. In CSV files only the text ``NA`` is missing."""
    reader = spark.read.schema(schema)
    if file_format == "csv":
        reader = reader.option("header", True).option("nullValue", "NA").option("encoding", "UTF-8")
    return reader.format(file_format).load(path)


def fleet_renames(catch: DataFrame, renames: dict[str, str] = FLEET_RENAMES) -> DataFrame:
    return catch.withColumn("fishing_entity", recode("fishing_entity", renames))


def read_fact(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    schema: str = CATCH,
    renames: dict[str, str] = FLEET_RENAMES,
) -> DataFrame:
    """The catch table, with fleets under the names the other inputs use."""
    return fleet_renames(read_table(spark, path, schema, file_format), renames)


def read_dimension(
    df: DataFrame, columns: list[str], renames: dict[str, str] | None = None, drop_first: tuple[str, str] | None = None
) -> DataFrame:
    """Selected and renamed columns of a lookup; ``drop_first`` (column, value) drops a repeated header row."""
    if drop_first:
        column, value = drop_first
        df = df.filter(F.col(column).isNull() | (F.col(column) != value))
    return df.select(*[F.col(f"`{c}`") for c in columns]).withColumnsRenamed(renames or {})


def population_dim(wide: DataFrame, indicator: str, year: int) -> DataFrame:
    """(iso3c, pop) of one indicator and year of a table with one column per year."""
    return wide.filter(F.col("indicator") == indicator).select(
        F.col("country").alias("iso3c"), F.col(f"`{year}`").alias("pop")
    )


def coastal_population_dim(coastal: DataFrame) -> DataFrame:
    """(iso3c, pop) where only people within 20 km of the coast count."""
    return coastal.select("iso3c", F.col("km_20").alias("pop"))
