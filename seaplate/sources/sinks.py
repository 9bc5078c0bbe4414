"""Writers: staged tables between steps and final CSV tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaplate.session import staging_path


def stage_table(df: DataFrame, name: str, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or staging_path(spark, name)
    df.write.mode("error").partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


class Staging:
    """The staged tables of one analysis by name, each written once, and independent ones at the same time.

    A step asks for the tables it needs; one that another step is just writing is waited for. So steps
    run together in the order that their needs leave, and Spark shares its cores between their jobs.
    """

    def __init__(self) -> None:
        self._tables: dict[str, Future] = {}
        self._lock = Lock()

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, written from ``build`` by the first step that asks for it."""
        with self._lock:
            first = name not in self._tables
            future = self._tables.setdefault(name, Future())
        if first:
            try:
                future.set_result(stage_table(build(), name))
            except BaseException as error:
                future.set_exception(error)
                raise
        return future.result()

    def together(self, *steps: Callable[[], DataFrame]) -> list[DataFrame]:
        """The results of steps that are run side by side, in their order; the first error among them is raised."""
        with ThreadPoolExecutor(len(steps)) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(SparkSession.active())(step)) for step in steps]]


def stage_by_year(catch: DataFrame, path: str | None = None) -> DataFrame:
    """The catch as one folder per year, so that a year is read without the others.

    Rows are gathered by year, and Spark splits a large year over as many tasks
    as its size asks for.
    """
    return stage_table(catch.hint("rebalance", "year"), "catch", path, ["year"])


def year_slice(staged: DataFrame, year: int) -> DataFrame:
    return staged.filter(F.col("year") == year)


def export_csv(df: DataFrame, path: str) -> str:
    """Write ``df`` as CSV part files with a header; missing values are written as NA."""
    df.write.mode("error").option("header", True).option("nullValue", "NA").option("encoding", "UTF-8").csv(path)
    return path
