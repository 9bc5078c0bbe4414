from threading import Barrier

import pytest
from pyspark.sql import functions as F

from seaplate import session
from seaplate.operators.catch import gear_sector_filter
from seaplate.sources import readers, sinks
from seaplate.sources.schemas import CATCH, balance_wide

CATCH_ROWS = [
    (2017, "Z", "Côte d'Ivoire", "Industrial", "Reported", "bottom trawl", "Discards", "A b", "x", 1.5),
    (2018, "Z", "Ghana", "Industrial", "Reported", "longline", "Discards", "A b", "x", None),
]


@pytest.fixture
def folder_of(tmp_path, monkeypatch):
    """The shared folder for one test; the setting itself is fixed when a session starts."""
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    return tmp_path


def test_the_setting_names_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_folder(spark) == session.shared_folder(spark)
    assert named is None or session.staging_path(spark, "x").startswith(named.rstrip("/"))


def test_csv_round_trip_and_fleet_rename(spark, folder_of, frame):
    path = sinks.export_csv(frame(CATCH_ROWS, CATCH), str(folder_of / "catch"))
    rows = {r["year"]: r for r in readers.read_fact(spark, path, "csv").collect()}
    assert rows[2017]["fishing_entity"] == "Ivory Coast" and rows[2017]["tonnes"] == 1.5
    assert rows[2018]["fishing_entity"] == "Ghana" and rows[2018]["tonnes"] is None


def test_csv_missing_text_is_not_a_product(spark, tmp_path):
    file = tmp_path / "balance.csv"
    file.write_text('"OUTPUT,0",countries,products,elements,...2,...3,...4,A2017\ns,c,#N/A,e [u],NA,x,FE,NA\n')
    row = readers.read_table(spark, str(file), balance_wide([2017]), "csv").first()
    assert row["products"] == "#N/A" and row["...2"] is None and row["A2017"] is None


def test_year_slice_reads_one_folder(folder_of, frame):
    staged = sinks.stage_by_year(frame(CATCH_ROWS, CATCH))
    one = sinks.year_slice(staged, 2018)
    assert [r["fishing_entity"] for r in one.collect()] == ["Ghana"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert list(folder_of.glob("seaplate/*/catch-*/year=2017"))


def test_gear_filter_and_columns_reach_the_scan(folder_of, frame):
    staged = sinks.stage_table(frame(CATCH_ROWS, CATCH), "fact")
    plan = gear_sector_filter(staged).groupBy("year").agg(F.sum("tonnes"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gear,bottom trawl)" in plan and "EqualTo(sector,Industrial)" in plan
    assert "ReadSchema: struct<year:int,sector:string,gear:string,tonnes:double>" in plan


def test_staging_uses_the_named_folder_and_cuts_lineage(folder_of, frame):
    staged = sinks.stage_table(frame(CATCH_ROWS, CATCH).groupBy("year").count(), "counts")
    assert list(folder_of.glob("seaplate/*/counts-*/*.parquet"))
    assert "Aggregate" not in staged._jdf.queryExecution().optimizedPlan().toString()


def test_no_private_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_dimension_and_population(frame):
    wide = frame([("AAA", "SP.POP.TOTL", 5.0), ("AAA", "SP.POP.GROW", 0.1)], "country string, indicator string, `2017` double")
    assert [tuple(r) for r in readers.population_dim(wide, "SP.POP.TOTL", 2017).collect()] == [("AAA", 5.0)]
    dim = frame([("code", "name"), ("AAA", "a"), (None, "b")], "c string, n string")
    got = readers.read_dimension(dim, ["c"], {"c": "iso3"}, drop_first=("c", "code"))
    assert got.columns == ["iso3"] and sorted(map(str, (r[0] for r in got.collect()))) == ["AAA", "None"]


def test_staged_tables_are_removed_together(spark, folder_of, frame):
    sinks.stage_table(frame(CATCH_ROWS, CATCH), "fact")
    (folder_of / "other").mkdir()
    assert session.remove_staged(spark)
    assert not list(folder_of.glob("seaplate/*/fact-*")) and (folder_of / "other").exists()


def test_tables_are_staged_once_and_together(spark, folder_of, frame):
    staging, built = sinks.Staging(), []
    meet = Barrier(2, timeout=60)  # passed only if both steps run at the same time

    def build(name):
        built.append(name)
        return frame([(name, 1)], "`a.b` string, n int")

    def one():
        meet.wait()
        return staging.table("one", lambda: build("one"))

    def two():
        meet.wait()
        return staging.table("two", lambda: staging.table("one", lambda: build("one")).withColumn("n", F.col("n") + 1))

    tables = staging.together(one, two, lambda: staging.table("one", lambda: build("one")))
    assert built == ["one"] and [t.first()["n"] for t in tables] == [1, 2, 1]
    assert tables[0].columns == ["a.b", "n"]


def test_an_error_of_a_step_reaches_all_that_wait(spark, folder_of):
    staging = sinks.Staging()

    def broken():
        raise ValueError("no table")

    with pytest.raises(ValueError, match="no table"):
        staging.together(lambda: staging.table("x", broken), lambda: staging.table("x", broken))
