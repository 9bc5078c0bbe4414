"""Tables behind maps and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seaplate.functions.nulls import cap_at, mean_strict, sum_skipna
from seaplate.functions.text import recode
from seaplate.operators.shape import left_lookup, wide_sum
from seaplate.sources.sinks import stage_table
from seaplate.vocab import METRIC_CAPS, REPORT_NAMES, REPORT_NUTRIENTS, SMALL_AREA_SQKM, TINY_AREA_SQKM

COUNTRY_KEYS = ["iso3", "country", "nutrient"]


def sev_country_mean(deltas: DataFrame) -> DataFrame:
    """Mean exposure over sex and age per country and nutrient; one missing value makes it NULL."""
    return (
        deltas.groupBy(*COUNTRY_KEYS)
        .agg(mean_strict("sev_base").alias("sev_base"), mean_strict("sev_high").alias("sev_high"))
        .withColumn("sev_delta", F.col("sev_high") - F.col("sev_base"))
        .withColumn("nutrient", recode("nutrient", REPORT_NAMES))
    )


def sev_report(means: DataFrame, nutrients: list[str] = REPORT_NUTRIENTS) -> DataFrame:
    """One row per country code, one column of exposure change per nutrient."""
    return wide_sum(means, ["iso3", "country"], "nutrient", {n: n for n in nutrients}, "sev_delta", strict=True)


def people_country_total(affected: DataFrame) -> DataFrame:
    """People per country and nutrient, and the log for display (0 up to one person)."""
    return (
        affected.groupBy(*COUNTRY_KEYS)
        .agg(sum_skipna("ndeficient_diff").alias("ndeficient_diff"))
        .withColumn("nutrient", recode("nutrient", REPORT_NAMES))
        .withColumn(
            "ndeficient_diff_log",
            F.when(F.col("ndeficient_diff") > 1, F.ln("ndeficient_diff")).otherwise(F.lit(0.0)),
        )
    )


def people_grand_total(totals: DataFrame) -> DataFrame:
    return totals.agg((F.sum("ndeficient_diff") / 1e6).alias("million_people"))


def metric_cap(df: DataFrame, metric: str, caps: dict[str, float] | None = None) -> DataFrame:
    """Cap a metric by nutrient; nutrients without a cap stay as they are."""
    caps = METRIC_CAPS[metric] if caps is None else caps
    value = F.col(metric)
    for nutrient, cap in caps.items():
        value = F.when(F.col("nutrient") == nutrient, cap_at(metric, float(cap))).otherwise(value)
    return df.withColumn(metric, value)


def ranked_counts(counts: DataFrame, group: str, value: str) -> DataFrame:
    """Adds the ranks ``_begin``..``_end`` that each distinct value of a group covers, its group's size ``_n`` and its ``_part``.

    ``counts`` holds (group, value, n). Rows are dealt by ranges of (group, value) to as many parts as their size asks
    for, so a large group is spread over many. Running sums are taken within a part, and the sums of the parts
    before, at most one row per group and part, make them exact.
    """
    dealt = counts.repartitionByRange(group, value).sortWithinPartitions(group, value)
    parts = stage_table(dealt.withColumn("_part", F.spark_partition_id()), "value-counts")
    totals = parts.groupBy(group, "_part").agg(F.sum("n").alias("_sum"))
    whole = Window.partitionBy(group)
    before = F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        F.col(group).alias("_group"), F.col("_part").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(whole).alias("_n")
    )
    ranked = parts.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at"))).drop("_group", "_at")
    inside = F.sum("n").over(Window.partitionBy(group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("_end", F.col("_before") + inside)
    return ranked.withColumn("_begin", F.col("_end") - F.col("n")).drop("_before")


def _quantiles(ranked: DataFrame, group: str, value: str, probabilities: list[float]) -> DataFrame:
    def at(rank):
        return F.max(F.when((F.col("_begin") <= rank) & (rank < F.col("_end")), F.col(value)))

    columns = []
    for i, p in enumerate(probabilities):
        position = (F.col("_n") - 1) * F.lit(p)
        low = at(F.floor(position))
        high = at(F.ceil(position))
        fraction = F.max(position - F.floor(position))
        columns.append((low + (high - low) * fraction).alias(f"q{i}"))
    return ranked.groupBy(group).agg(F.max("_n").alias("n"), *columns)


def exact_quantiles(counts: DataFrame, group: str, value: str, probabilities: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per group from (group, value, n) with distinct values."""
    return _quantiles(ranked_counts(counts, group, value), group, value, probabilities)


def metric_box_stats(df: DataFrame, metric: str, group: str = "nutrient") -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and outlier count; only finite values count.

    The quartiles meet the values by group and part, so a large group stays spread.
    """
    finite = F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(F.col(metric)) < float("inf"))
    counts = df.filter(finite).groupBy(group, F.col(metric).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = stage_table(ranked_counts(counts, group, "_v"), "value-ranks")
    quartiles = _quantiles(ranked, group, "_v", [0.25, 0.5, 0.75]).select(
        F.col(group).alias("_group"),
        F.col("n").alias("n_values"),
        F.col("q0").alias("q1"),
        F.col("q1").alias("median"),
        F.col("q2").alias("q3"),
    )
    parts = ranked.select(group, "_part").distinct()
    by_part = parts.join(quartiles, F.col(group).eqNullSafe(F.col("_group"))).select(
        F.col(group).alias("_group"), F.col("_part").alias("_at"), "n_values", "q1", "median", "q3"
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    within = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return (
        ranked.join(by_part, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
        .groupBy(group, "n_values", "q1", "median", "q3")
        .agg(
            F.min(F.when(within, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(within, F.col("_v"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~within, F.col("n"))), F.lit(0)).alias("n_outliers"),
        )
    )


def region_metric_layer(regions: DataFrame, metric: DataFrame, columns: list[str], code: str = "iso3c") -> DataFrame:
    """Every region with a metric where there is one."""
    return left_lookup(regions, metric, {"iso3": code}, columns)


def small_territory_layer(
    regions: DataFrame, tiny: DataFrame, metric: DataFrame, columns: list[str], required: str, code: str = "iso3c"
) -> DataFrame:
    """Small territories outside Europe that have a metric, smallest first."""
    centres = regions.select("iso3", "country", "continent", "area_sqkm").unionByName(
        tiny.select("iso3", "country", "continent").withColumn("area_sqkm", F.lit(TINY_AREA_SQKM))
    )
    layer = region_metric_layer(centres, metric, columns, code).filter(F.col(required).isNotNull())
    small = layer.filter((F.col("area_sqkm") <= SMALL_AREA_SQKM) & (F.col("continent") != "Europe"))
    return small.orderBy(F.asc_nulls_last("area_sqkm"), "iso3")


def foreign_vs_intake_points(zones: DataFrame) -> DataFrame:
    """Points of the foreign-share figure."""
    return zones.select("total_log", "perc_foreign", "intake", F.col("eez_iso").alias("label"))
