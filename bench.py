"""Times the headline queries and prints one JSON line.

Each query runs end to end, reading, staging and all, with its result counted
through a no-op sink; the value per query is the median of ``BENCH_RUNS`` runs
after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaplate.contract.queries import run
from seaplate.functions.quadrature import fit_struct, shortfall_integral
from seaplate.operators.risk import with_tails
from seaplate.session import local_session, remove_staged

HEADLINES = [
    "gear_share_by_year",
    "entity_share_for_year",
    "mean_biomass_by_key",
    "total_by_species_entity_year",
    "taxon_fallback",
    "functional_group_fill",
    "nutrient_supply",
    "supply_discard_ratio",
    "supply_share_table",
    "zone_flow",
    "net_nutrient_flow",
    "intake_by_group",
    "curve_table",
    "sev_micronutrient",
    "sev_omega3_gamma",
    "sev_micronutrient_gamma_distinct",
    "sev_red_meat",
    "paf_red_meat",
    "people_affected",
    "sev_report",
    "metric_box_stats_tonnes",
]


def distinct_gamma(spark: SparkSession, folder: str) -> DataFrame:
    """Gamma exposure integrals with a shape of its own for each customer, the costly case."""
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    shape = F.abs(F.col("c_acctbal")) / 50 + 0.05 + F.col("c_custkey") * 1e-7
    fits = customers.select(
        F.lit("gamma").alias("best_dist"), shape.alias("g_shape"), (shape / 10).alias("g_rate"), F.lit(0.0).alias("g_mean_diff"),
        *[F.lit(None).cast("double").alias(c) for c in ("ln_meanlog", "ln_sdlog", "ln_mean_diff")],
    )
    return with_tails(fits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))).select(shortfall_integral(fit_struct(), F.lit(10.0), F.lit(0.1)))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINES
    spark = local_session(cores, shuffle_partitions=int(cores), memory=os.environ.get("BENCH_MEMORY", "12g"))

    def frame(name: str) -> DataFrame:
        return distinct_gamma(spark, folder) if name == "sev_micronutrient_gamma_distinct" else run(name, spark, folder)

    def once(name: str) -> float:
        start = time.perf_counter()
        frame(name).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        remove_staged(spark)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
