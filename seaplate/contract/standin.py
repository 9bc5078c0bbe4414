"""The library's inputs, derived from the given star-schema tables.

Every function takes a ``Tables`` and returns one input in the shape the
operators expect. ``oracles.py`` states the same views in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seaplate.functions.nulls import sum_skipna
from seaplate.functions.text import lookup, sentence_case, word
from seaplate.operators.flows import aliases_from_key
from seaplate.operators.shape import wide_sum
from seaplate.sources.sinks import Staging
from seaplate.vocab import AGE_CODES, ASSAY_NUTRIENTS, MEAT_OUTCOMES

# Fixed values of the stand-in.
LINEAGES = {
    "blue": ("colour", "sense", "thing"),
    "red": ("colour", "sense", "thing"),
    "hot": ("temp", "sense", "thing"),
    "cold": ("temp", "sense", "thing"),
    "large": ("size", "form", "thing"),
    "new": ("age", "form", "thing"),
    "old": ("age", "form", "thing"),
}
EXTRA_SPECIES = ["Temp sp", "Form sp", "Thing sp", "Nope sp"]
PREPARATIONS = {
    "ECONOMY": "raw",
    "PROMO": "frozen",
    "LARGE": "small sample",
    "MEDIUM": "raw",
    "SMALL": "raw",
    "STANDARD": "cooked",
}
KEPT_PREPARATIONS = ["raw", "frozen", "small sample"]
KEPT_PARTS = ["muscle tissue", "edible"]
ZONE_PATTERNS = [(r"^nation 12$", "N12", "ASIA")]
BLOC_REGION = "EUROPE"
DISSOLVED = "NATION_23"
CURVE_AGES = [10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 30, 31, 32, 33, 99]  # 99 is no age of the intakes
UNLISTED_OUTCOME = "Gout"
BALANCE_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
BALANCE_CODES = ["CA", "FE", "MFAT", "O3", "PFAT", "SFAT", "TFAT", "VitA1", "VitB", "ZN", "PROT", "DES"]
CATCH_YEAR = 1998
SUPPLY_YEAR = 1997
SURVEY_AGES = [*[a for a in AGE_CODES if a != "95-99"], "100+"]
INTAKE_NUTRIENTS = ["Calcium", "Iron", "Zinc", "Vitamin A", "Vitamin B-12", "Omega-3 fatty acids"]


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


@dataclass
class Tables:
    """The given tables by name, and what one query run has staged."""

    spark: SparkSession
    folder: str
    staging: Staging = field(default_factory=Staging)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")


def _code(key: str, letter: str = "N") -> Column:
    return F.concat(F.lit(letter), F.lpad(F.col(key).cast("string"), 2, "0"))


def nations(t: Tables) -> DataFrame:
    """Nation with region, a code, and the code used in balances (bloc, world, or unknown)."""
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    balance = (
        F.when(F.col("r_name") == BLOC_REGION, F.lit("EUN"))
        .when(F.col("n_nationkey") == 24, F.lit("WLD"))
        .when(~F.col("n_nationkey").isin(11, 22), _code("n_nationkey"))
    )
    return nation.select(
        "n_nationkey", "n_name", "r_name", _code("n_nationkey").alias("iso3c"), balance.alias("balance_code")
    )


def catch(t: Tables, gaps: bool = False) -> DataFrame:
    """Catch rows; with ``gaps`` every order divisible by 17 has unknown tonnes.

    Three nations in four take part of their own zone's catch themselves, so foreign shares lie on both sides of 90 %.
    """
    own = (F.col("l_linenumber") <= F.col("c_nationkey") % 4) & (F.col("l_orderkey") % 2 == 0)
    zone = nations(t).select(
        F.col("n_nationkey").alias("z_key"), F.concat(F.replace("n_name", F.lit("_"), F.lit(" ")), F.lit(" ("), "r_name", F.lit(")")).alias("eez")
    )
    fleet = t.nation.select(F.col("n_nationkey").alias("f_key"), F.col("n_name").alias("fishing_entity"))
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(zone, F.col("c_nationkey") == F.col("z_key"))
        .join(fleet, F.col("f_key") == F.when(own, F.col("c_nationkey")).otherwise(F.col("s_nationkey")))
    )
    status = F.col("o_orderstatus")
    flag = F.col("l_returnflag")
    tonnes = F.col("l_quantity")
    if gaps:
        tonnes = F.when(F.col("l_orderkey") % 17 != 0, tonnes)
    return rows.select(
        F.year("l_shipdate").alias("year"),
        "eez",
        "fishing_entity",
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Industrial").otherwise("Artisanal").alias("sector"),
        F.when(F.col("l_linestatus") == "F", "Reported").otherwise("Unreported").alias("reporting_status"),
        F.when(status == "F", "bottom trawl").when(status == "O", "longline").otherwise("purse seine").alias("gear"),
        F.when(flag == "A", "Direct human consumption")
        .when(flag == "N", "Fishmeal and fish oil")
        .otherwise("Discards")
        .alias("end_use"),
        sentence_case("p_name").alias("scientific_name"),
        F.col("p_brand").alias("common_name"),
        tonnes.alias("tonnes"),
    )


def countries_iso_rows(t: Tables) -> DataFrame:
    """Fleet names and codes with second spellings; two nations have none."""
    base = t.nation.filter(~F.col("n_nationkey").isin(11, 22))
    again = base.filter(F.col("n_nationkey") % 5 == 0)
    return base.select(
        F.col("n_name").alias("missing_countries"), _code("n_nationkey").alias("iso3c"), F.col("n_nationkey").alias("line")
    ).unionByName(
        again.select(
            F.col("n_name").alias("missing_countries"),
            _code("n_nationkey", "X").alias("iso3c"),
            (F.col("n_nationkey") + 100).alias("line"),
        )
    )


def zone_aliases(t: Tables) -> DataFrame:
    """Written country names from the country key; nation 12 is left to a pattern, nation 22 unknown."""
    return aliases_from_key(country_key(t).filter(~F.col("iso3").isin("N12", "N22")))


def _people(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(
        (F.sum(F.greatest("c_acctbal", F.lit(0.0))) + 1000).alias("people")
    )


def population_wide(t: Tables) -> DataFrame:
    """Two indicators, one column per year."""
    people = _people(t).withColumn("indicator", F.explode(F.array(F.lit("SP.POP.TOTL"), F.lit("SP.URB.TOTL"))))
    part = F.when(F.col("indicator") == "SP.POP.TOTL", F.lit(1.0)).otherwise(F.lit(0.5))
    return people.select(
        _code("c_nationkey").alias("country"),
        "indicator",
        *[(F.col("people") * part * (1 + 0.01 * (y - 1995))).alias(str(y)) for y in BALANCE_YEARS],
    )


def coastal_population(t: Tables) -> DataFrame:
    return _people(t).select(
        _code("c_nationkey").alias("iso3c"), (F.col("people") * 0.2).alias("km_20"), (F.col("people") * 0.4).alias("km_50")
    )


def taxonomy(t: Tables) -> DataFrame:
    """Lineage of the first words of part names that are genera."""
    rows = [(genus, *lineage, line) for line, (genus, lineage) in enumerate(LINEAGES.items())]
    return t.spark.createDataFrame(rows, "genus string, family string, `order` string, class string, line int")


def assays(t: Tables) -> DataFrame:
    """Assay rows of parts, with holes so that every fallback rank is used."""
    genus, second = word("p_name", 0), word("p_name", 1)
    parts = F.split(lookup("genus_word", {g: ",".join(l) for g, l in LINEAGES.items()}), ",")
    n = F.col("p_partkey") % 7
    rows = t.part.select(
        "p_partkey",
        sentence_case("p_name").alias("sciname"),
        genus.alias("genus_word"),
        second.alias("second_word"),
        n.alias("n"),
        F.get(F.array(*[F.lit(x) for x in ASSAY_NUTRIENTS]), n.cast("int")).alias("nutrient"),
        F.when(F.col("p_partkey") % 100 == 99, "mg per 100 g").otherwise("mg").alias("nutrient_units"),
        lookup("p_type", PREPARATIONS).alias("food_prep"),
        F.when(F.col("p_brand") == "Brand#1", "liver").when(F.col("p_size") > 25, "edible").otherwise("muscle tissue").alias("food_part"),
        F.when(~((n == 6) & (second == "rod")), F.col("p_retailprice") / 100).alias("value"),
    )
    family, order, klass = (F.get(parts, F.lit(i)) for i in range(3))
    rows = rows.select(
        "p_partkey",
        "sciname",
        sentence_case("genus_word").alias("genus"),
        family.alias("family"),
        order.alias("order"),
        klass.alias("class"),
        "food_prep",
        "food_part",
        "nutrient",
        "nutrient_units",
        "value",
        "n",
        "second_word",
        "genus_word",
    )
    hole = (
        ((F.col("n") == 1) & (F.col("second_word") == "ring"))
        | ((F.col("n") == 2) & (F.col("genus_word") == "hot"))
        | ((F.col("n") == 3) & F.col("family").eqNullSafe("size"))
        | ((F.col("n") == 4) & F.col("order").eqNullSafe("sense"))
        | ((F.col("n") == 5) & (F.col("genus_word") == "small"))
    )
    return rows.filter(~hole).drop("n", "second_word", "genus_word")


def species_list(t: Tables) -> DataFrame:
    """Part names plus one name per rank that only a higher taxon or nothing can serve."""
    names = t.part.select(sentence_case("p_name").alias("scientific_name")).distinct()
    return names.unionByName(t.spark.createDataFrame([(s,) for s in EXTRA_SPECIES], "scientific_name string"))


def species_groups(t: Tables) -> DataFrame:
    """Functional group per species line; the first line of a genus counts."""
    first = F.when(word("p_name", 0).isin("blue", "cold", "new", "small"), "g1").otherwise("g2")
    group = F.when(F.col("p_partkey") % 50 == 49, "g3").otherwise(first)
    return t.part.select(
        sentence_case("p_name").alias("scientific_name"), group.alias("functional_group"), F.col("p_partkey").alias("line")
    )


def country_key(t: Tables) -> DataFrame:
    """Country key with bloc membership."""
    n = nations(t)
    return n.select(
        F.col("iso3c").alias("iso3"),
        F.col("n_name").alias("country"),
        F.col("iso3c").alias("iso3_use"),
        F.initcap(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("country_use"),
        F.when(F.col("r_name") == BLOC_REGION, "EUN").otherwise("COS").alias("group_code"),
        F.col("r_name").alias("continent_region"),
    )


def country_names(t: Tables) -> DataFrame:
    """Display names; every fourth code has none."""
    named = nations(t).filter(F.col("n_nationkey") % 4 != 1)
    return named.select("iso3c", F.initcap(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("country"))


def exclusions(t: Tables) -> DataFrame:
    listed = t.nation.filter(F.col("n_nationkey").isin(3, 7))
    return listed.select(F.col("n_name").alias("countries"), _code("n_nationkey").alias("iso"))


def balance_wide(t: Tables) -> DataFrame:
    """Mean order price by nation, product and nutrient, one column per year."""
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nations(t), F.col("c_nationkey") == F.col("n_nationkey")
    )
    priority = F.col("o_orderpriority")
    product = (
        F.when(priority == "1-URGENT", "Fish")
        .when(priority == "2-HIGH", "Beef and Veal")
        .when((priority == "3-MEDIUM") & (F.col("o_orderstatus") == "P"), "Unlisted crop")
        .when(priority == "3-MEDIUM", "Maize")
        .when(priority == "4-NOT SPECIFIED", "#N/A")
        .otherwise("Total food")
    )
    codes = F.array(*[F.lit(c) for c in BALANCE_CODES])
    keys = ["OUTPUT,0", "countries", "products", "elements", "...2", "...3", "...4"]
    code = F.get(codes, (F.col("o_orderkey") % 12).cast("int"))
    named = orders.select(
        F.lit("supply").alias("OUTPUT,0"),
        F.when(F.col("balance_code") == "EUN", "EU 27").otherwise(F.col("n_name")).alias("countries"),
        product.alias("products"),
        F.concat(code, F.lit(" supply [mg/cap/day]")).alias("elements"),
        F.col("balance_code").alias("...2"),
        F.upper(F.substring(product, 1, 3)).alias("...3"),
        code.alias("...4"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("price"),
    )
    cells = named.groupBy(*[F.col(f"`{k}`") for k in keys], "year").agg((F.avg("price") / 50000).alias("value"))
    years = {y: f"A{y}" for y in BALANCE_YEARS}
    return wide_sum(cells, [f"`{k}`" for k in keys], "year", years, "value", strict=True)


def supply_by_age_sex(t: Tables) -> DataFrame:
    """Mean account balance by nation and segment over sex and age bands; children up to 14."""
    nutrient = {"AUTOMOBILE": "Calcium", "BUILDING": "Iron", "FURNITURE": "Vitamin A", "HOUSEHOLD": "Vitamin B-12", "MACHINERY": "Zinc"}
    bands = [*list(AGE_CODES)[:16], "80+"]
    customer = t.customer.withColumn("band", (F.col("c_custkey") % 17).cast("int"))
    child = F.col("band") <= 2
    sex = F.when(child, "Children").when(F.floor(F.col("c_custkey") / 17) % 2 == 0, "Males").otherwise("Females")
    rows = customer.select(
        F.when(F.col("c_nationkey") % 4 == 0, _code("c_nationkey", "G")).otherwise(_code("c_nationkey")).alias("iso3_use"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("country_use"),
        lookup("c_mktsegment", nutrient).alias("nutrient"),
        F.lit("milligrams").alias("units_long"),
        F.lit("mg").alias("units_short"),
        sex.alias("sex"),
        F.get(F.array(*[F.lit(b) for b in bands]), F.col("band")).alias("age_range"),
        "c_nationkey",
        "c_acctbal",
    )
    keys = ["iso3_use", "country_use", "nutrient", "units_long", "units_short", "sex", "age_range"]
    supply = rows.groupBy(*keys).agg((F.avg(F.greatest("c_acctbal", F.lit(0.0))) + 100).alias("value_med"))
    gap = (F.col("country_use") == "Nation 5") & (F.col("age_range") == "80+")
    return supply.withColumn("value_med", F.when(~gap, F.col("value_med")))


def crosswalk(t: Tables) -> DataFrame:
    coded = t.nation.filter(F.col("n_nationkey") % 4 == 0)
    return coded.select(
        _code("n_nationkey").alias("iso3_cosimo"),
        F.col("n_name").alias("country_cosimo"),
        _code("n_nationkey", "G").alias("iso3_genus"),
        F.col("n_name").alias("country_genus"),
    )


def _orders_by_nation(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))


def intake_scalars(t: Tables) -> DataFrame:
    """Mean order price over nation, sex, age and three nutrients; the ages lack a known group and have an unknown one."""
    nutrients = F.array(F.lit("Omega-3 fatty acids"), F.lit("Vitamin B-12"), F.lit("Vitamin A"))
    ages = F.array(*[F.lit(a) for a in SURVEY_AGES])
    return (
        _orders_by_nation(t)
        .groupBy(
            _code("c_nationkey").alias("country_iso3"),
            F.get(nutrients, (F.col("o_custkey") % 3).cast("int")).alias("nutrient"),
            F.when(F.col("o_custkey") % 2 == 0, "men").otherwise("women").alias("sex"),
            F.get(ages, (F.col("o_orderkey") % 20).cast("int")).alias("age_group"),
        )
        .agg((F.avg("o_totalprice") / 250000).alias("scalar"))
    )


def _fits(t: Tables, best: str | None, **kinds: Column) -> DataFrame:
    """Fits by nation and the given kinds, moved a little with age; every third nation is gamma.

    Some nations spread three times as wide, some an eighth, which gives gamma shapes from about 0.3 to 200.
    ``best`` labels all of them alike.
    """
    logs = F.ln(F.col("o_totalprice") / 10000)
    spread = F.when(F.col("c_nationkey") % 5 == 1, 3.0).when(F.col("c_nationkey") % 5 == 2, 0.125).otherwise(1.0)
    fits = (
        _orders_by_nation(t)
        .groupBy("c_nationkey", *[kind.alias(name) for name, kind in kinds.items()])
        .agg(
            F.avg(logs).alias("meanlog"),
            (F.stddev_samp(logs) * spread).alias("sdlog"),
            (F.avg("o_totalprice") / 10000).alias("mean"),
            (F.stddev_samp("o_totalprice") / 10000 * spread).alias("sd"),
        )
    )
    demography = F.array(
        *[
            F.struct(F.lit(s).alias("sex"), F.lit(a).alias("age_group"), F.lit(i).alias("step"))
            for s in ("Males", "Females")
            for i, a in enumerate(AGE_CODES)
        ]
    )
    label = F.lit(best) if best else F.when(F.col("c_nationkey") % 3 == 0, "gamma").otherwise("log-normal")
    return fits.withColumn("d", F.explode(demography)).select(
        _code("c_nationkey").alias("country_iso3"),
        *kinds,
        "d.sex",
        "d.age_group",
        label.alias("best_dist"),
        F.try_divide(F.col("mean") * F.col("mean"), F.col("sd") * F.col("sd")).alias("g_shape"),
        F.try_divide(F.col("mean"), F.col("sd") * F.col("sd")).alias("g_rate"),
        (F.col("meanlog") + 0.01 * F.col("d.step")).alias("ln_meanlog"),
        F.col("sdlog").alias("ln_sdlog"),
    )


def distributions(t: Tables, best: str | None = None) -> DataFrame:
    """Fits by nation and nutrient, each nutrient from a sixth of the orders."""
    nutrients = F.array(*[F.lit(n) for n in INTAKE_NUTRIENTS])
    return _fits(t, best, nutrient=F.get(nutrients, (F.col("o_orderkey") % 6).cast("int")))


def meat_distributions(t: Tables, best: str | None = None) -> DataFrame:
    """Fits of meat intake by nation, from all orders, around 125 a day."""
    return _fits(t, best).withColumn("ln_meanlog", F.col("ln_meanlog") + 1.5).withColumn("g_rate", F.col("g_rate") / 4.5)


def _age_band_means(t: Tables, value: str, by: list[Column]) -> DataFrame:
    """Mean of a line-item column by five quantity bands and the curve ages."""
    ages = F.array(*[F.lit(a) for a in CURVE_AGES])
    band = F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int")
    return t.lineitem.groupBy(
        *by, band.alias("band"), F.get(ages, (F.col("l_partkey") % len(CURVE_AGES)).cast("int")).alias("age")
    ).agg(F.avg(value).alias("level"))


def omega_matrix(t: Tables) -> DataFrame:
    """Falling risk with one column per age, with points below, at and beyond the high end knot."""
    cells = _age_band_means(t, "l_discount", []).select(
        (3.0 * F.col("band")).alias("x"), "age", (1 - F.col("band") * F.col("level")).alias("y")
    )
    return wide_sum(cells, ["x"], "age", {a: f"age{a}" for a in CURVE_AGES}, "y", strict=True)


def meat_matrix(t: Tables) -> DataFrame:
    """Rising risk by outcome with one column per age; one outcome has no code."""
    outcomes = F.array(*[F.lit(o) for o in MEAT_OUTCOMES])
    listed = F.get(outcomes, (F.col("l_linenumber") - 1).cast("int"))
    outcome = F.when(F.col("l_suppkey") % 8 == 7, UNLISTED_OUTCOME).otherwise(listed).alias("Diet.high.in.red.meat")
    cells = _age_band_means(t, "l_tax", [outcome]).select(
        F.col("`Diet.high.in.red.meat`"),
        (50.0 * F.col("band")).alias("x"),
        "age",
        (1 + F.col("band") * F.col("level") * 2).alias("y"),
    )
    return wide_sum(cells, ["`Diet.high.in.red.meat`", "x"], "age", {a: f"age{a}" for a in CURVE_AGES}, "y", strict=True)


def requirements(t: Tables) -> DataFrame:
    """Requirements by age and sex code, one column per nutrient and availability."""
    ages = F.array(*[F.lit(a) for a in AGE_CODES.values()])
    base = t.customer.groupBy(
        F.get(ages, (F.col("c_custkey") % 20).cast("int")).alias("age_groups"),
        (F.floor(F.col("c_custkey") / 20) % 2 + 1).cast("int").alias("sex_groups"),
    ).agg((F.avg(F.greatest("c_acctbal", F.lit(0.0))) / 250 + 5).alias("b"))
    factors = {"Iron.5%": 1.5, "Iron.10%": 1.0, "Iron.12%": 0.8, "Zinc.low": 1.2, "Zinc.mod": 1.0, "Zinc.high": 0.9, "VitA": 1.1, "B12": 0.95, "Calcium": 1.0}
    return base.select("age_groups", "sex_groups", *[(F.col("b") * f).alias(c) for c, f in factors.items()])


def sdi(t: Tables) -> DataFrame:
    group = F.when(F.col("n_nationkey") % 3 == 0, "low").when(F.col("n_nationkey") % 3 == 1, "middle").otherwise("high")
    return t.nation.select(
        _code("n_nationkey").alias("iso3"),
        (F.col("n_nationkey") / 25).alias("sdi"),
        F.when(F.col("n_nationkey") != 6, group).alias("sdi_group"),
        (F.col("n_nationkey") / 30).alias("hdi"),
    )


def population_by_age_sex(t: Tables) -> DataFrame:
    """People by nation, sex and age group in two projection years; one nation has no old women."""
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("sex"), F.lit(a).alias("age_range"), F.lit(y).alias("year"), F.lit((i + 1) * f).alias("f"))
            for s in ("male", "female")
            for i, a in enumerate(AGE_CODES)
            for y, f in ((2015, 0.002), (2020, 0.004))
        ]
    )
    rows = _people(t).withColumn("d", F.explode(cells))
    kept = ~((F.col("c_nationkey") == 2) & (F.col("d.sex") == "female") & (F.col("d.age_range") == "95-99"))
    return rows.filter(kept).select(
        _code("c_nationkey").alias("iso3_use"),
        "d.sex",
        "d.age_range",
        "d.year",
        (F.col("people") * F.col("d.f")).alias("pop_size_50perc"),
    )


def deficiency(t: Tables) -> DataFrame:
    """Percentage deficient by nation and nutrient, unknown for one nation and nutrient."""
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    cells = rows.groupBy("s_nationkey", "l_linenumber").agg(F.avg("l_discount").alias("level"))
    value = 1000 * F.col("level") * (0.2 + (F.col("s_nationkey") % 5) / 5)
    gap = (F.col("s_nationkey") == 9) & (F.col("l_linenumber") == 7)
    return cells.select(
        _code("s_nationkey").alias("iso3"),
        F.concat(F.lit("nutrient "), F.col("l_linenumber").cast("string")).alias("nutrient"),
        F.when(~gap, value).alias("perc_deficient"),
    )


def regions(t: Tables) -> DataFrame:
    return nations(t).select(
        F.col("iso3c").alias("iso3"),
        F.col("n_name").alias("country"),
        F.when(F.col("r_name") == "EUROPE", "Europe").otherwise(F.col("r_name")).alias("continent"),
        (F.col("n_nationkey") + 1).cast("double").alias("_n"),
    ).select("iso3", "country", "continent", (F.col("_n") * 2000).alias("area_sqkm"))


def tiny_regions(t: Tables) -> DataFrame:
    return regions(t).filter(F.col("area_sqkm") % 14000 == 0).select(
        "iso3", F.concat(F.lit("tiny "), "country").alias("country"), "continent"
    )
