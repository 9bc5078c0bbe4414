"""The registered queries in SQL over the same tables, as an independent check.

``VIEWS`` are named building blocks; a query lists the text of its final SELECT
and gets the views it mentions, in order, as a WITH clause.
"""

from __future__ import annotations

import re
import zlib

from seaplate.contract import standin as s
from seaplate.functions.numeric import NORMAL_BOTTOM, NORMAL_SPLIT, NORMAL_TOP
from seaplate.vocab import (
    AGE_CODES,
    AGES_OVER_80,
    ASSAY_NUTRIENTS,
    BALANCE_NUTRIENTS,
    BALANCE_SCOPE,
    MEAT_OUTCOMES,
    METRIC_CAPS,
    PRODUCT_SECTORS,
    REPORT_NUTRIENTS,
    SUPPLY_NUTRIENTS,
    TAIL_Z,
)

VIEWS: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(v if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def code(key: str, letter: str = "N") -> str:
    return f"'{letter}' || lpad(CAST({key} AS VARCHAR), 2, '0')"


def case(column: str, mapping: dict, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


def pick(index: str, items) -> str:
    """Item of a literal list by 0-based index."""
    return f"list_extract([{', '.join(text(i) if isinstance(i, str) else str(i) for i in items)}], CAST({index} AS INTEGER) + 1)"


def ratio(n: str, d: str) -> str:
    return (
        f"CASE WHEN ({d}) = 0 THEN CASE WHEN ({n}) > 0 THEN CAST('inf' AS DOUBLE) "
        f"WHEN ({n}) < 0 THEN CAST('-inf' AS DOUBLE) END ELSE ({n}) / ({d}) END"
    )


def strict(value: str, fn: str = "sum", where: str | None = None) -> str:
    """Aggregate that is NULL as soon as one value of the (filtered) group is missing."""
    f = f" FILTER (WHERE {where})" if where else ""
    return f"CASE WHEN count({value}){f} = count(*){f} THEN {fn}({value}){f} END"


def fixed(value: str, digits: int) -> str:
    """Sum in whole units of 10**-digits, which no order of the rows changes."""
    return f"CAST(sum(CAST(round_even(({value}) * 1e{digits}, 0) AS HUGEINT)) AS DOUBLE) / 1e{digits}"


def r(column: str, digits: int, name: str | None = None) -> str:
    """Rounded column; adding 0.0 turns -0.0 into 0.0."""
    return f'round({column}, {digits}) + 0.0 AS "{name or column}"'


def rs(columns, digits: int) -> str:
    return ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in columns)


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def with_views(sql: str) -> str:
    needed: set[str] = set()

    def visit(body: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", body):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not needed:
        return sql
    recursive = "RECURSIVE " if any("UNION ALL SELECT * FROM (" in VIEWS[n] for n in needed) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed) + "\n" + sql


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLES.items()}


# Inputs.

view(
    "v_nations",
    f"""SELECT n_nationkey, n_name, r_name, {code('n_nationkey')} AS iso3c,
      CASE WHEN r_name = 'EUROPE' THEN 'EUN' WHEN n_nationkey = 24 THEN 'WLD'
           WHEN n_nationkey IN (11, 22) THEN NULL ELSE {code('n_nationkey')} END AS balance_code
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
view(
    "v_catch",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, replace(z.n_name, '_', ' ') || ' (' || z.r_name || ')' AS eez,
      z.n_nationkey AS z_key, f.n_nationkey AS f_key, z.r_name AS z_region,
      f.n_name AS fishing_entity,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Industrial' ELSE 'Artisanal' END AS sector,
      CASE l_linestatus WHEN 'F' THEN 'Reported' ELSE 'Unreported' END AS reporting_status,
      CASE o_orderstatus WHEN 'F' THEN 'bottom trawl' WHEN 'O' THEN 'longline' ELSE 'purse seine' END AS gear,
      CASE l_returnflag WHEN 'A' THEN 'Direct human consumption' WHEN 'N' THEN 'Fishmeal and fish oil'
           ELSE 'Discards' END AS end_use,
      upper(substring(p_name, 1, 1)) || substring(p_name, 2) AS scientific_name, p_name AS species,
      p_brand AS common_name, l_quantity AS full_tonnes,
      CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS tonnes
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN v_nations z ON c_nationkey = z.n_nationkey
    JOIN nation f ON f.n_nationkey = CASE WHEN l_linenumber <= c_nationkey % 4 AND l_orderkey % 2 = 0 THEN c_nationkey ELSE s_nationkey END""",
)
view("v_sel", "SELECT * FROM v_catch WHERE gear = 'bottom trawl' AND sector = 'Industrial'")
view(
    "v_iso_rows",
    f"""SELECT n_name AS missing_countries, {code('n_nationkey')} AS iso3c, n_nationkey AS line FROM nation
      WHERE n_nationkey NOT IN (11, 22)
    UNION ALL SELECT n_name, {code('n_nationkey', 'X')}, n_nationkey + 100 FROM nation
      WHERE n_nationkey % 5 = 0 AND n_nationkey NOT IN (11, 22)""",
)
view(
    "v_iso",
    """SELECT missing_countries, iso3c FROM v_iso_rows
    QUALIFY row_number() OVER (PARTITION BY missing_countries ORDER BY line) = 1""",
)
view(
    "v_people",
    "SELECT c_nationkey, sum(greatest(c_acctbal, 0)) + 1000 AS people FROM customer GROUP BY c_nationkey",
)
view("v_pop", f"SELECT {code('c_nationkey')} AS iso3c, people * 1.0 * (1 + 0.01 * ({s.SUPPLY_YEAR} - 1995)) AS pop FROM v_people")
view("v_coastal", f"SELECT {code('c_nationkey')} AS iso3c, people * 0.2 AS pop FROM v_people")
view(
    "v_taxa",
    "SELECT * FROM (VALUES "
    + values([[text(g), *map(text, lineage)] for g, lineage in s.LINEAGES.items()])
    + ') AS t(genus, family, "order", class)',
)
view(
    "v_assays",
    f"""SELECT p_partkey, p_name AS sciname, split_part(p_name, ' ', 1) AS genus, x.family, x."order", x.class,
      {case('p_type', s.PREPARATIONS)} AS food_prep,
      CASE WHEN p_brand = 'Brand#1' THEN 'liver' WHEN p_size > 25 THEN 'edible' ELSE 'muscle tissue' END AS food_part,
      {pick('p_partkey % 7', ASSAY_NUTRIENTS)} AS nutrient,
      CASE WHEN p_partkey % 100 = 99 THEN 'mg per 100 g' ELSE 'mg' END AS nutrient_units,
      CASE WHEN p_partkey % 7 = 6 AND split_part(p_name, ' ', 2) = 'rod' THEN NULL ELSE p_retailprice / 100 END AS value
    FROM part LEFT JOIN v_taxa x ON split_part(p_name, ' ', 1) = x.genus
    WHERE NOT (p_partkey % 7 = 1 AND split_part(p_name, ' ', 2) = 'ring')
      AND NOT (p_partkey % 7 = 2 AND split_part(p_name, ' ', 1) = 'hot')
      AND NOT (p_partkey % 7 = 3 AND coalesce(x.family, '') = 'size')
      AND NOT (p_partkey % 7 = 4 AND coalesce(x."order", '') = 'sense')
      AND NOT (p_partkey % 7 = 5 AND split_part(p_name, ' ', 1) = 'small')""",
)
view(
    "v_kept",
    """SELECT * FROM v_assays WHERE food_prep IN ('raw', 'frozen', 'small sample')
      AND food_part IN ('muscle tissue', 'edible')""",
)
view(
    "v_units",
    """SELECT nutrient, nutrient_units FROM v_kept
    QUALIFY row_number() OVER (PARTITION BY nutrient ORDER BY p_partkey) = 1""",
)
_LEVELS = {"species": "sciname", "genus": "genus", "family": "family", "order": '"order"', "class": "class"}
view(
    "v_stats",
    " UNION ALL ".join(
        f"""SELECT '{level}' AS level, {column} AS taxon, nutrient, CASE WHEN count(value) = count(*) THEN {fixed('value', 12)} / count(*) END AS value,
        {strict('value', 'stddev_samp')} AS ssd, count(*) AS count,
        {strict('value', 'stddev_samp')} / sqrt(count(*)) AS se
        FROM v_kept WHERE {column} IS NOT NULL GROUP BY {column}, nutrient"""
        for level, column in _LEVELS.items()
    ),
)
view("v_nutrients", "SELECT * FROM (VALUES " + values([[text(n)] for n in ASSAY_NUTRIENTS]) + ") AS t(nutrient)")
view(
    "v_species",
    "SELECT DISTINCT p_name AS species FROM part UNION ALL SELECT * FROM (VALUES "
    + values([[text(x.lower())] for x in s.EXTRA_SPECIES])
    + ") AS t(species)",
)
view(
    "v_lineage",
    """SELECT q.species, q.genus, q.spp, g.family,
      CASE WHEN g.class IS NULL THEN f."order" ELSE g."order" END AS "order", coalesce(g.class, f.class, o.class) AS class
    FROM (SELECT species, split_part(species, ' ', 1) AS genus, split_part(species, ' ', 2) AS spp FROM v_species) q
    LEFT JOIN v_taxa g ON q.genus = g.genus
    LEFT JOIN (SELECT DISTINCT family, "order", class FROM v_taxa) f ON q.genus = f.family
    LEFT JOIN (SELECT DISTINCT "order", class FROM v_taxa) o ON q.genus = o."order\"""",
)
_RANKS = [
    ("species", "species", "species"),
    ("genus", "genus", "genus"),
    ("family", "family", "family"),
    ("family", "family", "genus"),
    ("order", "order", '"order"'),
    ("order", "order", "genus"),
    ("class", "class", "class"),
    ("class", "class", "genus"),
]
view(
    "v_found",
    " UNION ALL ".join(
        f"""SELECT l.species, t.nutrient, {i} AS rank, '{label}' AS taxa_match, t.value, t.ssd, t.count, t.se
        FROM v_lineage l JOIN v_stats t ON t.level = '{level}' AND t.taxon = l.{column} WHERE t.value IS NOT NULL"""
        for i, (label, level, column) in enumerate(_RANKS)
    ),
)
view(
    "v_nearest",
    """SELECT l.*, n.nutrient, u.nutrient_units, b.value, b.ssd, b.count, b.se, b.taxa_match
    FROM v_lineage l CROSS JOIN v_nutrients n LEFT JOIN v_units u ON n.nutrient = u.nutrient
    LEFT JOIN (SELECT * FROM v_found QUALIFY row_number() OVER (PARTITION BY species, nutrient ORDER BY rank) = 1) b
      ON b.species = l.species AND b.nutrient = n.nutrient""",
)
view(
    "v_groups",
    """SELECT split_part(p_name, ' ', 1) AS genus,
      CASE WHEN p_partkey % 50 = 49 THEN 'g3'
           WHEN split_part(p_name, ' ', 1) IN ('blue', 'cold', 'new', 'small') THEN 'g1' ELSE 'g2' END AS functional_group
    FROM part QUALIFY row_number() OVER (PARTITION BY split_part(p_name, ' ', 1) ORDER BY p_partkey) = 1""",
)
_BIOMASS = "year, eez, fishing_entity, sector, reporting_status, end_use, scientific_name"
view("v_biomass", f"SELECT {_BIOMASS}, min(species) AS species, avg(tonnes) AS tonnes FROM v_sel GROUP BY {_BIOMASS}")
view(
    "v_full_biomass",
    f"SELECT {_BIOMASS}, min(species) AS species, avg(full_tonnes) AS tonnes FROM v_sel GROUP BY {_BIOMASS}",
)
view("v_species_rows", "SELECT species, count(*) AS n_rows FROM v_biomass GROUP BY species")
view(
    "v_group_means",
    f"""SELECT functional_group, nutrient, value, ssd, count FROM (
      SELECT g.functional_group, n.nutrient, {fixed('n.value * b.n_rows', 12)} / sum(b.n_rows) AS value
      FROM v_species_rows b JOIN v_nearest n ON b.species = n.species JOIN v_groups g ON g.genus = n.genus
      WHERE n.value IS NOT NULL GROUP BY g.functional_group, n.nutrient)
    JOIN (SELECT g.functional_group, n.nutrient, stddev_samp(n.value) AS ssd, count(*) AS count
      FROM v_biomass b JOIN v_nearest n ON b.species = n.species JOIN v_groups g ON g.genus = n.genus
      WHERE n.value IS NOT NULL GROUP BY g.functional_group, n.nutrient) USING (functional_group, nutrient)""",
)
_SHORT = {
    "Iron, total": "Iron",
    "Protein, total; calculated from total nitrogen": "Protein",
    "Total fatty acids, polyunsaturated": "DHA+EPA",
    "Vitamin A; sum of retinol/carotenoids": "Vitamin A, RAE",
}
view(
    "v_filled",
    f"""SELECT n.species, n.nutrient, n.nutrient_units, g.functional_group,
      CASE WHEN n.value IS NULL THEN m.value ELSE n.value END AS value,
      CASE WHEN n.value IS NULL THEN m.ssd ELSE n.ssd END AS ssd,
      CASE WHEN n.value IS NULL THEN m.count ELSE n.count END AS count,
      CASE WHEN n.value IS NULL THEN 'Functional group' ELSE n.taxa_match END AS taxa_match,
      {case('n.nutrient', _SHORT, 'n.nutrient')} AS short_nutrient
    FROM v_nearest n LEFT JOIN v_groups g ON g.genus = n.genus
    LEFT JOIN v_group_means m ON m.functional_group = g.functional_group AND m.nutrient = n.nutrient
    WHERE n.species IN (SELECT species FROM v_biomass)""",
)


def _supply(biomass: str) -> str:
    return f"""SELECT b.*, f.short_nutrient AS nutrient, f.value, f.taxa_match, f.value * b.tonnes * 10 * 1000 AS nut_supply
    FROM {biomass} b LEFT JOIN v_filled f ON b.species = f.species"""


view("v_supply", _supply("v_biomass"))
view("v_full_supply", _supply("v_full_biomass"))

# Sources, staging, sinks.

oracle(
    "read_fact",
    """SELECT CASE fishing_entity WHEN 'NATION_4' THEN 'Fourth Nation' ELSE fishing_entity END AS fishing_entity, year,
      count(*) AS n_rows, sum(tonnes) AS tonnes FROM v_catch GROUP BY 1, 2""",
)
oracle(
    "year_slice",
    f"SELECT year, eez, fishing_entity, scientific_name, full_tonnes AS tonnes FROM v_catch WHERE year = {s.CATCH_YEAR}",
)
oracle(
    "read_dimension",
    f"""SELECT {code('n_nationkey')} AS iso3, {code('n_nationkey', 'G')} AS genus_code FROM nation
    WHERE n_nationkey % 4 = 0 AND n_nationkey <> 0""",
)
oracle("dim_first", "SELECT * FROM v_iso")
oracle("population_dim", f"SELECT iso3c, {r('pop', 4)} FROM v_pop")
oracle("coastal_population_dim", f"SELECT iso3c, {r('pop', 4)} FROM v_coastal")
oracle(
    "stage_table",
    """SELECT fishing_entity, sum(full_tonnes) AS tonnes, count(DISTINCT scientific_name) AS n_species
    FROM v_sel GROUP BY fishing_entity""",
)
oracle("export_csv", "SELECT scientific_name, sum(full_tonnes) AS tonnes FROM v_sel GROUP BY scientific_name")

# Catch statistics.

_M = "coalesce(sum(tonnes), 0) / 1e6"
oracle(
    "gear_sector_filter", "SELECT year, eez, fishing_entity, end_use, scientific_name, tonnes FROM v_sel"
)
view("v_year_total", f"SELECT year, {_M} AS tonnes_tot FROM v_catch GROUP BY year")
view(
    "v_year_gear",
    f"""SELECT g.year, g.tonnes, t.tonnes_tot, 100 * ({ratio('g.tonnes', 't.tonnes_tot')}) AS perc_trawl
    FROM (SELECT year, {_M} AS tonnes FROM v_sel GROUP BY year) g LEFT JOIN v_year_total t ON g.year = t.year""",
)
oracle("catch_total_by_year", f"SELECT year, {r('tonnes_tot', 9)} FROM v_year_total")
oracle("gear_share_by_year", f"SELECT year, {rs(['tonnes', 'tonnes_tot'], 9)}, {r('perc_trawl', 8)} FROM v_year_gear")
oracle(
    "enduse_share_by_year",
    f"""SELECT year, end_use, {rs(['tonnes_end', 'tonnes', 'tonnes_tot'], 9)}, {r('perc_trawl', 8)},
      {r('100 * (' + ratio('tonnes_end', 'tonnes') + ')', 8, 'perc_enduse')}
    FROM (SELECT year, end_use, {_M} AS tonnes_end FROM v_sel GROUP BY year, end_use) LEFT JOIN v_year_gear USING (year)""",
)
oracle(
    "entity_share_for_year",
    f"""SELECT year, fishing_entity, {rs(['tonnes_iso', 'tonnes', 'tonnes_tot', 'tonnes_tot_iso'], 9)}, {r('perc_trawl', 8)},
      {r('100 * (' + ratio('tonnes_iso', 'tonnes') + ')', 8, 'perc_iso')},
      {r('100 * (' + ratio('tonnes_iso', 'tonnes_tot_iso') + ')', 8, 'perc_iso_tot')}
    FROM (SELECT year, fishing_entity, {_M} AS tonnes_iso FROM v_sel WHERE year = {s.CATCH_YEAR} GROUP BY 1, 2)
    LEFT JOIN v_year_gear USING (year)
    LEFT JOIN (SELECT year, fishing_entity, {_M} AS tonnes_tot_iso FROM v_catch GROUP BY 1, 2) USING (year, fishing_entity)""",
)
oracle(
    "species_list_for_year",
    f"""SELECT year, scientific_name, common_name, {r(_M, 9, 'tonnes_end')} FROM v_sel
    WHERE year = {s.CATCH_YEAR} GROUP BY 1, 2, 3""",
)
oracle("mean_biomass_by_key", f"SELECT {_BIOMASS}, {r('tonnes', 8)} FROM v_biomass")
_T = "coalesce(sum(tonnes), 0) AS tonnes"
oracle("total_by_species", f"SELECT scientific_name, {_T} FROM v_sel GROUP BY 1")
oracle("total_by_species_entity", f"SELECT scientific_name, fishing_entity, {_T} FROM v_sel GROUP BY 1, 2")
oracle(
    "total_by_species_entity_year",
    f"SELECT scientific_name, fishing_entity, gear, sector, year, {_T} FROM v_sel GROUP BY 1, 2, 3, 4, 5",
)
oracle(
    "total_for_entity",
    f"""SELECT scientific_name, fishing_entity, gear, sector, year, {_T} FROM v_sel
    WHERE fishing_entity = 'NATION_8' GROUP BY 1, 2, 3, 4, 5""",
)
oracle(
    "zone_species_total",
    f"""SELECT common_name, scientific_name, {strict('tonnes')} AS tonnes FROM v_sel
    WHERE eez = 'NATION 3 (EUROPE)' GROUP BY 1, 2""",
)
oracle("distinct_values", "SELECT DISTINCT sector FROM v_catch")

# Composition.

oracle(
    "assay_filter",
    """SELECT upper(substring(sciname, 1, 1)) || substring(sciname, 2) AS sciname, nutrient, food_prep, food_part, value
    FROM v_kept""",
)
oracle("nutrient_unit_key", "SELECT * FROM v_units")
oracle("taxon_stats", f"SELECT level, taxon, nutrient, count, {rs(['value', 'ssd', 'se'], 7)} FROM v_stats")
# Student quantile by bisection on the integral of cos^(df-1) over the angle t = sqrt(df) tan(a).
view("v_dfs", "SELECT DISTINCT CAST(count - 1 AS DOUBLE) AS df FROM v_stats WHERE count > 1")
view(
    "v_nodes",
    "SELECT i / 2000.0 AS u, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 6000.0 AS w "
    "FROM generate_series(0, 2000) AS g(i)",
)
view(
    "v_t_norm",
    "SELECT df, sum(w * pow(cos(u * pi() / 2), df - 1)) * pi() / 2 AS half FROM v_dfs, v_nodes GROUP BY df",
)
view(
    "v_t_steps",
    """SELECT 0 AS step, df, half, CAST(0 AS DOUBLE) AS lo, pi() / 2 AS hi FROM v_t_norm
    UNION ALL SELECT * FROM (
      SELECT s.step + 1, s.df, s.half,
        CASE WHEN m.mass < 0.95 * s.half THEN (s.lo + s.hi) / 2 ELSE s.lo END,
        CASE WHEN m.mass < 0.95 * s.half THEN s.hi ELSE (s.lo + s.hi) / 2 END
      FROM v_t_steps s JOIN LATERAL (
        SELECT sum(w * pow(cos(u * (s.lo + s.hi) / 2), s.df - 1)) * (s.lo + s.hi) / 2 AS mass FROM v_nodes) m ON true
      WHERE s.step < 50) AS bisected""",
)
view("v_t", "SELECT df, sqrt(df) * tan((lo + hi) / 2) AS t FROM v_t_steps WHERE step = 50")
oracle(
    "t_interval",
    f"""SELECT level, taxon, nutrient, {r('value - t * se', 6, 'lower_ci')}, {r('value + t * se', 6, 'upper_ci')}
    FROM v_stats LEFT JOIN v_t ON df = count - 1""",
)
oracle(
    "species_nutrient_grid",
    """SELECT species, split_part(species, ' ', 1) AS genus, split_part(species, ' ', 2) AS spp, nutrient
    FROM v_species CROSS JOIN v_nutrients""",
)
oracle("lineage_resolve", "SELECT * FROM v_lineage")
oracle(
    "taxon_fallback",
    f"""SELECT species, genus, spp, family, "order", class, nutrient, nutrient_units, count, taxa_match,
    {rs(['value', 'ssd', 'se'], 7)} FROM v_nearest""",
)
oracle(
    "functional_group_fill",
    f"""SELECT species, nutrient, nutrient_units, functional_group, count, taxa_match, {rs(['value', 'ssd'], 7)}
    FROM v_filled""",
)
oracle(
    "nutrient_supply",
    f"SELECT {_BIOMASS}, nutrient, taxa_match, {r('tonnes', 8)}, {r('value', 7)}, {r('nut_supply', 3)} FROM v_supply",
)
oracle(
    "species_composition_distinct",
    f"""SELECT DISTINCT upper(substring(species, 1, 1)) || substring(species, 2) AS scientific_name,
      short_nutrient AS nutrient, {r('value', 7)} FROM v_filled""",
)

# Ratio reports.


def _cells(keys: str, column: str, names, value: str = "nut_supply", skip: bool = False) -> str:
    cells = []
    for n in names:
        hit = f"{column} = {text(n)}"
        if skip:
            cell = f"CASE WHEN count(*) FILTER (WHERE {hit}) > 0 THEN coalesce(sum({value}) FILTER (WHERE {hit}), 0) END"
        else:
            cell = strict(value, "sum", hit)
        cells.append(f'{cell} AS "{n}"')
    return f"{keys}, " + ", ".join(cells)


_END_USES = ["Direct human consumption", "Discards", "Fishmeal and fish oil"]
_FLEET = "year, fishing_entity, nutrient"


def _fleet_supply(by: str, missing: bool) -> str:
    """Supply by year, fleet and ``by`` in fixed units; with ``missing`` an unknown amount makes a sum unknown."""
    total = (lambda x, d: f"CASE WHEN count({x}) = count(*) THEN {fixed(x, d)} END") if missing else (lambda x, d: f"coalesce({fixed(x, d)}, 0)")
    return f"""SELECT year, fishing_entity, {by}, f.short_nutrient AS nutrient, {total("f.value * t.tonnes * 10000.0", 6)} AS nut_supply
    FROM (SELECT year, fishing_entity, {by}, species, {total("tonnes", 12)} AS tonnes FROM v_biomass GROUP BY ALL) t
    LEFT JOIN v_filled f ON t.species = f.species GROUP BY ALL"""


def _fleet_cells(by: str, names, missing: bool) -> str:
    return f"SELECT {_cells(_FLEET, by, names, skip=not missing)} FROM ({_fleet_supply(by, missing)}) GROUP BY {_FLEET}"


view("v_fmfo", _fleet_cells("end_use", _END_USES, False))
view("v_discards", _fleet_cells("end_use", _END_USES, True))
view("v_reporting", _fleet_cells("reporting_status", ["Reported", "Unreported"], True))
_DHC, _FM = '"Direct human consumption"', 'coalesce("Fishmeal and fish oil", 0)'
oracle(
    "supply_enduse_fmfo",
    f"""SELECT {_FLEET}, {rs(_END_USES[:2], 6)}, {r(_FM, 6, 'Fishmeal and fish oil')},
      {r(ratio(_DHC, _FM), 7, 'fmfo_dhc_ratio')}, {r(ratio(_FM, _DHC), 7, 'dhc_fmfo_ratio')} FROM v_fmfo""",
)
oracle(
    "supply_discard_ratio",
    f"SELECT {_FLEET}, {rs(_END_USES, 6)}, {r(ratio('Discards', _DHC), 7, 'discard_ratio')} FROM v_discards",
)
oracle(
    "supply_reporting_ratio",
    f"""SELECT {_FLEET}, {rs(['Reported', 'Unreported'], 6)}, {r(ratio('Unreported', 'Reported'), 7, 'reporting_ratio')}
    FROM v_reporting""",
)
oracle(
    "supply_species_matrix",
    f"""SELECT scientific_name, {rs(SUPPLY_NUTRIENTS, 3)} FROM (
    SELECT {_cells('scientific_name', 'nutrient', SUPPLY_NUTRIENTS)} FROM v_full_supply GROUP BY scientific_name)""",
)


def _capped_ratio(source: str, metric: str, formula: str, cap: float) -> str:
    return f"""SELECT year, fishing_entity, iso3c, nutrient,
      {r(f'CASE WHEN {metric} > {cap} THEN {cap} ELSE {metric} END', 7, metric)}
    FROM (SELECT *, {formula} AS {metric} FROM {source}) LEFT JOIN v_iso ON fishing_entity = missing_countries
    WHERE year = {s.CATCH_YEAR} AND nutrient <> 'Protein'"""


oracle("ratio_cap_report", _capped_ratio("v_discards", "discard_ratio", ratio("Discards", _DHC), 2.5))
oracle(
    "ratio_cap_report_reporting", _capped_ratio("v_reporting", "reporting_ratio", ratio("Unreported", "Reported"), 10.0)
)

# Food balance.

view(
    "v_balance_orders",
    f"""SELECT CASE WHEN balance_code = 'EUN' THEN 'EU 27' ELSE n_name END AS countries, balance_code AS iso3c,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'Fish' WHEN o_orderpriority = '2-HIGH' THEN 'Beef and Veal'
           WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'Unlisted crop'
           WHEN o_orderpriority = '3-MEDIUM' THEN 'Maize' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '#N/A'
           ELSE 'Total food' END AS products,
      {pick('o_orderkey % 12', s.BALANCE_CODES)} AS code, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN v_nations ON c_nationkey = n_nationkey""",
)
view(
    "v_cells",
    """SELECT countries, iso3c, products, code, year, avg(o_totalprice) / 50000 AS value FROM v_balance_orders
    GROUP BY ALL""",
)
view(
    "v_long",
    f"""SELECT k.countries, k.products, k.iso3c, k.code, {case('k.code', BALANCE_NUTRIENTS, 'k.code')} AS nutrient,
      'mg/cap/day' AS units, CAST(y.year AS INTEGER) AS year, c.value
    FROM (SELECT DISTINCT countries, iso3c, products, code FROM v_cells) k
    CROSS JOIN (VALUES {values([[y] for y in s.BALANCE_YEARS])}) AS y(year)
    LEFT JOIN v_cells c ON c.countries = k.countries AND c.iso3c IS NOT DISTINCT FROM k.iso3c
      AND c.products = k.products AND c.code = k.code AND c.year = y.year""",
)
_SCOPE = ", ".join(text(n) for n in BALANCE_SCOPE)
view("v_scoped", f"SELECT * FROM v_long WHERE nutrient IN ({_SCOPE}) AND (iso3c IS NULL OR iso3c NOT IN ('N03', 'N07'))")
view(
    "v_members",
    """SELECT iso3c AS member, 'Nation ' || CAST(n_nationkey AS VARCHAR) AS member_name FROM v_nations
    WHERE r_name = 'EUROPE' AND n_name <> 'NATION_23'""",
)
view(
    "v_expanded",
    """SELECT countries, products, iso3c, nutrient, year, value FROM v_scoped
      WHERE iso3c IS NULL OR iso3c NOT IN ('EUN', 'WLD')
    UNION ALL SELECT member_name, products, member, nutrient, year, value FROM v_scoped CROSS JOIN v_members
      WHERE iso3c = 'EUN'""",
)
_LONG = "countries, products, iso3c, nutrient, year"
oracle(
    "balance_parse",
    f"""SELECT countries, products, iso3c, nutrient, code || ' supply ' AS nutrient_long, units, 'base' AS scenario,
      {', '.join(r(f'max(value) FILTER (WHERE year = {y})', 11, f'A{y}') for y in s.BALANCE_YEARS)}
    FROM v_long GROUP BY countries, products, iso3c, nutrient, code, units""",
)
oracle("balance_unpivot", f"SELECT {_LONG}, {r('value', 11)} FROM v_long")
oracle("balance_scope", f"SELECT {_LONG}, {r('value', 11)} FROM v_scoped")
oracle("bloc_expand", f"SELECT {_LONG}, {r('value', 11)} FROM v_expanded")
_SECTOR = case("products", PRODUCT_SECTORS)
oracle("production_sector", f"SELECT products, {_SECTOR} AS production_sector, count(*) AS n_rows FROM v_scoped GROUP BY 1, 2")
view(
    "v_sectors",
    f"""SELECT iso3c, {_SECTOR} AS production_sector,
      CASE nutrient WHEN 'Omega-3 fatty acids' THEN 'DHA+EPA' ELSE nutrient END AS nutrient,
      coalesce(sum(value), 0) AS nut_supply
    FROM v_expanded WHERE products <> 'Total food' AND year = {s.SUPPLY_YEAR} GROUP BY 1, 2, 3""",
)
oracle("sector_supply", f"SELECT iso3c, production_sector, nutrient, {r('nut_supply', 9)} FROM v_sectors")
for _name, _pop in (("", "v_pop"), ("_coastal", "v_coastal")):
    view(
        f"v_per_capita{_name}",
        f"""SELECT c.iso3c, 'bottom_trawl' AS production_sector,
          CASE c.nutrient WHEN 'Vitamin A, RAE' THEN 'Vitamin A' ELSE c.nutrient END AS nutrient,
          ({ratio('c.total', 'p.pop')}) / 365 AS nut_supply
        FROM (SELECT i.iso3c, nutrient, {strict('nut_supply')} AS total FROM v_full_supply
              LEFT JOIN v_iso i ON fishing_entity = missing_countries
              WHERE year = {s.SUPPLY_YEAR} AND end_use = 'Direct human consumption' GROUP BY 1, 2) c
        LEFT JOIN {_pop} p ON c.iso3c = p.iso3c""",
    )
    oracle(
        f"per_capita_supply{_name}",
        f"SELECT iso3c, production_sector, nutrient, {r('nut_supply', 7)} FROM v_per_capita{_name}",
    )
    _SECTORS = ["ASF", "Fish", "Other", "bottom_trawl"]
    view(
        f"v_wide_share{_name}",
        f"""SELECT {_cells('iso3c, nutrient', 'production_sector', _SECTORS)}
        FROM (SELECT * FROM v_sectors UNION ALL SELECT * FROM v_per_capita{_name}) GROUP BY iso3c, nutrient""",
    )
    view(
        f"v_filled_share{_name}",
        f"""SELECT iso3c, nutrient, ASF AS meat, coalesce(Fish, 0) AS Fish, coalesce(Other, 0) AS Other,
          coalesce(bottom_trawl, 0) AS bottom_trawl FROM v_wide_share{_name} WHERE ASF IS NOT NULL""",
    )
    view(
        f"v_shares{_name}",
        f"""SELECT iso3c, nutrient, meat + Fish AS ASF, Fish, Other, bottom_trawl, meat + Other + Fish AS total,
          100 * ({ratio('bottom_trawl', 'Fish')}) AS perc_fish, 100 * ({ratio('bottom_trawl', 'meat + Fish')}) AS perc_ASF,
          100 * ({ratio('bottom_trawl', 'meat + Other + Fish')}) AS perc_tot FROM v_filled_share{_name}""",
    )
    oracle(
        f"supply_share_table{_name}",
        "SELECT iso3c, nutrient, "
        + rs([*_SECTORS, "total", "perc_fish", "perc_ASF", "perc_tot"], 9)
        + f" FROM v_shares{_name}",
    )

# Foreign-fleet flows.

_ZONE_ISO = f"CASE WHEN z_key = 22 THEN NULL ELSE {code('z_key')} END"
_ZONE_REGION = "CASE WHEN z_key = 22 THEN NULL ELSE z_region END"
view(
    "v_zoned",
    f"""SELECT s.*, 'NATION ' || CAST(z_key AS VARCHAR) AS eez_country, {_ZONE_ISO} AS eez_iso, {_ZONE_REGION} AS continent,
      i.iso3c AS fishing_entity_ISO,
      CASE WHEN {_ZONE_ISO} = i.iso3c THEN 'your_country' WHEN {_ZONE_ISO} <> i.iso3c THEN 'other_country' END AS is_same
    FROM v_sel s LEFT JOIN v_iso i ON s.fishing_entity = i.missing_countries""",
)
view(
    "v_deficiency",
    f"""SELECT {code('s_nationkey')} AS iso3, l_linenumber,
      CASE WHEN s_nationkey = 9 AND l_linenumber = 7 THEN NULL
           ELSE 1000 * avg(l_discount) * (0.2 + (s_nationkey % 5) / 5) END AS perc_deficient
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_linenumber""",
)
view("v_intake", f"SELECT iso3, {strict('perc_deficient', 'avg')} AS intake FROM v_deficiency GROUP BY iso3")
view(
    "v_zone_flow",
    """SELECT z.*, your_country + other_country AS total,
      CASE WHEN your_country + other_country = 0 THEN NULL ELSE 100 * other_country / (your_country + other_country) END AS perc_foreign,
      CASE WHEN your_country + other_country < 1 THEN 1 ELSE ln(greatest(your_country + other_country, 1)) END AS total_log, intake
    FROM (SELECT eez_country, eez_iso, continent, coalesce(sum(full_tonnes) FILTER (WHERE is_same = 'your_country'), 0) AS your_country,
      coalesce(sum(full_tonnes) FILTER (WHERE is_same = 'other_country'), 0) AS other_country
      FROM v_zoned GROUP BY 1, 2, 3) z LEFT JOIN v_intake ON eez_iso = iso3""",
)
view(
    "v_fleet_flow",
    """SELECT fishing_entity_ISO AS iso3c, sum(full_tonnes) FILTER (WHERE is_same = 'your_country') AS your_country_entity,
      sum(full_tonnes) FILTER (WHERE is_same = 'other_country') AS other_country_entity FROM v_zoned GROUP BY 1""",
)
view(
    "v_scores",
    """SELECT eez_country, eez_iso, CAST(CASE WHEN intake > 25 THEN 1 WHEN intake <= 25 THEN 0 END AS INTEGER) AS is_vulnerable,
      CAST(CASE WHEN perc_foreign > 90 THEN 3 WHEN perc_foreign <= 90 THEN 0 END AS INTEGER) AS is_foreign FROM v_zone_flow""",
)
oracle(
    "zone_split",
    "SELECT DISTINCT eez, 'NATION ' || CAST(z_key AS VARCHAR) AS eez_country, z_region AS eez_region FROM v_catch",
)
oracle(
    "country_resolve",
    f"""SELECT DISTINCT eez, {_ZONE_ISO} AS iso3c, {_ZONE_REGION} AS continent,
      CASE WHEN z_key = 22 THEN NULL WHEN z_key % 4 <> 1 THEN 'Nation ' || CAST(z_key AS VARCHAR) ELSE {code('z_key')} END AS country
    FROM v_catch""",
)
oracle(
    "unresolved_names",
    f"""SELECT side, name, {r('sum(tonnes)', 6, 'tonnes')} FROM (
      SELECT 'zone' AS side, eez_country AS name, coalesce(tonnes, 0) AS tonnes FROM v_zoned WHERE eez_iso IS NULL
      UNION ALL SELECT 'fleet', fishing_entity, coalesce(tonnes, 0) FROM v_zoned WHERE fishing_entity_ISO IS NULL) GROUP BY 1, 2""",
)
oracle(
    "own_foreign_flag",
    f"""SELECT DISTINCT eez, fishing_entity, CASE WHEN {_ZONE_ISO} = i.iso3c THEN 'your_country'
      WHEN {_ZONE_ISO} <> i.iso3c THEN 'other_country' END AS is_same
    FROM v_catch LEFT JOIN v_iso i ON fishing_entity = missing_countries""",
)
oracle(
    "zone_fleet_tonnes",
    f"""SELECT eez_country, eez_iso, continent, fishing_entity, fishing_entity_ISO, {strict('tonnes')} AS tonnes, is_same
    FROM v_zoned GROUP BY ALL""",
)
_POINTS = f"{r('perc_foreign', 8)}, {r('total_log', 9)}, {r('intake', 8)}"
oracle(
    "zone_flow",
    f"SELECT eez_country, eez_iso, continent, your_country, other_country, total, {_POINTS} FROM v_zone_flow",
)
oracle("fleet_flow", "SELECT * FROM v_fleet_flow")
oracle(
    "flow_table",
    """SELECT eez_iso AS iso3c, your_country AS your_country_eez, other_country AS other_country_eez, your_country_entity,
      other_country_entity FROM v_zone_flow LEFT JOIN v_fleet_flow ON eez_iso = iso3c WHERE eez_iso IS NOT NULL""",
)
oracle("deficiency_mean", f"SELECT iso3, {r('intake', 8)} FROM v_intake")
oracle("vulnerability_score", "SELECT *, is_vulnerable + is_foreign AS is_all FROM v_scores")
oracle(
    "vulnerable_zones",
    "SELECT eez_country, eez_iso, is_vulnerable + is_foreign AS is_all FROM v_scores WHERE is_vulnerable = 1",
)
oracle(
    "critical_zones",
    "SELECT eez_country, eez_iso, is_vulnerable + is_foreign AS is_all FROM v_scores WHERE is_vulnerable + is_foreign = 4",
)
view(
    "v_nutrient_rows",
    f"""SELECT z.*, f.short_nutrient AS nutrient, f.value * z.tonnes * 10 * 1000 AS nut_supply
    FROM v_zoned z LEFT JOIN v_filled f ON z.species = f.species WHERE z.year = {s.SUPPLY_YEAR}""",
)


def _flagged(flag: str) -> str:
    return f"coalesce(sum(nut_supply) FILTER (WHERE is_same = '{flag}'), 0)"


view(
    "v_zone_nutrients",
    f"""SELECT z.*, pop, your_country + other_country AS total, ({ratio('other_country', 'pop')}) / 365 AS per_capita
    FROM (SELECT eez_country, eez_iso, continent, nutrient, {_flagged('your_country')} AS your_country,
      {_flagged('other_country')} AS other_country FROM v_nutrient_rows WHERE eez_iso IS NOT NULL GROUP BY 1, 2, 3, 4) z
    LEFT JOIN v_pop ON eez_iso = iso3c""",
)
view(
    "v_fleet_nutrients",
    f"""SELECT f.*, ({ratio('other_country_entity', 'pop')}) / 365 AS per_capita_entity
    FROM (SELECT fishing_entity_ISO AS iso3c, nutrient, {_flagged('your_country')} AS your_country_entity,
      {_flagged('other_country')} AS other_country_entity FROM v_nutrient_rows
      WHERE fishing_entity_ISO IS NOT NULL GROUP BY 1, 2) f LEFT JOIN v_pop p ON f.iso3c = p.iso3c""",
)
view(
    "v_net",
    """SELECT z.eez_iso AS iso3c, z.nutrient, coalesce(z.per_capita, 0) - coalesce(f.per_capita_entity, 0) AS per_capita
    FROM v_zone_nutrients z LEFT JOIN v_fleet_nutrients f ON z.eez_iso = f.iso3c AND z.nutrient IS NOT DISTINCT FROM f.nutrient""",
)
oracle(
    "nutrient_zone_flow",
    f"""SELECT eez_country, eez_iso, continent, nutrient, {rs(['your_country', 'other_country', 'total'], 2)}, {r('pop', 4)},
      {r('per_capita', 7)} FROM v_zone_nutrients""",
)
oracle(
    "nutrient_fleet_flow",
    f"""SELECT iso3c, nutrient, {rs(['your_country_entity', 'other_country_entity'], 2)}, {r('per_capita_entity', 7)}
    FROM v_fleet_nutrients""",
)
oracle("net_nutrient_flow", f"SELECT iso3c, nutrient, {r('per_capita', 7)} FROM v_net")

# Intake scenarios.

view(
    "v_other",
    f"""SELECT iso3c, nutrient, coalesce(sum(value), 0) AS supply FROM v_scoped
    WHERE products NOT IN ('Fish', 'Total food') AND year = {s.SUPPLY_YEAR} GROUP BY 1, 2""",
)
view(
    "v_fish",
    f"""SELECT b.iso3c, b.nutrient, b.units, b.value, o.supply, n.per_capita
    FROM v_scoped b LEFT JOIN v_other o ON b.iso3c IS NOT DISTINCT FROM o.iso3c AND b.nutrient = o.nutrient
    LEFT JOIN v_net n ON b.iso3c = n.iso3c AND b.nutrient =
      CASE n.nutrient WHEN 'DHA+EPA' THEN 'Omega-3 fatty acids' WHEN 'Vitamin A, RAE' THEN 'Vitamin A' ELSE n.nutrient END
    WHERE b.products = 'Fish' AND b.year = {s.SUPPLY_YEAR}""",
)
view(
    "v_scenarios",
    """SELECT iso3c, nutrient, units, 'base' AS scenario, value + supply AS total_supply FROM v_fish
    UNION ALL SELECT iso3c, nutrient, units, 'high',
      CASE WHEN per_capita IS NULL THEN value ELSE value + per_capita END + supply FROM v_fish""",
)
view(
    "v_intakes",
    f"""SELECT coalesce(m.member, x.iso3c) AS iso3,
      CASE WHEN m.member IS NOT NULL THEN m.member_name WHEN x.iso3c IS NULL THEN NULL
           WHEN CAST(substring(x.iso3c, 2) AS INTEGER) % 4 <> 1 THEN 'Nation ' || CAST(CAST(substring(x.iso3c, 2) AS INTEGER) AS VARCHAR)
           ELSE x.iso3c END AS country,
      CASE nutrient WHEN 'Vitamin A' THEN 'Vitamin A, RAE' WHEN 'Vitamin B12' THEN 'Vitamin B-12' ELSE nutrient END AS nutrient,
      units AS nutrient_units, CASE scenario WHEN 'base' THEN 'Base' ELSE 'High road' END AS scenario, total_supply AS intake
    FROM (SELECT *, CASE WHEN iso3c = 'EUN' THEN NULL ELSE substring(iso3c, 2) END AS num FROM v_scenarios
          WHERE iso3c IS NULL OR iso3c <> 'WLD') x
    LEFT JOIN v_members m ON x.iso3c = 'EUN'
    WHERE x.iso3c IS DISTINCT FROM 'EUN' OR m.member IS NOT NULL""",
)
VIEWS["v_intakes"] = VIEWS["v_intakes"].replace("CAST(substring(x.iso3c, 2) AS INTEGER)", "TRY_CAST(x.num AS INTEGER)")
_SEGMENT = {"AUTOMOBILE": "Calcium", "BUILDING": "Iron", "FURNITURE": "Vitamin A", "HOUSEHOLD": "Vitamin B-12", "MACHINERY": "Zinc"}
_BANDS = [*list(AGE_CODES)[:16], "80+"]
view(
    "v_supply_sex",
    f"""SELECT CASE WHEN c_nationkey % 4 = 0 THEN {code('c_nationkey', 'G')} ELSE {code('c_nationkey')} END AS iso3_use,
      'Nation ' || CAST(c_nationkey AS VARCHAR) AS country_use, {case('c_mktsegment', _SEGMENT)} AS nutrient,
      'milligrams' AS units_long, 'mg' AS units_short,
      CASE WHEN c_custkey % 17 <= 2 THEN 'Children' WHEN (c_custkey // 17) % 2 = 0 THEN 'Males' ELSE 'Females' END AS sex,
      {pick('c_custkey % 17', _BANDS)} AS age_range,
      CASE WHEN c_nationkey = 5 AND c_custkey % 17 = 16 THEN NULL ELSE avg(greatest(c_acctbal, 0)) + 100 END AS value_med
    FROM customer GROUP BY c_nationkey, c_mktsegment, c_custkey % 17, 6""",
)
view(
    "v_sexes",
    """SELECT iso3_use, country_use, nutrient, units_long, units_short, age_range, value_med, sex FROM v_supply_sex WHERE sex <> 'Children'
    UNION ALL SELECT iso3_use, country_use, nutrient, units_long, units_short, age_range, value_med, x
      FROM v_supply_sex CROSS JOIN (VALUES ('Males'), ('Females')) AS t(x) WHERE sex = 'Children'""",
)
_KEYS = "iso3_use, country_use, nutrient, units_long, units_short"
view(
    "v_scalars",
    f"""SELECT iso3_use AS iso3, nutrient, sex, age_range AS age_group, value_med / mean AS scalar FROM (
      SELECT *, CASE WHEN count(value_med) OVER (PARTITION BY {_KEYS}) = count(*) OVER (PARTITION BY {_KEYS})
        THEN avg(value_med) OVER (PARTITION BY {_KEYS}) END AS mean FROM v_sexes) WHERE mean IS NOT NULL""",
)
view(
    "v_scalars80",
    f"""SELECT iso3, nutrient, sex, age_group, scalar FROM v_scalars WHERE age_group <> '80+'
    UNION ALL SELECT iso3, nutrient, sex, a, scalar FROM v_scalars
      CROSS JOIN (VALUES {values([[text(a)] for a in AGES_OVER_80])}) AS t(a) WHERE age_group = '80+'""",
)
view(
    "v_survey",
    f"""SELECT {code('c_nationkey')} AS iso3,
      {pick('o_custkey % 3', ['Omega-3 fatty acids', 'Vitamin B-12', 'Vitamin A, RAE'])} AS nutrient,
      CASE WHEN o_custkey % 2 = 0 THEN 'Males' ELSE 'Females' END AS sex,
      {pick('o_orderkey % 20', s.SURVEY_AGES)} AS age_group, avg(o_totalprice) / 250000 AS scalar
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""",
)
view(
    "v_demography",
    "SELECT * FROM (VALUES "
    + values([[text(a), c, i] for i, (a, c) in enumerate(AGE_CODES.items())])
    + ") AS a(age_group, age_id, step) CROSS JOIN (VALUES ('Males', 1), ('Females', 2)) AS x(sex, sex_id)",
)
view(
    "v_survey_groups",
    """SELECT a.age_group, x.sex, x.sex_id, d.age_id FROM (SELECT DISTINCT age_group FROM v_survey) a
    CROSS JOIN (VALUES ('Males', 1), ('Females', 2)) AS x(sex, sex_id)
    LEFT JOIN v_demography d ON d.age_group = a.age_group AND d.sex = x.sex""",
)
view(
    "v_group_intake",
    """SELECT i.scenario, i.iso3, i.country, i.nutrient, i.nutrient_units, i.sex, i.age_group, i.sex_id, i.age_id,
      i.nutrient_genus, i.iso3_genus, g.scalar AS scalar_genus, v.scalar AS scalar_spade,
      CASE WHEN i.nutrient IN ('Omega-3 fatty acids', 'Vitamin B-12') OR g.scalar IS NULL THEN v.scalar ELSE g.scalar END AS scalar,
      i.intake AS mean_cntry
    FROM (SELECT *, CASE nutrient WHEN 'Vitamin A, RAE' THEN 'Vitamin A' ELSE nutrient END AS nutrient_genus,
            CASE WHEN TRY_CAST(substring(iso3, 2) AS INTEGER) % 4 = 0 THEN 'G' || substring(iso3, 2) ELSE iso3 END AS iso3_genus
          FROM v_intakes LEFT JOIN v_survey_groups ON iso3 IS NOT NULL) i
    LEFT JOIN v_scalars80 g ON i.iso3_genus = g.iso3 AND i.nutrient_genus = g.nutrient AND i.sex = g.sex AND i.age_group = g.age_group
    LEFT JOIN v_survey v ON i.iso3 = v.iso3 AND i.nutrient = v.nutrient AND i.sex = v.sex AND i.age_group = v.age_group""",
)
_SPREAD = "CASE c_nationkey % 5 WHEN 1 THEN 3.0 WHEN 2 THEN 0.125 ELSE 1.0 END"


def _fits(kind: str) -> str:
    return f"""SELECT {code('c_nationkey')} AS iso3, k, d.sex, d.age_group, d.sex_id, d.age_id,
      CASE WHEN c_nationkey % 3 = 0 THEN 'gamma' ELSE 'log-normal' END AS best_dist,
      CASE WHEN sd <> 0 THEN mean * mean / (sd * sd) END AS g_shape, CASE WHEN sd <> 0 THEN mean / (sd * sd) END AS g_rate,
      meanlog + 0.01 * d.step AS ln_meanlog, ln_sdlog
    FROM (SELECT c_nationkey, {kind} AS k, avg(ln(o_totalprice / 10000)) AS meanlog,
        stddev_samp(ln(o_totalprice / 10000)) * {_SPREAD} AS ln_sdlog, avg(o_totalprice) / 10000 AS mean,
        stddev_samp(o_totalprice) / 10000 * {_SPREAD} AS sd
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) CROSS JOIN v_demography d"""


view(
    "v_fits",
    f"""SELECT * EXCLUDE (k, sex_id, age_id), CASE k WHEN 3 THEN 'Vitamin A, RAE' ELSE {pick('k', s.INTAKE_NUTRIENTS)} END AS nutrient
    FROM ({_fits('o_orderkey % 6')})""",
)
view(
    "v_fitted",
    """SELECT i.*, mean_cntry * scalar AS mean_group, f.best_dist, f.g_shape, f.g_rate, f.ln_meanlog, f.ln_sdlog,
      f.g_shape / f.g_rate AS g_mean, mean_cntry * scalar - f.g_shape / f.g_rate AS g_mean_diff,
      exp(f.ln_meanlog + f.ln_sdlog * f.ln_sdlog / 2) AS ln_mean,
      mean_cntry * scalar - exp(f.ln_meanlog + f.ln_sdlog * f.ln_sdlog / 2) AS ln_mean_diff
    FROM v_group_intake i LEFT JOIN v_fits f
      ON i.iso3 = f.iso3 AND i.nutrient = f.nutrient AND i.sex = f.sex AND i.age_group = f.age_group""",
)
view("v_coded", "SELECT * FROM v_fitted WHERE mean_group IS NOT NULL")
oracle("other_food_supply", f"SELECT iso3c, nutrient, {r('supply', 9)} FROM v_other")
oracle("fish_scenarios", f"SELECT iso3c, nutrient, units, scenario, {r('total_supply', 9)} FROM v_scenarios")
oracle(
    "scenario_bloc_expand",
    f"SELECT iso3, country, nutrient, nutrient_units, scenario, {r('intake', 9)} FROM v_intakes",
)
oracle("sex_expand", f"SELECT {_KEYS}, sex, age_range, {r('value_med', 6)} FROM v_sexes")
oracle("group_scalar", f"SELECT iso3, nutrient, sex, age_group, {r('scalar', 8)} FROM v_scalars")
oracle("age_band_expand", f"SELECT iso3, nutrient, sex, age_group, {r('scalar', 8)} FROM v_scalars80")
oracle(
    "demographic_grid",
    """SELECT iso3, sex, age_group FROM (SELECT DISTINCT iso3 FROM v_intakes WHERE iso3 IS NOT NULL) CROSS JOIN v_survey_groups""",
)
oracle(
    "intake_by_group",
    f"""SELECT scenario, iso3, country, nutrient, nutrient_units, sex, age_group, nutrient_genus, iso3_genus,
      {rs(['scalar_genus', 'scalar_spade', 'scalar'], 11)}, {r('mean_cntry', 9)},
      {r('mean_cntry * scalar', 6, 'mean_group')} FROM v_group_intake""",
)
oracle(
    "distribution_attach",
    f"""SELECT scenario, iso3, nutrient, sex, age_group, best_dist,
      {rs(['g_mean', 'g_mean_diff', 'ln_mean', 'ln_mean_diff'], 6)} FROM v_fitted""",
)
oracle(
    "demographic_codes",
    f"""SELECT scenario, iso3, nutrient, CAST(sex_id AS INTEGER) AS sex_id, CAST(age_id AS INTEGER) AS age_id, sex,
      CASE WHEN age_id IS NOT NULL THEN age_group END AS age_group, {r('mean_group', 6)} FROM v_coded""",
)
oracle(
    "completeness_report",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS label, {c} AS label_value, count(*) AS n_rows, count(*) - count(scalar) AS n_missing
        FROM v_fitted GROUP BY {c}"""
        for c in ("nutrient", "country")
    )
    + """ UNION ALL SELECT 'strict supply', nutrient, count(*), count(*) - count(nut_supply) FROM v_per_capita GROUP BY nutrient"""
    + "".join(
        f" UNION ALL SELECT 'column', '{c}', count(*), count(*) - count({c}) FROM v_fitted"
        for c in ("iso3", "sex", "scalar", "mean_group", "best_dist")
    ),
)

# Risk curves: omega-3 is outcome 0 here.


def _bands(level: str, cause: str) -> str:
    return f"""SELECT {cause} AS cause_id, {pick(f'l_partkey % {len(s.CURVE_AGES)}', s.CURVE_AGES)} AS age_id,
      CAST(least(floor(l_quantity / 10), 4) AS INTEGER) AS band, avg({level}) AS level FROM lineitem GROUP BY 1, 2, 3"""


# An outcome without a code is known by minus the crc32 of its name.
_UNLISTED = -zlib.crc32(s.UNLISTED_OUTCOME.encode())
_CAUSE = f"CASE WHEN l_suppkey % 8 = 7 THEN {_UNLISTED} ELSE {pick('l_linenumber - 1', list(MEAT_OUTCOMES.values()))} END"
view(
    "v_points",
    f"""SELECT 0 AS cause_id, age_id, 3.0 * band AS x, 1 - band * level AS y FROM ({_bands('l_discount', '0')})
    UNION ALL SELECT cause_id, age_id, 50.0 * band, 1 + band * level * 2 FROM ({_bands('l_tax', _CAUSE)})""",
)
view("v_last", "SELECT cause_id, age_id, max_by(y, x) AS last_risk FROM v_points GROUP BY 1, 2")
_LOW = "CASE cause_id WHEN 0 THEN -0.2 ELSE -200 END"
_HIGH = "CASE cause_id WHEN 0 THEN 6.0 ELSE 1000 END"
view(
    "v_knots",
    f"""SELECT *, row_number() OVER (PARTITION BY cause_id, age_id ORDER BY x) - 1 AS i FROM (
      SELECT cause_id, age_id, x, avg(y) AS y FROM (
        SELECT cause_id, age_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM v_points
        UNION ALL SELECT cause_id, age_id, CAST({_LOW} AS DOUBLE), 1.0 FROM v_last
        UNION ALL SELECT cause_id, age_id, CAST({_HIGH} AS DOUBLE), last_risk FROM v_last) GROUP BY 1, 2, 3)""",
)
view(
    "v_secants",
    """SELECT *, (s + coalesce(lead(s) OVER w, s)) / 2 AS next_slope FROM (
      SELECT k.cause_id, k.age_id, k.i, (n.y - k.y) / (n.x - k.x) AS s
      FROM v_knots k JOIN v_knots n ON k.cause_id = n.cause_id AND k.age_id = n.age_id AND n.i = k.i + 1)
    WINDOW w AS (PARTITION BY cause_id, age_id ORDER BY i)""",
)


def _limited(side: str, left: str, right: str) -> str:
    a, b = f"(({left}) / s)", f"(({right}) / s)"
    own = left if side == "left" else right
    return f"""CASE WHEN s = 0 THEN 0.0 WHEN 2 * {a} + {b} > 3 AND {a} + 2 * {b} > 3
      AND {a} * 3 * ({a} + {b} - 2) < (2 * {a} + {b} - 3) * (2 * {a} + {b} - 3)
      THEN ({own}) * 3 / sqrt({a} * {a} + {b} * {b}) ELSE {own} END"""


view(
    "v_slopes",
    f"""SELECT cause_id, age_id, i, {_limited('left', 's', 'next_slope')} AS m_left, {_limited('right', 's', 'next_slope')} AS m_right
      FROM v_secants WHERE i = 0
    UNION ALL SELECT * FROM (
      SELECT p.cause_id, p.age_id, c.i, {_limited('left', 'p.m_right', 'c.next_slope')} AS m_left,
        {_limited('right', 'p.m_right', 'c.next_slope')} AS m_right
      FROM v_slopes p JOIN v_secants c ON p.cause_id = c.cause_id AND p.age_id = c.age_id AND c.i = p.i + 1) AS walked""",
)
view(
    "v_pieces",
    """SELECT a.cause_id, a.age_id, a.i AS piece, a.x AS x0, b.x AS x1, a.y AS y0, b.y AS y1, p.m_left AS m0,
      coalesce(q.m_left, p.m_right) AS m1, l.last_risk,
      CASE WHEN a.i = 0 THEN CAST('-inf' AS DOUBLE) ELSE a.x END AS lo,
      CASE WHEN q.i IS NULL THEN CAST('inf' AS DOUBLE) ELSE b.x END AS hi
    FROM v_knots a JOIN v_knots b ON a.cause_id = b.cause_id AND a.age_id = b.age_id AND b.i = a.i + 1
    JOIN v_slopes p ON p.cause_id = a.cause_id AND p.age_id = a.age_id AND p.i = a.i
    LEFT JOIN v_slopes q ON q.cause_id = a.cause_id AND q.age_id = a.age_id AND q.i = a.i + 1
    JOIN v_last l ON l.cause_id = a.cause_id AND l.age_id = a.age_id""",
)


# Stretches without a kink: the pieces, and the lines beyond both ends.
view(
    "v_stretches",
    """SELECT *, x0 AS a, x1 AS b FROM v_pieces UNION ALL SELECT *, CAST('-inf' AS DOUBLE), x0 FROM v_pieces WHERE isinf(lo)
    UNION ALL SELECT *, x1, CAST('inf' AS DOUBLE) FROM v_pieces WHERE isinf(hi)""",
)


def curve_at(x: str) -> str:
    h, t = "(x1 - x0)", f"((({x}) - x0) / (x1 - x0))"
    return f"""CASE WHEN {x} < x0 THEN y0 + m0 * ({x} - x0) WHEN {x} > x1 THEN y1 + m1 * ({x} - x1)
      ELSE y0 * (2 * pow({t}, 3) - 3 * pow({t}, 2) + 1) + {h} * m0 * (pow({t}, 3) - 2 * pow({t}, 2) + {t})
        + y1 * (3 * pow({t}, 2) - 2 * pow({t}, 3)) + {h} * m1 * (pow({t}, 3) - pow({t}, 2)) END"""


_PIECE = f"CAST(piece AS INTEGER) AS piece, x0, x1, {rs(['y0', 'y1', 'm0', 'm1', 'last_risk'], 8)}"
oracle(
    "curve_table",
    f"SELECT CAST(cause_id AS BIGINT) AS cause_id, CAST(age_id AS INTEGER) AS age_id, {_PIECE} FROM v_pieces WHERE cause_id <> 0",
)
oracle("curve_table_omega", f"SELECT CAST(age_id AS INTEGER) AS age_id, {_PIECE} FROM v_pieces WHERE cause_id = 0")
view(
    "v_persons",
    f"""SELECT o_custkey AS person, {pick(f'o_custkey % {len(s.CURVE_AGES) + 1}', [7, *s.CURVE_AGES])} AS age_id, avg(o_totalprice) AS price
    FROM orders GROUP BY o_custkey""",
)
oracle(
    "omega_risk",
    f"""SELECT person, CAST(q.age_id AS INTEGER) AS age_id, {r(f"CASE WHEN q.age_id IN (5, 6, 7, 8, 9) THEN 0 ELSE {curve_at('x')} END", 7, 'risk')}
    FROM (SELECT *, price / 10000 - 5 AS x FROM v_persons) q
    LEFT JOIN v_pieces p ON p.cause_id = 0 AND p.age_id = q.age_id AND lo <= x AND x < hi""",
)
_CAUSES = values([[c] for c in MEAT_OUTCOMES.values()])
oracle(
    "red_meat_risk",
    f"""SELECT person, CAST(q.cause AS INTEGER) AS cause_id, CAST(q.age_id AS INTEGER) AS age_id,
      {r(f"CASE WHEN q.age_id IN (5, 6, 7, 8, 9) THEN 0 ELSE {curve_at('x')} END", 7, 'risk')}
    FROM (SELECT *, price / 2000 AS x FROM v_persons CROSS JOIN (VALUES {_CAUSES}) AS t(cause)) q
    LEFT JOIN v_pieces p ON p.cause_id = q.cause AND p.age_id = q.age_id AND lo <= x AND x < hi""",
)

# Requirements and exposure.

view(
    "v_needs",
    f"""SELECT {pick('c_custkey % 20', list(AGE_CODES.values()))} AS age_id, (c_custkey // 20) % 2 + 1 AS sex_id,
      avg(greatest(c_acctbal, 0)) / 250 + 5 AS b FROM customer GROUP BY 1, 2""",
)
_FACTORS = [
    ("Iron", "low", 1.5),
    ("Iron", "middle", 1.0),
    ("Iron", "high", 0.8),
    ("Zinc", "low", 1.2),
    ("Zinc", "middle", 1.0),
    ("Zinc", "high", 0.9),
    ("Vitamin A, RAE", "any", 1.1),
    ("Vitamin B-12", "any", 0.95),
    ("Calcium", "any", 1.0),
]
view(
    "v_ears",
    f"""SELECT nutrient, availability, age_id, sex_id, b * factor AS ear FROM v_needs
    CROSS JOIN (VALUES {values([[text(n), text(a), f] for n, a, f in _FACTORS])}) AS t(nutrient, availability, factor)""",
)
view(
    "v_sdi",
    f"""SELECT {code('n_nationkey')} AS iso3, CASE WHEN n_nationkey = 6 THEN NULL WHEN n_nationkey % 3 = 0 THEN 'low'
      WHEN n_nationkey % 3 = 1 THEN 'middle' ELSE 'high' END AS sdi_group FROM nation""",
)
view(
    "v_needed",
    """SELECT c.*, d.sdi_group, e.ear, CASE c.nutrient WHEN 'Vitamin B-12' THEN 0.25 ELSE 0.1 END AS cv
    FROM v_coded c LEFT JOIN v_sdi d ON c.iso3 = d.iso3
    LEFT JOIN v_ears e ON e.nutrient = c.nutrient AND e.age_id = c.age_id AND e.sex_id = c.sex_id
      AND e.availability = CASE WHEN c.nutrient IN ('Iron', 'Zinc') THEN d.sdi_group ELSE 'any' END""",
)
_WHO = "scenario, iso3, nutrient, CAST(sex_id AS INTEGER) AS sex_id, CAST(age_id AS INTEGER) AS age_id"
oracle("ear_lookup", f"SELECT {_WHO}, sdi_group, {r('ear', 8)} FROM v_needed")


def _powers(coefficients: list[float], x: str) -> str:
    return " + ".join(f"{c!r} * pow({x}, {len(coefficients) - 1 - i})" for i, c in enumerate(coefficients))


def tail_of(z: str) -> str:
    """P(Z > z): Hart's fraction, and the continued fraction far out."""
    x = f"abs({z})"
    far = f"({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65)))))"
    tail = f"""(CASE WHEN {x} > 38 THEN 0 WHEN {x} < {NORMAL_SPLIT} THEN exp(-({z}) * ({z}) / 2) * ({_powers(NORMAL_TOP, x)})
      / ({_powers(NORMAL_BOTTOM, x)}) ELSE exp(-({z}) * ({z}) / 2) / ({far} * sqrt(2 * pi())) END)"""
    return f"CASE WHEN ({z}) >= 0 THEN {tail} ELSE 1 - {tail} END"


oracle(
    "micronutrient_risk",
    f"""SELECT {_WHO}, {r(tail_of('z'), 6, 'risk')}
    FROM (SELECT *, CASE WHEN ear <> 0 THEN (mean_group - ear) / (cv * ear) END AS z FROM v_needed)""",
)

# Boole's rule on 0..1 for every stretch. Other integrals than the code's: here the risk is integrated over the
# density, in z for log-normal and in log x for gamma fits, a curve piece by piece and the risk of a requirement from
# cut to cut around it, so that neither depends on how wide or how far shifted a fit is.


def _boole(name: str, n: int) -> None:
    view(
        name,
        f"""SELECT i / {n} AS u, CASE WHEN i IN (0, {n}) THEN 7 WHEN i % 2 = 1 THEN 32 WHEN i % 4 = 2 THEN 12 ELSE 14 END / {22.5 * n} AS w
        FROM (SELECT CAST(i AS DOUBLE) AS i FROM generate_series(0, {n}) AS g(i))""",
    )


_boole("v_piece_nodes", 400)
_boole("v_part_nodes", 160)
_DENSITY_Z = "exp(-z * z / 2) / sqrt(2 * pi())"
view("v_shapes", "SELECT DISTINCT g_shape AS a FROM v_fits WHERE g_shape > 0")
view("v_terms", "SELECT CAST(n AS DOUBLE) AS n FROM generate_series(0, 700) AS g(n)")
view(
    "v_g_steps",
    """SELECT 0 AS step, a, p, (ln(p) + lgamma(a + 1)) / a - 1 AS lo, ln(a + 12 * sqrt(a) + 40) AS hi
      FROM v_shapes CROSS JOIN (VALUES (0.0001), (0.9999)) AS t(p)
    UNION ALL SELECT * FROM (
      SELECT s.step + 1, s.a, s.p, CASE WHEN m.mass < s.p THEN (s.lo + s.hi) / 2 ELSE s.lo END,
        CASE WHEN m.mass < s.p THEN s.hi ELSE (s.lo + s.hi) / 2 END
      FROM v_g_steps s JOIN LATERAL (SELECT sum(exp((s.a + n) * (s.lo + s.hi) / 2 - exp((s.lo + s.hi) / 2)
        - lgamma(s.a + n + 1))) AS mass FROM v_terms) m ON true WHERE s.step < 60) AS bisected""",
)
view(
    "v_tails",
    """SELECT a, max((lo + hi) / 2) FILTER (WHERE p < 0.5) AS t_lo, max((lo + hi) / 2) FILTER (WHERE p > 0.5) AS t_hi
    FROM v_g_steps WHERE step = 60 GROUP BY a""",
)
_BOUND = "scenario, iso3, nutrient, CAST(sex_id AS INTEGER) AS sex_id, CAST(age_id AS INTEGER) AS age_id"
oracle(
    "intake_bounds",
    f"""SELECT {_BOUND},
      {r(f'CASE WHEN ln_sdlog > 0 THEN exp(ln_meanlog - {TAIL_Z} * ln_sdlog) + ln_mean_diff END', 5, 'val_lo')},
      {r(f'CASE WHEN ln_sdlog > 0 THEN exp(ln_meanlog + {TAIL_Z} * ln_sdlog) + ln_mean_diff END', 5, 'val_hi')} FROM v_coded""",
)
oracle(
    "intake_bounds_gamma",
    f"""SELECT {_BOUND}, {r('exp(t_lo) / g_rate + g_mean_diff', 5, 'val_lo')}, {r('exp(t_hi) / g_rate + g_mean_diff', 5, 'val_hi')}
    FROM v_coded LEFT JOIN v_tails ON a = g_shape""",
)
_ROW = "scenario, country, iso3, nutrient, sex_id, age_id"
view(
    "v_micro_rows",
    """SELECT * FROM v_needed WHERE age_id >= 5
      AND nutrient IN ('Zinc', 'Iron', 'Calcium', 'Vitamin A, RAE', 'Vitamin B-12')""",
)
view("v_omega_rows", "SELECT * FROM v_coded WHERE nutrient = 'Omega-3 fatty acids' AND age_id >= 10")
def floored(value: str) -> str:
    return f"CASE WHEN ({value}) < 0 THEN 0 ELSE {value} END"


def _clipped(value: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {value}))"


def _integrals(rows: str, keys: str, pieces: str, mu: str, sd: str, shift: str) -> str:
    """Mean risk of log-normal rows per curve: the sum over a curve's pieces."""
    z = lambda x: f"CASE WHEN {x} <= {shift} THEN -{TAIL_Z} ELSE {_clipped(f'(ln({x} - {shift}) - {mu}) / {sd}', f'-{TAIL_Z}', TAIL_Z)} END"
    return f"""SELECT {keys}, cause_id, last_risk, sum(w * (z_hi - z_lo) * {_DENSITY_Z} * ({curve_at('v')})) AS integral
    FROM (SELECT *, exp({mu} + {sd} * z) + {shift} AS v
      FROM (SELECT *, z_lo + (z_hi - z_lo) * u AS z
        FROM (SELECT q.*, p.* EXCLUDE (age_id), CASE WHEN isinf(p.a) THEN -{TAIL_Z} ELSE {z('p.a')} END AS z_lo,
                CASE WHEN isinf(p.b) THEN {TAIL_Z} ELSE {z('p.b')} END AS z_hi
              FROM {rows} q JOIN v_stretches p ON {pieces} AND p.age_id = q.age_id WHERE {sd} > 0)
        CROSS JOIN v_piece_nodes WHERE z_hi > z_lo)) GROUP BY {keys}, cause_id, last_risk"""


def _gamma_integrals(rows: str, keys: str) -> str:
    """The same for gamma rows of omega-3, in log x."""
    unit = lambda x: f"(({x} - g_mean_diff) * g_rate)"
    t = lambda x: f"CASE WHEN {unit(x)} <= exp(t_lo) THEN t_lo ELSE {_clipped(f'ln({unit(x)})', 't_lo', 't_hi')} END"
    return f"""SELECT {keys}, last_risk, sum(w * (t_b - t_a) * exp(g_shape * t - exp(t) - lgamma(g_shape)) * ({curve_at('v')})) AS integral
    FROM (SELECT *, exp(t) / g_rate + g_mean_diff AS v
      FROM (SELECT *, t_a + (t_b - t_a) * u AS t
        FROM (SELECT q.*, p.* EXCLUDE (age_id), CASE WHEN isinf(p.a) THEN t_lo ELSE {t('p.a')} END AS t_a,
                CASE WHEN isinf(p.b) THEN t_hi ELSE {t('p.b')} END AS t_b
              FROM {rows} q JOIN v_tails ts ON ts.a = g_shape JOIN v_stretches p ON p.cause_id = 0 AND p.age_id = q.age_id)
        CROSS JOIN v_piece_nodes WHERE t_b > t_a)) GROUP BY {keys}, last_risk"""


def _omega(integrals: str, guard: str) -> str:
    own = ", ".join(f"c.{k}" for k in _ROW.split(", "))
    return f"""SELECT {own}, {floored(f"CASE WHEN {guard} THEN {ratio('integral - last_risk', '1 - last_risk')} END * 100")} AS sev
    FROM v_omega_rows c LEFT JOIN ({integrals}) g USING ({_ROW})"""


_CUTS = (-9, -6, -4.5, -3, -2, -1, 0, 1, 2, 3, 4.5, 6, 9)


def _micro(rows: str, place: str, low: str, high: str, x: str, density: str, guard: str) -> str:
    """Exposure per row: the risk over the density, from cut to cut. ``place`` turns an intake ``v`` into the variable ``p``
    that is integrated over from ``low`` to ``high``, and ``x`` turns ``p`` into the intake."""
    cuts = [place.replace("{v}", f"(ear + {k} * cv * ear)") for k in _CUTS] + [f"{low} + ({high} - {low}) * {k / 8}" for k in range(9)]
    return f"""SELECT {", ".join(f"c.{k}" for k in _ROW.split(", "))}, g.sev FROM v_micro_rows c LEFT JOIN (
      SELECT {_ROW}, 100 * sum(w * (p_hi - p_lo) * {density} * ({tail_of("u")})) AS sev
      FROM (SELECT *, ({x} - ear) / (cv * ear) AS u
        FROM (SELECT q.*, n.w, p_lo + (p_hi - p_lo) * n.u AS p
          FROM (SELECT * EXCLUDE (cuts, i), cuts[i] AS p_lo, cuts[i + 1] AS p_hi
            FROM (SELECT *, unnest(range(1, len(cuts))) AS i
              FROM (SELECT *, list_sort([{", ".join(cuts)}]) AS cuts FROM {rows} WHERE {guard} AND ear <> 0))) q
          CROSS JOIN v_part_nodes n WHERE p_hi > p_lo))
      GROUP BY {_ROW}) g USING ({_ROW})"""


def _place(own: str, low: str, high: str, floor: str) -> str:
    return f"CASE WHEN {{v}} <= {floor} THEN {low} ELSE {_clipped(own, low, high)} END"


_LN_PLACE = _place("(ln({v} - ln_mean_diff) - ln_meanlog) / ln_sdlog", f"-{TAIL_Z}", str(TAIL_Z), "ln_mean_diff")
_G_PLACE = _place("ln(({v} - g_mean_diff) * g_rate)", "t_lo", "t_hi", "g_mean_diff")
view(
    "v_sev_micro",
    _micro("v_micro_rows", _LN_PLACE, f"-{TAIL_Z}", str(TAIL_Z), "exp(ln_meanlog + ln_sdlog * p) + ln_mean_diff",
           "exp(-p * p / 2) / sqrt(2 * pi())", "ln_sdlog > 0"),
)
view(
    "v_sev_micro_gamma",
    _micro("v_micro_rows JOIN v_tails ON a = g_shape", _G_PLACE, "t_lo", "t_hi", "exp(p) / g_rate + g_mean_diff",
           "exp(g_shape * p - exp(p) - lgamma(g_shape))", "g_shape > 0"),
)
_OMEGA_LN = _integrals("v_omega_rows", _ROW, "p.cause_id = 0", "ln_meanlog", "ln_sdlog", "ln_mean_diff")
view("v_sev_omega", _omega(_OMEGA_LN, "ln_sdlog > 0"))
view("v_sev_omega_gamma", _omega(_gamma_integrals("v_omega_rows", _ROW), "g_shape > 0"))
for _name, _view in (
    ("sev_micronutrient", "v_sev_micro"),
    ("sev_micronutrient_gamma", "v_sev_micro_gamma"),
    ("sev_omega3", "v_sev_omega"),
    ("sev_omega3_gamma", "v_sev_omega_gamma"),
):
    oracle(_name, f"SELECT {_BOUND}, {r('sev', 4)} FROM {_view}")
view(
    "v_meat_rows",
    f"""SELECT x.scenario, f.iso3, f.sex_id, f.age_id, f.ln_meanlog + 1.5 AS mu, f.ln_sdlog AS sd, x.shift
    FROM ({_fits('0')}) f CROSS JOIN (VALUES ('Base', 0.0), ('High road', 5.0)) AS x(scenario, shift)""",
)
_MEAT_ROW = "scenario, iso3, sex_id, age_id"
view(
    "v_meat_integrals",
    f"""SELECT m.scenario, m.iso3, m.sex_id, m.age_id, c.cause_id, c.last_risk, g.integral
    FROM v_meat_rows m LEFT JOIN (SELECT * FROM v_last WHERE cause_id <> 0) c ON c.age_id = m.age_id
    LEFT JOIN ({_integrals('v_meat_rows', _MEAT_ROW, 'p.cause_id <> 0', 'mu', 'sd', 'shift')}) g
    ON g.scenario = m.scenario AND g.iso3 = m.iso3 AND g.sex_id = m.sex_id AND g.age_id = m.age_id AND g.cause_id = c.cause_id""",
)
_YOUNG = "age_id IN (5, 6, 7, 8, 9)"


_MEAT = "iso3, CAST(sex_id AS INTEGER) AS sex_id, CAST(age_id AS INTEGER) AS age_id, CAST(cause_id AS BIGINT) AS cause_id"
oracle(
    "sev_red_meat",
    f"""SELECT scenario, {_MEAT}, {r(f'CASE WHEN {_YOUNG} THEN 0 ELSE {floored("sev")} END', 4, 'sev')}
    FROM (SELECT *, ({ratio('integral - 1', 'last_risk - 1')}) * 100 AS sev FROM v_meat_integrals)""",
)


def _sides(source: str, keys: str) -> str:
    return f"""SELECT {keys}, {strict('integral', 'sum', "scenario = 'Base'")} AS base,
      {strict('integral', 'sum', "scenario = 'High road'")} AS high FROM {source} GROUP BY {keys}"""


view("v_meat_sides", _sides("v_meat_integrals", "iso3, sex_id, age_id, cause_id, last_risk"))


def _paf(source: str, columns: str, value: str) -> str:
    return f"""SELECT {columns}, {rs(['base', 'high'], 6)}, {r(f'CASE WHEN {_YOUNG} THEN 0 ELSE {value} END', 6, 'paf')}
    FROM {source}"""


oracle("paf_red_meat", _paf("v_meat_sides", _MEAT, floored(ratio("base - 1", "base"))))
oracle("paf_red_meat_relative", _paf("v_meat_sides", _MEAT, ratio("high - base", "base")))
view(
    "v_omega_integrals",
    f"""SELECT c.scenario, c.iso3, c.sex_id, c.age_id, l.last_risk, g.integral
    FROM (SELECT * FROM v_coded WHERE nutrient = 'Omega-3 fatty acids') c
    LEFT JOIN v_last l ON l.cause_id = 0 AND l.age_id = c.age_id
    LEFT JOIN ({_integrals("(SELECT scenario, iso3, sex_id, age_id, ln_meanlog, ln_sdlog, ln_mean_diff FROM v_coded WHERE nutrient = 'Omega-3 fatty acids')",
                           "scenario, iso3, sex_id, age_id", "p.cause_id = 0", "ln_meanlog", "ln_sdlog", "ln_mean_diff")}) g
    ON g.scenario = c.scenario AND g.iso3 = c.iso3 AND g.sex_id = c.sex_id AND g.age_id = c.age_id""",
)
view("v_omega_sides", _sides("v_omega_integrals", "iso3, sex_id, age_id, last_risk"))
_WHOM = "iso3, CAST(sex_id AS INTEGER) AS sex_id, CAST(age_id AS INTEGER) AS age_id"
oracle("paf_omega3", _paf("v_omega_sides", _WHOM, ratio("base - last_risk", "base")))
oracle("paf_omega3_relative", _paf("v_omega_sides", _WHOM, ratio("high - base", "base")))


def _deltas(source: str) -> str:
    keys = "nutrient, country, iso3, sex_id, age_id"
    return f"""SELECT *, sev_base - sev_high AS sev_reduction, sev_high - sev_base AS sev_delta FROM (
      SELECT {keys}, {strict('sev', 'sum', "scenario = 'Base'")} AS sev_base,
        {strict('sev', 'sum', "scenario = 'High road'")} AS sev_high FROM ({source}) GROUP BY {keys})"""


view("v_deltas", _deltas("SELECT * FROM v_sev_micro UNION ALL SELECT * FROM v_sev_omega"))
_MIXED = " UNION ALL ".join(
    f"""SELECT l.scenario, l.country, l.iso3, l.nutrient, l.sex_id, l.age_id,
      CASE WHEN CAST(substring(l.iso3, 2) AS INTEGER) % 3 = 0 THEN g.sev ELSE l.sev END AS sev
    FROM v_sev_{kind} l JOIN v_sev_{kind}_gamma g ON l.scenario = g.scenario AND l.iso3 = g.iso3 AND l.nutrient = g.nutrient
      AND l.sex_id = g.sex_id AND l.age_id = g.age_id"""
    for kind in ("micro", "omega")
)
view("v_deltas_mixed", _deltas(_MIXED))
_DELTA = f"""SELECT nutrient, country, iso3, CAST(sex_id AS INTEGER) AS sex_id, CAST(age_id AS INTEGER) AS age_id,
  {rs(['sev_base', 'sev_high', 'sev_reduction', 'sev_delta'], 4)} FROM """
oracle("sev_scenario_delta", _DELTA + "v_deltas")
oracle("sev_scenario_delta_mixed", _DELTA + "v_deltas_mixed")
view(
    "v_npeople",
    f"""SELECT {code('c_nationkey')} AS iso3, d.sex, d.age_group, people * (d.step + 1) * 0.004 AS npeople
    FROM v_people CROSS JOIN v_demography d
    WHERE NOT (c_nationkey = 2 AND d.sex = 'Females' AND d.age_group = '95-99')""",
)
oracle("population_slice", f"SELECT iso3, sex, age_group, {r('npeople', 5)} FROM v_npeople")
view(
    "v_affected",
    """SELECT *, abs(CASE WHEN high - base > 0 THEN 0 ELSE high - base END) AS diff FROM (
      SELECT d.iso3, d.country, d.nutrient, g.sex, g.age_group, n.npeople, n.npeople * d.sev_base / 100 AS base,
        n.npeople * d.sev_high / 100 AS high
      FROM v_deltas d JOIN v_demography g ON d.sex_id = g.sex_id AND d.age_id = g.age_id
      LEFT JOIN v_npeople n ON n.iso3 = d.iso3 AND n.sex = g.sex AND n.age_group = g.age_group)""",
)
oracle(
    "people_affected",
    f"""SELECT iso3, nutrient, sex, age_group, {r('npeople', 4)}, {r('base', 2, 'ndeficient_base')},
      {r('high', 2, 'ndeficient_high')}, {r('diff', 2, 'ndeficient_diff')} FROM v_affected""",
)

# Reports.

_REPORT = "CASE nutrient WHEN 'Omega-3 fatty acids' THEN 'DHA+EPA' WHEN 'Vitamin A, RAE' THEN 'Vitamin A' WHEN 'Vitamin B-12' THEN 'Vitamin B12' ELSE nutrient END"
view(
    "v_country_mean",
    f"""SELECT *, sev_high - sev_base AS sev_delta FROM (SELECT iso3, country, {_REPORT} AS nutrient,
      {strict('sev_base', 'avg')} AS sev_base, {strict('sev_high', 'avg')} AS sev_high FROM v_deltas GROUP BY 1, 2, 3)""",
)
oracle("sev_country_mean", f"SELECT iso3, country, nutrient, {rs(['sev_base', 'sev_high', 'sev_delta'], 4)} FROM v_country_mean")
oracle(
    "sev_report",
    f"""SELECT iso3, country, {rs(REPORT_NUTRIENTS, 4)} FROM (
    SELECT {_cells('iso3, country', 'nutrient', REPORT_NUTRIENTS, 'sev_delta')} FROM v_country_mean GROUP BY iso3, country)""",
)
view(
    "v_country_people",
    f"SELECT iso3, country, {_REPORT} AS nutrient, coalesce(sum(diff), 0) AS n FROM v_affected GROUP BY 1, 2, 3",
)
oracle(
    "people_country_total",
    f"""SELECT iso3, country, nutrient, {r('n', 1, 'ndeficient_diff')},
      {r('CASE WHEN n > 1 THEN ln(greatest(n, 1)) ELSE 0 END', 4, 'ndeficient_diff_log')} FROM v_country_people""",
)
oracle("people_grand_total", f"SELECT {r('sum(n) / 1e6', 6, 'million_people')} FROM v_country_people")


def _cap(metric: str) -> str:
    arms = " ".join(f"WHEN nutrient = {text(n)} AND {metric} > {c} THEN {c}" for n, c in METRIC_CAPS[metric].items())
    return f"CASE {arms} ELSE {metric} END AS {metric}"


view("v_capped", "SELECT iso3c, nutrient, " + ", ".join(_cap(m) for m in METRIC_CAPS) + " FROM v_shares")
oracle("metric_cap", f"SELECT iso3c, nutrient, {rs(list(METRIC_CAPS), 6)} FROM v_capped")


def _box(source: str, group: str, metric: str) -> str:
    return f"""SELECT {group}, n_values, {rs(['q1', 'median', 'q3'], 6)},
      {r('min(v) FILTER (WHERE inside)', 6, 'whisker_low')}, {r('max(v) FILTER (WHERE inside)', 6, 'whisker_high')},
      count(*) FILTER (WHERE NOT inside) AS n_outliers
    FROM (SELECT *, v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) AS inside
      FROM (SELECT {group}, {metric} AS v FROM {source} WHERE {metric} IS NOT NULL AND isfinite({metric}))
      JOIN (SELECT {group}, count(*) AS n_values, quantile_cont({metric}, 0.25) AS q1, quantile_cont({metric}, 0.5) AS median,
              quantile_cont({metric}, 0.75) AS q3 FROM {source}
            WHERE {metric} IS NOT NULL AND isfinite({metric}) GROUP BY {group}) USING ({group}))
    GROUP BY {group}, n_values, q1, median, q3"""


oracle("metric_box_stats", _box("v_shares", "nutrient", "perc_ASF"))
oracle("metric_box_stats_tonnes", _box("v_catch", "end_use", "tonnes"))
view(
    "v_regions",
    """SELECT iso3c AS iso3, n_name AS country, CASE r_name WHEN 'EUROPE' THEN 'Europe' ELSE r_name END AS continent,
      (n_nationkey + 1) * 2000.0 AS area_sqkm, n_nationkey FROM v_nations""",
)
oracle(
    "region_metric_layer",
    f"""SELECT iso3, country, continent, CAST(area_sqkm AS DOUBLE) AS area_sqkm, nutrient, {r('perc_ASF', 6)}
    FROM v_regions LEFT JOIN (SELECT * FROM v_capped WHERE nutrient = 'Iron') ON iso3 = iso3c""",
)
oracle(
    "small_territory_layer",
    f"""SELECT iso3, country, continent, CAST(area_sqkm AS DOUBLE) AS area_sqkm, {r('perc_ASF', 6)}
    FROM (SELECT iso3, country, continent, area_sqkm FROM v_regions
          UNION ALL SELECT iso3, 'tiny ' || country, continent, 10.0 FROM v_regions WHERE (n_nationkey + 1) % 7 = 0)
    JOIN (SELECT * FROM v_capped WHERE nutrient = 'Zinc') ON iso3 = iso3c
    WHERE perc_ASF IS NOT NULL AND area_sqkm <= 25000 AND continent <> 'Europe'""",
)
oracle("foreign_vs_intake_points", f"SELECT {_POINTS}, eez_iso AS label FROM v_zone_flow")
