"""Catch to nutrient supply: composition of every species, filled and attached to the catch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seaplate.operators import composition as comp
from seaplate.sources.sinks import stage_table
from seaplate.vocab import ASSAY_NUTRIENTS, ASSAY_PARTS, ASSAY_PREPARATIONS


def species_composition(
    species: DataFrame,
    assays: DataFrame,
    taxonomy: DataFrame,
    *,
    assay_order: str,
    taxonomy_order: str,
    nutrients: list[str] = ASSAY_NUTRIENTS,
    preparations: list[str] = ASSAY_PREPARATIONS,
    parts: list[str] = ASSAY_PARTS,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Composition of each species and nutrient by the nearest taxon with assays; ``stats`` are the taxa's statistics, where
    they have been worked out already."""
    kept = comp.assay_filter(assays, nutrients, preparations, parts)
    lineage = comp.lineage_resolve(comp.species_words(species), taxonomy, taxonomy_order)
    units = comp.nutrient_unit_key(kept, assay_order)
    return comp.taxon_fallback(lineage, comp.taxon_stats(kept) if stats is None else stats, nutrients, units)


def filled_composition(
    cells: DataFrame,
    assays: DataFrame,
    taxonomy: DataFrame,
    species_groups: DataFrame,
    *,
    assay_order: str,
    taxonomy_order: str,
    group_order: str,
    **selection,
) -> DataFrame:
    """Composition of the caught species, gaps filled from functional groups.

    ``cells`` is the staged catch by cell (``catch_cells``). The fallback is staged too, since
    the group means and the result both start from it.
    """
    species_rows = comp.catch_rows(cells)
    nearest = species_composition(
        species_rows.withColumnRenamed("species", "scientific_name"),
        assays,
        taxonomy,
        assay_order=assay_order,
        taxonomy_order=taxonomy_order,
        **selection,
    )
    nearest = stage_table(nearest.drop("lower_ci", "upper_ci"), "nearest")
    return comp.functional_group_fill(nearest, species_rows, species_groups, group_order)
