"""String rules: recoding, name splitting and normalisation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from seaplate.functions.nulls import ColumnLike, as_col

# Separators between a country and its region in a zone name,
# and the accented letters folded when country names are compared.
ZONE_SEPARATORS = r"[_;,()%/]"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"


def lookup(value: ColumnLike, mapping: dict) -> Column:
    """Mapped value, NULL when it is not listed."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(table, as_col(value))


def recode(value: ColumnLike, mapping: dict) -> Column:
    """Mapped value, the value itself when it is not listed."""
    value = as_col(value)
    return F.coalesce(lookup(value, mapping), value) if mapping else value


def trim_space(value: ColumnLike) -> Column:
    """Strip every kind of white space at both ends."""
    return F.regexp_replace(as_col(value), r"^\s+|\s+$", "")


def sentence_case(value: ColumnLike) -> Column:
    value = as_col(value)
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substr(value, F.lit(2))))


def word(value: ColumnLike, position: int) -> Column:
    """The word at ``position`` (0-based), NULL when there are fewer."""
    return F.get(F.split(as_col(value), " ", -1), F.lit(position))


def piece(value: ColumnLike, pattern: str, position: int) -> Column:
    return F.get(F.split(as_col(value), pattern, -1), F.lit(position))


def plain_name(value: ColumnLike) -> Column:
    """A country name reduced to lower-case letters and digits, single-spaced."""
    folded = F.translate(F.lower(as_col(value)), ACCENTED, FOLDED)
    return F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))
