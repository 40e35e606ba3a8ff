"""Column functions over names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(x: Column) -> Column:
    """Trim, lower-case, underscores to spaces, one space between words; null is ''."""
    spaced = F.translate(F.lower(F.trim(x)), "_\t\n\x0b\f\r", " " * 6)
    # few names need the pattern, which costs more than all the rest
    return F.coalesce(F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)), F.lit(""))


def genus_of(clean: Column) -> Column:
    return F.substring_index(clean, " ", 1)


#: Words from which on a name describes a strain.  Fixed values.
STRAIN_WORDS = ("strain", "str", "subsp", "ssp", "serovar", "sv", "pv", "biovar", "bv")


def species_of(clean: Column) -> Column:
    """First two words of the name before any strain word; one where the second is sp. or sp."""
    head = F.trim(F.regexp_replace(clean, r"\b(" + "|".join(STRAIN_WORDS) + r")\b.*$", ""))
    words = F.split(head, " ")
    first, second = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    return F.when(second.isNull() | second.isin("sp", "sp."), first).otherwise(F.concat_ws(" ", first, second))


def slugify(x: Column) -> Column:
    """Runs of anything but a-z and 0-9 become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def accession_alias(slug: Column) -> Column:
    """The unversioned accession of a versioned one, else ''."""
    return F.regexp_extract(slug, r"^(n[cmrtwz]_\d+)_\d+$", 1)


def label_of(token: Column, positive, known) -> Column:
    """1 for a positive token, 0 for another known one; anything else raises."""
    t = F.lower(F.trim(token))
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(t, F.lit("null"))))
    return F.when(t.isin(*positive), 1).when(t.isin(*known), 0).otherwise(unknown.cast("int"))


def or_unknown(x: Column) -> Column:
    return F.coalesce(F.when(x != "", x), F.lit("Unknown"))


def clip01(p: Column) -> Column:
    """Non-finite or null probability is a half; the rest is held within [0, 1]."""
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return F.when(bad, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
