"""Named queries over the driver tables, each with its SQL twin where one exists."""

from . import composites, drivers, evaluation, modelling, pairs, relations, sequences
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "composites", "drivers", "evaluation", "flagship", "modelling", "pairs", "relations", "sequences"]


def flagship(spark, sf_dir):
    return QUERIES["pairs_logo_auroc"](spark, sf_dir)
