"""Every registered query with its SQL."""

from gradeline.catalog import bootstrap, cohort, contracts, features, metrics, modelling, storage, terms, text  # noqa: F401
from gradeline.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
