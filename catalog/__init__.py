"""The registered queries, one per operator, with SQL counterparts."""

from catalog import comparisons, models, rows, studies
from catalog.fixtures import rounded_frame, rounded_sql

ENTRIES = {**rows.E, **comparisons.E, **models.E, **studies.E}

__all__ = ["ENTRIES", "rounded_frame", "rounded_sql"]
