"""Who may see what: visibility, scope, boundary, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible(classification: Column, owner: Column, viewer: Column, is_admin: Column) -> Column:
    """Admins see all; others what is not RESTRICTED or their own. A missing classification is visible; nobody owns for a null viewer."""
    own = F.coalesce(owner == viewer, F.lit(False))
    return F.coalesce(is_admin, F.lit(False)) | ~classification.eqNullSafe(F.lit("RESTRICTED")) | own


def sendable(classification: Column) -> Column:
    """What may leave: PUBLIC alone; missing and unknown tiers are withheld."""
    return F.coalesce(classification, F.lit("")) == "PUBLIC"


def tier_rank(classification: Column) -> Column:
    """PUBLIC 0, all else 1: an unknown tier counts as the strictest."""
    return F.when(classification == "PUBLIC", 0).otherwise(1)


def stricter(candidate: Column, current: Column) -> Column:
    """The stricter of two tiers; a missing current tier takes the candidate, a missing candidate changes nothing."""
    rank = lambda c: F.when(c == "RESTRICTED", 1).when(c == "PUBLIC", 0)
    return F.when(candidate.isNotNull() & (current.isNull() | (rank(candidate) > rank(current))), candidate).otherwise(current)
