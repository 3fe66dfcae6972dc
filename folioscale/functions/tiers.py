"""Tiers of a record, from the spellings found in exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted spellings of each tier and its rank; anything else counts as backup.
TIER_RANK = {"core": 0, "核心": 0, "important": 1, "重要": 1, "backup": 2, "备选": 2, "peripheral": 2, "alternative": 2}
TIERS = ("core", "important", "backup")


def tier_rank(column: Column | str) -> Column:
    """0 core, 1 important, 2 backup; blanks at the ends and case set aside, unknown and null are 2."""
    key = F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^[\s\x{3000}]+|[\s\x{3000}]+$", ""))
    rank = F.lit(2)
    for level in (1, 0):
        names = [name for name, value in TIER_RANK.items() if value == level]
        rank = F.when(key.isin(*names), F.lit(level)).otherwise(rank)
    return rank


def tier_name(column: Column | str) -> Column:
    """The canonical English name of a tier."""
    rank = tier_rank(column)
    return F.when(rank == 0, TIERS[0]).when(rank == 1, TIERS[1]).otherwise(TIERS[2])
