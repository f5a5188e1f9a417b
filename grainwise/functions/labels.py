"""Text and calendar labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_CATEGORY = "Unknown"


def category_label(translated: Column, raw: Column) -> Column:
    """Display name of a category: translated, else raw, else unknown."""
    name = F.coalesce(translated, raw, F.lit(UNKNOWN_CATEGORY))
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def first_of_month(moment: Column) -> Column:
    """The month as a DATE; ``date_trunc`` would attach a time zone."""
    return F.trunc(moment, "MM")
