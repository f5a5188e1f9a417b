"""Delivery measures as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published delivery buckets, in whole days against the
# promise. Each bucket includes its upper edge.
BUCKET_EDGES = (-10, -3, 0, 3, 10)
BUCKET_LABELS = (
    "10+ days early",
    "3-10 days early",
    "0-3 days early",
    "1-3 days late",
    "3-10 days late",
    "10+ days late",
)

MICROS_PER_DAY = 86_400_000_000


def micros_between(start: Column, end: Column) -> Column:
    """Exact elapsed microseconds between zone-less timestamps.

    ``timestampdiff`` would read both in the session time zone and lose or gain
    an hour across a clock change; subtraction does not.
    """
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("long")


def days_between(start: Column, end: Column) -> Column:
    """Elapsed days with their fraction; NULL when either side is NULL."""
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def whole_days_late(delivered: Column, promised: Column) -> Column:
    """Calendar days past the promised day. A promise is a day, not an instant."""
    return F.datediff(F.to_date(delivered), F.to_date(promised))


def is_late(delay: Column) -> Column:
    """True, False, or NULL when the outcome is unknown."""
    return F.when(delay.isNotNull(), delay > 0)


def bucketize(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label right-closed bins; ``len(labels)`` is ``len(edges) + 1``; NULL stays NULL."""
    if len(labels) != len(edges) + 1:
        raise ValueError("bucketize needs exactly one label more than edges")
    if list(edges) != sorted(set(edges)):
        raise ValueError("bucketize edges must be strictly increasing")
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, name in zip(edges, labels):
        label = label.when(value <= F.lit(edge), F.lit(name))
    return label.otherwise(F.lit(labels[-1]))


def delivery_columns(purchased: Column, delivered: Column, promised: Column) -> dict[str, Column]:
    """Every derived delivery column of the order fact, by name."""
    delay = whole_days_late(delivered, promised)
    return {
        "is_delivered": delivered.isNotNull(),
        "delivery_days": days_between(purchased, delivered),
        "estimated_days": days_between(purchased, promised),
        "delay_days": delay,
        "is_late": is_late(delay),
        "delivery_bucket": bucketize(delay, BUCKET_EDGES, BUCKET_LABELS),
    }
