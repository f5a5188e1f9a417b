from .delivery import (
    BUCKET_EDGES,
    BUCKET_LABELS,
    bucketize,
    days_between,
    delivery_columns,
    is_late,
    whole_days_late,
)
from .labels import category_label, first_of_month
from .numbers import mean, ratio, rounded

__all__ = [
    "BUCKET_EDGES",
    "BUCKET_LABELS",
    "bucketize",
    "category_label",
    "days_between",
    "delivery_columns",
    "first_of_month",
    "is_late",
    "mean",
    "ratio",
    "rounded",
    "whole_days_late",
]
