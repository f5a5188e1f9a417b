"""Registry of business metrics and their evaluation over any dimensions.

A metric is either a base aggregate over one population of one fact, or a
ratio or difference of base aggregates. Evaluating any number of them is one
aggregation of the fact: base aggregates first, then a projection. Distinct
counts and ratios are therefore recomputed at every level, never summed up.

An exact distinct count needs one row per counted value. The fact is then
collapsed once to its dimensions and that value, with every other aggregate in
parts that add up (sums and counts), and all levels are worked out of the collapsed rows: the fact
is read once, and what is expanded to the levels of a cube is the collapsed table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mean, ratio
from ..functions.numbers import rounded_sql
from ..operators.calendar import month_over_month, year_to_date
from ..operators.populations import delivered, reviewed, sales, sales_rows
from ..operators.totals import merge_totals

ORDER, ITEM = "order", "item"


@dataclass(frozen=True)
class Metric:
    """``build`` gives an aggregate; with ``needs`` it is built from other metrics instead.

    ``parts`` are aggregates that add up over any split of the rows, and ``merge``
    makes the metric of their totals. A distinct count names its column and population instead.
    """

    fact: str
    build: Callable[[], Column]
    needs: tuple[str, ...] = ()
    parts: tuple[Callable[[], Column], ...] = ()
    merge: Callable[..., Column] | None = None
    distinct: tuple[str, Callable[[], Column]] | None = None


def _total(fact: str, value: Callable[[], Column]) -> Metric:
    part = lambda: F.sum(value())
    return Metric(fact, part, parts=(part,), merge=F.sum)


def _rows(fact: str, condition: Callable[[], Column]) -> Metric:
    part = lambda: F.count_if(condition())
    return Metric(fact, part, parts=(part,), merge=lambda n: F.coalesce(F.sum(n), F.lit(0)))


def _average(fact: str, value: Callable[[], Column]) -> Metric:
    parts = (lambda: F.sum(value()), lambda: F.count(value()))
    return Metric(fact, lambda: mean(value()), parts=parts, merge=lambda total, n: ratio(F.sum(total), F.sum(n)))


def _distinct(fact: str, column: str, population: Callable[[], Column]) -> Metric:
    return Metric(fact, lambda: F.countDistinct(_in(population, column)), distinct=(column, population))


def _in(population: Callable[[], Column], value: str) -> Column:
    return F.when(population(), F.col(value))


def _late() -> Column:
    return delivered() & F.col("is_late")


def _on_time() -> Column:
    return delivered() & ~F.col("is_late")


def _over(numerator: str, denominator: str) -> Callable[[], Column]:
    return lambda: ratio(F.col(numerator), F.col(denominator))


# Order rows are counted, not counted distinct: the order fact holds one row
# per order, which grain_check and the reconciliation verify. Customers do
# repeat, so theirs is the one exact distinct count.
METRICS: dict[str, Metric] = {
    # sales
    "total_revenue": _total(ORDER, lambda: _in(sales, "order_value")),
    "product_revenue": _total(ORDER, lambda: _in(sales, "product_revenue")),
    "freight_revenue": _total(ORDER, lambda: _in(sales, "freight_value")),
    "total_orders": _rows(ORDER, lambda: sales()),
    "total_customers": _distinct(ORDER, "customer_unique_id", sales),
    "items_ordered": _total(ORDER, lambda: _in(sales, "item_count")),
    "aov": Metric(ORDER, _over("total_revenue", "total_orders"), ("total_revenue", "total_orders")),
    "avg_valued_order": _average(ORDER, lambda: _in(sales, "order_value")),
    "items_per_order": Metric(ORDER, _over("items_ordered", "total_orders"), ("items_ordered", "total_orders")),
    # delivery
    "delivered_orders": _rows(ORDER, lambda: delivered()),
    "avg_delivery_days": _average(ORDER, lambda: _in(delivered, "delivery_days")),
    "avg_promised_days": _average(ORDER, lambda: _in(delivered, "estimated_days")),
    "avg_delivery_vs_promise": _average(ORDER, lambda: _in(delivered, "delay_days")),
    "late_orders": _rows(ORDER, lambda: _late()),
    "late_delivery_rate": Metric(
        ORDER, _over("late_orders", "delivered_orders"), ("late_orders", "delivered_orders")
    ),
    "on_time_delivery_rate": Metric(
        ORDER, lambda: F.lit(1.0) - F.col("late_delivery_rate"), ("late_delivery_rate",)
    ),
    "avg_promise_padding_days": Metric(
        ORDER,
        lambda: F.col("avg_promised_days") - F.col("avg_delivery_days"),
        ("avg_promised_days", "avg_delivery_days"),
    ),
    # reviews
    "avg_review_score": _average(ORDER, lambda: _in(sales, "review_score")),
    "reviewed_orders": _rows(ORDER, lambda: reviewed()),
    "review_coverage": Metric(ORDER, _over("reviewed_orders", "total_orders"), ("reviewed_orders", "total_orders")),
    "one_star_orders": _rows(ORDER, lambda: sales() & (F.col("review_score") == 1)),
    "five_star_orders": _rows(ORDER, lambda: sales() & (F.col("review_score") == 5)),
    "one_star_rate": Metric(
        ORDER, _over("one_star_orders", "reviewed_orders"), ("one_star_orders", "reviewed_orders")
    ),
    "five_star_rate": Metric(
        ORDER, _over("five_star_orders", "reviewed_orders"), ("five_star_orders", "reviewed_orders")
    ),
    "avg_review_late": _average(ORDER, lambda: _in(_late, "review_score")),
    "avg_review_on_time": _average(ORDER, lambda: _in(_on_time, "review_score")),
    "review_gap_late_vs_on_time": Metric(
        ORDER,
        lambda: F.col("avg_review_late") - F.col("avg_review_on_time"),
        ("avg_review_late", "avg_review_on_time"),
    ),
    "revenue_at_risk": _total(ORDER, lambda: _in(_late, "order_value")),
    "late_revenue_share": Metric(
        ORDER, _over("revenue_at_risk", "total_revenue"), ("revenue_at_risk", "total_revenue")
    ),
    # payments against goods, over all orders
    "all_order_value": _total(ORDER, lambda: F.col("order_value")),
    "all_payment_value": _total(ORDER, lambda: F.col("payment_value")),
    "payments_over_item_value": Metric(
        ORDER,
        lambda: ratio(F.col("all_payment_value"), F.col("all_order_value")) - 1,
        ("all_payment_value", "all_order_value"),
    ),
    # categories, at item grain
    "category_revenue": _total(ITEM, lambda: _in(sales, "item_value")),
    "category_freight": _total(ITEM, lambda: _in(sales, "freight_value")),
    "items_sold": _rows(ITEM, lambda: sales()),
    "avg_item_price": _average(ITEM, lambda: _in(sales, "price")),
    "avg_item_freight": _average(ITEM, lambda: _in(sales, "freight_value")),
    "freight_share": Metric(
        ITEM, _over("category_freight", "category_revenue"), ("category_freight", "category_revenue")
    ),
    "late_items": _rows(ITEM, lambda: _late()),
    "delivered_items": _rows(ITEM, lambda: delivered()),
    "category_late_rate": Metric(ITEM, _over("late_items", "delivered_items"), ("late_items", "delivered_items")),
    "category_avg_review": _average(ITEM, lambda: _in(sales, "review_score")),
    "category_avg_review_late": _average(ITEM, lambda: _in(_late, "review_score")),
    "category_avg_review_on_time": _average(ITEM, lambda: _in(_on_time, "review_score")),
}

# Sketches for dashboards over very many groups, where an exact distinct count
# would shuffle every customer once per grouping level.
APPROXIMATE = {
    "total_customers": lambda: F.approx_count_distinct(_in(sales, "customer_unique_id"), 0.01),
}

ORDER_METRICS = tuple(n for n, m in METRICS.items() if m.fact == ORDER)
ITEM_METRICS = tuple(n for n, m in METRICS.items() if m.fact == ITEM)


def _resolve(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Base aggregates to compute, and derived metrics in an order that works."""
    base: list[str] = []
    derived: list[str] = []

    def visit(name: str) -> None:
        metric = METRICS[name]
        for need in metric.needs:
            visit(need)
        target = derived if metric.needs else base
        if name not in target:
            target.append(name)

    for name in names:
        visit(name)
    return base, derived


def evaluate(
    fact: DataFrame,
    metrics: Sequence[str],
    dims: Sequence[str] = (),
    grouping: str = "groupBy",
    approximate: bool = False,
) -> DataFrame:
    """``dims`` and ``metrics`` of a fact; ``grouping`` may also be rollup or cube.

    Filter the fact first (``slice_rows``) to evaluate under a slicer: a
    metric's own population then intersects it. Subtotal rows of a rollup or
    cube carry NULL in the dimension and their level in ``grouping_id``.
    ``approximate`` swaps the exact distinct count for a sketch within 1%.

    With an exact distinct count the levels are worked out of the fact collapsed to
    ``dims`` and the counted column, so that one pass of the fact serves all metrics.
    """
    facts = {METRICS[n].fact for n in metrics}
    if len(facts) != 1:
        raise ValueError(f"metrics of one fact only, got {sorted(facts)}")
    if grouping not in ("groupBy", "rollup", "cube"):
        raise ValueError(f"unknown grouping: {grouping}")
    base, derived = _resolve(metrics)
    sketches = APPROXIMATE if approximate else {}
    levels = [] if grouping == "groupBy" else ["grouping_id"]
    level = [F.grouping_id().alias("grouping_id")] if levels else []
    exact = [n for n in base if METRICS[n].distinct and n not in sketches]
    if exact:
        rows, aggregates = _collapsed(fact, base, exact, dims, grouping, sketches)
    else:
        rows, aggregates = fact, [sketches.get(n, METRICS[n].build)().alias(n) for n in base]
    out = getattr(rows, grouping)(*dims).agg(*level, *aggregates)
    if derived:
        # One projection: a derived metric may refer to one listed before it.
        out = out.select("*", *[METRICS[n].build().alias(n) for n in derived])
    return out.select(*dims, *levels, *metrics)


def _collapsed(
    fact: DataFrame, base: Sequence[str], exact: Sequence[str], dims: Sequence[str], grouping: str, sketches: Mapping
) -> tuple[DataFrame, list[Column]]:
    """The fact by ``dims`` and counted columns, and the aggregates of the base metrics over that.

    Every part is combined on the map side, so a value that holds a large share
    of the rows is one row per task.
    """
    counted = list(dict.fromkeys(METRICS[n].distinct[0] for n in exact))
    parts: list[Column] = []
    aggregates: list[Column] = []
    for n in base:
        metric = METRICS[n]
        if n in exact:
            column, population = metric.distinct
            parts.append(F.coalesce(F.bool_or(population()), F.lit(False)).alias(f"_in_{n}"))
            value = F.when(F.col(f"_in_{n}"), F.col(f"_of_{column}"))
            # One row per value already, unless several columns are counted or levels mix the dimensions.
            once = len(counted) == 1 and grouping == "groupBy"
            aggregates.append((F.count(value) if once else F.countDistinct(value)).alias(n))
            continue
        if n in sketches:
            raise ValueError(f"{n} is sketched and cannot stand beside the exact {', '.join(exact)}")
        names = [f"_{n}_{i}" for i in range(len(metric.parts))]
        parts += [part().alias(name) for part, name in zip(metric.parts, names)]
        aggregates.append(metric.merge(*map(F.col, names)).alias(n))
    return fact.groupBy(*dims, *(F.col(c).alias(f"_of_{c}") for c in counted)).agg(*parts), aggregates


def revenue_by_month(fct_order: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Monthly revenue with its change on the prior calendar month and year to date."""
    monthly = evaluate(sales_rows(fct_order), ["total_revenue"], [*dims, "order_month"])
    compared = month_over_month(monthly, "order_month", "total_revenue", dims)
    return year_to_date(compared, "order_month", "total_revenue", dims)


def grain_check(fct_order: DataFrame) -> DataFrame:
    """The diagnostics card: is the order fact still one row per order?"""
    counted = fct_order.agg(F.count("*").alias("order_rows"), F.countDistinct("order_id").alias("distinct_orders"))
    orders = F.format_number("distinct_orders", 0)
    text = F.when(
        F.col("order_rows") == F.col("distinct_orders"), F.concat(F.lit("OK - "), orders, F.lit(" orders"))
    ).otherwise(
        F.concat(F.lit("BROKEN - "), F.format_number("order_rows", 0), F.lit(" rows for "), orders, F.lit(" orders"))
    )
    return counted.select("order_rows", "distinct_orders", text.alias("grain_check"))


def tie_out(fct_order: DataFrame, fct_order_item: DataFrame) -> DataFrame:
    """The diagnostics card: do both facts agree on total value?"""
    totals = merge_totals(
        evaluate(fct_order, ["total_revenue"]), evaluate(fct_order_item, ["category_revenue"])
    )
    gap = F.coalesce("total_revenue", F.lit(0)) - F.coalesce("category_revenue", F.lit(0))
    text = F.when(F.abs(gap) < 0.01, F.lit("OK")).otherwise(
        F.concat(F.lit("MISMATCH "), F.format_number(gap, 2))
    )
    return totals.select("total_revenue", "category_revenue", text.alias("tie_out"))


# Decimal places at the report edge; money stays exact and counts are whole.
PLACES = {"aov": 2, "avg_valued_order": 2}


def at_edge(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double of a result for display or comparison."""
    return df.selectExpr(
        *[f"{rounded_sql(n, PLACES.get(n, places))} as `{n}`" if t == "double" else f"`{n}`" for n, t in df.dtypes]
    )
