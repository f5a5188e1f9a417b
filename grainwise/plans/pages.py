"""Datasets behind the report pages and the written analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mean, ratio, rounded
from ..functions.delivery import MICROS_PER_DAY, micros_between
from ..operators.calendar import month_over_month
from ..operators.populations import delivered, delivered_rows, enough_volume, sales_rows, too_little_volume
from ..operators.shares import cumulative_share, scaled_to_max, share_of_total, step_change, top_n
from ..operators.stats import correlation, exact_median, histogram, paired_histogram
from .marts import DELIVERED_AT
from .metrics import at_edge, evaluate
from .reports import category_performance, delivery_vs_review, monthly_sales, state_performance

# Fixed values of the published analysis; all are parameters below.
MIN_MONTH_ORDERS = 50
MIN_CATEGORY_LINES = 500
TOP_CATEGORIES = 12
TABLE_CATEGORIES = 20
SCORE_BENCHMARK = 4.10
STATE_SCORE_BENCHMARK = 4.0


# sales overview


def kpi_cards(fct_order: DataFrame) -> DataFrame:
    return at_edge(evaluate(fct_order, ["total_revenue", "total_orders", "aov", "total_customers"]))


def revenue_by_month_with_mom(fct_order: DataFrame) -> DataFrame:
    monthly = monthly_sales(fct_order)
    return at_edge(month_over_month(monthly, "order_month", "revenue"))


def revenue_by_state(fct_order: DataFrame) -> DataFrame:
    """Revenue and its share by state, over all sales rather than deliveries."""
    by_state = evaluate(sales_rows(fct_order), ["total_revenue"], ["customer_state"])
    return at_edge(share_of_total(by_state, "total_revenue"))


# order value


def aov_trend(fct_order: DataFrame) -> DataFrame:
    names = ["total_orders", "aov", "avg_valued_order", "items_per_order"]
    return at_edge(evaluate(sales_rows(fct_order), names, ["order_month"]))


def order_value_distribution(fct_order: DataFrame, width: int = 50) -> DataFrame:
    return histogram(sales_rows(fct_order), F.col("order_value"), width)


def items_per_order_distribution(fct_order: DataFrame) -> DataFrame:
    return sales_rows(fct_order).groupBy("item_count").agg(F.count("*").alias("orders"))


def payment_mix(fct_order: DataFrame) -> DataFrame:
    """Orders and their share by main payment type and longest installment plan."""
    mix = sales_rows(fct_order).groupBy("primary_payment_type", "max_installments").agg(F.count("*").alias("orders"))
    return at_edge(share_of_total(mix, "orders"))


def monthly_trend(fct_order: DataFrame, minimum: int = MIN_MONTH_ORDERS) -> DataFrame:
    """Months with enough orders, beside the average order value of that whole period."""
    months = enough_volume(monthly_sales(fct_order), "orders", minimum, strict=True)
    period = months.agg(ratio(F.sum("revenue"), F.sum("orders"))).scalar()
    return at_edge(months.withColumn("period_aov", period))


def dropped_months(fct_order: DataFrame, minimum: int = MIN_MONTH_ORDERS) -> DataFrame:
    """The months a trend leaves out, to be named under it."""
    few = too_little_volume(monthly_sales(fct_order), "orders", minimum, strict=True)
    return few.select(F.date_format("order_month", "yyyy-MM").alias("month"), "orders").orderBy("month")


def peak_month(fct_order: DataFrame, minimum: int = MIN_MONTH_ORDERS) -> DataFrame:
    """The month with the highest revenue, and the span of the trend it belongs to."""
    months = enough_volume(monthly_sales(fct_order), "orders", minimum, strict=True)
    best = F.max_by(F.struct("order_month", "revenue"), F.struct("revenue", "order_month"))
    return months.agg(
        best.alias("best"), F.min("order_month").alias("first_month"), F.max("order_month").alias("last_month")
    ).select(
        F.col("best.order_month").alias("peak_month"),
        F.col("best.revenue").alias("peak_revenue"),
        F.date_format("first_month", "MMM yyyy").alias("first_month"),
        F.date_format("last_month", "MMM yyyy").alias("last_month"),
    )


def growth_inputs(fct_order: DataFrame) -> DataFrame:
    """Is growth in orders, in basket value or in basket size?"""
    names = ["total_revenue", "total_orders", "aov", "items_per_order", "total_customers"]
    return at_edge(evaluate(sales_rows(fct_order), names, ["order_month"]))


def repeat_rate(fct_order: DataFrame) -> DataFrame:
    """Share of customers with more than one order."""
    per_customer = (
        sales_rows(fct_order)
        .where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.count("*").alias("n"))
    )
    return at_edge(
        per_customer.agg(
            F.count("*").alias("customers"),
            F.count_if(F.col("n") > 1).alias("repeat_customers"),
            ratio(F.count_if(F.col("n") > 1), F.count("*")).alias("repeat_rate"),
        )
    )


# delivery performance


def late_trend(fct_order: DataFrame) -> DataFrame:
    names = ["delivered_orders", "late_orders", "late_delivery_rate"]
    return at_edge(evaluate(delivered_rows(fct_order), names, ["order_month"]))


def delivery_distribution(fct_order: DataFrame, width: int = 5) -> DataFrame:
    """Actual and promised days on one set of bins."""
    days = {"actual_orders": F.col("delivery_days"), "promised_orders": F.col("estimated_days")}
    return paired_histogram(delivered_rows(fct_order), days, width)


def median_delivery(fct_order: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Exact median of days from purchase to delivery."""
    elapsed = micros_between(F.col("order_purchase_timestamp"), F.col(DELIVERED_AT))
    found = exact_median(delivered_rows(fct_order), elapsed, dims, name="micros")
    return found.select(*dims, rounded(F.col("micros") / float(MICROS_PER_DAY), 6).alias("median_delivery_days"))


def approx_median_delivery(fct_order: DataFrame, dims: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Sketch median, one pass, where a stated error will do."""
    return (
        delivered_rows(fct_order)
        .groupBy(*dims)
        .agg(F.percentile_approx("delivery_days", 0.5, accuracy).alias("median_delivery_days"))
    )


def bucket_steps(fct_order: DataFrame) -> DataFrame:
    """Score per delivery bucket, the step from the bucket before, and its side of the promise."""
    buckets = delivery_vs_review(fct_order).where(F.col("bucket_ord").isNotNull())
    stepped = step_change(buckets, "bucket_ord", "avg_review")
    return at_edge(stepped.withColumn("early", F.contains("delivery_bucket", F.lit("early"))))


def state_table(fct_order: DataFrame, benchmark: float = STATE_SCORE_BENCHMARK) -> DataFrame:
    """State performance with bubble size and a flag for scores under the benchmark."""
    flagged = state_performance(fct_order).withColumn("below_benchmark", F.col("avg_review") < benchmark)
    return at_edge(scaled_to_max(flagged, "revenue"))


def state_contrast(fct_order: DataFrame, states: Sequence[str]) -> DataFrame:
    """Chosen states side by side: actual, promised, late rate, score."""
    names = ["avg_delivery_days", "avg_promised_days", "late_delivery_rate", "avg_review_score"]
    chosen = fct_order.where(delivered() & F.col("customer_state").isin(*states))
    return at_edge(evaluate(chosen, names, ["customer_state"]))


def state_drivers(fct_order: DataFrame) -> DataFrame:
    """Across states, what goes with the score: speed or the kept promise?"""
    states = state_performance(fct_order)
    return at_edge(
        states.agg(
            F.count("*").alias("states"),
            correlation("avg_delivery_days", "avg_review").alias("corr_delivery_days"),
            correlation("late_rate", "avg_review").alias("corr_late_rate"),
        )
    )


# reviews


def late_one_star_share(fct_order: DataFrame) -> DataFrame:
    """Late orders' share of all one-star reviews, and how much likelier they are."""
    late, one = F.col("is_late"), F.col("review_score") == 1
    counted = delivered_rows(fct_order).agg(
        F.count_if(one).alias("one_star"),
        F.count_if(one & late).alias("late_one_star"),
        F.count_if(late).alias("late_orders"),
        F.count_if(~late).alias("on_time_orders"),
        F.count_if(one & ~late).alias("on_time_one_star"),
    )
    late_rate = ratio(F.col("late_one_star"), F.col("late_orders"))
    on_time_rate = ratio(F.col("on_time_one_star"), F.col("on_time_orders"))
    return at_edge(
        counted.select(
            "one_star",
            "late_one_star",
            ratio(F.col("late_one_star"), F.col("one_star")).alias("late_share_of_one_star"),
            F.try_divide(late_rate, on_time_rate).alias("one_star_risk_ratio"),
        )
    )


def counterfactual_gap(fct_order: DataFrame) -> DataFrame:
    """Upper bound on the overall score if late orders rated like on-time ones."""
    scored = delivered_rows(fct_order).agg(
        mean(F.col("review_score")).alias("overall_score"),
        mean(F.when(~F.col("is_late"), F.col("review_score"))).alias("on_time_score"),
    )
    return at_edge(scored.withColumn("bound", F.col("on_time_score") - F.col("overall_score")))


# product categories


def top_categories(
    fct_order_item: DataFrame, n: int = TOP_CATEGORIES, benchmark: float = SCORE_BENCHMARK
) -> DataFrame:
    """The largest categories by revenue, flagged where the score is under the benchmark."""
    top = top_n(category_performance(fct_order_item), "revenue", "product_category", n)
    return top.withColumn("below_benchmark", F.col("avg_review") < benchmark)


def category_table(fct_order_item: DataFrame, n: int = TABLE_CATEGORIES) -> DataFrame:
    names = ["category_revenue", "items_sold", "category_avg_review", "freight_share", "category_late_rate"]
    measured = evaluate(sales_rows(fct_order_item), names, ["product_category"])
    return at_edge(top_n(measured, "category_revenue", "product_category", n))


def category_treemap(fct_order_item: DataFrame) -> DataFrame:
    measured = evaluate(sales_rows(fct_order_item), ["category_revenue"], ["product_category"])
    return at_edge(share_of_total(measured, "category_revenue"))


def category_concentration(fct_order_item: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    """How much of all revenue the ``n`` largest categories carry."""
    measured = evaluate(sales_rows(fct_order_item), ["category_revenue"], ["product_category"])
    return at_edge(cumulative_share(measured, "category_revenue", "product_category", n))


def price_vs_review(fct_order_item: DataFrame) -> DataFrame:
    names = ["items_sold", "avg_item_price", "category_avg_review"]
    return at_edge(evaluate(sales_rows(fct_order_item), names, ["product_category"]))


def category_drivers(fct_order_item: DataFrame, minimum: int = MIN_CATEGORY_LINES) -> DataFrame:
    """Across categories with enough lines, what goes with the score?"""
    names = ["items_sold", "category_avg_review", "category_late_rate", "freight_share", "avg_item_price"]
    measured = evaluate(sales_rows(fct_order_item), names, ["product_category"])

    def against_score(x: str) -> Column:
        return correlation(x, "category_avg_review")

    return at_edge(
        enough_volume(measured, "items_sold", minimum).agg(
            F.count("*").alias("categories"),
            against_score("category_late_rate").alias("corr_late_rate"),
            against_score("freight_share").alias("corr_freight_share"),
            against_score("avg_item_price").alias("corr_avg_price"),
        )
    )


def category_lateness_split(fct_order_item: DataFrame) -> DataFrame:
    """Score on time and late per category, with all categories as the last level.

    A rollup: both levels come from one aggregation, and a category that is
    NULL could not be mistaken for the total because ``is_total`` says which.
    """
    names = ["category_avg_review_on_time", "category_avg_review_late", "category_late_rate"]
    split = evaluate(sales_rows(fct_order_item), names, ["product_category"], "rollup")
    return at_edge(split.select("product_category", (F.col("grouping_id") == 1).alias("is_total"), *names))
