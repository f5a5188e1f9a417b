"""The five reports a second time, as SQL text over the raw tables.

Nothing here uses a function of the marts: keys, filters, lateness, buckets and
labels are spelled out again, so that a mistake in a shared helper cannot
stand on both sides of a comparison. Braces name tables, not columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.readers import RawTables

_DELIVERED = "select order_id, order_delivered_customer_date as done from {orders}"
_DELIVERED_BY_LINE = "select order_id, max(%s) as done from {order_items} group by order_id"

_ORDERS = """
    with delivered as (%(delivered)s),
    scores as (
        select order_id, max_by(review_score,
            struct(review_answer_timestamp, review_creation_date, review_id)) as score
        from {order_reviews} group by order_id
    ),
    worth as (select order_id, sum(price + freight_value) as worth from {order_items} group by order_id),
    o as (
        select b.order_id, b.customer_id, scores.score, worth.worth, delivered.done,
            trunc(cast(b.order_purchase_timestamp as date), 'MM') as month,
            cast(delivered.done - b.order_purchase_timestamp as interval second) as took,
            date_diff(cast(delivered.done as date), cast(b.order_estimated_delivery_date as date)) as behind
        from {orders} b
        left join delivered on delivered.order_id = b.order_id
        left join scores on scores.order_id = b.order_id
        left join worth on worth.order_id = b.order_id
        where b.order_status is null or b.order_status not in (%(cancelled)s)
    )
"""

_ROUND = "cast(round(cast(%s as decimal(28,9)), %d) as double)"


def _mean(value: str, places: int) -> str:
    return _ROUND % (f"try_divide(cast(sum({value}) as double), count({value}))", places)


_LATE = "case when behind > 0 then 1 when behind <= 0 then 0 end"

MONTHLY = f"""
    select month as order_month, count(*) as orders, sum(worth) as revenue, {_mean('worth', 2)} as aov,
        count(distinct c.customer_unique_id) as customers
    from o left join {{customers}} c on c.customer_id = o.customer_id group by month
"""

STATE = f"""
    select c.customer_state, count(*) as orders, sum(worth) as revenue,
        {_mean('cast(took as decimal(20,6)) / 86400', 3)} as avg_delivery_days,
        {_mean(_LATE, 3)} as late_rate, {_mean('score', 3)} as avg_review
    from o left join {{customers}} c on c.customer_id = o.customer_id
    where done is not null group by c.customer_state
"""

BUCKET = f"""
    , named(delivery_bucket) as (values ('10+ days early'), ('3-10 days early'), ('0-3 days early'),
        ('1-3 days late'), ('3-10 days late'), ('10+ days late')),
    d as (
        select order_id, score, worth, case when behind <= -10 then '10+ days early'
            when behind <= -3 then '3-10 days early' when behind <= 0 then '0-3 days early'
            when behind <= 3 then '1-3 days late' when behind <= 10 then '3-10 days late'
            when behind > 10 then '10+ days late' end as label
        from o where done is not null
    ),
    counted as (
        select label, count(*) as orders, {_mean('score', 3)} as avg_review, sum(worth) as revenue from d group by label
    )
    select coalesce(label, delivery_bucket) as delivery_bucket, coalesce(orders, 0) as orders, avg_review, revenue
    from counted full join named on label = delivery_bucket
"""

CATEGORY = f"""
    select coalesce(initcap(replace(coalesce(t.product_category_name_english, p.product_category_name), '_', ' ')),
            'Unknown') as product_category,
        count(*) as items, sum(i.price + i.freight_value) as revenue, {_mean('i.price', 3)} as avg_price,
        {_mean('i.freight_value', 3)} as avg_freight, {_mean('score', 3)} as avg_review, {_mean(_LATE, 3)} as late_rate
    from {{order_items}} i join o on o.order_id = i.order_id
    left join {{products}} p on p.product_id = i.product_id
    left join {{category_translation}} t on t.product_category_name = p.product_category_name
    group by 1
"""

LATENESS = f"""
    select behind > 0 as is_late, count(*) as orders, {_mean('score', 3)} as avg_review,
        {_mean('case when score = 1 then 1 else 0 end', 3)} as pct_1_star,
        {_mean('case when score = 5 then 1 else 0 end', 3)} as pct_5_star
    from o where done is not null group by 1
"""

#: Report, its key and its SQL. The values compared are all other columns.
REPORTS = {
    "monthly_sales": ("order_month", MONTHLY),
    "category_performance": ("product_category", CATEGORY),
    "state_performance": ("customer_state", STATE),
    "delivery_vs_review": ("delivery_bucket", BUCKET),
    "review_by_lateness": ("is_late", LATENESS),
}


def report_from_raw(raw: RawTables, name: str) -> DataFrame:
    """One of the five reports straight from the raw tables."""
    statuses = ", ".join("'" + s.replace("'", "''") + "'" for s in raw.cancelled_statuses)
    delivered = _DELIVERED if raw.line_delivered is None else _DELIVERED_BY_LINE % raw.line_delivered
    text = _ORDERS % {"delivered": delivered, "cancelled": statuses} + REPORTS[name][1]
    named = {
        "orders": raw.orders, "order_items": raw.order_items, "order_reviews": raw.order_reviews,
        "customers": raw.customers, "products": raw.products, "category_translation": raw.category_translation,
    }
    used = {table: df for table, df in named.items() if f"{{{table}}}" in text}
    return raw.orders.sparkSession.sql(text, **used)
