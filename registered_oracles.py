"""DuckDB SQL for every registered query, written from the definitions.

The fragments below are plain common table expressions over the benchmark
tables; each query states its own aggregation on top of them.
"""

from __future__ import annotations

STATES = "('NATION_1', 'NATION_2', 'NATION_3', 'NATION_7')"
CATEGORIES = "('Asia 2', 'Brand#25', 'Unknown')"


def rnd(x: str, places: int) -> str:
    """Half-up through a decimal, so both engines agree on ties."""
    return f"cast(round(cast({x} as decimal(28,9)), {places}) as double)"


def dbl(x: str) -> str:
    return f"cast({x} as double)"


def avg(x: str, where: str | None = None) -> str:
    flt = f" filter (where {where})" if where else ""
    return f"(cast(sum({x}){flt} as double) / nullif(count({x}){flt}, 0))"


def cnt(where: str) -> str:
    return f"count(*) filter (where {where})"


def div(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


# common table expressions, in dependency order

CTES = {
    "li": (
        (),
        """
        select l_orderkey as order_id, l_linenumber as order_item_id, l_partkey as product_id,
               l_suppkey as seller_id, l_shipdate as shipping_limit_date, l_linestatus,
               cast(l_extendedprice as decimal(12,2)) as price,
               cast(round(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)), 2)
                    as decimal(12,2)) as freight_value
        from lineitem""",
    ),
    "ibo": (
        ("li",),
        """
        select order_id, count(*) as item_count, count(distinct seller_id) as seller_count,
               sum(price) as product_revenue, sum(freight_value) as freight_value,
               sum(price + freight_value) as order_value,
               max(shipping_limit_date) filter (where l_linestatus = 'F') as delivered_at
        from li group by order_id""",
    ),
    "py": (
        (),
        """
        select l_orderkey as order_id, cast(l_linenumber as bigint) * 1000000000 + l_partkey as seq,
               case l_returnflag when 'A' then 'credit' when 'N' then 'transfer' else 'voucher' end as kind,
               cast(floor(l_quantity / 10) + 1 as bigint) as installments,
               cast(round((cast(l_extendedprice as decimal(12,2))
                           + cast(round(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)), 2) as decimal(12,2)))
                    * cast(1 + floor(l_quantity / 10) / 100 as decimal(4,2)), 2) as decimal(12,2)) as paid
        from lineitem""",
    ),
    "pay": (
        ("py",),
        """
        select order_id, sum(paid) as payment_value, count(*) as payment_splits, max(installments) as max_installments,
               first(kind order by paid desc, seq) as primary_payment_type
        from py group by order_id""",
    ),
    "upay": (
        (),
        """
        select user_id as customer_id, sum(cast(value as decimal(12,2))) as payment_value,
               count(*) as payment_splits,
               max(cast(floor(value / 100) + 1 as bigint)) as max_installments,
               first(event_type order by cast(value as decimal(12,2)) desc, event_id) as primary_payment_type
        from events group by user_id""",
    ),
    "rv": (
        (),
        """
        select l_orderkey as order_id, l_partkey * 8 + l_linenumber as review_id,
               case when cast(l_quantity as bigint) % 17 <> 0 then cast(l_quantity as bigint) % 5 + 1 end as review_score,
               l_shipdate as created, case when l_linestatus = 'F' then l_shipdate + to_days(l_linenumber) end as answered
        from lineitem where l_returnflag <> 'R'""",
    ),
    "rev": (
        ("rv",),
        """
        select order_id, review_score, created from (
            select *, row_number() over (partition by order_id
                order by answered desc nulls last, created desc nulls last, review_id desc) as rn from rv) where rn = 1""",
    ),
    "cust": (
        (),
        """
        select c_custkey as customer_id, c_custkey as customer_unique_id,
               lpad(cast(c_nationkey as varchar), 5, '0') as customer_zip_code_prefix,
               c_mktsegment as customer_city, n_name as customer_state
        from customer left join nation on n_nationkey = c_nationkey""",
    ),
    "sell": (
        (),
        """
        select s_suppkey as seller_id, lpad(cast(s_nationkey as varchar), 5, '0') as seller_zip_code_prefix,
               s_name as seller_city, n_name as seller_state
        from supplier left join nation on n_nationkey = s_nationkey""",
    ),
    "fo": (
        ("ibo", "pay", "cust", "rev"),
        """
        select o.o_orderkey as order_id, o.o_custkey as customer_id, c.customer_unique_id,
               c.customer_state, c.customer_city, o.o_orderstatus as order_status,
               o.o_orderstatus = 'P' as is_cancelled, i.delivered_at is not null as is_delivered,
               o.o_orderdate as order_purchase_timestamp, cast(o.o_orderdate as date) as order_date,
               cast(date_trunc('month', o.o_orderdate) as date) as order_month,
               i.delivered_at as order_delivered_customer_date,
               o.o_orderdate + interval 60 day as order_estimated_delivery_date,
               (epoch_us(i.delivered_at) - epoch_us(o.o_orderdate)) / 86400e6 as delivery_days,
               (epoch_us(o.o_orderdate + interval 60 day) - epoch_us(o.o_orderdate)) / 86400e6 as estimated_days,
               date_diff('day', cast(o.o_orderdate + interval 60 day as date), cast(i.delivered_at as date)) as delay_days,
               cast(i.delivered_at as date) > cast(o.o_orderdate + interval 60 day as date) as is_late,
               i.item_count, i.seller_count, i.product_revenue, i.freight_value, i.order_value,
               p.payment_value, p.payment_splits, p.max_installments, p.primary_payment_type,
               r.review_score
        from orders o
        left join rev r on r.order_id = o.o_orderkey
        left join cust c on c.customer_id = o.o_custkey
        left join ibo i on i.order_id = o.o_orderkey
        left join pay p on p.order_id = o.o_orderkey""",
    ),
    "bucket": (
        (),
        """
        select * from (values (1, '10+ days early'), (2, '3-10 days early'), (3, '0-3 days early'),
               (4, '1-3 days late'), (5, '3-10 days late'), (6, '10+ days late')) v(bucket_ord, delivery_bucket)""",
    ),
    "fct": (
        ("fo",),
        """
        select *, case when delay_days is null then null when delay_days <= -10 then '10+ days early'
                       when delay_days <= -3 then '3-10 days early' when delay_days <= 0 then '0-3 days early'
                       when delay_days <= 3 then '1-3 days late' when delay_days <= 10 then '3-10 days late'
                       else '10+ days late' end as delivery_bucket
        from fo""",
    ),
    "s": (("fct",), "select * from fct where not is_cancelled"),
    "d": (("fct",), "select * from fct where not is_cancelled and is_delivered"),
    "prod": (
        (),
        """
        select p_partkey as product_id, p_retailprice as product_weight_g,
               array_to_string(list_transform(string_split(lower(replace(coalesce(
                   t.english, case when p_size <> 1 then p_brand end, 'unknown'), '_', ' ')), ' '),
                   lambda w: upper(w[1]) || w[2:]), ' ') as product_category
        from part left join (
            select 'Brand#' || n_nationkey as name,
                   replace(lower(r_name), ' ', '_') || '_' || n_nationkey as english
            from nation join region on n_regionkey = r_regionkey) t
          on t.name = case when p_size <> 1 then p_brand end""",
    ),
    "fi": (
        ("li", "fct", "prod"),
        """
        select li.order_id, li.order_item_id, li.product_id, li.seller_id, li.shipping_limit_date,
               coalesce(p.product_category, 'Unknown') as product_category, p.product_weight_g,
               li.price, li.freight_value, li.price + li.freight_value as item_value,
               f.customer_state, f.order_status, f.is_cancelled, f.is_delivered, f.order_purchase_timestamp,
               f.order_month, f.delivery_days, f.delay_days, f.is_late, f.delivery_bucket, f.review_score
        from li join fct f on f.order_id = li.order_id
        left join prod p on p.product_id = li.product_id""",
    ),
    "si": (("fi",), "select * from fi where not is_cancelled"),
}


def with_ctes(needs: tuple[str, ...], body: str) -> str:
    """Prefix a query with the fragments it uses and theirs."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in wanted:
            wanted.append(name)

    for name in needs:
        visit(name)
    if not wanted:
        return body.strip()
    listed = ",\n".join(f"{n} as ({CTES[n][1]})" for n in wanted)
    return f"with {listed}\n{body.strip()}"


SALE = "not is_cancelled"
DONE = "not is_cancelled and is_delivered"
LATE = f"{DONE} and is_late"
ON_TIME = f"{DONE} and not is_late"


def _sum(x: str, where: str) -> str:
    return f"sum({x}) filter (where {where})"


N_ORDERS = f"count(distinct order_id) filter (where {SALE})"
N_DONE = f"count(distinct order_id) filter (where {DONE})"
N_LATE = f"count(distinct order_id) filter (where {LATE})"
N_REVIEWED = cnt(f"{SALE} and review_score is not null")
REVENUE = _sum("order_value", SALE)

ORDER_METRICS = {
    "total_revenue": dbl(REVENUE),
    "product_revenue": dbl(_sum("product_revenue", SALE)),
    "freight_revenue": dbl(_sum("freight_value", SALE)),
    "total_orders": N_ORDERS,
    "total_customers": f"count(distinct customer_unique_id) filter (where {SALE})",
    "items_ordered": f"cast({_sum('item_count', SALE)} as bigint)",
    "aov": rnd(div(REVENUE, N_ORDERS), 2),
    "avg_valued_order": rnd(avg("order_value", SALE), 2),
    "items_per_order": rnd(div(_sum("item_count", SALE), N_ORDERS), 6),
    "delivered_orders": N_DONE,
    "avg_delivery_days": rnd(avg("delivery_days", DONE), 6),
    "avg_promised_days": rnd(avg("estimated_days", DONE), 6),
    "avg_delivery_vs_promise": rnd(avg("delay_days", DONE), 6),
    "late_orders": N_LATE,
    "late_delivery_rate": rnd(div(N_LATE, N_DONE), 6),
    "on_time_delivery_rate": rnd(f"1 - {div(N_LATE, N_DONE)}", 6),
    "avg_promise_padding_days": rnd(f"{avg('estimated_days', DONE)} - {avg('delivery_days', DONE)}", 6),
    "avg_review_score": rnd(avg("review_score", SALE), 6),
    "reviewed_orders": N_REVIEWED,
    "review_coverage": rnd(div(N_REVIEWED, N_ORDERS), 6),
    "one_star_orders": cnt(f"{SALE} and review_score = 1"),
    "five_star_orders": cnt(f"{SALE} and review_score = 5"),
    "one_star_rate": rnd(div(cnt(f"{SALE} and review_score = 1"), N_REVIEWED), 6),
    "five_star_rate": rnd(div(cnt(f"{SALE} and review_score = 5"), N_REVIEWED), 6),
    "avg_review_late": rnd(avg("review_score", LATE), 6),
    "avg_review_on_time": rnd(avg("review_score", ON_TIME), 6),
    "review_gap_late_vs_on_time": rnd(f"{avg('review_score', LATE)} - {avg('review_score', ON_TIME)}", 6),
    "revenue_at_risk": dbl(_sum("order_value", LATE)),
    "late_revenue_share": rnd(div(_sum("order_value", LATE), REVENUE), 6),
    "all_order_value": dbl("sum(order_value)"),
    "all_payment_value": dbl("sum(payment_value)"),
    "payments_over_item_value": rnd(f"{div('sum(payment_value)', 'sum(order_value)')} - 1", 6),
}

ITEM_METRICS = {
    "category_revenue": dbl(_sum("item_value", SALE)),
    "category_freight": dbl(_sum("freight_value", SALE)),
    "items_sold": cnt(SALE),
    "avg_item_price": rnd(avg("price", SALE), 6),
    "avg_item_freight": rnd(avg("freight_value", SALE), 6),
    "freight_share": rnd(div(_sum("freight_value", SALE), _sum("item_value", SALE)), 6),
    "late_items": cnt(LATE),
    "delivered_items": cnt(DONE),
    "category_late_rate": rnd(div(cnt(LATE), cnt(DONE)), 6),
    "category_avg_review": rnd(avg("review_score", SALE), 6),
    "category_avg_review_late": rnd(avg("review_score", LATE), 6),
    "category_avg_review_on_time": rnd(avg("review_score", ON_TIME), 6),
}


def measures(source: dict[str, str], names: tuple[str, ...] | None = None) -> str:
    return ",\n".join(f"{source[n]} as {n}" for n in (names or tuple(source)))


MONTHLY = f"""
    select order_month, count(*) as orders, {dbl('sum(order_value)')} as revenue,
           {rnd(avg('order_value'), 2)} as aov, count(distinct customer_unique_id) as customers
    from s group by order_month"""

CATEGORY = f"""
    select product_category, count(*) as items, {dbl('sum(item_value)')} as revenue,
           {rnd(avg('price'), 3)} as avg_price, {rnd(avg('freight_value'), 3)} as avg_freight,
           {rnd(avg('review_score'), 3)} as avg_review,
           {rnd(div(cnt('is_late'), cnt('is_late is not null')), 3)} as late_rate
    from si group by product_category"""

BUCKETS = f"""
    select b.delivery_bucket, cast(b.bucket_ord as bigint) as bucket_ord, count(d.order_id) as orders,
           {rnd(avg('review_score'), 3)} as avg_review, {dbl('sum(order_value)')} as revenue
    from bucket b left join d on d.delivery_bucket = b.delivery_bucket
    group by b.delivery_bucket, b.bucket_ord"""

STATE = f"""
    select customer_state, count(*) as orders, {dbl('sum(order_value)')} as revenue,
           {rnd(avg('delivery_days'), 3)} as avg_delivery_days,
           {rnd(div(cnt('is_late'), cnt('is_late is not null')), 3)} as late_rate,
           {rnd(avg('review_score'), 3)} as avg_review
    from d group by customer_state"""

LATENESS = f"""
    select is_late, count(*) as orders, {rnd(avg('review_score'), 3)} as avg_review,
           {rnd(div(cnt('review_score = 1'), 'count(*)'), 3)} as pct_1_star,
           {rnd(div(cnt('review_score = 5'), 'count(*)'), 3)} as pct_5_star"""

HEADLINE = f"""
    {LATENESS}
    from (select cast(max_ship as date) > cast(o_orderdate as date) + 60 as is_late,
                 review_score
          from orders join (select l_orderkey, max(l_shipdate) as max_ship from lineitem
                            where l_linestatus = 'F' group by l_orderkey) on l_orderkey = o_orderkey
          left join rev on rev.order_id = o_orderkey
          where o_orderstatus <> 'P')
    group by is_late"""

ROLLUP_NAMES = ("total_revenue", "total_orders", "total_customers", "aov", "late_delivery_rate", "one_star_rate")


MONTH_REV = "select order_month, sum(order_value) as rev from s group by order_month"
MONTH_REV_DIMS = (
    "select customer_state, delivery_bucket, order_month, sum(order_value) as rev "
    "from s group by customer_state, delivery_bucket, order_month"
)

KEY_CHECKS = (
    ("region", ("r_regionkey",)),
    ("nation", ("n_nationkey",)),
    ("customer", ("c_custkey",)),
    ("supplier", ("s_suppkey",)),
    ("part", ("p_partkey",)),
    ("orders", ("o_orderkey",)),
    ("lineitem", ("l_orderkey", "l_linenumber")),
    ("events", ("event_id",)),
)
REFERENCE_CHECKS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
)
ROW_CHECKS = (
    ("region", "not_null", "r_name", "r_name is null"),
    ("nation", "not_null", "n_name", "n_name is null"),
    ("customer", "not_null", "c_name", "c_name is null"),
    ("customer", "not_null", "c_nationkey", "c_nationkey is null"),
    ("part", "between", "p_size", "p_size not between 1 and 50"),
    ("orders", "not_null", "o_custkey", "o_custkey is null"),
    ("orders", "not_null", "o_orderstatus", "o_orderstatus is null"),
    ("orders", "not_null", "o_orderdate", "o_orderdate is null"),
    ("orders", "not_null", "o_orderpriority", "o_orderpriority is null"),
    ("lineitem", "not_null", "l_orderkey", "l_orderkey is null"),
    ("lineitem", "not_null", "l_partkey", "l_partkey is null"),
    ("lineitem", "not_null", "l_suppkey", "l_suppkey is null"),
    ("lineitem", "not_null", "l_extendedprice", "l_extendedprice is null"),
    ("lineitem", "not_null", "l_tax", "l_tax is null"),
    ("lineitem", "between", "l_linenumber", "l_linenumber not between 1 and 7"),
    ("lineitem", "between", "l_discount", "l_discount not between 0 and 0.1e0"),
    ("events", "not_null", "user_id", "user_id is null"),
    ("events", "not_null", "ts", "ts is null"),
)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _constraints() -> str:
    parts = []
    for table, keys in KEY_CHECKS:
        cols = ", ".join(keys)
        parts.append(
            f"select '{table}' as table_name, 'primary_key' as rule, '{','.join(keys)}' as columns, "
            f"(select count(*) from {table}) - (select count(*) from (select distinct {cols} from {table})) as violations"
        )
    for table, col, parent, parent_col in REFERENCE_CHECKS:
        parts.append(
            f"select '{table}', 'foreign_key', '{col}', (select count(*) from {table} c where c.{col} is not null "
            f"and not exists (select 1 from {parent} p where p.{parent_col} = c.{col}))"
        )
    for table, rule, col, bad in ROW_CHECKS:
        parts.append(f"select '{table}', '{rule}', '{col}', (select count(*) from {table} where {bad})")
    return (
        "select *, case when violations = 0 then 'PASS' else 'FAIL' end as status from ("
        + "\nunion all ".join(parts)
        + ")"
    )


def _compare_headline() -> str:
    rows = []
    for col in ("orders", "avg_review", "pct_1_star", "pct_5_star"):
        rows.append(
            f"""select '{col}' as column_name, count(a.n) as rows_left, count(b.n) as rows_right,
                count(*) filter (where b.n is null) as only_left, count(*) filter (where a.n is null) as only_right,
                count(*) filter (where a.n > 1 or b.n > 1) as repeated_keys,
                count(*) filter (where a.n is not null and b.n is not null
                                 and (a.{col} is null) <> (b.{col} is null)) as null_mismatches,
                max(abs(cast(a.{col} as double) - cast(b.{col} as double))) as max_abs_delta
                from a full join b on a.is_late is not distinct from b.is_late"""
        )
    union = "\nunion all ".join(rows)
    return with_ctes(
        ("d",),
        f"""
        , a as (select *, count(*) over (partition by is_late) as n from ({LATENESS} from d group by is_late)),
        b as (select *, count(*) over (partition by is_late) as n from ({HEADLINE}))
        select *, only_left = 0 and only_right = 0 and repeated_keys = 0 and null_mismatches = 0
                  and coalesce(max_abs_delta, 0) <= 0.011 as ok
        from ({union})""",
    )


def _reconciliation(payment_gap: float = 0.05, unpaid: str = "unpaid <= raw_orders * 0.03") -> str:
    t = """
        , t as (select (select count(*) from orders) as raw_orders,
            (select count(*) from li) as raw_items,
            (select sum(price) from li) as raw_revenue,
            (select sum(paid) from py) as raw_payments,
            (select count(*) from fct) as fct_orders,
            (select count(distinct order_id) from fct) as fct_ids,
            (select sum(product_revenue) from fct) as fct_revenue,
            (select sum(order_value) from fct) as fct_value,
            (select count(*) from fct where payment_value is null) as unpaid,
            (select count(*) from fi) as fct_items,
            (select sum(item_value) from fi) as fi_value)"""

    def row(n: int, name: str, ok: str, bad: str, expected: str, actual: str, known: str = "false") -> str:
        return (
            f"select cast({n} as bigint) as ord, '{name}' as \"check\", "
            f"case when {ok} then 'PASS' when {known} then 'KNOWN GAP' else '{bad}' end as status, "
            f"cast({expected} as varchar) as expected, cast({actual} as varchar) as actual from t"
        )

    rows = [
        row(1, "fct_order is one row per order", "fct_orders = fct_ids and fct_orders = raw_orders", "FAIL",
            "raw_orders", "fct_orders"),
        row(2, "fct_order_item preserves every item line", "fct_items = raw_items", "FAIL", "raw_items", "fct_items"),
        row(3, "product revenue ties to raw item prices", "fct_revenue = raw_revenue", "FAIL",
            "raw_revenue", "fct_revenue"),
        row(4, "order value ties to item grain", "fct_value = fi_value", "FAIL", "fi_value", "fct_value"),
        row(5, "payments equal order value", "raw_payments = fct_value", "FAIL", "fct_value", "raw_payments",
            f"abs({div('raw_payments', 'fct_value')} - 1) <= {payment_gap}"),
        row(6, "every order has a payment row", "unpaid = 0", "FAIL", "0", "unpaid", unpaid),
    ]
    return with_ctes(("fi",), t + "\n" + "\nunion all ".join(rows))


def _naive(parent: str, key: str, a: tuple, b: tuple) -> str:
    """The literal join, for a report that never builds it."""
    (an, at, ak, av), (bn, bt, bk, bv) = a, b
    return f"""
        select (select count(*) from {parent}) as parent_rows, naive_rows,
               {dbl('na')} as naive_{an}, {dbl('nb')} as naive_{bn},
               {dbl('ta')} as true_{an}, {dbl('tb')} as true_{bn},
               {rnd(div('na', 'ta') + ' * 100 - 100', 1)} as pct_{an}_overstated,
               {rnd(div('nb', 'tb') + ' * 100 - 100', 1)} as pct_{bn}_overstated
        from (select count(*) as naive_rows, sum({av}) as na, sum({bv}) as nb
              from {parent} join {at} on {ak} = {key} join {bt} on {bk} = {key}),
             (select sum({av}) as ta from {at}), (select sum({bv}) as tb from {bt})"""


def _oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    d_money = ("product_revenue", "freight_value", "order_value", "payment_value")
    q["fct_order"] = with_ctes(
        ("fct",), "select * replace (" + ", ".join(f"{dbl(c)} as {c}" for c in d_money) + ") from fct"
    )
    q["fct_order_item"] = with_ctes(
        ("fi",),
        "select * replace (cast(order_item_id as bigint) as order_item_id, "
        + ", ".join(f"{dbl(c)} as {c}" for c in ("price", "freight_value", "item_value"))
        + ") from fi",
    )
    q["dim_product"] = with_ctes(("prod",), "select * from prod")
    q["dim_customer"] = with_ctes(("cust",), "select * from cust")
    q["dim_seller"] = with_ctes(("sell",), "select * from sell")
    q["dim_date"] = """
        select date, extract(year from date) as year, extract(month from date) as month_no,
               strftime(date, '%b') as month_name, strftime(date, '%Y-%m') as year_month,
               'Q' || extract(quarter from date) as quarter, cast(date_trunc('month', date) as date) as month_start
        from (select cast(unnest(generate_series(
                  make_date((select min(extract(year from o_orderdate)) from orders), 1, 1)::timestamp,
                  make_date((select max(extract(year from o_orderdate)) from orders), 12, 31)::timestamp,
                  interval 1 day)) as date) as date)"""
    q["items_by_order"] = with_ctes(
        ("ibo",),
        f"""select order_id, item_count, seller_count, {dbl('product_revenue')} as product_revenue,
            {dbl('freight_value')} as freight_value, {dbl('order_value')} as order_value,
            delivered_at as order_delivered_customer_date from ibo""",
    )
    q["payments_by_order"] = with_ctes(
        ("pay",),
        f"""select o_orderkey as order_id, {dbl('payment_value')} as payment_value, payment_splits, max_installments,
            primary_payment_type from orders left join pay on order_id = o_orderkey""",
    )
    q["payments_by_parent"] = with_ctes(
        ("upay",),
        f"""select customer_id, {dbl('payment_value')} as payment_value, payment_splits,
            max_installments, primary_payment_type from upay""",
    )
    q["reviews_by_order"] = with_ctes(("rev",), "select order_id, review_score, created as review_creation_date from rev")
    q["keep_latest"] = """
        select user_id, event_id, ts, event_type, value
        from (select *, row_number() over (partition by user_id order by ts desc nulls last, event_id desc) as rn
              from events) where rn = 1"""
    q["delivery_columns"] = with_ctes(
        ("fct",),
        """select order_id, is_cancelled, is_delivered, order_date, order_month, delivery_days, estimated_days,
           delay_days, is_late, delivery_bucket from fct""",
    )

    q["monthly_sales"] = with_ctes(("s",), MONTHLY + " order by order_month")
    q["category_performance"] = with_ctes(("si",), CATEGORY + " order by revenue desc")
    q["delivery_vs_review"] = with_ctes(("d", "bucket"), BUCKETS + " order by bucket_ord")
    q["state_performance"] = with_ctes(("d",), STATE + " order by revenue desc")
    q["review_by_lateness"] = with_ctes(("d",), LATENESS + " from d group by is_late order by is_late")
    q["headline_from_raw"] = with_ctes(("rev",), HEADLINE)

    q["metrics_total"] = with_ctes(("fct",), f"select {measures(ORDER_METRICS)} from fct")
    for name, dim in (("metrics_by_state", "customer_state"), ("metrics_by_month", "order_month")):
        q[name] = with_ctes(("fct",), f"select {dim}, {measures(ORDER_METRICS)} from fct group by {dim}")
    q["item_metrics_total"] = with_ctes(("fi",), f"select {measures(ITEM_METRICS)} from fi")
    q["item_metrics_by_category"] = with_ctes(
        ("fi",), f"select product_category, {measures(ITEM_METRICS)} from fi group by product_category"
    )
    for name, how, dims in (
        ("metrics_rollup", "rollup", "order_status, customer_state"),
        ("metrics_cube", "cube", "delivery_bucket, customer_city"),
    ):
        q[name] = with_ctes(
            ("fct",),
            f"""select {dims}, cast(grouping({dims}) as bigint) as grouping_id,
                {measures(ORDER_METRICS, ROLLUP_NAMES)} from fct group by {how} ({dims})""",
        )
    in_slice = f"""cast(order_purchase_timestamp as date) between date '1996-07-01' and date '1998-06-30'
                   and customer_state in {STATES}"""
    q["slice_metrics"] = with_ctes(
        ("fct",),
        f"select customer_state, {measures(ORDER_METRICS)} from fct where {in_slice} group by customer_state",
    )
    q["slice_item_metrics"] = with_ctes(
        ("fi",),
        f"""select product_category, {measures(ITEM_METRICS)} from fi
            where {in_slice} and product_category in {CATEGORIES} group by product_category""",
    )
    q["metrics_by_dims"] = with_ctes(
        ("fi", "sell"),
        f"""select extract(year from order_purchase_timestamp) as year,
            'Q' || extract(quarter from order_purchase_timestamp) as quarter, seller_state, {measures(ITEM_METRICS)}
            from fi left join sell on sell.seller_id = fi.seller_id group by 1, 2, 3""",
    )

    q["revenue_mom"] = with_ctes(
        ("s",),
        f"""select m.*, p.revenue as prior_revenue,
            {rnd(div('cast(m.revenue as decimal(38,2)) - cast(p.revenue as decimal(38,2))', 'p.revenue'), 6)} as revenue_mom
            from ({MONTHLY}) m left join ({MONTHLY}) p on p.order_month = m.order_month - interval 1 month""",
    )
    for name, inner, keys in (
        ("revenue_ytd", MONTH_REV, ()),
        ("revenue_mom_by_state", MONTH_REV_DIMS, ("customer_state", "delivery_bucket")),
    ):
        mine = "".join(f"m.{k}, " for k in keys)
        same = "".join(f" and p.{k} is not distinct from m.{k}" for k in keys)
        year = ", ".join([*keys, "extract(year from order_month)"])
        q[name] = with_ctes(
            ("s",),
            f"""select {mine}m.order_month, {dbl('m.rev')} as total_revenue, {dbl('p.rev')} as prior_total_revenue,
                {rnd(div('m.rev - p.rev', 'p.rev'), 6)} as total_revenue_mom, {dbl('m.ytd')} as total_revenue_ytd
                from (select *, sum(rev) over (partition by {year} order by order_month) as ytd from ({inner})) m
                left join ({inner}) p on p.order_month = m.order_month - interval 1 month{same}""",
        )
    q["months_filled"] = with_ctes(
        ("s",),
        f""", m as ({MONTH_REV_DIMS}),
        spine as (select customer_state, delivery_bucket,
                         cast(unnest(generate_series(min(order_month)::timestamp, max(order_month)::timestamp,
                              interval 1 month)) as date) as order_month
                  from m group by customer_state, delivery_bucket)
        select spine.customer_state, spine.delivery_bucket, spine.order_month, {dbl('m.rev')} as total_revenue
        from spine left join m on m.customer_state is not distinct from spine.customer_state
             and m.delivery_bucket is not distinct from spine.delivery_bucket and m.order_month = spine.order_month""",
    )
    q["grain_check"] = with_ctes(
        ("fct",),
        """select n as order_rows, k as distinct_orders,
           case when n = k then 'OK - ' || format('{:,}', k) || ' orders'
                else 'BROKEN - ' || format('{:,}', n) || ' rows for ' || format('{:,}', k) || ' orders' end as grain_check
           from (select count(*) as n, count(distinct order_id) as k from fct)""",
    )
    q["tie_out"] = with_ctes(
        ("fi",),
        f"""select {dbl('a')} as total_revenue, {dbl('b')} as category_revenue,
            case when abs(a - b) < 0.01 then 'OK' else 'MISMATCH ' || format('{{:,.2f}}', {dbl('a - b')}) end as tie_out
            from (select sum(order_value) as a from fct where {SALE}),
                 (select sum(item_value) as b from fi where {SALE})""",
    )

    q["kpi_cards"] = with_ctes(
        ("fct",),
        f"select {measures(ORDER_METRICS, ('total_revenue', 'total_orders', 'aov', 'total_customers'))} from fct",
    )
    q["revenue_by_state"] = with_ctes(
        ("s",),
        f"""select customer_state, {dbl('sum(order_value)')} as total_revenue,
            {rnd(div('sum(order_value)', 'sum(sum(order_value)) over ()'), 6)} as total_revenue_share
            from s group by customer_state""",
    )
    q["aov_trend"] = with_ctes(
        ("s",),
        f"""select order_month,
            {measures(ORDER_METRICS, ('total_orders', 'aov', 'avg_valued_order', 'items_per_order'))}
            from s group by order_month""",
    )
    q["order_value_hist"] = with_ctes(
        ("s",),
        """select cast(floor(order_value / 5000) * 5000 as bigint) as bin_start, count(*) as row_count
           from s where order_value is not null group by 1""",
    )
    q["items_per_order_dist"] = with_ctes(
        ("s",), "select item_count, count(*) as orders from s group by item_count"
    )
    q["payment_mix"] = with_ctes(
        ("s",),
        f"""select primary_payment_type, max_installments, count(*) as orders,
            {rnd(div('count(*)', 'sum(count(*)) over ()'), 6)} as orders_share
            from s group by primary_payment_type, max_installments""",
    )
    q["monthly_trend"] = with_ctes(
        ("s",),
        f"""select *, {rnd(div('sum(cast(revenue as decimal(38,2))) over ()', 'sum(orders) over ()'), 6)} as period_aov
            from ({MONTHLY}) where orders > 50""",
    )
    q["dropped_months"] = with_ctes(
        ("s",),
        """select strftime(order_month, '%Y-%m') as month, count(*) as orders
           from s group by order_month having count(*) <= 125""",
    )
    q["peak_month"] = with_ctes(
        ("s",),
        f"""select arg_max(order_month, revenue) as peak_month, max(revenue) as peak_revenue,
            strftime(min(order_month), '%b %Y') as first_month, strftime(max(order_month), '%b %Y') as last_month
            from ({MONTHLY}) where orders > 50""",
    )
    growth = ("total_revenue", "total_orders", "aov", "items_per_order", "total_customers")
    q["growth_inputs"] = with_ctes(
        ("s",), f"select order_month, {measures(ORDER_METRICS, growth)} from s group by order_month"
    )
    q["repeat_rate"] = with_ctes(
        ("s",),
        f"""select count(*) as customers, {cnt('n > 1')} as repeat_customers,
            {rnd(div(cnt('n > 1'), 'count(*)'), 6)} as repeat_rate
            from (select customer_unique_id, count(*) as n from s group by customer_unique_id)""",
    )
    trend = ("delivered_orders", "late_orders", "late_delivery_rate")
    q["late_trend"] = with_ctes(
        ("d",), f"select order_month, {measures(ORDER_METRICS, trend)} from d group by order_month"
    )
    q["delivery_hist"] = with_ctes(
        ("d",),
        f"""select bin_start, {cnt("k = 'a'")} as actual_orders, {cnt("k = 'p'")} as promised_orders
            from (select 'a' as k, cast(floor(delivery_days / 30) * 30 as bigint) as bin_start from d
                  union all select 'p', cast(floor(estimated_days / 30) * 30 as bigint) from d)
            group by bin_start""",
    )
    q["median_delivery"] = with_ctes(
        ("d",), f"select {rnd('median(delivery_days)', 6)} as median_delivery_days from d"
    )
    q["median_delivery_by_state"] = with_ctes(
        ("d",),
        f"""select customer_state, {rnd('median(delivery_days)', 6)} as median_delivery_days
            from d group by customer_state""",
    )
    q["bucket_step"] = with_ctes(
        ("d", "bucket"),
        f"""select *, {rnd('avg_review - lag(avg_review) over (order by bucket_ord)', 6)} as avg_review_step,
            delivery_bucket like '%early%' as early from ({BUCKETS})""",
    )
    q["state_table"] = with_ctes(
        ("d",),
        f"""select *, avg_review < 3.0 as below_benchmark,
            {rnd('revenue / max(revenue) over ()', 6)} as revenue_scaled from ({STATE})""",
    )
    contrast = ("avg_delivery_days", "avg_promised_days", "late_delivery_rate", "avg_review_score")
    q["state_contrast"] = with_ctes(
        ("d",),
        f"""select customer_state, {measures(ORDER_METRICS, contrast)} from d
            where customer_state in {STATES} group by customer_state""",
    )
    q["state_drivers"] = with_ctes(
        ("d",),
        f"""select count(*) as states, {rnd('corr(avg_delivery_days, avg_review)', 6)} as corr_delivery_days,
            {rnd('corr(late_rate, avg_review)', 6)} as corr_late_rate from ({STATE})""",
    )
    q["late_one_star_share"] = with_ctes(
        ("d",),
        f"""select one as one_star, late_one as late_one_star, {rnd(div('late_one', 'one'), 6)} as late_share_of_one_star,
            {rnd(div(div('late_one', 'late'), div('one - late_one', 'n - late')), 6)} as one_star_risk_ratio
            from (select count(*) as n, {cnt('is_late')} as late, {cnt('review_score = 1')} as one,
                         {cnt('review_score = 1 and is_late')} as late_one from d)""",
    )
    q["counterfactual_gap"] = with_ctes(
        ("d",),
        f"""select {rnd(avg('review_score'), 6)} as overall_score,
            {rnd(avg('review_score', 'not is_late'), 6)} as on_time_score,
            {rnd(avg('review_score', 'not is_late') + ' - ' + avg('review_score'), 6)} as bound from d""",
    )

    q["top_categories"] = with_ctes(
        ("si",),
        f"""select *, avg_review < 3.0 as below_benchmark from ({CATEGORY})
            order by revenue desc, product_category limit 12""",
    )
    table = ("category_revenue", "items_sold", "category_avg_review", "freight_share", "category_late_rate")
    q["category_table"] = with_ctes(
        ("si",),
        f"""select product_category, {measures(ITEM_METRICS, table)} from si group by product_category
            order by category_revenue desc, product_category limit 20""",
    )
    by_category = """select product_category, sum(item_value) as rev from si group by product_category"""
    q["share_of_total"] = with_ctes(
        ("si",),
        f"""select product_category, {dbl('rev')} as category_revenue,
            {rnd(div('rev', 'sum(rev) over ()'), 6)} as category_revenue_share from ({by_category})""",
    )
    q["cumulative_share"] = with_ctes(
        ("si",),
        f"""select product_category, {dbl('rev')} as category_revenue, rank,
            {rnd(div('rev', 'total'), 6)} as share, {rnd(div('running', 'total'), 6)} as cumulative_share
            from (select *, row_number() over w as rank, sum(rev) over w as running, sum(rev) over () as total
                  from ({by_category}) window w as (order by rev desc, product_category rows unbounded preceding))
            where rank <= 12""",
    )
    prices = ("items_sold", "avg_item_price", "category_avg_review")
    q["price_vs_review"] = with_ctes(
        ("si",),
        f"select product_category, {measures(ITEM_METRICS, prices)} from si group by product_category",
    )
    score = avg("review_score")
    q["category_drivers"] = with_ctes(
        ("si",),
        f"""select count(*) as categories, {rnd('corr(late_rate, score)', 6)} as corr_late_rate,
            {rnd('corr(freight, score)', 6)} as corr_freight_share, {rnd('corr(price, score)', 6)} as corr_avg_price
            from (select product_category, {score} as score, {div(cnt(LATE), cnt(DONE))} as late_rate,
                         {div('sum(freight_value)', 'sum(item_value)')} as freight, {avg('price')} as price
                  from si group by product_category having count(*) >= 500)""",
    )
    split = ("category_avg_review_on_time", "category_avg_review_late", "category_late_rate")
    q["category_lateness_split"] = with_ctes(
        ("si",),
        f"""select product_category, false as is_total, {measures(ITEM_METRICS, split)} from si group by product_category
            union all select null, true, {measures(ITEM_METRICS, split)} from si""",
    )

    q["reconciliation"] = _reconciliation()
    q["reconciliation_grown_gap"] = _reconciliation(0.02, "unpaid <= 1")
    q["check_order"] = f"""select row_number() over (order by ord) as place, "check", status from ({q["reconciliation"]})"""
    q["report_order"] = "\nunion all ".join(
        f"""select '{name}' as report, row_number() over (order by {order}) as place, cast({key} as varchar) as row_key
            from ({q[name]})"""
        for name, order, key in (
            ("monthly_sales", "order_month", "order_month"),
            ("category_performance", "revenue desc, product_category", "product_category"),
            ("delivery_vs_review", "bucket_ord, delivery_bucket", "delivery_bucket"),
            ("state_performance", "revenue desc, customer_state", "customer_state"),
            ("review_by_lateness", "is_late", "is_late"),
        )
    )
    q["compare_headline"] = _compare_headline()
    for name, report, columns in (
        ("compare_monthly", "monthly_sales", ("orders", "revenue", "aov", "customers")),
        ("compare_category", "category_performance",
         ("items", "revenue", "avg_price", "avg_freight", "avg_review", "late_rate")),
        ("compare_state", "state_performance", ("orders", "revenue", "avg_delivery_days", "late_rate", "avg_review")),
        ("compare_delivery", "delivery_vs_review", ("orders", "avg_review", "revenue")),
    ):
        # Two derivations that agree in every key and value.
        rows = " union all ".join(
            f"""select '{c}' as column_name, n as rows_left, n as rows_right, 0::bigint as only_left,
                0::bigint as only_right, 0::bigint as repeated_keys, 0::bigint as null_mismatches,
                case when {c} > 0 then 0::double end as max_abs_delta, true as ok
                from (select count(*) as n, count({c}) as {c} from report)"""
            for c in columns
        )
        q[name] = f"with report as ({q[report]}) {rows}"
    q["additivity"] = with_ctes(
        ("fi",),
        f"""select n as categories, {dbl('a')} as sum_of_categories, {dbl('b')} as total_revenue, a = b as additive
            from (select count(*) as n, sum(rev) as a from
                     (select product_category, sum(item_value) as rev from fi where {SALE} group by product_category)),
                 (select sum(order_value) as b from fct where {SALE})""",
    )
    q["fanout_orders"] = with_ctes(
        ("li", "py"),
        _naive(
            "orders",
            "o_orderkey",
            ("revenue", "li", "li.order_id", "price + freight_value"),
            ("payments", "py", "py.order_id", "paid"),
        ),
    )
    q["fanout_report"] = _naive(
        "customer",
        "c_custkey",
        ("orders", "orders", "o_custkey", "cast(o_totalprice as decimal(12,2))"),
        ("events", "events", "user_id", "cast(value as decimal(12,2))"),
    )
    q["review_coverage"] = f"""
        select count(*) as orders, {cnt('r.o_orderkey is null')} as orders_without_review,
               {rnd(div('count(r.o_orderkey)', 'count(*)'), 6)} as coverage
        from orders o left join (select distinct l_orderkey as o_orderkey from lineitem where l_returnflag <> 'R') r
          on r.o_orderkey = o.o_orderkey"""
    q["constraint_report"] = _constraints()
    q["duplicate_reviews"] = f"""
        select cast(sum(n) as bigint) as row_count, count(*) as distinct_keys, {cnt('n > 1')} as repeated_keys,
               cast(sum(n) - count(*) as bigint) as surplus_rows, max(n) as max_per_key
        from (select user_id, count(*) as n from events group by user_id)"""
    counts = "\nunion all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in TABLES)
    q["raw_row_counts"] = counts
    q["load_audit"] = f"""
        select *, case when expected is null then null when row_count = expected then 'PASS' else 'FAIL' end as status
        from (select *, cast(null as bigint) as rejected, row_count as records, cast(case table_name when 'region' then 5 when 'nation' then 25 end as bigint) as expected
              from ({counts}))"""
    q["delivered_from_raw"] = """
        select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as order_status, delivered_at
        from orders join (select l_orderkey, max(l_shipdate) as delivered_at from lineitem
                          where l_linestatus = 'F' group by l_orderkey) on l_orderkey = o_orderkey
        where o_orderstatus not in ('P')"""
    for name, where in (
        ("sales_base", SALE),
        ("delivered_base", DONE),
        ("reviewed_base", f"{SALE} and review_score is not null"),
    ):
        q[name] = with_ctes(
            ("fct",),
            f"""select order_id, is_cancelled, is_delivered, {dbl('order_value')} as order_value, review_score
                from fct where {where}""",
        )
    q["population_sizes"] = with_ctes(
        ("fct",),
        f"""select count(*) as all_orders, {cnt(SALE)} as sales_orders, {cnt(DONE)} as delivered_orders,
            {N_REVIEWED} as reviewed_orders from fct""",
    )
    return q


def oracle_sql() -> dict[str, str]:
    return _oracles()
