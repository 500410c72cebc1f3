"""Derived targets and features of the stateless family."""

from pyspark.sql import functions as F

from tabloom.functions import fixed_values as V
from tabloom.functions.scalars import named
from tabloom.functions.stats import fit_stats
from tabloom.operators import profile as P
from tabloom.operators import targets as T
from tabloom.operators.joins import group_values
from tabloom.queries.base import cut_sql, flag_sql, query, r, rounded, table
from tabloom.session import checkpoint


def stats_cte(columns, name: str, shares: str) -> str:
    """CTE ``s`` with mean, deviations, range and quantiles of each column."""
    parts = ", ".join(
        f"avg({c}::DOUBLE) AS {c}_mean, stddev_samp({c}::DOUBLE) AS {c}_std, stddev_pop({c}::DOUBLE) AS {c}_pop, min({c})::DOUBLE AS {c}_min, "
        f"max({c})::DOUBLE AS {c}_max, quantile_cont({c}::DOUBLE, {shares}) AS {c}_q" for c in columns)
    return f"s AS (SELECT {parts} FROM {name})"


PRICE_Q = "[0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE]"


def price_sql(c, key, name):
    z = f"(({c} - {c}_mean) / {c}_pop)"
    q = [f"{c}_q[{i}]" for i in range(1, 6)]
    return f"""WITH {stats_cte([c], name, PRICE_Q)}
        SELECT {key}, {cut_sql(c, [f'{c}_min', q[1], q[2], q[3], f'{c}_max'], V.TIER, True)} AS {c}_tier,
        {flag_sql(f'{c} > {q[2]}')} AS {c}_is_high,
        {cut_sql(c, [None, q[1], q[2], q[3], None], V.QUANTILE_SEGMENT)} AS {c}_quantile_segment,
        {flag_sql(f'{c} >= {q[4]}')} AS {c}_high_value, {flag_sql(f'{c} <= {q[0]}')} AS {c}_low_value,
        round({z}, 6) AS {c}_zscore, {flag_sql(f'abs{z} > 2')} AS {c}_is_outlier,
        {cut_sql(z, [None, -2, -1, 1, 2, None], V.STD_CATEGORY)} AS {c}_std_category FROM {name}, s"""


def family(df, key, c, shares, features):
    s = fit_stats(df, {c: shares})[c]
    return df.select(key, *[v.alias(n) for n, v in features(c, s).items()])


@query(price_sql("o_totalprice", "o_orderkey", "orders"))
def price_features(spark, folder):
    """F1-F7 on order totals."""
    df = family(table(spark, folder, "orders"), "o_orderkey", "o_totalprice", T.PRICE_SHARES, T.price_features)
    return rounded(df, o_totalprice_zscore=6)


@query(price_sql("p_retailprice", "p_partkey", "part"))
def price_features_part(spark, folder):
    """F1-F7 on retail prices, which hold many equal values."""
    df = family(table(spark, folder, "part"), "p_partkey", "p_retailprice", T.PRICE_SHARES, T.price_features)
    return rounded(df, p_retailprice_zscore=6)


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 100.0 ELSE l_discount END::DOUBLE AS price FROM lineitem),
    s AS (SELECT min(price) AS lo, max(price) AS hi FROM d)
    SELECT tier, count(*) AS n FROM (SELECT """ + cut_sql(
        "price", ["lo", "lo + (hi - lo) / 4", "lo + 2 * ((hi - lo) / 4)", "lo + 3 * ((hi - lo) / 4)", "hi"], V.TIER, True)
    + """ AS tier FROM d, s) GROUP BY 1""")
def price_tier_ties(spark, folder):
    """F1 where ties make the quartile edges collapse, so that equal widths take over."""
    price = F.when(F.col("l_discount") > 0.05, 100.0).otherwise(F.col("l_discount"))
    df = table(spark, folder, "lineitem").select("l_orderkey", price.alias("price"))
    made = family(df, "l_orderkey", "price", T.PRICE_SHARES, T.price_features)
    return made.groupBy(F.col("price_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


QTY_Q = "[0.15::DOUBLE, 0.2::DOUBLE, 1.0::DOUBLE / 3, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 2.0::DOUBLE / 3, 0.8::DOUBLE, 0.85::DOUBLE]"


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS line_qty FROM lineitem), {stats_cte(['line_qty'], 'd', QTY_Q)},
    f AS (SELECT {cut_sql('line_qty', ['line_qty_min', 'line_qty_q[3]', 'line_qty_q[7]', 'line_qty_max'], V.THIRDS, True)} AS line_qty_category,
    {flag_sql('line_qty > line_qty_q[5]')} AS line_qty_above_median,
    {cut_sql('line_qty', ['line_qty_min', 'line_qty_q[2]', 'line_qty_q[4]', 'line_qty_q[6]', 'line_qty_q[8]', 'line_qty_max'], V.PERCENTILE_SEGMENT, True)} AS line_qty_percentile_segment,
    {cut_sql('line_qty', ['0', 'line_qty_q[1]', 'line_qty_q[9]', None], V.STOCK_LEVEL, True)} AS line_qty_stock_level,
    {flag_sql('line_qty <= line_qty_q[1]')} AS line_qty_restock_needed, line_qty FROM d, s)
    SELECT line_qty, line_qty_category, line_qty_above_median, line_qty_percentile_segment, line_qty_stock_level,
           line_qty_restock_needed, count(*) AS n FROM f GROUP BY ALL""")
def quantity_features(spark, folder):
    """F8-F11 on line quantities."""
    df = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_quantity").alias("line_qty"))
    s = fit_stats(df, {"line_qty": T.QUANTITY_SHARES})["line_qty"]
    made = T.quantity_features("line_qty", s)
    return (df.withColumns(made).groupBy("line_qty", *made).agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH d AS (SELECT event_id, value FROM events), s AS (SELECT min(value) AS lo, max(value) AS hi,
        quantile_cont(value, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS q FROM d)
    SELECT event_id, round((value - lo) / (hi - lo), 6) AS value_normalized,
        {cut_sql('value', ['lo', 'q[1]', 'q[2]', 'q[3]', 'hi'], V.RATING_SATISFACTION, True)} AS value_satisfaction FROM d, s""")
def rating_features(spark, folder):
    """F12, F13 on event values."""
    made = family(table(spark, folder, "events"), "event_id", "value", T.QUARTILES, T.rating_features)
    return rounded(made, value_normalized=6)


@query("""SELECT doc_id, quality::DOUBLE AS quality_normalized,
    CASE quality WHEN 1 THEN 'Poor' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Good' ELSE 'Unknown' END AS quality_satisfaction FROM labels""")
def rating_features_few(spark, folder):
    """F12, F13 where a rating has only two values."""
    return family(table(spark, folder, "labels"), "doc_id", "quality", T.QUARTILES, T.rating_features)


GEN_Q = "[0.25::DOUBLE, 0.33::DOUBLE, 0.5::DOUBLE, 0.67::DOUBLE, 0.75::DOUBLE]"


@query(f"""WITH {stats_cte(['l_extendedprice'], 'lineitem', GEN_Q)},
    f AS (SELECT {cut_sql('l_extendedprice', ['l_extendedprice_min', 'l_extendedprice_q[1]', 'l_extendedprice_q[3]', 'l_extendedprice_q[5]', 'l_extendedprice_max'], V.QUARTERS, True)} AS l_extendedprice_category,
    {flag_sql('l_extendedprice > l_extendedprice_q[3]')} AS l_extendedprice_above_median,
    {cut_sql('l_extendedprice', [None, 'l_extendedprice_q[2]', 'l_extendedprice_q[4]', None], V.TREND)} AS l_extendedprice_trend, l_extendedprice FROM lineitem, s)
    SELECT l_extendedprice_category, l_extendedprice_above_median, l_extendedprice_trend, count(*) AS n,
           min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM f GROUP BY ALL""")
def numeric_features(spark, folder):
    """F14 on line prices."""
    df = table(spark, folder, "lineitem").select("l_extendedprice")
    s = fit_stats(df, {"l_extendedprice": T.GENERIC_SHARES})["l_extendedprice"]
    made = T.generic_features("l_extendedprice", s)
    return df.withColumns(made).groupBy(*made).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


def recency_sql(days):
    return cut_sql(days, [0, 30, 90, 180, None], V.RECENCY)


@query(f"""WITH d AS (SELECT o_orderkey, o_orderdate, date_diff('microsecond', o_orderdate, (SELECT max(o_orderdate) FROM orders)) // 86400000000 AS days FROM orders)
    SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month,
    quarter(o_orderdate)::INT AS o_orderdate_quarter, {flag_sql('isodow(o_orderdate) >= 6')} AS o_orderdate_is_weekend,
    days AS o_orderdate_recency_days, {recency_sql('days')} AS o_orderdate_recency_category FROM d""")
def date_features(spark, folder):
    """F15-F17, X1-X4 on order dates."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    newest = df.agg(F.max("o_orderdate").cast("string")).first()[0]
    return df.select("o_orderkey", *[v.alias(n) for n, v in T.date_features("o_orderdate", newest).items()])


@query(f"""WITH d AS (SELECT event_id, date_diff('microsecond', ts, (SELECT max(ts) FROM events)) // 86400000000 AS days FROM events)
    SELECT event_id, days AS ts_recency_days, {recency_sql('days')} AS ts_recency_category FROM d""")
def recency_of_events(spark, folder):
    """F16, F17 where the time of day matters."""
    df = table(spark, folder, "events").select("event_id", "ts")
    newest = df.agg(F.max("ts").cast("string")).first()[0]
    recency = T.recency_features("ts", F.lit(newest).cast("timestamp_ntz"))
    return df.select("event_id", *[v.alias(n) for n, v in recency.items()])


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_quantity - 1, 0) AS v FROM lineitem),
    m AS (SELECT median(v) AS med FROM d), f AS (SELECT coalesce(v, med) AS v FROM d, m),
    s AS (SELECT min(v) AS lo, max(v) AS hi, quantile_cont(v, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS q FROM f)
    SELECT {cut_sql('v', ['lo', 'q[1]', 'q[2]', 'q[3]', 'hi'], V.TIER, True)} AS category, count(*) AS n,
           round(min(v), 4) AS lo, round(max(v), 4) AS hi, round(avg(v), 4) AS mean FROM f, s GROUP BY 1""")
def ratio_features(spark, folder):
    """price per unit, with zero divisors filled by the median."""
    df = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("line_price"), (F.col("l_quantity") - 1).alias("line_units"))
    made = T.TargetGenerator(roles={"line_price": "price", "line_units": "quantity"}).generate(df)
    v = F.col("line_price_per_line_units")
    return made.groupBy(F.col("line_price_per_line_units_category").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), r(F.min(v), 4).alias("lo"), r(F.max(v), 4).alias("hi"),
        r(F.avg(v), 4).alias("mean"))


@query(f"""WITH g AS (SELECT l_suppkey, avg(l_extendedprice) AS m, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1),
    d AS (SELECT l_orderkey, l_linenumber, l_suppkey, m, t FROM lineitem JOIN g USING (l_suppkey)),
    s AS (SELECT min(m) AS ml, max(m) AS mh, quantile_cont(m, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS mq,
                 min(t) AS tl, max(t) AS th, quantile_cont(t, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS tq FROM d)
    SELECT l_suppkey, round(m, 3) AS mean, round(t, 2) AS total, {cut_sql('round(m, 6)', ['round(ml, 6)', 'round(mq[1], 6)', 'round(mq[2], 6)', 'round(mq[3], 6)', 'round(mh, 6)'], V.QUARTERS, True)} AS mean_category,
           {cut_sql('round(t, 4)', ['round(tl, 4)', 'round(tq[1], 4)', 'round(tq[2], 4)', 'round(tq[3], 4)', 'round(th, 4)'], V.QUARTERS, True)} AS total_category, count(*) AS n
    FROM d, s GROUP BY ALL""")
def group_mean_sum(spark, folder):
    """Supplier mean and sum on every line, and their quartile class."""
    df = table(spark, folder, "lineitem").select("l_suppkey", "l_extendedprice")
    made = group_values(df, "l_suppkey", T.group_measures(["l_extendedprice"], "l_suppkey"))
    # sums are rounded before binning: their last digits depend on the order of addition
    mean, total = (F.round(F.col(f"l_extendedprice_by_l_suppkey_{a}"), d) for a, d in (("mean", 6), ("sum", 4)))
    made = checkpoint(made.select("l_suppkey", mean.alias("m"), total.alias("t")))
    s = fit_stats(made, {"m": T.QUARTILES, "t": T.QUARTILES})
    edges = {c: [round(e, d) for e in s[c].edges(*T.QUARTILES)] for c, d in (("m", 6), ("t", 4))}
    classes = {f"{c}_class": T.labelled_quantiles(F.col(c), edges[c], V.QUARTERS) for c in edges}
    return made.withColumns(classes).groupBy(
        "l_suppkey", r(F.col("m"), 3).alias("mean"), r(F.col("t"), 2).alias("total"),
        F.col("m_class").alias("mean_category"), F.col("t_class").alias("total_category")).agg(
        F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS (SELECT doc_id, length(text) AS n FROM documents),
    s AS (SELECT min(n) AS lo, max(n) AS hi, quantile_cont(n::DOUBLE, [1.0::DOUBLE / 3, 2.0::DOUBLE / 3]) AS q FROM d)
    SELECT doc_id, n AS text_length, {cut_sql('n', ['lo', 'q[1]', 'q[2]', 'hi'], V.TEXT_LENGTH, True)} AS text_length_category FROM d, s""")
def text_features(spark, folder):
    """F22, X8 on whole documents."""
    df = table(spark, folder, "documents").select("doc_id", "text")
    made = T.TargetGenerator(roles={"text": "text"}).generate(df)
    return made.select("doc_id", F.col("text_length").cast("bigint").alias("text_length"), "text_length_category")


@query(f"""WITH d AS (SELECT vec_id, embedding[1]::DOUBLE AS lat, embedding[2]::DOUBLE AS lon FROM embeddings),
    c AS (SELECT avg(lat) AS la, avg(lon) AS lo FROM d), e AS (SELECT vec_id, sqrt((lat - la) ** 2 + (lon - lo) ** 2) AS dist FROM d, c),
    s AS (SELECT min(dist) AS l, max(dist) AS h, quantile_cont(dist, [1.0::DOUBLE / 3, 2.0::DOUBLE / 3]) AS q FROM e)
    SELECT vec_id, round(dist, 6) AS distance_from_center, {cut_sql('dist', ['l', 'q[1]', 'q[2]', 'h'], V.LOCATION_ZONE, True)} AS location_zone FROM e, s""")
def location_features(spark, folder):
    """F23, F24 on two embedding components taken as coordinates."""
    df = table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding")[0].cast("double").alias("place_latitude"),
        F.col("embedding")[1].cast("double").alias("place_longitude"))
    made = T.TargetGenerator(roles={"place_latitude": "location", "place_longitude": "location"}).generate(df)
    return made.select("vec_id", r(F.col("distance_from_center")).alias("distance_from_center"), "location_zone")


CUSTOMER_ORDERS = """(SELECT c_custkey, c_acctbal AS income, sum(o_totalprice) AS sales, count(o_orderkey) AS orders_made,
    CASE WHEN max(c_custkey) % 10 = 0 THEN NULL ELSE count(DISTINCT o_orderpriority) END AS visits,
    date_diff('day', max(o_orderdate), TIMESTAMP '2002-01-01') AS recency FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"""


def customer_orders(spark, folder):
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("sales"), F.count("o_orderkey").alias("orders_made"),
        F.count_distinct("o_orderpriority").alias("kinds"), F.max("o_orderdate").alias("last"))
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("income"))
    return (customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "income", "sales", F.coalesce("orders_made", F.lit(0)).alias("orders_made"),
        F.when(F.col("c_custkey") % 10 != 0, F.coalesce("kinds", F.lit(0))).alias("visits"),
        F.datediff(F.lit("2002-01-01").cast("date"), "last").cast("bigint").alias("recency")))


def scaled_sql(c):
    return f"(coalesce({c}::DOUBLE, {c}_q[2]) - {c}_min) / ({c}_max - {c}_min)"


SCORES = f"""WITH d AS (SELECT c_custkey, income, round(sales, 2) AS sales, orders_made, visits, recency FROM {CUSTOMER_ORDERS}),
    {stats_cte(['income', 'sales', 'orders_made', 'visits', 'recency'], 'd', '[0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]')},
    e AS (SELECT d.*, round(({scaled_sql('income')} + {scaled_sql('sales')}) / 2, 9) AS value_score,
                 round(({scaled_sql('orders_made')} + {scaled_sql('visits')} + {scaled_sql('recency')}) / 3, 9) AS behavior_score,
                 s.* FROM d, s),
    q AS (SELECT min(value_score) AS vl, max(value_score) AS vh, quantile_cont(value_score, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS v,
                 min(behavior_score) AS bl, max(behavior_score) AS bh, quantile_cont(behavior_score, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS b FROM e)"""


def scored_customers(spark, folder):
    """Customers with rounded scores and the statistics needed for their segments."""
    df = customer_orders(spark, folder).persist()
    worth, habits = ["income", "sales"], ["orders_made", "visits", "recency"]
    stats = fit_stats(df, {c: T.QUARTILES for c in [*worth, *habits]})
    df = df.withColumns({"value_score": F.round(T.score(worth, stats), 9),
                         "behavior_score": F.round(T.score(habits, stats), 9)})
    return df, stats, fit_stats(df, {"value_score": T.QUARTILES, "behavior_score": T.QUARTILES})


@query(SCORES + f"""SELECT c_custkey, round(value_score, 6) AS value_score,
    {cut_sql('value_score', ['vl', 'v[1]', 'v[2]', 'v[3]', 'vh'], V.VALUE_SEGMENT, True)} AS value_segment,
    {cut_sql('income', [None, 'income_mean - income_std', 'income_mean', 'income_mean + income_std', None], V.STDDEV_SEGMENT)} AS income_stddev_segment,
    {cut_sql('income', ['income_min', 'income_q[1]', 'income_q[2]', 'income_q[3]', 'income_max'], V.QUANTILE_SEGMENT, True)} AS income_percentile_segment
    FROM e, q""")
def value_score_segments(spark, folder):
    """F25-F28 on customers."""
    df, stats, fitted = scored_customers(spark, folder)
    return df.select("c_custkey", r(F.col("value_score")).alias("value_score"),
                     T.value_segment(fitted["value_score"]).alias("value_segment"),
                     *[v.alias(n) for n, v in T.spread_features("income", stats["income"]).items()])


@query(SCORES + f"""SELECT c_custkey, round(behavior_score, 6) AS behavior_score,
    {cut_sql('behavior_score', ['bl', 'b[1]', 'b[2]', 'b[3]', 'bh'], V.BEHAVIOR_SEGMENT, True)} AS behavior_segment FROM e, q""")
def behavior_segments(spark, folder):
    """F29, F30 on customers."""
    df, _, fitted = scored_customers(spark, folder)
    segment = T.labelled_quantiles(F.col("behavior_score"), fitted["behavior_score"].edges(*T.QUARTILES),
                                   V.BEHAVIOR_SEGMENT)
    return df.select("c_custkey", r(F.col("behavior_score")).alias("behavior_score"),
                     segment.alias("behavior_segment"))


@query(SCORES + """SELECT CASE WHEN coalesce(recency < recency_q[2], false) THEN 'Active' ELSE 'Lapsed' END
    || CASE WHEN value_score > v[2] THEN ' High Value' ELSE ' Low Value' END AS customer_lifecycle, count(*) AS n FROM e, q GROUP BY 1""")
def lifecycle(spark, folder):
    """F31 on customers."""
    df, stats, fitted = scored_customers(spark, folder)
    stage = T.lifecycle(F.col("value_score"), fitted["value_score"].median, F.col("recency"), stats["recency"].median)
    return df.groupBy(stage.alias("customer_lifecycle")).agg(F.count(F.lit(1)).alias("n"))


QUARTILE_Q = "[0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]"


def quarter_sql(c, labels):
    return cut_sql(c, [f"{c}_min", f"{c}_q[1]", f"{c}_q[2]", f"{c}_q[3]", f"{c}_max"], labels, True)


@query(f"""WITH g AS (SELECT l_orderkey, sum(l_quantity) AS total, avg(l_quantity) AS mean FROM lineitem GROUP BY 1),
    d AS (SELECT l_orderkey, l_extendedprice AS price, l_quantity AS qty, l_tax AS tax, l_shipdate, total, mean,
                 l_extendedprice / nullif(l_quantity, 0) AS unit FROM lineitem JOIN g USING (l_orderkey)),
    {stats_cte(['price', 'tax', 'total', 'mean', 'unit'], 'd', QUARTILE_Q)},
    t AS (SELECT quantile_cont(qty, [1.0::DOUBLE / 3, 2.0::DOUBLE / 3]) AS qt, min(qty) AS ql, max(qty) AS qh, max(l_shipdate) AS newest FROM d),
    f AS (SELECT {quarter_sql('price', V.TIER)} AS sale_price_tier, {cut_sql('qty', ['ql', 'qt[1]', 'qt[2]', 'qh'], V.THIRDS, True)} AS sale_quantity_category,
        {quarter_sql('tax', V.RATING_SATISFACTION)} AS tax_rating_satisfaction, year(l_shipdate)::INT AS ship_date_year,
        {recency_sql("date_diff('microsecond', l_shipdate, newest) // 86400000000")} AS ship_date_recency_category,
        {quarter_sql('unit', V.TIER)} AS sale_price_per_sale_quantity_category,
        {quarter_sql('total', V.QUARTERS)} AS sale_quantity_by_order_id_sum_category, {quarter_sql('mean', V.QUARTERS)} AS sale_quantity_by_order_id_mean_category,
        'Medium' AS return_text_length_category,
        {cut_sql('price', [None, 'price_mean - price_std', 'price_mean', 'price_mean + price_std', None], V.STDDEV_SEGMENT)} AS sale_price_stddev_segment FROM d, s, t)
    SELECT *, count(*) AS n FROM f GROUP BY ALL""")
def generate_all(spark, folder):
    """F32: every family at once on lines; rows per combination of the generated classes."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier_id"),
        F.col("l_extendedprice").alias("sale_price"), F.col("l_quantity").alias("sale_quantity"),
        F.col("l_tax").alias("tax_rating"), F.col("l_shipdate").alias("ship_date"),
        F.col("l_returnflag").alias("return_text"))
    made = T.generate_features(lines)
    classes = ["sale_price_tier", "sale_quantity_category", "tax_rating_satisfaction", "ship_date_year",
               "ship_date_recency_category", "sale_price_per_sale_quantity_category",
               "sale_quantity_by_order_id_sum_category", "sale_quantity_by_order_id_mean_category",
               "return_text_length_category", "sale_price_stddev_segment"]
    return made.groupBy(*classes).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd,
        quantile_cont(o_totalprice, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS q FROM orders),
    f AS (SELECT {cut_sql('o_totalprice', ['lo', 'q[1]', 'q[2]', 'q[3]', 'hi'], V.TIER, True)} AS o_totalprice_tier,
        {cut_sql('o_totalprice', [None, 'q[1]', 'q[2]', 'q[3]', None], V.QUANTILE_SEGMENT)} AS o_totalprice_quantile_segment,
        {cut_sql('(o_totalprice - m) / sd', [None, -2, -1, 1, 2, None], V.STD_CATEGORY)} AS o_totalprice_std_category FROM orders, s),
    t AS (SELECT 'o_totalprice_tier' AS target, o_totalprice_tier AS class FROM f
          UNION ALL SELECT 'o_totalprice_quantile_segment', o_totalprice_quantile_segment FROM f
          UNION ALL SELECT 'o_totalprice_std_category', o_totalprice_std_category FROM f),
    c AS (SELECT target, class, count(*) AS n FROM t WHERE class IS NOT NULL GROUP BY ALL),
    g AS (SELECT target, count(*) AS classes, min(n) AS smallest_class FROM c GROUP BY 1)
    SELECT *, CASE WHEN classes = 2 THEN 'binary' ELSE 'multiclass' END AS task FROM g WHERE classes >= 2 AND smallest_class >= 5""")
def candidate_targets(spark, folder):
    """A25 on the generated classes of order totals."""
    df = table(spark, folder, "orders")
    made = family(df, "o_orderkey", "o_totalprice", T.PRICE_SHARES, T.price_features)
    classes = [c for c in made.columns if c.endswith(("_category", "_tier", "_segment"))]
    return P.candidate_targets(made.select(*[named(c) for c in classes]), classes)
