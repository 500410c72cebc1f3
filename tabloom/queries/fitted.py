"""Features fitted once and applied to any table."""

from pyspark.sql import functions as F

from tabloom.functions import fixed_values as V
from tabloom.operators import profile as P
from tabloom.operators.fitted import FeatureTransformer
from tabloom.queries.base import cut_sql, flag_sql, query, r, rounded, table
from tabloom.queries.features import recency_sql, stats_cte
from tabloom.session import work_folder

SHARES = "[0.25::DOUBLE, 0.33::DOUBLE, 0.5::DOUBLE, 0.67::DOUBLE, 0.75::DOUBLE]"


def numeric_sql(c):
    q = {p: f"{c}_q[{i + 1}]" for i, p in enumerate((25, 33, 50, 67, 75))}
    z = f"(({c} - {c}_mean) / {c}_std)"
    return f"""round({z}, 6) AS {c}_zscore, {flag_sql(f'abs{z} > 2')} AS {c}_is_outlier,
        {flag_sql(f'{c} > {q[50]}')} AS {c}_is_high, {flag_sql(f'{c} > {q[50]}')} AS {c}_above_median,
        {cut_sql(c, [f'{c}_min', q[25], q[50], q[75], f'{c}_max'], V.QUARTERS, True)} AS {c}_category,
        {cut_sql(c, [f'{c}_min', q[33], q[67], f'{c}_max'], V.TREND, True)} AS {c}_trend,
        {cut_sql(c, [None, f'{c}_mean - {c}_std', f'{c}_mean - 0.5 * {c}_std', f'{c}_mean + 0.5 * {c}_std', f'{c}_mean + {c}_std', None], V.STD_CATEGORY)} AS {c}_std_category"""


def price_class_sql(c):
    width = f"({c}_max - {c}_min)"
    quarter = f"{width} / 4"
    return f"""{cut_sql(c, [f'{c}_min', f'{c}_min + {quarter}', f'{c}_min + 2 * ({quarter})', f'{c}_min + 3 * ({quarter})', f'{c}_max'], V.TIER, True)} AS {c}_tier,
        {cut_sql(c, [f'{c}_min', f'{c}_q[1]', f'{c}_q[3]', f'{c}_q[5]', f'{c}_min + 0.9 * {width}', f'{c}_max'], V.PRICE_STRATEGY, True)} AS {c}_price_strategy"""


@query(f"""WITH {stats_cte(['p_retailprice', 'p_size'], 'part', SHARES)}
    SELECT p_partkey, {numeric_sql('p_retailprice')}, {price_class_sql('p_retailprice')}, {numeric_sql('p_size')} FROM part, s""")
def fitted_price_features(spark, folder):
    """F33-F38, F6, F9, F44 on part."""
    df = table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_size")
    fitted = FeatureTransformer().fit(df.drop("p_partkey"))
    made = fitted.transform(df, return_merged=True).drop("p_retailprice", "p_size")
    return rounded(made, p_retailprice_zscore=6, p_size_zscore=6)


@query(f"""WITH d AS (SELECT l_quantity AS item_count FROM lineitem), {stats_cte(['item_count'], 'd', SHARES)},
    f AS (SELECT item_count, {numeric_sql('item_count')},
        {cut_sql('item_count', ['item_count_min', 'item_count_min + 0.2 * (item_count_max - item_count_min)', 'item_count_min + 0.5 * (item_count_max - item_count_min)', 'item_count_min + 0.8 * (item_count_max - item_count_min)', 'item_count_max'], V.FITTED_STOCK_LEVEL, True)} AS item_count_stock_level FROM d, s)
    SELECT *, count(*) AS n FROM f GROUP BY ALL""")
def fitted_stock_features(spark, folder):
    """F39 and the general numeric features on line quantities."""
    df = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("item_count"))
    made = rounded(FeatureTransformer().fit_transform(df), item_count_zscore=6)
    return made.groupBy(*made.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS (SELECT event_id, floor(value) % 11 AS nps_score, round(floor(value) % 11 / 2, 1) AS star_rating, value AS long_score FROM events),
    w AS (SELECT min(long_score) AS lo, max(long_score) AS hi, (max(long_score) - min(long_score)) / 5 AS step FROM d)
    SELECT event_id, {cut_sql('nps_score', V.TEN_POINT_EDGES, V.SATISFACTION, True)} AS nps_score_satisfaction,
    {cut_sql('nps_score', V.NPS_EDGES, V.NPS, True)} AS nps_score_nps_category,
    {cut_sql('star_rating', V.FIVE_POINT_EDGES, V.SATISFACTION, True)} AS star_rating_satisfaction,
    {cut_sql('star_rating', V.NPS_EDGES, V.NPS, True)} AS star_rating_nps_category,
    {cut_sql('long_score', ['lo', 'lo + step', 'lo + 2 * step', 'lo + 3 * step', 'lo + 4 * step', 'hi'], V.SATISFACTION, True)} AS long_score_satisfaction
    FROM d, w""")
def fitted_rating_features(spark, folder):
    """F40, F41 on three rating scales."""
    points = F.floor("value") % 11
    df = table(spark, folder, "events").select(
        "event_id", points.cast("double").alias("nps_score"),
        F.round(points / 2, 1).alias("star_rating"), F.col("value").alias("long_score"))
    fitted = FeatureTransformer(target_only=True).fit(df.drop("event_id"))
    made = fitted.transform(df)
    return made.select("event_id", *[c for c in made.columns if c.endswith(("_satisfaction", "_nps_category"))])


@query(f"""WITH d AS (SELECT o_orderkey, o_orderdate, date_diff('microsecond', o_orderdate, TIMESTAMP '2002-01-01 12:00:00') // 86400000000 AS days FROM orders)
    SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month,
    quarter(o_orderdate)::INT AS o_orderdate_quarter, {flag_sql('isodow(o_orderdate) >= 6')} AS o_orderdate_is_weekend,
    days AS o_orderdate_recency_days, {recency_sql('days')} AS o_orderdate_recency_category FROM d""")
def fitted_date_features(spark, folder):
    """F42 and date parts against a given reference moment."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    fitted = FeatureTransformer(reference_date="2002-01-01 12:00:00").fit(df.drop("o_orderkey"))
    return fitted.transform(df).drop("o_orderdate")


@query(f"""WITH d AS (SELECT l_extendedprice / nullif(l_quantity - 1, 0) AS v FROM lineitem),
    s AS (SELECT quantile_cont(v, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS q FROM d)
    SELECT {cut_sql('v', [None, 'q[1]', 'q[2]', 'q[3]', None], V.QUARTERS)} AS category, count(*) AS n,
    round(min(v), 4) AS lo, round(max(v), 4) AS hi FROM d, s GROUP BY 1""")
def fitted_ratio_features(spark, folder):
    """F18, F19 of the fitted family: zero divisors stay NULL."""
    df = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("line_price"), (F.col("l_quantity") - 1).alias("line_count"))
    made = FeatureTransformer().fit_transform(df)
    v = F.col("line_price_per_line_count")
    return made.groupBy(F.col("line_price_per_line_count_category").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), r(F.min(v), 4).alias("lo"), r(F.max(v), 4).alias("hi"))


@query(f"""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
        quantile_cont(o_totalprice, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS q FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')
    SELECT o_orderkey, round((o_totalprice - m) / sd, 6) AS o_totalprice_zscore,
    {cut_sql('o_totalprice', ['lo', 'q[1]', 'q[2]', 'q[3]', 'hi'], V.QUARTERS, True)} AS o_totalprice_category
    FROM orders, s WHERE o_orderdate >= TIMESTAMP '1999-01-01'""")
def fit_old_apply_new(spark, folder):
    """Fitted on older orders, saved, loaded and applied to newer ones."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    border = F.lit("1999-01-01").cast("timestamp_ntz")
    path = work_folder(spark, "transformer")
    FeatureTransformer().fit(orders.where(F.col("o_orderdate") < border).select("o_totalprice")).save(spark, path)
    fitted = FeatureTransformer.load(spark, path)
    made = fitted.transform(orders.where(F.col("o_orderdate") >= border))
    return made.select("o_orderkey", r(F.col("o_totalprice_zscore")).alias("o_totalprice_zscore"),
                       "o_totalprice_category")


@query("""SELECT * FROM (VALUES ('zscore', 4::BIGINT), ('is_outlier', 4), ('is_high', 4), ('above_median', 4), ('category', 6), ('trend', 4),
    ('std_category', 4), ('tier', 1), ('price_strategy', 1), ('stock_level', 2), ('year', 1), ('month', 1), ('quarter', 1), ('is_weekend', 1),
    ('recency_days', 1), ('recency_category', 1), ('ratio', 2)) t(family, n)
    WHERE (SELECT count(DISTINCT l_extendedprice) > 3 AND count(DISTINCT l_quantity) > 3 AND count(DISTINCT l_discount) > 3 AND count(DISTINCT l_tax) > 3 FROM lineitem)""")
def feature_catalogue(spark, folder):
    """How many columns of each family apply to lineitem.

    The word ``count`` in ``l_discount`` makes that column a quantity here.
    """
    df = table(spark, folder, "lineitem").select(
        F.col("l_quantity"), "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    fitted = FeatureTransformer().fit(df)
    found = P.feature_families(fitted.generated_columns, df)
    return found
