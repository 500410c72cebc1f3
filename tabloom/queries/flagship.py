"""The shortest way through the library: fit, apply, group."""

from pyspark.sql import functions as F

from tabloom.functions import fixed_values as V
from tabloom.operators.fitted import FeatureTransformer
from tabloom.queries.base import cut_sql, query, r, table
from tabloom.queries.features import stats_cte
from tabloom.queries.fitted import SHARES

C = "l_extendedprice"
Z = f"(({C} - {C}_mean) / {C}_std)"


@query(f"""WITH {stats_cte([C], 'lineitem', SHARES)},
    f AS (SELECT {cut_sql(C, [f'{C}_min', f'{C}_q[1]', f'{C}_q[3]', f'{C}_q[5]', f'{C}_max'], V.QUARTERS, True)} AS price_class, {Z} AS z FROM lineitem, s)
    SELECT price_class, count(*) AS n, round(avg(z), 4) AS mean_z, count(*) FILTER (abs(z) > 2) AS outliers FROM f GROUP BY 1""")
def price_classes(spark, folder):
    """Line prices by fitted quartile class."""
    df = table(spark, folder, "lineitem").select(C)
    made = FeatureTransformer(target_only=True).fit_transform(df)
    return made.groupBy(F.col(f"{C}_category").alias("price_class")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(f"{C}_zscore"), 4).alias("mean_z"),
        F.sum(f"{C}_is_outlier").alias("outliers"))
