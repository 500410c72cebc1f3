"""Imputing, scaling, encoding, selecting, sampling and splitting."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions.scalars import hash_unit, named
from tabloom.operators import encode as E
from tabloom.operators import joins as J
from tabloom.operators import rules as R
from tabloom.operators import sampling as M
from tabloom.operators import strata
from tabloom.queries.associations import JOINED, LEAK, joined, mi_sql
from tabloom.queries.base import flag_sql, query, r, rounded, table

GAPS = """(SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance,
    CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment, c_nationkey FROM customer)"""


def gaps(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"), "c_nationkey")


@query(f"""WITH d AS (SELECT * FROM {GAPS}) SELECT c_custkey, round(coalesce(balance, (SELECT median(balance) FROM d)), 4) AS balance FROM d""")
def impute_median(spark, folder):
    """E1."""
    df = E.impute_numbers(gaps(spark, folder).select("c_custkey", "balance"), ["balance"])
    return rounded(df, balance=4)


@query(f"""WITH d AS (SELECT * FROM {GAPS}) SELECT c_custkey, round(coalesce(balance, (SELECT avg(balance) FROM d)), 4) AS balance FROM d""")
def impute_mean(spark, folder):
    """E2."""
    df = E.impute_numbers(gaps(spark, folder).select("c_custkey", "balance"), ["balance"], "mean")
    return rounded(df, balance=4)


MODE = "(SELECT segment FROM d WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)"


@query(f"""WITH d AS (SELECT * FROM {GAPS}) SELECT c_custkey, coalesce(segment, {MODE}) AS segment FROM d""")
def impute_mode(spark, folder):
    """E3."""
    return E.impute_text(gaps(spark, folder).select("c_custkey", "segment"), ["segment"])


@query("""SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice FROM orders""")
def scale(spark, folder):
    """E4."""
    df = E.scale(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return rounded(df, o_totalprice=6)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderkey, " + ", ".join(
    f"(o_orderpriority = '{p}')::INT AS \"o_orderpriority_{p}\"" for p in PRIORITIES) + " FROM orders")
def onehot_all(spark, folder):
    """E6, E7."""
    return E.one_hot(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], None)


@query(f"""WITH d AS (SELECT * FROM {GAPS}) SELECT c_custkey, """ + ", ".join(
    f"coalesce(segment = '{v}', false)::INT AS \"segment_{v}\"" for v in
    ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM d")
def dummies(spark, folder):
    """NULL has no dummy."""
    return E.dummies(gaps(spark, folder).select("c_custkey", "segment"))


@query("""WITH t AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY 1)
    SELECT CASE WHEN rank <= 9 THEN p_brand ELSE 'infrequent' END AS category, sum(n)::BIGINT AS n FROM t GROUP BY 1""")
def onehot_topk(spark, folder):
    """E5: nine frequent brands, one column for the rest; column sums."""
    coded = E.one_hot(table(spark, folder, "part").select("p_brand"), ["p_brand"], 10)
    sums = coded.agg(*[F.sum(named(c)).alias(c) for c in coded.columns])
    tall = sums.unpivot([], [named(c) for c in coded.columns], "category", "n")
    return tall.withColumn("category", F.regexp_replace("category", "^p_brand_", ""))


@query("""WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 40))
    SELECT p_partkey, coalesce(i, -1) AS brand_index FROM part LEFT JOIN k USING (p_brand)""")
def ordinal(spark, folder):
    """Fitted on one part of the table, -1 for what is new."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    fitted = E.category_index(part.where("p_size <= 40"), "p_brand")
    return E.ordinal(part, "p_brand", fitted, "brand_index").select("p_partkey", "brand_index")


@query("""WITH k AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS i FROM customer)
    SELECT c_custkey, i AS name_index FROM customer JOIN k USING (c_name)""")
def ordinal_many(spark, folder):
    """E8 on a column in which every value differs."""
    df = table(spark, folder, "customer").select("c_custkey", "c_name")
    return E.ordinal(df, "c_name", out="name_index").select("c_custkey", "name_index")


@query("""SELECT doc_id, dense_rank() OVER (ORDER BY coalesce(lang, 'None')) - 1 AS label FROM documents""")
def label_encode(spark, folder):
    """E19, X18."""
    return E.label_encode(table(spark, folder, "documents").select("doc_id", "lang"), "lang").select("doc_id", "label")


@query("""WITH d AS (SELECT o_custkey, (o_orderstatus = 'F')::INT::DOUBLE AS y FROM orders),
    k AS (SELECT o_custkey, (sum(y) + 5 * (SELECT avg(y) FROM d)) / (count(y) + 5) AS v FROM d GROUP BY 1)
    SELECT o_orderkey, round(v, 6) AS customer_target FROM orders JOIN k USING (o_custkey)""")
def target_encode(spark, folder):
    """E9."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    y = (F.col("o_orderstatus") == "F").cast("double")
    coded = E.target_encode(df, "o_custkey", y, 5.0, "customer_target")
    return coded.select("o_orderkey", r(F.col("customer_target")).alias("customer_target"))


@query("""SELECT 2::BIGINT AS per_row, count(*) AS rows, 2.0 * count(*) AS filled, true AS spread FROM part""")
def hash_encode(spark, folder):
    """Every row fills one slot per column, and the slots are spread."""
    coded = E.hash_encode(table(spark, folder, "part").select("p_brand", "p_type"), ["p_brand", "p_type"], width=1024)
    slots = coded.select(vector_to_array("hashed").alias("v"))
    each = slots.select(F.aggregate("v", F.lit(0.0), lambda t, x: t + x).alias("filled"),
                        F.array_position("v", F.array_max("v")).alias("slot"))
    return each.agg(F.max("filled").cast("bigint").alias("per_row"), F.count(F.lit(1)).alias("rows"),
                    F.sum("filled").alias("filled"), (F.count_distinct("slot") > 2).alias("spread"))


@query("""WITH k AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS i FROM (SELECT DISTINCT p_type FROM part))
    SELECT p_partkey, ((i & 4) <> 0)::INT AS p_type_0, ((i & 2) <> 0)::INT AS p_type_1, ((i & 1) <> 0)::INT AS p_type_2
    FROM part JOIN k USING (p_type)""")
def binary_encode(spark, folder):
    """E11."""
    coded = E.binary_encode(table(spark, folder, "part").select("p_partkey", "p_type"), "p_type")
    return coded.select("p_partkey", "p_type_0", "p_type_1", "p_type_2")


def polynomial_sql(x, factors):
    value = f"{factors[0]!r}::DOUBLE"
    for f in factors[1:]:
        value = f"({value} * ({x}) + {f!r}::DOUBLE)"
    return value


@query("""WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS i FROM (SELECT DISTINCT o_custkey FROM orders)),
    n AS (SELECT count(*) AS n FROM k)
    SELECT o_orderkey, n AS width, i AS slot, 1 AS filled FROM orders JOIN k USING (o_custkey), n""")
def onehot_sparse(spark, folder):
    """One-hot of a column of any number of values."""
    coded = E.one_hot_sparse(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    parts = coded.select("o_orderkey", F.unwrap_udt("one_hot").alias("v"))     # as an array every row would be as long as the dictionary
    return parts.select("o_orderkey", F.col("v.size").cast("bigint").alias("width"),
                        F.coalesce(F.get("v.indices", F.lit(0)), F.lit(-1)).cast("bigint").alias("slot"),
                        F.aggregate("v.values", F.lit(0.0), lambda t, x: t + x).cast("int").alias("filled"))


NORMAL_SHARES = "[" + ", ".join(f"{i}.0::DOUBLE / 99" for i in range(100)) + "]"


@query(f"""WITH e AS (SELECT quantile_cont(o_totalprice, {NORMAL_SHARES}) AS e FROM orders),
    d AS (SELECT o_orderkey, o_totalprice AS v, greatest(len(list_filter(e, lambda x: x < o_totalprice)), 1) AS i, e FROM orders, e),
    p AS (SELECT o_orderkey, (i - 1) / 99.0::DOUBLE + (v - e[i]) * ((1.0::DOUBLE / 99) / (e[i + 1] - e[i])) AS p FROM d),
    c AS (SELECT o_orderkey, p, greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) AS q FROM p),
    t AS (SELECT o_orderkey, q, CASE WHEN least(q, 1 - q) >= 0.02425::DOUBLE THEN q - 0.5 ELSE sqrt(-2 * ln(least(q, 1 - q))) END AS t FROM c),
    z AS (SELECT o_orderkey, CASE WHEN least(q, 1 - q) >= 0.02425::DOUBLE THEN {polynomial_sql('t * t', E.NORMAL_MIDDLE)} * t / {polynomial_sql('t * t', E.NORMAL_MIDDLE_UNDER)}
        WHEN q < 0.5 THEN {polynomial_sql('t', E.NORMAL_TAIL)} / {polynomial_sql('t', E.NORMAL_TAIL_UNDER)} ELSE -{polynomial_sql('t', E.NORMAL_TAIL)} / {polynomial_sql('t', E.NORMAL_TAIL_UNDER)} END AS z FROM t)
    SELECT o_orderkey, round(z, 4) AS o_totalprice FROM z""")
def quantile_normal(spark, folder):
    """E15."""
    df = E.quantile_normal(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return rounded(df, o_totalprice=4)


@query("""SELECT c AS feature FROM (SELECT 'l_quantity' AS c, var_pop(l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_tax', var_pop(l_tax) FROM lineitem
    UNION ALL SELECT 'fixed', 0 UNION ALL SELECT 'l_linenumber', var_pop(l_linenumber) FROM lineitem) WHERE v <> 0""")
def variance_filter(spark, folder):
    """E16."""
    df = table(spark, folder, "lineitem").select("l_quantity", "l_tax", "l_linenumber", F.lit(3).alias("fixed"))
    return spark.createDataFrame([(c,) for c in E.varying_columns(df)], "feature string")


@query(f"""SELECT feature, round(mutual_info, 5) AS mutual_info FROM ({mi_sql(LEAK, 'size_class', False, JOINED)})
    ORDER BY mutual_info DESC, feature LIMIT 3""")
def select_k_mi(spark, folder):
    """E17."""
    return rounded(E.best_by_mutual_info(joined(spark, folder), list(LEAK), "size_class", 3), mutual_info=5)


F_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query("SELECT feature, round(f, 4) AS f FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2) AS f FROM lineitem"
    for c in F_COLUMNS) + ") ORDER BY f DESC, feature LIMIT 4")
def select_k_f(spark, folder):
    """E18."""
    return rounded(E.best_by_f(table(spark, folder, "lineitem"), F_COLUMNS, "l_extendedprice", 4), f=4)


def hash_sql(key, seed=42):
    return f"('0x' || substr(md5({key}::VARCHAR || ':{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':42'), o_orderkey LIMIT 500")
def sample_n(spark, folder):
    """M1: 500 random orders."""
    return M.sample_rows(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), 500, "o_orderkey")


@query("""WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT count(*) AS n FROM orders)
    SELECT label, c.n AS n_before, true AS kept, true AS in_proportion, round(c.n::DOUBLE / t.n, 6) AS share_before FROM c, t""")
def stratified_sample(spark, folder):
    """M2: every class keeps a row, and its number of rows is that of the sample up to six deviations."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    part = M.stratified_sample(orders, 5000, "o_orderstatus", "o_orderkey")
    report = M.sampling_report(orders, part, "o_orderstatus")
    share = F.least(F.lit(1.0), 5000 / F.sum("n_before").over(Window.partitionBy()))
    wanted = F.col("n_before") * share
    report = report.withColumn("wanted", wanted)
    return rounded(report.select("label", "n_before", (F.col("n_after") > 0).alias("kept"), (
        F.abs(F.col("n_after") - F.col("wanted")) <= 6 * F.sqrt("wanted") + 1).alias("in_proportion"), "share_before"), share_before=6)


@query(f"""WITH h AS (SELECT doc_id, toxic, md5(doc_id::VARCHAR || ':42') AS h, {hash_sql('doc_id')} AS u FROM labels),
    e AS (SELECT toxic, min(h) AS a, max(h) AS b FROM h GROUP BY 1)
    SELECT doc_id, toxic, CASE WHEN a < b AND h = a THEN true WHEN a < b AND h = b THEN false ELSE u < 0.2 END AS test FROM h JOIN e USING (toxic)""")
def stratified_split(spark, folder):
    """M3: 80/20 with every class on both sides."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return M.marked_split(labels, "doc_id", 0.2, "toxic").withColumnRenamed("__test", "test")


CLASS_RANKS = """c AS (SELECT {label} AS class, {key} AS id, count(*) OVER (PARTITION BY {label}) AS n, count(*) OVER () AS total,
        row_number() OVER (PARTITION BY {label} ORDER BY md5({key}::VARCHAR || ':42')) AS place FROM {table}),
    s AS (SELECT DISTINCT class, n, total, least({n}, total)::BIGINT AS wanted FROM c),
    b AS (SELECT class, n, n * wanted // total AS base, wanted - sum(n * wanted // total) OVER () AS over,
        row_number() OVER (ORDER BY n * wanted % total DESC, '=' || class) AS nth FROM s),
    q AS (SELECT class, n, base + CASE WHEN nth <= over THEN 1 ELSE 0 END AS quota FROM b)"""


def class_ranks(table: str, label: str, key: str, n: str) -> str:
    """SQL: the rows of every class in the order of their hashes (c), and the exact quota of every class (q)."""
    return CLASS_RANKS.format(table=table, label=label, key=key, n=n)


@query(f"WITH {class_ranks('orders', 'o_orderstatus', 'o_orderkey', '5000')} SELECT id AS o_orderkey, class AS o_orderstatus FROM c JOIN q USING (class) WHERE place <= quota")
def exact_sample(spark, folder):
    """M2: 5,000 orders, of every status its exact share."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return strata.exact_sample(orders, 5000, "o_orderstatus", "o_orderkey")


@query(f"""WITH {class_ranks('customer', 'c_nationkey', 'c_custkey', 'ceil(0.2 * total)')}
    SELECT id AS c_custkey, class AS c_nationkey, place <= CASE WHEN q.n < 2 THEN 0 ELSE greatest(1, least(q.n - 1, quota)) END AS test FROM c JOIN q USING (class)""")
def exact_split(spark, folder):
    """M3: a fifth of the customers of every nation, exact to the row."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return strata.exact_split(customers, "c_custkey", 0.2, "c_nationkey", name="test")


@query(f"""WITH {class_ranks('orders', 'o_orderpriority', 'o_orderkey', '1')}
    SELECT id AS o_orderkey, class AS o_orderpriority, (SELECT count(*) FROM range(1, 5) f(k) WHERE place > n * k // 5)::INTEGER AS fold FROM c""")
def stratified_folds(spark, folder):
    """Five folds of orders that differ by at most one row per priority."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return strata.stratified_folds(orders, "o_orderkey", "o_orderpriority", 5)


@query(f"SELECT o_orderstatus, count(*) FILTER ({hash_sql('o_orderkey')} < 0.25) AS test, count(*) FILTER ({hash_sql('o_orderkey')} >= 0.25) AS train FROM orders GROUP BY 1")
def random_split(spark, folder):
    """M4: 75/25 by key hash."""
    u = hash_unit(F.col("o_orderkey"), M.SEED)
    return table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.count_if(u < 0.25).alias("test"), F.count_if(u >= 0.25).alias("train"))


@query("SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 2)")
def missing_classes(spark, folder):
    """Classes that a small part of the table lacks."""
    part = table(spark, folder, "part")
    return J.missing_labels(part, part.where("p_size < 2"), "p_name")


# --- rules ------------------------------------------------------------------------------

LINES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_linenumber * 0.7 AS points,
    date_diff('day', l_shipdate, TIMESTAMP '2002-01-01') AS idle FROM lineitem)"""


@query(f"""SELECT CASE WHEN points < 2 OR idle > 1800 THEN 'At Risk' ELSE 'Healthy' END AS any_risk,
    CASE WHEN points < 2 OR idle > 180 THEN 'At Risk' WHEN points < 4 AND idle > 90 THEN 'Needs Attention' ELSE 'Healthy' END AS health,
    CASE WHEN l_quantity < 3 OR points < 2 THEN 0 WHEN l_quantity < 8 AND points < 4 THEN 1 WHEN l_quantity >= 8 AND points >= 4 THEN 2 ELSE 0 END AS tier,
    {flag_sql('l_quantity > 5 AND points > 3 AND idle > 300')} AS high_value, count(*) AS n FROM {LINES} GROUP BY ALL""")
def rule_labels(spark, folder):
    """Ordered rules on lines."""
    points = F.col("l_linenumber") * 0.7
    idle = F.datediff(F.lit("2002-01-01").cast("date"), F.col("l_shipdate").cast("date"))
    quantity = F.col("l_quantity")
    return table(spark, folder, "lineitem").groupBy(
        R.first_match([((points < 2) | (idle > 1800), "At Risk")], "Healthy").alias("any_risk"),
        R.account_health(points, idle).alias("health"),
        R.customer_tier(quantity, points).alias("tier"),
        R.high_value_customer(quantity, points, idle).alias("high_value")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, CASE WHEN coalesce(c_acctbal, 0) * 1000 > 1000000 AND c_nationkey * 10 > 100 THEN 'Enterprise'
        WHEN coalesce(c_acctbal, 0) * 1000 > 100000 AND c_nationkey * 10 > 10 THEN 'Mid-Market' ELSE 'Small Business' END AS segment FROM customer""")
def company_segments(spark, folder):
    """Three sizes of company."""
    df = table(spark, folder, "customer")
    return df.select("c_custkey", R.company_segment(F.col("c_acctbal") * 1000, F.col("c_nationkey") * 10).alias("segment"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view')::DOUBLE / count(*) AS open_rate, count(*) FILTER (event_type = 'signup')::DOUBLE AS forms,
        CASE WHEN user_id % 3 <> 0 THEN count(*) FILTER (event_type = 'click')::DOUBLE END AS visits, sum(value) AS seconds FROM events GROUP BY 1)
    SELECT user_id, floor(greatest(0, least(open_rate * 20 + forms * 10 + coalesce(visits, 0) * 5 + seconds * (1.0::DOUBLE / 60), 100)))::INT AS score FROM u""")
def lead_score(spark, folder):
    """Weighted score per user."""
    def kind(name):
        return F.count_if(F.col("event_type") == name).cast("double")
    users = table(spark, folder, "events").groupBy("user_id").agg(
        (kind("view") / F.count(F.lit(1))).alias("open_rate"), kind("signup").alias("forms"),
        F.when(F.col("user_id") % 3 != 0, kind("click")).alias("visits"), F.sum("value").alias("seconds"))
    return users.select("user_id", R.lead_score(*[F.col(c) for c in ("open_rate", "forms", "visits", "seconds")]).alias("score"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 5000 THEN 1 ELSE o_orderkey % 2 END::BIGINT AS won FROM orders""")
def rule_fallback(spark, folder):
    """A rule, else the fallback column."""
    rule = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 5000)
    return table(spark, folder, "orders").select("o_orderkey", R.rule_else(rule, F.col("o_orderkey") % 2).cast("bigint").alias("won"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS u, floor(l_quantity * l_discount) AS b, floor(l_extendedprice / 64) / 4 AS p, l_extendedprice, l_discount FROM lineitem),
    f AS (SELECT *, round(u * p, 2) AS gross_sales, round(b * p, 2) AS returns FROM d)
    SELECT l_partkey, round(sum(gross_sales), 2) AS gross_sales, round(sum(returns), 2) AS returns, sum(u - b) AS net_units,
           round(sum(round(gross_sales - returns, 2)), 2) AS net_sales, round(sum(floor(l_extendedprice) * (1 + l_discount)), 2) AS estimated FROM f GROUP BY 1""")
def sales_derivations(spark, folder):
    """R5, R6 summed per part."""
    price = F.floor(F.col("l_extendedprice") / 64) / 4
    units = F.col("l_quantity")
    returned = F.floor(units * F.col("l_discount")).cast("double")
    made = R.sales_columns(units, returned, price, F.lit(0.125))
    df = table(spark, folder, "lineitem").withColumns(
        made | {"estimated": R.estimated_value(F.floor("l_extendedprice"), F.col("l_discount"))})
    return df.groupBy("l_partkey").agg(
        r(F.sum("gross_sales"), 2).alias("gross_sales"), r(F.sum("returns"), 2).alias("returns"),
        F.sum("net_units").alias("net_units"), r(F.sum("net_sales"), 2).alias("net_sales"),
        r(F.sum("estimated"), 2).alias("estimated"))
