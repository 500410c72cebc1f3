"""Column profiles, counts and class shares."""

from pyspark.sql import functions as F

from tabloom.functions import scalars as X
from tabloom.operators import columns as C
from tabloom.operators import profile as P
from tabloom.operators.encode import dummies
from tabloom.plans.prepare import days_since
from tabloom.queries.base import query, r, rounded, table

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_TEXT = ["l_returnflag", "l_linestatus"]


def profile_sql(name: str, columns, text) -> str:
    parts = [f"""SELECT '{c}' AS feature, count(*) AS rows, count(DISTINCT {c}) AS distinct_n,
        count(*) - count({c}) AS nulls, {str(c in text).lower()} AS textual FROM {name}""" for c in columns]
    return f"""WITH p AS ({' UNION ALL '.join(parts)}), q AS (
        SELECT *, distinct_n + (nulls > 0)::BIGINT AS with_null,
               distinct_n::DOUBLE / rows AS u, nulls::DOUBLE / rows AS m FROM p)
        SELECT feature, rows, distinct_n AS "distinct", nulls, with_null AS distinct_with_null,
               round(u, 6) AS unique_ratio, round(m, 6) AS null_ratio, with_null <= 1 AS constant,
               u > 0.9 AS id_like, textual AND u > 0.9 AS high_cardinality, m > 0.5 AS null_heavy
        FROM q"""


@query(profile_sql("lineitem", LINEITEM, LINE_TEXT))
def profile_columns(spark, folder):
    """A1-A5 over every column of lineitem."""
    return rounded(P.profile_columns(table(spark, folder, "lineitem")), unique_ratio=6, null_ratio=6)


@query(profile_sql("(SELECT *, NULL::DOUBLE AS empty, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS sparse, 7 AS fixed FROM customer)",
                   ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "empty", "sparse", "fixed"],
                   ["c_name", "c_mktsegment"]))
def profile_gaps(spark, folder):
    """A1-A5 where a column is empty, mostly NULL or constant."""
    df = table(spark, folder, "customer").withColumns({
        "empty": F.lit(None).cast("double"),
        "sparse": F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")),
        "fixed": F.lit(7)})
    return rounded(P.profile_columns(df), unique_ratio=6, null_ratio=6)


@query("""WITH d AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
    m AS (SELECT 'quality' AS feature, count(*) - count(quality) AS missing FROM d
          UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM d
          UNION ALL SELECT 'lang', count(*) - count(lang) FROM d
          UNION ALL SELECT 'doc_id', count(*) - count(doc_id) FROM d)
    SELECT * FROM m WHERE missing > 0""")
def missing_report(spark, folder):
    """A23 on documents with and without labels."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return P.missing_report(docs.join(table(spark, folder, "labels"), "doc_id", "left"))


def stats_sql(name, columns):
    parts = [f"""SELECT '{c}' AS feature, avg({c})::DOUBLE AS mean, stddev_samp({c}) AS std,
        min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
        quantile_cont({c}::DOUBLE, [0.25::DOUBLE, 0.33::DOUBLE, 0.5::DOUBLE, 0.67::DOUBLE, 0.75::DOUBLE]) AS q FROM {name}"""
             for c in columns]
    return f"""SELECT feature, round(mean, 4) AS mean, round(std, 4) AS std, min, max,
        round(q[1], 4) AS q25, round(q[2], 4) AS q33, round(q[3], 4) AS median, round(q[4], 4) AS q67,
        round(q[5], 4) AS q75, round(mean - std, 4) AS minus_sigma, round(mean - 0.5 * std, 4) AS minus_half_sigma,
        round(mean + 0.5 * std, 4) AS plus_half_sigma, round(mean + std, 4) AS plus_sigma
        FROM ({' UNION ALL '.join(parts)})"""


DIGITS = dict(mean=4, std=4, q25=4, q33=4, median=4, q67=4, q75=4, minus_sigma=4, minus_half_sigma=4,
              plus_half_sigma=4, plus_sigma=4)


@query(stats_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def column_stats(spark, folder):
    """A6 on lineitem."""
    df = table(spark, folder, "lineitem")
    return rounded(P.column_stats(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), **DIGITS)


@query(stats_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def fit_bins(spark, folder):
    """A6-A7 on part."""
    return rounded(P.column_stats(table(spark, folder, "part")), **DIGITS)


@query("""SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def value_counts(spark, folder):
    """The ten most frequent parts."""
    return P.value_counts(table(spark, folder, "lineitem"), "l_partkey")


@query("""SELECT o_orderstatus AS label, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share
    FROM orders GROUP BY 1""")
def class_distribution(spark, folder):
    """A10, W2."""
    return rounded(P.class_distribution(table(spark, folder, "orders"), "o_orderstatus"), share=6)


@query("""WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)
    SELECT count(*) AS classes, min(n) AS smallest, max(n) AS largest, round(min(n)::DOUBLE / max(n), 6) AS ratio,
           min(n)::DOUBLE / max(n) < 0.25 AS imbalanced FROM c""")
def imbalance(spark, folder):
    """A11."""
    return rounded(P.imbalance(table(spark, folder, "labels"), "toxic"), ratio=6)


@query("""WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1)
    SELECT label, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""")
def class_weights(spark, folder):
    """A12."""
    return rounded(P.class_weights(table(spark, folder, "orders"), "o_orderpriority"), weight=6)


@query("""WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1),
    w AS (SELECT label, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) AS weight FROM c)
    SELECT o_orderstatus, round(sum(weight), 4) AS weight, count(*) AS n
    FROM orders JOIN w ON o_orderpriority = label GROUP BY 1""")
def weighted_rows(spark, folder):
    """A12 attached to every row."""
    df = P.with_class_weight(table(spark, folder, "orders"), "o_orderpriority")
    return df.groupBy("o_orderstatus").agg(r(F.sum("weight"), 4).alias("weight"),
                                           F.count(F.lit(1)).alias("n"))


@query("SELECT (count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus))::BIGINT AS dummies FROM lineitem")
def dummy_total(spark, folder):
    """A26."""
    return P.dummy_total(table(spark, folder, "lineitem"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in
                          ("customer", "orders", "lineitem", "embeddings", "events")))
def table_counts(spark, folder):
    """A28."""
    return P.table_counts({t: table(spark, folder, t) for t in
                           ("customer", "orders", "lineitem", "embeddings", "events")})


# o_orderkey, o_custkey: id; o_totalprice has no word of its own; status and date by their words
@query("""SELECT * FROM (VALUES ('l_orderkey', 'numeric'), ('l_partkey', 'numeric'), ('l_suppkey', 'numeric'), ('l_linenumber', 'quantity'),
    ('l_quantity', 'quantity'), ('l_extendedprice', 'numeric'), ('l_discount', 'quantity'), ('l_tax', 'rating'),
    ('l_returnflag', 'category'), ('l_linestatus', 'category'), ('l_shipdate', 'date')) t(feature, role)
    WHERE feature NOT IN ('l_suppkey', 'l_partkey', 'l_orderkey')
    UNION ALL SELECT k, CASE WHEN n < 10 AND lo >= 0 AND hi <= 5 THEN 'rating' WHEN lo >= 0 AND hi < 1000 THEN 'quantity' ELSE 'numeric' END
    FROM (SELECT 'l_orderkey' AS k, count(DISTINCT l_orderkey) n, min(l_orderkey) lo, max(l_orderkey) hi FROM lineitem
          UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), min(l_partkey), max(l_partkey) FROM lineitem
          UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey), min(l_suppkey), max(l_suppkey) FROM lineitem)""")
def column_roles(spark, folder):
    """Role of every column by name and value range."""
    df = table(spark, folder, "lineitem")
    return spark.createDataFrame(list(C.column_roles(df).items()), "feature string, role string")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price_text,
    o_custkey::DOUBLE AS customer_text, o_orderstatus AS status FROM orders""")
def numbers_from_text(spark, folder):
    """Loose text to numbers by value, and by whole column."""
    orders = table(spark, folder, "orders")
    loose = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a"))
        .otherwise(F.col("o_totalprice").cast("string")).alias("price_text"),
        F.col("o_custkey").cast("string").alias("customer_text"),
        F.col("o_orderstatus").alias("status"))
    whole = C.numbers_where_whole(loose, ["customer_text", "status"])
    return whole.withColumn("price_text", C.to_number("price_text"))


@query("""WITH m AS (SELECT median(c_acctbal) FILTER (c_custkey % 5 <> 0) AS med FROM customer),
    s AS (SELECT c_mktsegment AS v FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
    SELECT c_custkey, round(CASE WHEN c_custkey % 5 = 0 THEN med ELSE c_acctbal END, 4) AS c_acctbal,
           CASE WHEN c_custkey % 4 = 0 THEN s.v ELSE c_mktsegment END AS c_mktsegment FROM customer, m, s""")
def fill_typical(spark, folder):
    """Median and most frequent value into the gaps."""
    df = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return rounded(C.fill_typical(df), c_acctbal=4)


@query("""SELECT c_custkey, c_acctbal, 0 AS absent, (c_mktsegment = 'BUILDING')::INT AS "cat__c_mktsegment_BUILDING",
    (c_mktsegment = 'MACHINERY')::INT AS "cat__c_mktsegment_MACHINERY", 0 AS "cat__c_region_ASIA" FROM customer""")
def align_features(spark, folder):
    """Exactly the columns a model expects."""
    return C.align_one_hot(table(spark, folder, "customer"), [
        "c_custkey", "c_acctbal", "absent", "cat__c_mktsegment_BUILDING",
        "cat__c_mktsegment_MACHINERY", "cat__c_region_ASIA"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS whole,
    CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice + 0.125 END AS "decimal",
    CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS "text" FROM orders""")
def manual_values(spark, folder):
    """Typed text values as whole number, decimal or text."""
    orders = table(spark, folder, "orders")
    k = F.col("o_orderkey") % 3
    value = (F.when(k == 0, F.col("o_custkey").cast("string"))
             .when(k == 1, (F.col("o_totalprice") + 0.125).cast("string"))
             .otherwise(F.col("o_orderpriority")))
    return orders.select("o_orderkey", C.typed_value(value).alias("v")).select("o_orderkey", "v.*")


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 0""")
def complete_rows(spark, folder):
    """Rows with all numbers and the target known."""
    df = table(spark, folder, "customer").select(
        F.col("c_custkey"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("target"))
    return C.known_target(C.complete_rows(df), "target").drop("target")


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, quarter(o_orderdate)::INT AS q, day(o_orderdate)::INT AS d,
    isodow(o_orderdate)::INT - 1 AS wd, (isodow(o_orderdate) >= 6)::INT AS weekend,
    date_diff('microsecond', o_orderdate, TIMESTAMP '2002-01-01 06:00:00') // 86400000000 AS age, epoch_ns(o_orderdate) AS nanos,
    regexp_replace(o_orderpriority, '[^0-9A-Za-z]', '_', 'g') AS clean, concat_ws(' ', o_orderstatus, o_orderpriority) AS joined,
    round(o_totalprice / nullif(o_orderkey % 5, 0), 4) AS ratio, round(sqrt(abs(o_totalprice - 250000)), 4) AS root,
    o_orderstatus IN ('F', 'O') AS closed, printf('%.4f', o_custkey / 8.0::DOUBLE) AS four, printf('%.2f%%', (o_custkey % 8) / 8.0::DOUBLE * 100) AS pct,
    round(list_avg([CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END, CASE WHEN o_orderkey % 2 > 0 THEN o_orderkey END]), 4) AS mean,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE -1 END AS code FROM orders""")
def scalar_functions(spark, folder):
    """X1-X6, X10-X18 on every order."""
    day, key, cust = F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_custkey")
    means = [F.when(key % 3 > 0, cust.cast("double")), F.when(key % 2 > 0, key.cast("double"))]
    return table(spark, folder, "orders").select(
        "o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.quarter(day).alias("q"), F.dayofmonth(day).alias("d"),
        F.weekday(day).alias("wd"), X.weekend(day).alias("weekend"),
        X.whole_days(day, F.lit("2002-01-01 06:00:00").cast("timestamp_ntz")).alias("age"), X.epoch_nanos(day).alias("nanos"),
        X.clean_name(F.col("o_orderpriority")).alias("clean"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("joined"),
        r(X.safe_ratio(F.col("o_totalprice"), key % 5), 4).alias("ratio"),
        r(F.sqrt(F.abs(F.col("o_totalprice") - 250000)), 4).alias("root"), F.col("o_orderstatus").isin("F", "O").alias("closed"),
        X.four_decimals(cust / 8).alias("four"), X.percent_text((cust % 8) / 8).alias("pct"), r(X.row_mean(means), 4).alias("mean"),
        X.category_code(F.col("o_orderstatus"), ["F", "P"]).alias("code"))


@query("""SELECT o_orderkey, date_diff('microsecond', o_orderdate, TIMESTAMP '2002-01-01') // 86400000000 AS o_orderdate_days_since,
    (o_orderstatus = 'F')::INT AS "o_orderstatus_F", (o_orderstatus = 'O')::INT AS "o_orderstatus_O", (o_orderstatus = 'P')::INT AS "o_orderstatus_P" FROM orders""")
def days_and_dummies(spark, folder):
    """Dates as days up to a reference, dummies for the rest, ids dropped."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return dummies(days_since(orders, "2002-01-01", ["o_custkey"]), ["o_orderstatus"])


@query("""SELECT count(*) AS rows, 6 AS columns, 'o_custkey:bigint o_orderdate:timestamp_ntz' AS kinds, count(*) FILTER (o_orderkey % 10 = 0) AS missing FROM orders""")
def describe_table(spark, folder):
    """Shape, types and missing values."""
    orders = table(spark, folder, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")))
    about = P.describe(orders)
    kinds = " ".join(f"{c}:{about['types'][c]}" for c in ("o_custkey", "o_orderdate"))
    return spark.createDataFrame([(about["rows"], about["columns"], kinds, about["missing"]["o_totalprice"])],
                                 "rows bigint, columns int, kinds string, missing bigint")
