"""Correlation, chi-square, mutual information and screening."""

from pyspark.sql import functions as F

from tabloom.operators import association as A
from tabloom.operators import screening as S
from tabloom.operators.neighbours import neighbour_information
from tabloom.queries.base import query, r, rounded, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "disc_price", "charge"]
PRICED = """(SELECT *, l_extendedprice * (1 - l_discount) AS disc_price,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"""


def priced(spark, folder):
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, folder, "lineitem").withColumns(
        {"disc_price": disc, "charge": disc * (1 + F.col("l_tax"))})


def pairs_sql(columns, name):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", abs(corr({a}, {b})) AS correlation FROM {name}"
        for i, a in enumerate(columns) for b in columns[i + 1:])


@query(f"""SELECT "left", "right", round(correlation, 6) AS correlation FROM ({pairs_sql(NUMBERS, PRICED)})""")
def corr_matrix(spark, folder):
    """A13."""
    return rounded(A.correlation_pairs(priced(spark, folder), NUMBERS), correlation=6)


DERIVED = 200


@query(f"""WITH v AS (SELECT p_partkey, k, (p_partkey * (7 * k + 3) % (k + 11) + p_size * (k % 5) + p_retailprice * (k % 3))::DOUBLE AS x
        FROM part, range({DERIVED}) r(k) WHERE (p_partkey + k) % 7 <> 0)
    SELECT 'c' || a.k AS "left", 'c' || b.k AS "right", round(abs(corr(a.x, b.x)), 6) AS correlation
    FROM v a JOIN v b ON a.p_partkey = b.p_partkey AND a.k < b.k GROUP BY a.k, b.k""")
def corr_wide(spark, folder):
    """All pairs of 200 columns with gaps, in one scan."""
    part = table(spark, folder, "part")
    value = "CASE WHEN (p_partkey + {k}) % 7 <> 0 THEN p_partkey * (7 * {k} + 3) % ({k} + 11) + p_size * ({k} % 5) + p_retailprice * ({k} % 3) END"
    df = part.select(*[F.expr(value.format(k=k)).alias(f"c{k}") for k in range(DERIVED)])
    return rounded(A.correlation_pairs(df, df.columns), correlation=6)


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, l_quantity), 6) AS correlation FROM {PRICED}" for c in NUMBERS[1:]))
def corr_target(spark, folder):
    """A14."""
    return rounded(A.target_correlation(priced(spark, folder), NUMBERS[1:], "l_quantity"), correlation=6)


@query(f"""WITH RECURSIVE p AS (SELECT * FROM ({pairs_sql(NUMBERS[1:], PRICED)}) WHERE correlation >= 0.85),
    t AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, abs(corr({c}, l_quantity)) AS y FROM {PRICED}" for c in NUMBERS[1:])}),
    o AS (SELECT row_number() OVER (ORDER BY correlation DESC, "left", "right") AS i, "left" AS a, "right" AS b,
                 correlation, (SELECT y FROM t WHERE c = "left") >= (SELECT y FROM t WHERE c = "right") AS keep_left FROM p),
    s AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS gone, NULL::VARCHAR AS feature, NULL::VARCHAR AS kept, NULL::DOUBLE AS correlation
          UNION ALL
          SELECT o.i, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone
                           ELSE list_append(gone, CASE WHEN keep_left THEN b ELSE a END) END,
                 CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN NULL
                      WHEN keep_left THEN b ELSE a END,
                 CASE WHEN keep_left THEN a ELSE b END, o.correlation
          FROM s JOIN o ON o.i = s.i + 1)
    SELECT feature, kept, round(correlation, 6) AS correlation FROM s WHERE feature IS NOT NULL""")
def greedy_corr_drop(spark, folder):
    """A15, T3."""
    df = priced(spark, folder)
    columns = NUMBERS[1:]
    with_target = {x["feature"]: x["correlation"] for x in
                   A.target_correlation(df, columns, "l_quantity").collect()}
    gone = A.greedy_correlated_drop(A.correlation_pairs(df, columns), with_target)
    return spark.createDataFrame([(f, k, round(v, 6)) for f, k, v in gone],
                                 "feature string, kept string, correlation double")


PARTS = {"o_orderdate_year": "year(o_orderdate)", "o_orderdate_month": "month(o_orderdate)",
         "o_orderdate_day": "day(o_orderdate)", "o_orderdate_dayofweek": "isodow(o_orderdate) - 1"}
CROSSTAB = " UNION ALL ".join(
    f"SELECT '{p}' AS part, ({e})::INT AS value, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL"
    for p, e in PARTS.items())


@query(CROSSTAB)
def temporal_crosstab(spark, folder):
    """A16."""
    return A.part_crosstab(table(spark, folder, "orders"), "o_orderdate", "o_orderpriority")


@query(f"""WITH c AS ({CROSSTAB}),
    e AS (SELECT part, value, label, n, sum(n) OVER (PARTITION BY part, value)::DOUBLE AS rn,
                 sum(n) OVER (PARTITION BY part, label)::DOUBLE AS cn, sum(n) OVER (PARTITION BY part)::DOUBLE AS total FROM c),
    s AS (SELECT part, max(total) * (sum(n * n / (rn * cn)) - 1) AS chi2,
                 (count(DISTINCT value) - 1) * (count(DISTINCT label) - 1) AS dof FROM e GROUP BY part)
    SELECT part, round(chi2, 4) AS chi2, dof FROM s""")
def temporal_chi2(spark, folder):
    """A17."""
    found = A.temporal_chi_square(table(spark, folder, "orders"), "o_orderdate", "o_orderpriority")
    return rounded(found, chi2=4)


@query(" UNION ALL ".join(f"SELECT '{p}' AS feature, round(corr({e}, o_totalprice), 6) AS correlation FROM orders"
                          for p, e in PARTS.items()))
def temporal_corr(spark, folder):
    """A18, X1, X2."""
    found = A.temporal_correlation(table(spark, folder, "orders"), "o_orderdate", "o_totalprice")
    return rounded(found, correlation=6)


JOINED = """(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, c_nationkey, c_acctbal, c_mktsegment,
    CASE WHEN o_totalprice > 400000 THEN 'big' WHEN o_totalprice > 100000 THEN 'usual' ELSE 'small' END AS size_class,
    CASE WHEN o_totalprice < 150000 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_cheap FROM orders JOIN customer ON o_custkey = c_custkey)"""


def joined(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customer = table(spark, folder, "customer").drop("c_name")
    size = (F.when(F.col("o_totalprice") > 400000, "big").when(F.col("o_totalprice") > 100000, "usual")
            .otherwise("small"))
    return (orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
            .withColumn("size_class", size)
            .withColumn("is_cheap", (F.col("o_totalprice") < 150000).cast("double")))


def mi_sql(columns: dict[str, bool], target: str, target_numeric: bool, name: str, bins: int = 20) -> str:
    """Plug-in mutual information; numbers are cut at their quantiles."""
    shares = "[" + ", ".join(f"{i / bins!r}::DOUBLE" for i in range(bins + 1)) + "]"

    def code(c, numeric):
        if not numeric:
            return f"coalesce({c}::VARCHAR, '?')"
        return f"(SELECT greatest(len(list_filter(e, lambda x: x < {c}::DOUBLE)), 1) FROM (SELECT list_distinct(quantile_cont({c}::DOUBLE, {shares})) AS e FROM d) q)::VARCHAR"
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {code(c, numeric)} AS x, {code(target, target_numeric)} AS y FROM d WHERE {target} IS NOT NULL"
        for c, numeric in columns.items())
    return f"""WITH d AS (SELECT * FROM {name}), t AS ({parts}),
        xy AS (SELECT feature, x, y, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
        fx AS (SELECT feature, x, sum(n) AS n FROM xy GROUP BY ALL), fy AS (SELECT feature, y, sum(n) AS n FROM xy GROUP BY ALL),
        a AS (SELECT feature, sum(n * ln(n)) AS v, sum(n) AS total FROM xy GROUP BY 1),
        b AS (SELECT feature, sum(n * ln(n)) AS v FROM fx GROUP BY 1), c AS (SELECT feature, sum(n * ln(n)) AS v FROM fy GROUP BY 1)
        SELECT feature, greatest(ln(total) + (a.v - b.v - c.v) / total, 0) AS mutual_info
        FROM a JOIN b USING (feature) JOIN c USING (feature)"""


# numbers with few values, as ``is_cheap``, count as categories
MI_COLUMNS = {"is_cheap": False, "o_orderstatus": False, "o_totalprice": True, "o_orderpriority": False, "c_nationkey": True,
              "c_acctbal": True, "c_mktsegment": False}


@query(f"""WITH m AS ({mi_sql(MI_COLUMNS, 'size_class', False, JOINED)})
    SELECT feature, round(mutual_info, 5) AS mutual_info, round(mutual_info / (SELECT max(mutual_info) FROM m), 5) AS normalized FROM m""")
def mutual_info(spark, folder):
    """A19."""
    scored = A.mutual_information(joined(spark, folder), list(MI_COLUMNS), "size_class",
                                  ["is_cheap", *[c for c, numeric in MI_COLUMNS.items() if numeric]])
    return rounded(A.normalized(scored), mutual_info=5, normalized=5)


LEAK = {"is_cheap": False, "o_orderstatus": False, "o_orderpriority": False, "c_mktsegment": False, "o_orderkey": True,
        "o_custkey": True, "o_totalprice": True, "c_nationkey": True, "c_acctbal": True}


NEAR_COLUMNS = ["o_totalprice", "is_cheap", "o_custkey", "c_nationkey", "c_acctbal"]


def neighbours_sql(columns, target, name, k=3):
    """Neighbours by lag and lead within the class, counts of nearer rows by running sums, digamma by harmonic numbers."""
    tall = " UNION ALL ".join(f"SELECT '{c}' AS feature, {target} AS y, {c}::DOUBLE AS x FROM {name}" for c in columns)
    reach = ", ".join(f"greatest(x - lag(x, {j}) OVER w, lead(x, {k - j}) OVER w - x)" if 0 < j < k
                      else f"lead(x, {k}) OVER w - x" if j == 0 else f"x - lag(x, {k}) OVER w" for j in range(k + 1))
    # greatest() skips NULL, so a side without enough rows is ruled out by asking for its outermost row
    known = ", ".join(f"CASE WHEN lag(x, {j}) OVER w IS NOT NULL AND lead(x, {k - j}) OVER w IS NOT NULL THEN 1 END" for j in range(k + 1))
    return f"""WITH t AS ({tall}),
        d AS (SELECT feature, y, x, count(*) OVER (PARTITION BY feature, y) AS size, [{reach}] AS reach, [{known}] AS known
              FROM t WINDOW w AS (PARTITION BY feature, y ORDER BY x)),
        v AS (SELECT feature, y, x, size, list_min([CASE WHEN known[i] = 1 THEN reach[i] END FOR i IN range(1, {k + 2})]) AS r FROM d),
        g AS (SELECT feature, y, x, size, r, count(*) AS n FROM v GROUP BY ALL),
        c AS (SELECT feature, x, sum(count(*)) OVER (PARTITION BY feature ORDER BY x) AS upto, count(*) AS here FROM t GROUP BY feature, x),
        e AS (SELECT g.*, coalesce(a.upto, 0) AS high FROM g ASOF LEFT JOIN c a ON g.feature = a.feature AND g.x + g.r > a.x),
        f AS (SELECT e.*, coalesce(b.upto, 0) AS low FROM e ASOF LEFT JOIN c b ON e.feature = b.feature AND e.x - e.r >= b.x),
        m AS (SELECT f.*, CASE WHEN r = 0 THEN c.here ELSE high - low END AS within FROM f JOIN c USING (feature, x)),
        h AS (SELECT i, -0.5772156649015329 + coalesce(sum(CASE WHEN i > 1 THEN 1.0::DOUBLE / (i - 1) END) OVER (ORDER BY i), 0) AS psi
              FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM {name}))) AS i))
        SELECT feature, greatest((SELECT psi FROM h WHERE i = (SELECT count(*) FROM {name}))
            + sum(n * (z.psi - s.psi - w.psi)) / sum(n), 0) AS mutual_info
        FROM m JOIN h z ON z.i = CASE WHEN r = 0 THEN m.n ELSE {k} END JOIN h s ON s.i = m.size JOIN h w ON w.i = m.within GROUP BY feature"""


@query(f"SELECT feature, round(mutual_info, 6) AS mutual_info FROM ({neighbours_sql(NEAR_COLUMNS, 'size_class', JOINED)})")
def mutual_info_neighbours(spark, folder):
    """By nearest neighbours, no bins."""
    return rounded(neighbour_information(joined(spark, folder), NEAR_COLUMNS, "size_class"), mutual_info=6)


@query(f"""SELECT feature, round(mutual_info, 5) AS score, 'mutual_info' AS measure
    FROM ({mi_sql(LEAK, 'size_class', False, JOINED)}) WHERE mutual_info > 0.4""")
def leakage_report(spark, folder):
    """A21 for a class target."""
    return rounded(S.leaky_features(joined(spark, folder), "size_class"), score=5)


@query(f"""SELECT * FROM ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 5) AS score, 'correlation' AS measure FROM {PRICED}"
    for c in ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_discount', 'l_tax', 'disc_price', 'charge'])})
    WHERE score > 0.8 UNION ALL
    SELECT feature, round(mutual_info, 5), 'mutual_info' FROM ({mi_sql({'l_returnflag': False, 'l_linestatus': False}, 'l_extendedprice', True, PRICED)})
    WHERE mutual_info > 0.4""")
def leakage_numeric(spark, folder):
    """A21 for a numeric target."""
    return rounded(S.leaky_features(priced(spark, folder), "l_extendedprice"), score=5)


SCREENED = """(SELECT l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
    floor(l_extendedprice / 1000) AS price_k, floor(l_extendedprice * (1 - l_discount) / 1000) AS disc_k,
    floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000) AS charge_k,
    1 AS fixed, NULL::DOUBLE AS empty, CASE WHEN l_linenumber = 1 THEN l_tax END AS sparse,
    l_orderkey * 100000 + l_partkey AS line_id FROM lineitem)"""
SCREENED_COLUMNS = ["l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "price_k",
                    "disc_k", "charge_k", "fixed", "empty", "sparse", "line_id"]
SCREENED_NUMBERS = ["l_linenumber", "l_discount", "l_tax", "price_k", "disc_k", "charge_k"]


def screened_lines(spark, folder):
    price = F.col("l_extendedprice")
    disc = price * (1 - F.col("l_discount"))
    return table(spark, folder, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.floor(price / 1000).alias("price_k"), F.floor(disc / 1000).alias("disc_k"),
        F.floor(disc * (1 + F.col("l_tax")) / 1000).alias("charge_k"), F.lit(1).alias("fixed"),
        F.lit(None).cast("double").alias("empty"),
        F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("sparse"),
        (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("line_id"))


@query(f"""WITH RECURSIVE d AS (SELECT * FROM {SCREENED}),
    f AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS k, count(*) AS n, count(*) - count({c}) AS m FROM d" for c in SCREENED_COLUMNS)}),
    first AS (SELECT feature, CASE WHEN k + (m > 0)::INT <= 1 THEN 'constant' WHEN k::DOUBLE / n > 0.9 THEN 'id_like'
                              WHEN m::DOUBLE / n > 0.5 THEN 'null_heavy' END AS reason FROM f),
    p AS (SELECT * FROM ({pairs_sql(SCREENED_NUMBERS, 'd')}) WHERE correlation >= 0.85),
    t AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, abs(corr({c}, l_quantity)) AS y FROM d" for c in SCREENED_NUMBERS)}),
    o AS (SELECT row_number() OVER (ORDER BY correlation DESC, "left", "right") AS i, "left" AS a, "right" AS b,
                 (SELECT y FROM t WHERE c = "left") >= (SELECT y FROM t WHERE c = "right") AS keep_left FROM p),
    s AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS gone
          UNION ALL
          SELECT o.i, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone
                           ELSE list_append(gone, CASE WHEN keep_left THEN b ELSE a END) END
          FROM s JOIN o ON o.i = s.i + 1)
    SELECT feature, reason FROM first WHERE reason IS NOT NULL
    UNION ALL SELECT unnest(gone), 'high_correlation' FROM (SELECT gone FROM s ORDER BY i DESC LIMIT 1)""")
def screen_report(spark, folder):
    """Which columns would be dropped, and why."""
    return S.screen_features(screened_lines(spark, folder), "l_quantity").report().select("feature", "reason")
