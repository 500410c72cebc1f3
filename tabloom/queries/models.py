"""Measures, training and scoring on the star tables."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.functions import fixed_values as V
from tabloom.functions.scalars import named
from tabloom.operators.fitted import FeatureTransformer
from tabloom.plans import classify, cluster, metrics, prepare, regress, score
from tabloom.plans import models as M
from tabloom.queries.associations import joined
from tabloom.queries.base import cut_sql, query, r, rounded, table
from tabloom.queries.encoding import hash_sql
from tabloom.queries.fitted import SHARES, numeric_sql
from tabloom.queries.features import stats_cte
from tabloom.session import work_folder
from tabloom.streaming import score as streaming

RULE = "CASE WHEN length(text) > 2000 THEN 1 WHEN length(text) > 300 THEN quality ELSE 0 END"


def ruled(spark, folder):
    """Labels beside the class and the score of a rule on the whole text."""
    size = F.length("text")
    rule = F.when(size > 2000, 1).when(size > 300, F.col("quality")).otherwise(0)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return table(spark, folder, "labels").join(docs, "doc_id").select(
        "doc_id", "quality", "toxic", rule.alias("rule"), (size % 97).alias("score"))


@query(f"""WITH d AS (SELECT quality AS y, {RULE} AS p FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT DISTINCT y AS k FROM d UNION SELECT DISTINCT p FROM d),
    m AS (SELECT k, count(*) FILTER (y = k) AS support, count(*) FILTER (p = k) AS predicted, count(*) FILTER (y = k AND p = k) AS hits FROM d, c GROUP BY 1),
    s AS (SELECT k AS class, CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS re, support FROM m)
    SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, support FROM s""")
def confusion_report(spark, folder):
    """Precision, recall, F1 and support per class."""
    found = metrics.class_report(metrics.confusion(ruled(spark, folder), "quality", "rule"))
    return rounded(found, precision=6, recall=6, f1=6)


@query("""SELECT round(1 - sum((o_totalprice - p) ** 2) / (var_pop(o_totalprice) * count(*)), 6) AS r2 FROM (
    SELECT o_totalprice, 10 * o_custkey + 250000 AS p FROM orders)""")
def r2_of_rule(spark, folder):
    """L21."""
    df = table(spark, folder, "orders").select("o_totalprice", (10 * F.col("o_custkey") + 250000).alias("p"))
    return rounded(metrics.r2(df, "o_totalprice", "p"), r2=6)


@query("""WITH d AS (SELECT quality AS y, length(text) % 97 AS s FROM labels JOIN documents USING (doc_id)),
    g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY 1),
    c AS (SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
    SELECT round((sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)))::DOUBLE, 6) AS auc FROM c""")
def auc_of_score(spark, folder):
    """Area under the ROC curve, ties counted half."""
    area = metrics.binary_auc(ruled(spark, folder), F.col("quality"), F.col("score"))
    return spark.createDataFrame([(round(area, 6),)], "auc double")


SIX = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS b, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS s FROM customer),
    f AS (SELECT c_custkey, coalesce(b, (SELECT median(b) FROM d)) AS b, coalesce(s, (SELECT s FROM d WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1)) AS s FROM d),
    t AS (SELECT avg(b) AS m, stddev_pop(b) AS sd FROM f)
    SELECT c_custkey, round((b - m) / sd, 5) AS "num__b", """ + ", ".join(f"""(s = '{v}')::INT::DOUBLE AS "cat__s_{v}\"""" for v in SIX) + " FROM f, t")
def preprocess(spark, folder):
    """Imputed, scaled and one-hot encoded columns of a fitted pipeline."""
    df = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("b"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("s"))
    prep = prepare.create_preprocessor(df, ["b"], ["s"])
    array = vector_to_array("features")
    made = prep.transform(df).select("c_custkey", *[array[i].alias(n) for i, n in enumerate(prep.feature_names)])
    return rounded(made, num__b=5)


@query("""WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part))
    SELECT p_partkey, (p_type = 'ECONOMY')::INT::DOUBLE AS economy, i::DOUBLE AS brand FROM part JOIN k USING (p_brand)""")
def preprocess_wide(spark, folder):
    """Narrow columns one-hot, wide ones by position."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    prep = prepare.fallback_preprocessor(part.drop("p_partkey"), "p_size")
    names, array = prep.feature_names, vector_to_array("features")
    return prep.transform(part).select(
        "p_partkey", array[names.index("cat__p_type_ECONOMY")].alias("economy"),
        array[names.index("cat_high__p_brand")].alias("brand"))


@query(f"""WITH m AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd FROM part),
    d AS (SELECT p_partkey, (p_retailprice - m) / sd AS price, p_type FROM part, m), {stats_cte(['price'], 'd', SHARES)}
    SELECT p_partkey, round(price, 5) AS scaled, {cut_sql('price', ['price_min', 'price_q[1]', 'price_q[3]', 'price_q[5]', 'price_max'], V.QUARTERS, True)} AS category,
           (p_type = 'ECONOMY')::INT::DOUBLE AS economy FROM d, s""")
def prepared_features(spark, folder):
    """features generated after imputing, scaling and one-hot encoding."""
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_type")
    fitted = prepare.PreparedFeatures().fit(part.drop("p_partkey"), target_only=True)
    made = fitted.transform(part, keep=["p_partkey"])
    return made.select("p_partkey", r(F.col("num__p_retailprice"), 5).alias("scaled"),
                       F.col("num__p_retailprice_category").alias("category"), F.col("cat__p_type_ECONOMY").alias("economy"))


def order_facts(spark, folder):
    """Orders with their customer; the target leans on price and balance."""
    df = joined(spark, folder).drop("o_custkey", "size_class", "is_cheap")
    worth = F.col("o_totalprice") + 30 * F.col("c_acctbal")
    noise = (F.col("o_orderkey") * 7919) % 150000
    return df.withColumn("target", F.when(worth + noise > 500000, "high").otherwise("usual"))


TWO = "CASE WHEN o_totalprice + 30 * c_acctbal + (o_orderkey * 7919) % 150000 > 500000 THEN 'high' ELSE 'usual' END"
THREE = "CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice > 150000 THEN 'mid' ELSE 'small' END"


def support_sql(target: str, models: list[str]) -> str:
    """Held-out rows per model and class: the split is decided by the MD5 of the key."""
    names = ", ".join(f"'{m}'" for m in models)
    return f"""WITH f AS (SELECT o_orderkey, {target} AS class FROM orders JOIN customer ON o_custkey = c_custkey),
    h AS (SELECT class, md5(o_orderkey::VARCHAR || ':42') AS h, {hash_sql('o_orderkey')} AS u FROM f),
    e AS (SELECT class, min(h) AS a, max(h) AS b FROM h GROUP BY 1)
    SELECT model, class, count(*)::DOUBLE AS support, true AS sound FROM h JOIN e USING (class), (SELECT unnest([{names}]) AS model)
    WHERE CASE WHEN a < b AND h = a THEN true WHEN a < b AND h = b THEN false ELSE u < 0.2 END GROUP BY 1, 2"""


def supports(spark, trained):
    """Rows per model and class; sound if all measures are shares and the model is about as good as the largest class."""
    rows = metrics.report_rows(spark, trained.results, trained.labels)
    each = rows.where("class IS NOT NULL").groupBy("model", "class").pivot("metric", ["precision", "recall", "f1", "support"]).agg(F.first("value"))
    accuracy = rows.where("metric = 'accuracy'").select("model", F.col("value").alias("accuracy"))
    total = each.groupBy("model").agg(F.sum("support").alias("total"), F.max("support").alias("largest"))
    shares = F.least("precision", "recall", "f1") >= 0, F.greatest("precision", "recall", "f1") <= 1
    good = F.col("accuracy").between(0.9 * F.col("largest") / F.col("total"), 1.0)
    return each.join(accuracy, "model").join(total, "model").select("model", "class", "support", (shares[0] & shares[1] & good).alias("sound"))


@query(support_sql(TWO, ["LogisticRegression", "RandomForest", "GradientBoosting"]))
def train_classifier(spark, folder):
    """Leaking columns dropped, the quick models compared on held-out orders."""
    t = classify.train_classification(order_facts(spark, folder), "target", key="o_orderkey",
                                      models=M.quick_models(), threshold=2.0)
    return supports(spark, t)


@query(support_sql(TWO, ["VotingClassifier", "BaggingClassifier", "AdaBoostClassifier", "RF_FeatureSelection", "RFE_LogisticRegression"]))
def train_ensembles(spark, folder):
    """Voting, bagging, boosting by weights, forest selection and elimination."""
    chosen = {
        "VotingClassifier": M.soft_vote([M.of(M.logistic), M.of(lambda s: M.forest(s, 50, 10))]),
        "BaggingClassifier": M.of(lambda s: M.bagged_trees(20).setMaxDepth(10)),
        "AdaBoostClassifier": M.ada_boost(rounds=12),
        "RF_FeatureSelection": M.forest_selected(),
        "RFE_LogisticRegression": M.recursive_elimination(13)}
    t = classify.train_classification(order_facts(spark, folder), "target", key="o_orderkey", drop_leaky=False,
                                      models=chosen, threshold=2.0)
    return supports(spark, t)


@query(support_sql(THREE, ["GradientBoosting", "OVR_LogisticRegression"]))
def train_multiclass(spark, folder):
    """More than two classes, boosted trees and regressions one against the rest."""
    df = order_facts(spark, folder).drop("target").withColumn(
        "target", F.when(F.col("o_totalprice") > 400000, "large").when(F.col("o_totalprice") > 150000, "mid").otherwise("small"))
    chosen = {"GradientBoosting": M.of(lambda s: M.boosted(s, 10, 4)),
              "OVR_LogisticRegression": M.of(lambda s: M.create_fresh_model("OVR_LogisticRegression", s))}
    t = classify.train_classification(df, "target", key="o_orderkey", drop_leaky=False, models=chosen, threshold=2.0)
    return supports(spark, t)


@query(support_sql(THREE, ["LogisticRegression", "OVR_LogisticRegression"]))
def search_parameters(spark, folder):
    """Random search with three folds."""
    df = order_facts(spark, folder).withColumn("target", F.expr(THREE))
    t = classify.train_classification(df, "target", key="o_orderkey", drop_leaky=False, threshold=2.0, search=M.Search(draws=3),
                                      models={"LogisticRegression": None, "OVR_LogisticRegression": None})
    return supports(spark, t)


@query("SELECT 5::BIGINT AS n, true AS falling, true AS shares")
def feature_importances(spark, folder):
    """Five strongest source columns of a forest."""
    t = classify.train_classification(order_facts(spark, folder), "target", key="o_orderkey", drop_leaky=False,
                                      models={"RandomForest": M.of(M.forest)})
    found = [r["importance"] for r in t.importance_table(spark, 5).collect()]
    whole = sum(t.importance.values())
    return spark.createDataFrame([(len(found), found == sorted(found, reverse=True), 0 < found[0] <= 1 and abs(whole - 1) < 1e-6)],
                                 "n bigint, falling boolean, shares boolean")


@query("SELECT o_orderkey, true AS known, true AS same, true AS bounded FROM orders JOIN customer ON o_custkey = c_custkey")
def score_classifier(spark, folder):
    """Trained, saved, loaded and applied to every order."""
    df = order_facts(spark, folder)
    t = classify.train_classification(df, "target", key="o_orderkey", drop_leaky=False,
                                      models={"LogisticRegression": M.of(M.logistic)})
    path = work_folder(spark, "models")
    t.save(spark, f"{path}/target")
    held = classify.load_trained(spark, f"{path}/target")
    scored = score.predict_classification(df.drop("target"), held, "orders")
    return scored.select("o_orderkey", F.col("predicted_target").isin("high", "usual").alias("known"), (
        (F.col("predicted_target") == F.col("predicted_orders")) & (F.col("predicted_target") == F.col("predicted_y"))).alias("same"),
        F.col("probability").between(0.5, 1.0).alias("bounded"))


@query("""SELECT o_orderkey, 'classification' AS type, 'target' AS target_variable, true AS known, true AS bounded, 'high,usual' AS classes
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def score_records(spark, folder):
    """Result records with all classes and probabilities."""
    df = order_facts(spark, folder)
    t = classify.train_classification(df, "target", key="o_orderkey", drop_leaky=False,
                                      models={"LogisticRegression": M.of(M.logistic)})
    made = score.make_predictions(df.drop("target"), t)
    return made.select("o_orderkey", "result.type", "result.target_variable", F.array_contains("result.all_classes", F.col("result.prediction")).alias("known"),
                       F.col("result.probability").cast("double").between(50, 100).alias("bounded"), F.array_join("result.all_classes", ",").alias("classes"))


@query("""SELECT l_quantity, count(*) AS n, true AS ordered FROM lineitem GROUP BY 1""")
def train_regressor(spark, folder):
    """Line price from all its other columns, predicted for every line."""
    lines = table(spark, folder, "lineitem")
    df = lines.withColumn("key", F.xxhash64(*[named(c) for c in lines.columns]))
    chosen = regress.regressors(df.count(), trees=20)
    t = regress.train_regression(df, "l_extendedprice", key="key", models=chosen)
    scored = score.predict_regression(lines.drop("l_extendedprice"), t)
    return scored.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), (F.min("prediction") <= F.max("prediction")).alias("ordered"))


@query("""SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + 10 * l_quantity::BIGINT AS prediction FROM lineitem""")
def regress_dates(spark, folder):
    """A target linear in the date, learnt, stored, loaded and predicted from the raw table."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    days = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    df = lines.select("l_quantity", "l_shipdate", (days + 10 * F.col("l_quantity")).cast("double").alias("due"),
                      F.xxhash64("l_orderkey", "l_linenumber").alias("key"))
    t = regress.train_regression(df, "due", key="key", models={"Ridge Regression": regress.ridge(1, alpha=0.0)})
    path = work_folder(spark, "regressor")
    t.save(spark, path)
    scored = score.predict_regression(lines, classify.load_trained(spark, path))
    return scored.select("l_orderkey", "l_linenumber", F.round("prediction").cast("bigint").alias("prediction"))


@query("""WITH s AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem) SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 3) AS intercept FROM s""")
def linear_fit(spark, folder):
    """An unpenalised linear fit, which SQL can repeat."""
    df = table(spark, folder, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    ready = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(df)
    fitted = regress.ridge(1, alpha=0.0).fit(ready)
    return spark.createDataFrame([(round(float(fitted.coefficients[0]), 4), round(fitted.intercept, 3))], "slope double, intercept double")


def vectors(spark, folder):
    """Every component of the embeddings as a column."""
    parts = table(spark, folder, "embeddings")
    size = parts.agg(F.max(F.size("embedding"))).first()[0]
    return parts.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)])


@query("""SELECT k, CASE WHEN k = 1 THEN (SELECT (max(len(embedding)) * count(*))::DOUBLE FROM embeddings) END AS closed_form, true AS falls, true AS bounded
    FROM (SELECT unnest(range(1, 21))::INTEGER AS k)""")
def kmeans_choice(spark, folder):
    """Cost, silhouette and Davies-Bouldin for up to twenty clusters from ten starts each, and the choice of each.

    The cost of one cluster of scaled columns is rows times columns; more clusters never cost more.
    """
    df = vectors(spark, folder).drop("vec_id", "label")
    prep = prepare.build_preprocessor(df, None, impute="mean")
    ready = prep.transform(df).select("features").persist()
    scan = cluster.scan_clusters(ready)
    ready.unpersist()
    rows = []
    for k in sorted(scan.cost):
        falls = k == 1 or scan.cost[k] <= scan.cost[k - 1] * 1.001
        bounded = k == 1 or -1 <= scan.silhouette[k] <= 1 and scan.davies_bouldin[k] > 0
        rows.append((k, round(scan.cost[k], 3) if k == 1 else None, falls, bounded and all(scan.best(m) in scan.cost for m in cluster.METHODS)))
    return spark.createDataFrame(rows, "k int, closed_form double, falls boolean, bounded boolean")


@query("""SELECT label, count(*) AS n, true AS known FROM embeddings GROUP BY 1""")
def score_clusters(spark, folder):
    """Cluster of every vector, counted per label."""
    df = vectors(spark, folder)
    t = cluster.train_clustering(df.drop("vec_id", "label"), n_clusters=4)
    scored = score.predict_clustering(df, t)
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("cluster").between(0, 3)).alias("known"))


DB = """WITH v AS (SELECT vec_id, label AS c, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT c, i, avg(x) AS a FROM v GROUP BY 1, 2),
    d AS (SELECT vec_id, v.c, sqrt(sum((x - a) ** 2)) AS d FROM v JOIN m ON v.c = m.c AND v.i = m.i GROUP BY 1, 2),
    s AS (SELECT c, avg(d) AS s FROM d GROUP BY 1),
    g AS (SELECT x.c, y.c AS o, sqrt(sum((x.a - y.a) ** 2)) AS gap FROM m x JOIN m y ON x.i = y.i AND x.c <> y.c GROUP BY 1, 2),
    p AS (SELECT g.c, max((sx.s + sy.s) / gap) AS worst FROM g JOIN s sx ON sx.c = g.c JOIN s sy ON sy.c = g.o GROUP BY 1)
    SELECT round(avg(worst), 5) AS davies_bouldin FROM p"""


@query(DB)
def davies_bouldin(spark, folder):
    """L25 with the labels as clusters."""
    df = vectors(spark, folder)
    names = [c for c in df.columns if c not in ("vec_id", "label")]
    means = df.groupBy("label").agg(*[F.avg(n).alias(n) for n in names]).orderBy("label").collect()
    centres = [[row[n] for n in names] for row in means]
    value = cluster.davies_bouldin(df, "label", F.array(*names), centres)
    return spark.createDataFrame([(round(value, 5),)], "davies_bouldin double")


@query("SELECT unnest(['o_orderstatus', 'o_orderpriority', 'c_mktsegment']) AS target_variable, true AS bounded")
def categorical_models(spark, folder):
    """Every categorical column of orders with their customers predicted from the other ones."""
    df = joined(spark, folder).select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment")
    made = classify.predict_categorical(df, depth=10, key="o_orderkey")
    return made.select("target_variable", F.col("accuracy").between(0, 1).alias("bounded"))


@query("SELECT count(*) AS n, true AS known FROM orders")
def derived_target(spark, folder):
    """Features generated, one derived class learnt, every order scored."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    fitted = FeatureTransformer(target_only=True).fit(orders.select("o_totalprice"))
    made = fitted.transform(orders)
    target = next(c for c in fitted.generated_columns if c.endswith("_category"))
    df = made.select("o_orderkey", "o_custkey", "o_totalprice", target)
    t = classify.train_classification(df, target, key="o_orderkey", drop_leaky=False,
                                      models={"RandomForest": M.of(lambda s: M.forest(s, 50, 10))})
    scored = score.predict_with_class_columns(df.drop(target, "o_custkey"), t)
    total = sum((F.col(f"probability_{v}") for v in t.labels), F.lit(0.0))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.bool_and(named(f"predicted_{target}").isin(*t.labels) & (F.abs(total - 1) < 1e-6)).alias("known"))


@query(f"""WITH {stats_cte(['o_totalprice'], 'orders', SHARES)} SELECT o_orderkey, {numeric_sql('o_totalprice')} FROM orders, s""")
def stream_features(spark, folder):
    """Fitted features over a file stream give what the batch gives."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    fitted = FeatureTransformer(target_only=True).fit(orders.select("o_totalprice"))
    fitted.features = [f for f in fitted.features if f.kind not in ("tier", "price_strategy")]
    source, output = work_folder(spark, "incoming"), work_folder(spark, "scored")
    orders.repartition(3).write.parquet(source)
    stream = streaming.read_stream(spark, source, "o_orderkey bigint, o_totalprice double", files_per_batch=1)
    streaming.run_to_end(streaming.feature_scorer(fitted)(stream), output, work_folder(spark, "progress"))
    made = spark.read.parquet(output).drop("o_totalprice")
    return rounded(made, o_totalprice_zscore=6)


@query("SELECT o_orderkey, true AS known, true AS bounded FROM orders JOIN customer ON o_custkey = c_custkey")
def stream_score(spark, folder):
    """Loose text records scored by a fitted model as they arrive."""
    df = order_facts(spark, folder).select("o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment", "target")
    t = classify.train_classification(df, "target", key="o_orderkey", drop_leaky=False,
                                      models={"LogisticRegression": M.of(M.logistic)})
    source, output = work_folder(spark, "records"), work_folder(spark, "results")
    df.select(*[named(c).cast("string").alias(c) for c in df.columns if c != "target"]).repartition(2).write.json(source)
    stream = streaming.read_stream(spark, source, "o_orderkey string, o_totalprice string, c_acctbal string, c_mktsegment string", "json")
    kinds = {"o_orderkey": "bigint", "o_totalprice": "double", "c_acctbal": "double", "c_mktsegment": "string"}
    streaming.run_to_end(streaming.record_scorer(t, kinds)(stream), output, work_folder(spark, "progress"))
    return spark.read.parquet(output).select("o_orderkey", F.col("result.prediction").isin("high", "usual").alias("known"),
                                             F.col("result.probability").cast("double").between(50, 100).alias("bounded"))
