import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import association as A
from tabloom.operators import encode as E
from tabloom.operators import profile as P
from tabloom.operators import rules as R
from tabloom.operators import sampling as M
from tabloom.operators import screening as S
from tabloom.plans import prepare


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=str)


def test_unseen_category(spark):
    fit = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    coded = E.ordinal(new, "c", E.category_index(fit, "c"), "i")
    assert rows(coded, "c", "i") == rows(spark.createDataFrame([("a", 0), ("z", -1), (None, -1)], "c string, i long"), "c", "i")
    values, other = E.frequent_values(fit, "c", None)
    hot = new.withColumns(E.one_hot_columns("c", values, other))
    assert rows(hot, "c_a", "c_b") == [(0, 0), (0, 0), (1, 0)]
    prep = prepare.create_preprocessor(fit, [], ["c"])
    made = prep.transform(new).select("c", vector_to_array("features").alias("f")).collect()
    assert {r["c"]: list(r["f"]) for r in made} == {"a": [1, 0], "z": [0, 0], None: [0, 1]}


def test_numbering_of_many_values(spark):
    df = spark.range(500).select(F.format_string("v%05d", F.col("id") * 7 % 500).alias("c")).repartition(6)
    found = {r["c"]: r["index"] for r in E.numbered(df, "c").collect()}
    assert found == {f"v{i:05d}": i for i in range(500)}


def test_rare_values_share_a_column(spark):
    values = [f"v{i}" for i in range(12) for _ in range(20 - i)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    coded = E.one_hot(df, ["c"], 10)
    assert len(coded.columns) == 10 and "c_infrequent" in coded.columns
    assert coded.agg(F.sum("c_infrequent")).first()[0] == 11 + 10 + 9


def test_quantile_normal_keeps_order_and_gaps(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(101)] + [(None,)], "x double")
    made = [r["x"] for r in E.quantile_normal(df, ["x"]).collect()]
    assert made[-1] is None
    known = made[:-1]
    assert known == sorted(known) and abs(known[50]) < 0.01 and known[0] < -4 < 4 < known[-1]


def test_target_encoding_smooths(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0), (None, 0.0)], "c string, y double")
    found = {r["c"]: r["c_target"] for r in E.target_encode(df, "c", "y", 2.0).collect()}
    assert found == pytest.approx({"a": (1 + 2 * 0.5) / 4, "b": (1 + 2 * 0.5) / 3, None: 0.5})


def test_encoding_choices(spark):
    assert E.choose_encoding(11, ["c"]) == "hashing" and E.choose_encoding(3, ["c"]) == "target"
    assert E.choose_encoding(None, ["c"]) == "target"
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 15).cast("string").alias("b"),
                                 F.col("id").cast("string").alias("c"))
    low, high, _ = E.split_by_cardinality(df, ["a", "b", "c"], 20)
    assert (low, high) == (["a", "b"], ["c"])
    assert E.split_by_cardinality(df, ["a", "b"], 20, 10)[:2] == (["a"], ["b"])


@pytest.mark.parametrize("encoding", ["target", "ordinal", "binary", "hashing"])
def test_wide_preprocessor(spark, encoding):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 40).cast("string").alias("wide"), (F.col("id") % 3).cast("string").alias("low"),
                                 F.when(F.col("id") % 5 != 0, F.col("id") * 1.0).alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    p = prepare.build_preprocessor(df.drop("k"), "label", max_categories=10, encoding=encoding)
    wide = p.wide(df)
    assert wide.columns == p.feature_names and wide.count() == 400
    assert {s.source for s in p.slots} == {"x", "low", "wide"}
    x = wide.select(F.avg("num__x"), F.stddev_pop("num__x")).first()
    assert x[0] == pytest.approx(0, abs=1e-9) and x[1] == pytest.approx(1)
    assert p.wide(df, ["one"]).columns[0] == "feature_0"
    again = prepare.Preprocessor.load(p.model, p.info())
    assert again.slots == p.slots


def test_feature_selection(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("__row"), (F.col("id") % 2).cast("double").alias("label"),
                                 ((F.col("id") % 2) * 5.0).alias("good"), F.lit(1.0).alias("flat"), (F.hash("id") % 100).cast("double").alias("noise"))
    p = prepare.build_preprocessor(df.drop("__row"), "label")
    kept = prepare.select_features(p, df, "__row", 1, True)
    assert kept.feature_names == ["num__good"]
    assert prepare.select_features(p, df, "__row", 1, False).feature_names == ["num__good"]
    assert kept.transform(df).select(vector_to_array("features").alias("f")).first()["f"][0] == pytest.approx(-1)


def test_screening(spark):
    df = spark.range(200).select(
        F.col("id").alias("key_like"), F.lit("x").alias("fixed"), F.lit(None).cast("double").alias("empty"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 10).alias("sparse"), (F.col("id") % 20).alias("a"), (F.col("id") % 20 * 2).alias("b"),
        F.concat(F.lit("n"), "id").alias("name_like"), (F.col("id") % 20 + F.col("id") % 3).alias("y"))
    found = S.screen_features(df, "y")
    assert found.by_reason() == {"constant": ["fixed", "empty"], "high_cardinality": [], "id_like": ["key_like", "name_like"],
                                 "null_heavy": ["sparse"], "high_correlation": ["b"], "high_mutual_info": [], "temporal_leakage": []}
    assert found.cleaned.columns == ["a", "y"]
    strict = S.screen_features(df, "y", drop_high_mutual_info=True)
    assert strict.by_reason()["high_mutual_info"] == ["a"]
    quick = S.screen_features(df, "y", exact=False)
    assert quick.dropped == found.dropped


def test_temporal_leakage(spark):
    df = spark.range(600).select(F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("day"), (F.col("id") % 7 + 1.0).alias("other"))
    month = F.when(F.month("day") > 6, "late").otherwise("early")
    assert S.screen_features(df.withColumn("y", month), "y", temporal_columns=["day"], id_threshold=2).by_reason()["temporal_leakage"] == ["day"]
    assert S.screen_features(df.withColumn("y", F.year("day") * 10.0 + F.col("other")), "y", temporal_columns=["day"], id_threshold=2).by_reason()["temporal_leakage"] == ["day"]
    assert S.screen_features(df.withColumn("y", (F.hash("day") % 2).cast("string")), "y", temporal_columns=["day"], id_threshold=2).by_reason()["temporal_leakage"] == []


def test_mutual_information_bounds(spark):
    df = spark.range(1000).select((F.col("id") % 4).cast("string").alias("y"), (F.col("id") % 4).cast("double").alias("same"),
                                  F.floor(F.col("id") / 4).alias("unrelated"), F.lit(None).cast("string").alias("gap"))
    found = {r["feature"]: r["mutual_info"] for r in A.mutual_information(df, ["same", "unrelated", "gap"], "y", ["same", "unrelated"]).collect()}
    assert found["same"] == pytest.approx(math.log(4)) and found["unrelated"] == pytest.approx(0, abs=1e-9) and found["gap"] == 0


def test_leaky_numbers_for_a_class_target(spark):
    df = spark.range(500).select((F.col("id") % 2).cast("string").alias("y"), (F.col("id") % 2 * 3.0).alias("copy"), (F.col("id") % 5).alias("other"))
    assert [r["feature"] for r in S.leaky_features(df, "y").collect()] == ["copy"]


def test_profile_tools(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "n int, t string")
    sketch = {r["feature"]: r["distinct"] for r in P.profile_columns(df, exact=False).collect()}
    assert sketch == {"n": 2, "t": 2}
    about = P.describe(df)
    assert (about["rows"], about["columns"], about["missing"]) == (3, 2, {"t": 1})


def test_sampling_is_repeatable_and_exact(spark):
    df = spark.range(2000).withColumn("c", F.when(F.col("id") < 2, "rare").when(F.col("id") == 2, "one").otherwise("usual"))
    first = rows(M.sample_rows(df, 100, "id"), "id")
    assert len(first) == 100 and first == rows(M.sample_rows(df.repartition(7), 100, "id"), "id")
    train, test = M.split(df, "id", 0.2, "c")
    assert train.count() + test.count() == 2000 and 300 < test.count() < 500
    assert train.where("c = 'rare'").count() == 1 == test.where("c = 'rare'").count()
    assert M.stratified_sample(df, 5000, "c", "id").count() == 2000


def test_rules(spark):
    df = spark.createDataFrame([(1.0, 10), (3.0, 100), (4.5, 10), (None, None)], "s double, d int")
    assert [r[0] for r in df.select(R.account_health(F.col("s"), F.col("d"))).collect()] == ["At Risk", "Needs Attention", "Healthy", "Healthy"]
    none = F.lit(None).cast("double")
    assert df.select(R.lead_score(none, F.lit(20.0), none, none)).first()[0] == 100
    assert df.select(R.campaign_answered(F.lit(0.3), F.lit(0.2), none, F.lit(0))).first()[0] == 1
    assert df.select(R.opportunity_won(F.lit("Proposal"), F.lit(6000), F.lit(0))).first()[0] == 1
    assert df.select(R.lead_converted(F.lit("Cold"), F.lit("Meeting"), F.lit(7))).first()[0] == 7


def test_chi_square_tail():
    # table values of the 5 % and 1 % points
    for dof, five, one in ((1, 3.841, 6.635), (2, 5.991, 9.210), (3, 7.815, 11.345), (10, 18.307, 23.209), (31, 44.985, 52.191)):
        assert A.chi_square_tail(five, dof) == pytest.approx(0.05, abs=2e-4)
        assert A.chi_square_tail(one, dof) == pytest.approx(0.01, abs=1e-4)
    assert A.chi_square_tail(0, 3) == 1.0


def test_continuity_correction(spark):
    cells = spark.createDataFrame([("t", 0, "a", 8), ("t", 0, "b", 2), ("t", 1, "a", 1), ("t", 1, "b", 5)], "part string, value int, label string, n long")
    plain, corrected = (A.chi_square(cells, corrected=c).first()["chi2"] for c in (False, True))
    assert plain == pytest.approx(6.112, abs=1e-3) and corrected == pytest.approx(16 * 30**2 / 3780)


def test_one_hot_refuses_wide_columns(spark, monkeypatch):
    monkeypatch.setattr(E, "WIDEST", 10)
    with pytest.raises(ValueError):
        E.one_hot(spark.range(20).select(F.col("id").cast("string").alias("c")), ["c"], None)


def test_inverse_normal(spark):
    from statistics import NormalDist
    shares = [1e-7, 1e-4, 0.02, 0.0243, 0.1, 0.5, 0.7, 0.975, 0.99, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in shares], "p double")
    for row in E.with_inverse_normal(df, {"z": "p"}).collect():
        assert row["z"] == pytest.approx(NormalDist().inv_cdf(row["p"]), abs=1e-7)


def test_rare_classes_stay(spark):
    df = spark.range(50_000).select("id", F.when(F.col("id") < 3, "rare").when(F.col("id") % 2 == 0, "a").otherwise(None).alias("c"))
    part = M.stratified_sample(df, 1000, "c", "id")
    found = {r["c"]: r["count"] for r in part.groupBy("c").count().collect()}
    assert found["rare"] >= 1 and 350 < found["a"] < 650 and 350 < found[None] < 650


def test_attached_tables_by_every_way(spark):
    from tabloom.operators.joins import attach, fits_broadcast
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None)
                                    .otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    table = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("__rows"), F.min("id").alias("first"))
    want = sorted((tuple(r) for r in attach(rows, table, "k", "__rows").collect()), key=str)
    for weight in ("__rows", None):
        table_ = table if weight else table.drop("__rows")
        got = attach(rows, table_, "k", weight, limit_bytes=0)
        near = attach(rows, table_, "k", weight)
        assert sorted(map(str, got.select("k", "id", "first").collect())) == sorted(map(str, near.select("k", "id", "first").collect()))
    assert len(want) == 4000
    assert not fits_broadcast(spark.range(100).select(F.repeat(F.lit("x"), 10_000).alias("t")), 500_000)


def test_repeats_inside_a_load(spark):
    from tabloom.operators.joins import only_new
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), ("c", 1)], "id string, v int")
    old = spark.createDataFrame([("c",)], "id string")
    assert sorted(map(tuple, only_new(new, old, "id").collect())) == [("a", 1), ("b", 5)]


def test_sparse_one_hot_names_no_slots(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "k string")
    coded = E.one_hot_sparse(df, "k")
    assert not coded.schema["one_hot"].metadata      # the encoder's names of all slots would pass through the driver
    assert sorted((str(r.k), r.one_hot.size, r.one_hot.indices.tolist()) for r in coded.collect()) == [
        ("None", 2, []), ("a", 2, [0]), ("b", 2, [1]), ("b", 2, [1])]


def test_sparse_one_hot_query_makes_no_arrays(spark, tmp_path):
    from tabloom.queries.encoding import onehot_sparse
    spark.range(20).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    found = onehot_sparse(spark, str(tmp_path))
    assert "vector_to_array" not in found._jdf.queryExecution().toString().lower() and "UDF(one_hot" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(i, 7, i % 7, 1) for i in range(20)]


def test_rows_are_spread_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(100_000).withColumn("same", F.lit(None).cast("string")).coalesce(1)
    spread = M.spread_rows(rows, 100_000)
    sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == cores and max(sizes) < 1.2 * 100_000 / cores and sum(sizes) == 100_000
    assert M.spread_rows(rows.limit(500), 500).rdd.getNumPartitions() == 1
    assert M.spread_rows(rows, 500_000 * 100 + 1).rdd.getNumPartitions() == max(cores, 101)
