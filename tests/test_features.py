import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabloom.functions.bins import cut, equal_width, labelled_quantiles
from tabloom.functions.stats import fit_stats
from tabloom.operators import columns as C
from tabloom.operators import targets as T
from tabloom.operators.fitted import FeatureTransformer
from tabloom.operators.joins import attach, group_values
from tabloom.session import work_folder


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double").coalesce(1)


def test_cut_is_right_closed(spark):
    df = numbers(spark, [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, None])
    assert column(df, cut(F.col("x"), [0, 1, 2], ["a", "b"])) == [None, "a", "a", "b", "b", None, None]
    assert column(df, cut(F.col("x"), [0, 1, 2], ["a", "b"], True))[0] == "a"
    with pytest.raises(ValueError):
        cut(F.col("x"), [0, 0, 2], ["a", "b"])


def test_quantile_classes_fall_back(spark):
    df = numbers(spark, [1.0, 5.0])
    v = F.col("x")
    assert column(df, labelled_quantiles(v, [1, 1, 1, 2, 5], list("abcd"))) == ["a", "d"]
    assert column(df, labelled_quantiles(v, [3, 3, 3, 3, 3], list("abcd"))) == ["Medium", "Medium"]
    assert equal_width(0, 8, 4) == [0, 2, 4, 6, 8]


def test_missing_beside_a_flag_is_zero(spark):
    df = numbers(spark, [1.0, 2.0, 3.0, 4.0, 9.0, None], "price")
    s = fit_stats(df, {"price": T.PRICE_SHARES})["price"]
    made = T.price_features("price", s)
    assert column(df, made["price_is_high"]) == [0, 0, 0, 1, 1, 0]
    assert column(df, made["price_tier"])[-1] is None
    assert T.price_features("price", fit_stats(numbers(spark, [1.0, 2.0], "price"), {"price": T.PRICE_SHARES})["price"]) == {}


def test_recency_of_the_latest_day_has_no_class(spark):
    days = [dt.datetime(2024, 1, 31), dt.datetime(2024, 1, 30, 12), dt.datetime(2024, 1, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "day timestamp_ntz").coalesce(1)
    made = T.date_features("day", dt.datetime(2024, 1, 31))
    assert column(df, made["day_recency_days"]) == [0, 0, 30, None]
    assert column(df, made["day_recency_category"]) == [None, None, "Very Recent", None]
    assert column(df, made["day_is_weekend"]) == [0, 0, 0, 0]


def test_zero_divisor(spark):
    df = spark.createDataFrame([(10.0, 2.0), (10.0, 0.0), (30.0, 3.0), (8.0, 1.0), (5.0, 5.0)], "unit_price double, unit_quantity double")
    stateless = T.generate_features(df)
    assert sorted(column(stateless, "unit_price_per_unit_quantity")) == [1.0, 5.0, 6.5, 8.0, 10.0]
    fitted = FeatureTransformer().fit_transform(df)
    assert sorted(column(fitted, "unit_price_per_unit_quantity"), key=lambda v: v or 0) == [None, 1.0, 5.0, 8.0, 10.0]


def test_roles_by_name_and_range(spark):
    df = spark.createDataFrame(
        [(i, f"2024-01-{i % 28 + 1:02d}", float(i % 5), float(i), i * 100000.0, "k", f"t{i}", 1.5) for i in range(300)],
        "order_id int, seen string, stars double, pieces double, worth double, kind string, words string, sale_price double")
    assert C.column_roles(df) == {"order_id": "id", "seen": "date", "stars": "rating", "pieces": "quantity",
                                  "worth": "numeric", "kind": "category", "words": "text", "sale_price": "price"}


def test_group_values_of_a_hot_key(spark):
    rows = [("hot", float(i)) for i in range(2000)] + [(f"k{i}", 1.0) for i in range(1000)] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    measures = T.group_measures(["v"], "k")
    small = group_values(df, "k", measures)
    large = group_values(df, "k", measures, limit_bytes=1000)   # forces the hot and cold branches
    for made in (small, large):
        assert made.count() == 3001
        found = {r["k"]: r["v_by_k_sum"] for r in made.select("k", "v_by_k_sum").distinct().collect()}
        assert found["hot"] == sum(range(2000)) and found["k7"] == 1.0 and found[None] is None


def test_attach_without_weight(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    table = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert attach(df, table, "k", limit_bytes=1).where("v IS NULL").count() == 5


def test_transform_of_fit_data_equals_fit_transform(spark):
    df = spark.range(100).select((F.col("id") * 1.25).alias("list_price"), (F.col("id") % 7).alias("item_count"))
    one, two = FeatureTransformer(), FeatureTransformer()
    left = one.fit_transform(df).collect()
    path = work_folder(spark, "features")
    two.fit(df).save(spark, path)
    loaded = FeatureTransformer.load(spark, path)
    assert loaded.transform(df).collect() == left
    assert loaded.generated_columns == one.generated_columns
    assert loaded.transform(df, return_merged=False).columns == one.generated_columns


def test_transformer_plans_by_name(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("user_score"), F.lit("2024-03-04").alias("start_date"),
                                F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"))
    fitted = FeatureTransformer(reference_date="2024-03-14").fit(df)
    assert "user_score_satisfaction" in fitted.generated_columns
    assert "user_score_nps_category" not in fitted.generated_columns   # above ten
    assert fitted.categories["kind"] == {"a": 25, "b": 25}
    row = fitted.transform(df).first()
    assert (row["start_date_year"], row["start_date_recency_days"], row["start_date_recency_category"]) == (2024, 10, "Very Recent")
    assert not any(c.startswith("start_date") for c in FeatureTransformer(target_only=True).fit(df).generated_columns)


def test_bins_cover_known_rows(spark):
    df = spark.range(1000).select(F.pow(F.col("id") - 300, F.lit(2)).cast("double").alias("cost_value"))
    made = FeatureTransformer().fit_transform(df)
    for c in ("category", "trend", "tier", "std_category"):
        assert made.where(F.col(f"cost_value_{c}").isNull()).count() == 0, c


def test_collapsed_edges_give_no_class(spark):
    df = numbers(spark, [1.0] * 90 + [2.0, 3.0, 4.0, 5.0], "paid_value")
    made = FeatureTransformer().fit_transform(df)
    assert made.where("paid_value_category IS NOT NULL").count() == 0
    assert made.where("paid_value_tier IS NULL").count() == 0


def test_column_tools(spark):
    df = spark.createDataFrame([(" 1", "a"), ("x", "b"), (None, "c")], "n string, t string")
    assert column(df, C.to_number("n")) == [1.0, None, None]
    assert C.numbers_where_whole(df).schema["n"].dataType.simpleString() == "string"
    kept = C.align_columns(df, ["t", "missing"])
    assert kept.columns == ["t", "missing"] and kept.first()["missing"] == 0
    with pytest.raises(ValueError):
        C.require_columns(df, ["nope"])
    typed = df.select(C.typed_value("n").alias("v")).select("v.*").collect()
    assert [tuple(r) for r in typed] == [(1, None, None), (None, None, "x"), (None, None, None)]
    cleaned = C.clean_columns(spark.createDataFrame([("2024-01-01", "soon")], "` due_date ` string, end_time string"))
    assert [f.dataType.simpleString() for f in cleaned.schema] == ["timestamp", "string"]
    assert cleaned.columns == ["due_date", "end_time"]


def test_valid_ids(spark):
    df = spark.createDataFrame([("1d0046a9-3ed3-4cdb-b8c4-3e47f4cb527c",), ("x",), (None,)], "id string")
    assert column(df, C.valid_id("id")) == [True, False, False]
    assert all(len(v) == 36 for v in column(df, C.valid_or_new_id("id")))


def test_dates_do_not_depend_on_the_session_zone(spark):
    days = [dt.datetime(2024, 3, 10), dt.datetime(2024, 3, 11), dt.datetime(2024, 11, 4)]
    df = spark.createDataFrame([(d,) for d in days], "day timestamp_ntz").coalesce(1)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "Asia/Tokyo", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            made = T.generate_features(df.withColumn("price", F.lit(1.0)))
            assert column(made, "day_recency_days") == [239, 238, 0], name
            fitted = FeatureTransformer(reference_date="2024-11-04").fit(df.withColumnRenamed("day", "a_date"))
            assert column(fitted.transform(df.withColumnRenamed("day", "a_date")), "a_date_recency_days") == [239, 238, 0], name
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_small_column_tools(spark):
    df = spark.createDataFrame([(1.5, "a", 1), (None, None, 2), (2.5, "a", 3)], "x double, t string, n int")
    assert C.narrow_floats(df).dtypes == [("x", "float"), ("t", "string"), ("n", "int")]
    assert C.text_target(df, "n").dtypes[2] == ("n", "string") and C.as_text(df, ["x"]).dtypes[0] == ("x", "string")
    assert C.added_columns(["a"], ["a", "b"]) == ["b"]
    assert C.prefixed(df, {"num": ["x"], "cat": ["t"]}).columns == ["num__x", "cat__t"]
    assert [tuple(r) for r in C.fill_typical(df).collect()] == [(1.5, "a", 1), (2.0, "a", 2), (2.5, "a", 3)]
    assert C.complete_rows(df).count() == 2 and C.known_target(df, "t").count() == 2
    assert C.numeric_features(df, "n") == ["x"]
    loose = spark.createDataFrame([("7", "x")], "a string, b string")
    assert tuple(C.coerce_record(loose, {"a": "int", "b": "double", "c": "string"}).first()) == (7, None, None)
    hot = C.align_one_hot(spark.createDataFrame([("u_v", 1)], "my_col string, n int"), ["cat__my_col_u_v", "cat__my_col_w", "n", "gone"])
    assert tuple(hot.first()) == (1, 0, 1, 0)


def test_text_dates_count_as_temporal(spark):
    from tabloom.operators.screening import screen_features
    df = spark.range(600).select(F.date_format(F.timestamp_seconds(F.col("id") * 86400), "yyyy-MM-dd").alias("day"),
                                 (F.col("id") % 7).alias("x"), F.when(F.col("id") < 300, "a").otherwise("b").alias("y"))
    df = df.withColumn("day", F.when(F.col("x") < 5, F.lit("2020-01-01")).otherwise(F.col("day")))
    found = screen_features(df, "y", temporal_columns=["day"], cardinality_threshold=1.0, id_threshold=1.0)
    assert ("day", "temporal_leakage") in [(f, reason) for f, reason, _ in found.findings]
