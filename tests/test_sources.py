import pytest
import datetime as dt

from pyspark.sql import functions as F

from tabloom.operators import documents as D
from tabloom.sources import readers as R
from tabloom.sources import registry, sinks
from tabloom.streaming import score as streaming


def put(path, data, encoding="utf-8"):
    path.write_bytes(data.encode(encoding))
    return str(path)


def test_separators(spark, tmp_path):
    for i, sep in enumerate([",", ";", "\t", "|"]):
        p = put(tmp_path / f"f{i}.csv", f"a{sep} b{sep}c\n1{sep} 2{sep}x\n3{sep} 4{sep}y\n")
        df = R.read_data_flexible(spark, p)
        assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 2, "x"), (3, 4, "y")], sep
    assert R.separator_by_count(["a;b,c;d", "e;f"]) == ";"
    assert R.separator_of_first_match(["abc", "a;b,c"]) == "," and R.separator_of_first_match(["x"]) == ";"
    assert R.get_delimiter(spark, p) == ";"
    assert {r["separator"]: r["n"] for r in R.separator_report(spark, p).collect()} == {",": 0, ";": 0, "\t": 0, "|": 6}


def test_encodings(spark, tmp_path):
    put(tmp_path / "u.csv", "name;n\nçé;1\n")
    put(tmp_path / "l.csv", "name;n\nçé;1\n", "latin-1")
    put(tmp_path / "w.csv", "name;n\n“ç”;1\n", "cp1252")
    found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in R.file_encodings(spark, str(tmp_path)).collect()}
    assert found == {"u.csv": "UTF-8", "l.csv": "ISO-8859-1", "w.csv": "windows-1252"}
    assert R.read_data_flexible(spark, str(tmp_path / "l.csv")).first()["name"] == "çé"
    assert R.read_data_flexible(spark, str(tmp_path / "w.csv")).first()["name"] == "“ç”"


def test_broken_lines(spark, tmp_path):
    p = put(tmp_path / "b.csv", "a,b\n1,2\nx,3\n4,5\n6,7,8\n")
    read = R.read_delimited(spark, p, ",", schema="a int, b int")
    assert [tuple(r) for r in read.collect()] == [(1, 2), (4, 5)]
    assert [r["b"] for r in read.select("b").collect()] == [2, 3, 5]
    kept = R.read_delimited(spark, p, ",", schema="a int, b int", keep_broken=True)
    assert [r["_broken"] for r in kept.collect() if r["_broken"]] == ["x,3", "6,7,8"]


def test_json(spark, tmp_path):
    p = put(tmp_path / "n.json", '[{"a": 1, "b": {"c": "x", "d.e": {"f": 2}}}, {"a": 3, "b": {"c": "y"}}]')
    df = R.read_data_flexible(spark, p)
    assert sorted(df.columns) == ["a", "b.c", "b.d.e.f"]
    assert R.read_json(spark, p, flatten=False).columns == ["a", "b"]
    assert R.read_folder(spark, p, "json", multiLine=True).where(F.col("source_file").endswith("n.json")).count() == 2


def test_preview_and_records(spark, tmp_path):
    p = put(tmp_path / "t.txt", "\n".join("x" * 2000 for _ in range(300)))
    assert len(R.preview(spark, p)) == 100_000 and len(R.preview(spark, p, 10)) == 10 * 2001 - 1
    assert R.from_records(spark, {"a": 1}).count() == 1
    retried = put(tmp_path / "semi.csv", "a;b\n1;2\n")
    assert R.read_or_retry(spark, retried).columns == ["a", "b"]


def test_registry(spark, tmp_path):
    store = registry.Registry(spark, str(tmp_path))
    now = dt.datetime(2024, 1, 1)
    store.append("models", spark.createDataFrame([("m1", "u1", "A", "x", "t", ["f"], 0.5, now), ("m2", "u2", "B", "y", "t", ["f"], 0.7, now + dt.timedelta(1))],
                                                 "id string, user_id string, name string, model_type string, target_variable string, feature_names array<string>, accuracy double, created_at timestamp"))
    scored = spark.createDataFrame([(1.5, "yes")], "x double, p string")
    store.log_predictions(scored, "u1", "m1", ["x"], ["p"])
    store.log_predictions(scored, "u1", "m2", ["x"], ["p"])
    logs, models = store.table("prediction_logs"), store.table("models")
    assert logs.first()["input_data"] == '{"x":1.5}' and logs.count() == 2
    assert {r["model_name"] for r in registry.user_prediction_logs(logs, models, "u1", 5).collect()} == {"A", "B"}
    assert registry.owned(models, "u2").first()["id"] == "m2"
    users = spark.createDataFrame([("u1", "ann"), ("u2", "bob")], "id string, username string")
    assert [r["owner"] for r in registry.recent_models(models, users).collect()] == ["bob", "ann"]
    embeds = spark.createDataFrame([("e1", "u1", "m1", now)], "id string, user_id string, model_id string, created_at timestamp")
    assert registry.embedding_by_id(embeds, models, "e1").first()["metadata"]["accuracy"] == 0.5
    store.save_use_cases(spark.createDataFrame([("c1", "u1", "f.csv")], "id string, user_id string, filename string"))
    assert registry.file_listing(spark, str(tmp_path)).where(F.col("path").contains("user_id=u1")).count() == 1
    sinks.write_record(spark, str(tmp_path / "record"), {"a": 1})
    assert sinks.read_record(spark, str(tmp_path / "record")) == {"a": 1}
    assert [tuple(r) for r in sinks.class_map(spark, ["x", "y"]).collect()] == [(0, "x"), (1, "y")]


def test_proposal_shapes(spark):
    texts = [
        'Intro\n[{"title": "T", "kpis": "none", "extra": 1}, {"target_variable": "y"}]\nbye',
        "Proposal: Alpha\nbody one\n**Key Performance Indicators**\nfirst\nkpi again\nsecond\n",
        "[{not json}] but a long enough text",
        "",
        "Use Case\nMODEL_TYPE: Regression\nTARGET_VARIABLE: z\nrest of it",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {}
    for r in D.proposal_rows(df, "t", "k").orderBy("k", "position").collect():
        found.setdefault(r["k"], []).append(r)
    assert [r["title"] for r in found[0]] == ["T", "AI Use Case"] and found[0][0]["kpis"] == [] and found[0][1]["target_variable"] == "y"
    assert found[1][0]["title"] == "Proposal: Alpha" and found[1][0]["description"] == "body one"
    assert found[2][0]["title"] == "AI Use Case Proposal" and found[2][0]["description"] == texts[2]
    assert found[3][0]["description"] == ""
    assert (found[4][0]["model_type"], found[4][0]["target_variable"], found[4][0]["description"]) == ("regression", "z", "rest of it")


def test_bullets_and_fences(spark):
    text = "Use Case 1: **Bold**\nabout\nKPIs:\n1. one\n  more\n2. two\nTARGET_VARIABLE: y"
    r = D.proposal_rows(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r["title"], r["description"], r["kpis"]) == ("Bold", "about", ["one\n  more", "two\nTARGET_VARIABLE: y"])
    df = spark.createDataFrame([("```py\nx = 1\n```",)], "t string")
    assert df.select(D.without_fences(F.col("t"))).first()[0] == "x = 1\n"
    assert df.select(D.identifier_words(F.lit("a1 b a1 9c _d"))).first()[0] == ["a1", "b", "_d"]


def test_stored_documents(spark, tmp_path):
    put(tmp_path / "d.json", '{"id": "1", "user_id": "u", "proposals": [{"title": "A", "model_type": "regression"}, {"title": "B"}]}')
    docs = spark.read.schema(registry.USE_CASE_DOCUMENT).json(str(tmp_path), multiLine=True)
    listed = D.stored_proposals(docs)
    assert [(r["position"], r["title"], r["model_type"]) for r in listed.orderBy("position").collect()] == [(0, "A", "regression"), (1, "B", "auto")]
    assert {r["model_type"]: r["n"] for r in D.proposal_counts(listed).collect()} == {"regression": 1, "auto": 1}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(source)
        streaming.run_to_end(streaming.read_stream(spark, source, "id long"), out, progress)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(20))


def test_json_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": {"c": 2}}\n{"a": 2}\n\n{"a": 3}\n')
    (tmp_path / "b.json").write_text('[{"a": 4},\n {"a": 5}]')
    (tmp_path / "c.json").write_text('{\n"a": 6}')
    from tabloom.sources import readers
    assert sorted(r["a"] for r in readers.read_data_flexible(spark, str(tmp_path / "a.json")).collect()) == [1, 2, 3]
    assert sorted(r["a"] for r in readers.read_json(spark, f"{tmp_path}/*.json").collect()) == [1, 2, 3, 4, 5, 6]


def test_quoted_values(spark, tmp_path):
    from tabloom.sources import readers
    (tmp_path / "q.csv").write_text('id,t\n1,"a\nb"\n2,"say ""x"", y"\n3,plain\nbad,line,with,more\n')
    rows = readers.read_delimited(spark, str(tmp_path / "q.csv"), ",", schema="id int, t string").collect()
    assert sorted((r["id"], r["t"]) for r in rows) == [(1, "a\nb"), (2, 'say "x", y'), (3, "plain")]
    assert readers.broken_lines(spark, str(tmp_path / "q.csv"), separator=",", schema="id int, t string") == 1


def test_encodings_of_a_folder(spark, tmp_path):
    from tabloom.sources import readers
    texts = {"utf-8": "Müller Straße né", "latin-1": "Müller Straße né", "shift_jis": "日本語のテキスト", "cp1251": "Привет мир как дела",
             "cp1250": "žluťoučký kůň šťastný", "utf-16": "Übung macht", "utf-16-le": "Grüße aus", "cp1252": "“Quote” – €5 é"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(f"id,t\n1,{text}\n".encode(name))
    rows = readers.read_data_flexible(spark, f"{tmp_path}/*.csv").collect()
    assert sorted(r["t"] for r in rows) == sorted(texts.values())


def test_work_folder_must_be_shared(monkeypatch):
    from types import SimpleNamespace

    from tabloom.session import work_folder
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        work_folder(cluster, "x")
