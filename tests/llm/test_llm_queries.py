"""Queries of the package: the same rows as SQL, or as a plain version where SQL has none; and the whole pipeline."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from tabloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    con = duckdb.connect()
    for name_ in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{folder}/{name_}.parquet'")
    df = QUERIES[name](spark, folder)
    columns = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall(), key=str)


def test_all_are_registered():
    known = entry_points.queries()
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(known) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_decontamination_query(spark, folder):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, folder).collect()}
    assert want <= got and len(got - want) <= 1


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, columns = docs, docs.columns
    ids = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, folder)
        if name != "token ids":
            assert kept.columns == columns
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len({texts[i] for i in ids[2]}) == len(ids[2]) and {texts[i] for i in ids[2]} == {texts[i] for i in ids[1]}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not [i for i in ids[4] if any(x in texts[i] for x in items)]
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == ids[5] == ids[4] and all(r.round_trip and r.parity for r in out)
