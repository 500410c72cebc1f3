"""Shards against plain extendible hashing and against SQL."""

import hashlib
import math

import duckdb
import pytest

from tabloom.llm.queries import shard_sql
from tabloom.llm.sharding import shard_documents, shards, write_shards


def bits(key):
    return f"{int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16):060b}"


def plain(sizes, limit):
    start = max(0, math.floor(math.log2(max(1, sum(sizes.values())) / limit)))
    found = {}

    def split(keys, depth):
        if keys and (sum(sizes[k] for k in keys) <= limit or len(keys) == 1) and depth >= start:
            for k in keys:
                found[k] = bits(k)[:depth], depth, sum(sizes[k] for k in keys), len(keys)
        elif keys:
            for b in "01":
                split([k for k in keys if bits(k)[depth] == b], depth + 1)
    split(list(sizes), 0)
    return found


@pytest.mark.parametrize("limit", [50, 400, 3000, 10 ** 6])
def test_shards(spark, limit):
    sizes = {k: (k * 37) % 90 for k in range(600)} | {1000: 5000, 1001: 0}
    items = spark.createDataFrame(list(sizes.items()), "key bigint, n_bytes bigint").repartition(3)
    got = {r.key: (r.shard, r.depth, r.shard_bytes, r.shard_rows) for r in shards(items, limit).collect()}
    assert got == plain(sizes, limit)


def test_one_hot_key(spark):
    rows = [(7, 10, "same")] * 500 + [(None, 10, "x")] * 50 + [(k, None, "y") for k in range(20)] + [(8, 999, "large")]
    items = spark.createDataFrame(rows, "key bigint, n_bytes bigint, depth_of string").repartition(3)
    got = shards(items, 100).collect()
    assert len(got) == len(rows)
    weight, count = {}, {}
    for r in got:
        weight[r.shard] = weight.get(r.shard, 0) + r.n_bytes
        count[r.shard] = count.get(r.shard, 0) + 1
    assert all(w <= 100 or count[s] == 1 for s, w in weight.items())
    assert all(weight[r.shard] == r.shard_bytes and count[r.shard] == r.shard_rows for r in got)


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for limit in (2000, 30000, 10 ** 9):
        df = shard_documents(docs, limit)
        want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({shard_sql(limit)})").fetchall())
        assert sorted(tuple(r) for r in df.collect()) == want
    assert shard_documents(docs.where("false"), 10).count() == 0


def test_write(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    write_shards(docs, str(tmp_path / "out"), 200_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("__shard").exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert back.selectExpr("sum(octet_length(text)) over (partition by __shard) as n").where("n > 200000").count() == 0
