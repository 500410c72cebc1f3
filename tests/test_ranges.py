"""Records with line ends or commas inside quotes, read by byte ranges, against the readers of the standard library."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tabloom.sources import ranges
from tabloom.sources import readers as R


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def values(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", '"', ",", "\n", "\r\n", "é", "日", "[", "]", "{", "}", "\\", " b"]
    return ["x" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) + "x" for _ in range(n)]


def written(rows, header=("id", "te\nxt", "v"), **options):
    out = io.StringIO(newline="")
    writer = csv.writer(out, **options)
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("chunk", [300, 1 << 22])
def test_csv_records(small_splits, tmp_path, chunk):
    rows = [[str(k), t, str(k / 7)] for k, t in enumerate(values(1500))] + [["1500", "long " + "\n,\"" * 20_000, "0"]]
    path = tmp_path / "q.csv"
    path.write_bytes(written(rows).encode())
    chunks = ranges.chunks_of(small_splits, str(path), "\n", False, chunk)
    assert chunks.select("block").distinct().count() > 3
    first, others, stray = ranges.quoted_records(small_splits, str(path), ",", chunk)
    assert [bytes(r.data) for r in first.collect()] == [b'id,"te\nxt",v'] and not stray
    got = [next(csv.reader(io.StringIO(bytes(r.data).decode(), newline=""))) for r in others.collect()]
    assert sorted(got) == sorted(rows)


def test_csv_tables(small_splits, tmp_path):
    rows = [(k, t, k / 7) for k, t in enumerate(values(1500, 2))]
    path = tmp_path / "q.csv"
    path.write_bytes(b"\xef\xbb\xbf" + written(rows, ("id", "text", "v")).encode())
    df = R.read_data_flexible(small_splits, str(path))
    assert df.dtypes == [("id", "int"), ("text", "string"), ("v", "double")] and df.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, df.collect())) == rows
    latin = [(k, t.replace("日", "ß"), k / 7) for k, t, _ in rows]
    (tmp_path / "l.csv").write_bytes(written(latin, ("id", "text", "v"), delimiter=";").encode("latin-1"))
    read = R.read_delimited(small_splits, str(tmp_path / "l.csv"), ";", "ISO-8859-1")
    assert sorted(map(tuple, read.collect())) == latin


def test_each_file_is_decided(small_splits, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "open.csv").write_text('a,b\n3.5,"x\ny"\n\n4,"last ""one"""')
    (tmp_path / "stray.csv").write_text('a,b\n5,5" pipe\n6,"x\ny"\n7,6" z\n')
    assert sorted(map(tuple, R.read_delimited(small_splits, str(tmp_path), ",").collect())) == [
        (1.0, "x"), (2.0, "y"), (3.5, "x\ny"), (4.0, 'last "one"'), (5.0, '5" pipe'), (6.0, "x\ny"), (7.0, '6" z')]
    assert [f.rsplit("/", 1)[1] for f in ranges.quoted_records(small_splits, str(tmp_path))[2]] == ["stray.csv"]
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "b.csv").write_text('a,b\n1,"x\ny"\nz,"q"\n2,"c",3\n3,"never\nclosed')
    read = R.read_delimited(small_splits, str(broken), ",", schema="a int, b string")
    assert {r.a for r in read.collect()} >= {1} and not {r.a for r in read.collect()} & {2, None}
    assert R.broken_lines(small_splits, str(broken), separator=",", schema="a int, b string") >= 2


@pytest.mark.parametrize("chunk", [200, 1 << 22])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(small_splits, tmp_path, monkeypatch, chunk, indent):
    monkeypatch.setattr(ranges.array_elements, "__defaults__", (chunk,))
    rows = [{"i": k, "t": t, "o": {"x": [1, [2, {"y": t}]], "z,": k / 7}} for k, t in enumerate(values(800, 3))]
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps(rows, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    elements = ranges.array_elements(small_splits, str(path)).collect()
    assert sorted((json.loads(bytes(r.data)) for r in elements), key=lambda r: r["i"]) == rows
    df = R.read_data_flexible(small_splits, str(path))
    assert sorted((r["i"], r["t"], r["o.z,"]) for r in df.collect()) == [(r["i"], r["t"], r["o"]["z,"]) for r in rows]


def test_json_ends(small_splits, tmp_path):
    rows = [{"i": k, "t": "a,b"} for k in range(100)]
    whole = json.dumps(rows)
    cases = {"cut": whole[:-8], "string": whole[:-4], "comma": whole[:-1] + ",", "empty": "[ ]", "one": '[{"i": 0, "t": "a,b"}]', "blank": "\n"}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    count = {}
    for name in cases:
        read = R.read_json(small_splits, str(tmp_path / f"{name}.json"))
        if "i" in read.columns:
            count[name] = sorted(r["i"] for r in read.collect() if r["i"] is not None)
            broken = read.cache().where("_corrupt_record IS NOT NULL").count() if "_corrupt_record" in read.columns else 0
            assert broken == (name in ("cut", "string")), name
    assert count == {"cut": list(range(99)), "string": list(range(99)), "comma": list(range(100)), "one": [0]}
    (tmp_path / "mix").mkdir()
    (tmp_path / "mix" / "lines.json").write_text('{"i": 1}\n{"i": 2}\n')
    (tmp_path / "mix" / "document.json").write_text('{"i": 3,\n "t": "[,"}')
    (tmp_path / "mix" / "array.json").write_text('[{"i": 4},\n{"i": 5, "t": "]"}]')
    mixed = R.read_json(small_splits, str(tmp_path / "mix"))
    assert sorted((r["i"], r["t"]) for r in mixed.collect()) == [(1, None), (2, None), (3, "[,"), (4, None), (5, "]")]
    assert mixed.where(F.col("t").isNotNull()).count() == 2


def test_chunks_go_to_python_one_by_one(spark, tmp_path, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    cutter = ranges._cutter

    def watched(*args):
        run = cutter(*args)

        def outer(batches):
            def each():
                for batch in batches:
                    sizes.add(batch.num_rows > 1)
                    yield batch
            return run(each())
        return outer

    monkeypatch.setattr(ranges, "_cutter", watched)
    monkeypatch.setattr(ranges, "BATCH_BYTES", 20_000)
    held = spark.conf.get(ranges._BATCH_LIMIT, None)
    (tmp_path / "one.csv").write_text(written([[str(i), "x" * 100, "y"] for i in range(4000)]), encoding="utf-8")
    first, others, stray = ranges.quoted_records(spark, str(tmp_path / "one.csv"), chunk_bytes=20_000)
    assert (first.count(), others.count(), stray) == (1, 4000, [])
    assert sizes.value == 0
    assert spark.conf.get(ranges._BATCH_LIMIT, None) == held
