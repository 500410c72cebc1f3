"""Groups of identical texts against a plain version."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabloom.llm.exact_dedup import drop_exact_copies, exact_groups

ROWS = [(1, "a", 0), (2, "b", 0), (3, "a", 1), (4, None, 0), (5, "", 0), (6, "é" * 100_000, 0), (7, "é" * 100_000, 0),
        (8, "A", 0), (9, "a ", 0), (None, "a", 0), (None, "only", 0), (3, "a", 1), (10, "b", 0)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, text string, hash int").repartition(4)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_groups(spark, keep, weak):
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    best = {t: {"smallest": min, "largest": max}[keep]((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest())
            for i, t, _ in ROWS]
    # a hash that many texts share: bytes still tell them apart
    more = {"content_hash": lambda c: F.substring(F.md5(F.length(c).cast("string")), 1, 1)} if weak else {}
    got = [tuple(r) for r in exact_groups(frame(spark), keep, **more).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_drop(spark):
    docs = frame(spark)
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted({r.doc_id for r in left.collect() if r.doc_id is not None}) == [1, 2, 4, 6, 8, 9]


def test_empty(spark):
    assert exact_groups(frame(spark).where("false")).count() == 0
    assert drop_exact_copies(frame(spark).where("false")).count() == 0
