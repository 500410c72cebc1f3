"""Filter interactions against a plain version that applies the filters one after the other."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tabloom.llm import filter_audit
from tabloom.llm.filter_audit import audit, filter_masks, first_ids, possible_repeats, repeat_sketch

DOCS = "doc_id bigint, text string, lang string, mask int, n int, part string"


def fixture():
    rng = random.Random(7)
    words = ["Alpha", "beta", "GAMMA", "x#y", "delta", "été", "a", "b c"] + [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 5, 99, 100, 120]))) for _ in range(60)]
    texts += ["", None, " \t\n", "X" * 10 + "y" * 90, "X" * 11 + "y" * 89, " ".join(["w"] * 100), "long " * 50_000]
    texts += [" ".join(f"u{k}" for k in range(80)) + " u1" * 20, " ".join(f"u{k}" for k in range(79)) + " u1" * 21]
    rows = [(k, t, rng.choice(["en", "fr", "", None])) for k, t in enumerate(texts)]
    rows += [(100 + k, rng.choice(texts[:20]), "en") for k in range(30)] + [(None, texts[0], "en"), (3, texts[3], "fr"), (3, texts[3], "fr")]
    return [(*r, 0, 0, "x") for r in rows]


def fails(docs):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang, *_ in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield lang or "", i, {c for c, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search(r"[#$%&*|]", text)), i is not None and i > least.get(text, i))) if bad}


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    found = list(fails(docs))
    rows, removed = {}, {}
    for part in {p for p, *_ in found}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for p, i, f in found if p == part]
            everything = list(left)
            for step, c in enumerate(order, 1):
                out = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                removed[part, c] = removed.get((part, c), 0) + len(out)
                rows[part, order, step] = (len(left), len(out), sum(c in f for _, f in everything) - len(out),
                                           sum(f == {c} for _, f in everything), sum(i in good for i, _ in out),
                                           sum(i in toxic for i, _ in out))
    return sorted((*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in rows.items())


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_all_orders(spark, monkeypatch, sent):
    monkeypatch.setattr(filter_audit, "SENT_BYTES", sent)       # a sketch above the limit is joined
    docs = fixture()
    labels = [(0, 1, 0), (1, 0, 1), (2, None, 1), (100, 1, 1), (100, 0, 0), (101, 1, 0), (None, 1, 1), (5000, 1, 1)]
    masks = filter_masks(spark.createDataFrame(docs, DOCS).repartition(5),
                         spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = audit(masks, "ABCDE").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                       "good_lost", "toxic_lost", "shapley").collect()
    assert sorted(map(tuple, got)) == plain(docs, labels)


def test_other_filters_without_labels(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "c")], "id int, body string").withColumn("kind", F.lit(1))
    masks = filter_masks(docs, None, lambda t: {"x": t.contains("a")}, "id", "body", "kind")
    assert sorted((r.part, r["mask"], r.n) for r in masks.collect()) == [("1", 0, 1), ("1", 1, 2), ("1", 3, 1)]
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in audit(masks, "xy").collect()}
    assert got == {("xy", 1): (1, 3, 0, 5), ("xy", 2): (1, 0, 1, 1), ("yx", 1): (3, 1, 0, 1), ("yx", 2): (1, 2, 1, 5)}
    with pytest.raises(ValueError):
        audit(masks, "xx")


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert audit(filter_masks(empty), "ABCDE").count() == 0


@pytest.mark.parametrize("segments", [1, 64])
def test_sketch_loses_no_repeat(spark, segments):
    texts = [f"t{k}" for k in range(20_000)] + [f"t{k}" for k in range(0, 20_000, 7)] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("h", F.xxhash64("text"))
    maybe = possible_repeats(rows, repeat_sketch(rows.select("h"), segments), segments, "h")
    found = [r.text for r in maybe.select("text").collect()]
    repeated = {f"t{k}" for k in range(0, 20_000, 7)}
    assert repeated <= set(found) and found.count("t7") == 3
    if segments == 64:
        assert len(set(found) - repeated) < 400          # the others are cleared, but for a few
    firsts = first_ids(maybe).collect()
    assert sorted(r.first for r in firsts) == list(range(0, 20_000, 7))
