"""Language identification: features by hand, held-out accuracy, rejection."""

import zlib

import numpy as np
import pytest

from tabloom.llm.language import BUCKETS, LanguageModel, drop_unidentified, fit, groups, label_documents, predict


def plain_groups(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        else:
            words, word = words + [word] * bool(word), ""
    out = []
    for n in (1, 2, 3, 4):
        for w in words:
            for g in [w[i:i + 1] for i in range(len(w))] if n == 1 else [("\0" + w + "\0")[i:i + n] for i in range(len(w) + 3 - n)]:
                h = n
                for c in g:
                    h = (h * 16777619 & 0xFFFFFFFF) ^ ord(c)
                out.append((h * 2654435761 & 0xFFFFFFFF) >> 16)
    return sorted(out)


@pytest.mark.parametrize("text", ["", "123 !!", "a", "Ab, cd\n\nÉé1x", "日本 語", "\ud800x", "o'clock  İstanbul"])
def test_groups(text):
    got = groups(text)
    assert sorted(got.tolist()) == plain_groups(text)


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = label_documents(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    apart = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in apart) / len(apart) > 0.97
    assert sum(r.rejected for r in rows) <= 2
    # labels of held-out rows have no part
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 'xx', lang) AS lang")
    assert sorted(map(tuple, label_documents(other).collect())) == sorted(map(tuple, rows))


ROWS = [(1, "the cat and the dog", "en", 1), (2, "le chat et le chien", "fr", 1), (3, None, "en", 1), (4, "", "fr", 1), (5, "123", None, 1),
        (None, "the dog", None, 1), (None, "the dog", None, 1), (6, "le chien " * 50_000, None, 1)] + [
        (10 + i, t, l, 1) for i, (t, l) in enumerate([("the house and the garden", "en"), ("la maison et le jardin", "fr")] * 20)]


def test_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, score int")
    rows = label_documents(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    for i in (3, 4, 5):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert not by_id[None].held_out and by_id[6].lang_pred == "fr"
    left = drop_unidentified(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in ROWS} - {3, 4, 5}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in label_documents(docs).collect()} == {"und"}
    assert [r.doc_id for r in drop_unidentified(docs).collect()] == [1]
    assert label_documents(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        fit(docs.selectExpr("doc_id AS key", "text", "lang AS label"))


def test_rejection(spark):
    model = LanguageModel(["a", "b"], np.zeros((BUCKETS, 2), np.float32), np.zeros(2, np.float32), 1.0, 0.55)
    df = spark.createDataFrame([("word",)], "text string")
    assert [tuple(r)[1:] for r in predict(df, model).collect()] == [("a", 0.5, True)]


def test_unknown_languages_and_junk_are_rejected(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(4)
    junk = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(40)) for _ in range(50)]
    junk += ["ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนหรือวรรณยุกต์", "中文是世界上使用人数最多的语言之一，也是联合国的工作语言",
             "Все люди рождаются свободными и равными в своем достоинстве и правах",
             "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
             "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
             "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgZW5jb2RlZCB0ZXh0IGZvciB0ZXN0aW5n", "asdf jkl; qwer uiop zxcv asdfg hjkl qwerty"]
    strange = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], "doc_id bigint, text string, lang string")
    left = {r.doc_id for r in drop_unidentified(docs.unionByName(strange)).collect()}
    assert not [i for i in left if i < 0] and len(left) >= docs.count() - 2
