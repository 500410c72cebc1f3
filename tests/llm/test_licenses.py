"""Licence passages: winnowing against a plain version, spans and edits."""

import random

import numpy as np

from tabloom.llm.licenses import TEMPLATES, WINDOW, license_spans, winnowed
from tabloom.llm.seeds import WORD, grams, word_spans, words


def plain_winnowed(numbers):
    places, hashes = grams(numbers, 3)
    known = dict(zip(places.tolist(), hashes.tolist()))
    chosen = set()
    for start in range(-WINDOW + 1, len(numbers)):
        window = [(known[p], -p) for p in range(start, start + WINDOW) if p in known]
        if window:
            chosen.add(-min(window)[1])
    return sorted(chosen)


def test_winnowing():
    rng = random.Random(2)
    for _ in range(100):
        numbers = np.array([rng.randint(0, 3) for _ in range(rng.randint(3, 60))])
        assert winnowed(numbers)[0].tolist() == plain_winnowed(numbers)
    assert len(winnowed(np.array([], dtype=np.int64))[0]) == 0


def test_words():
    for text in ("", "Ab c_1, d\u00a0E\u201cf\u201d\u2014g", "\u0130stanbul \u00c9t\u00e9\u3000x", "a\x0bb\x1cc\x85d\u0660 \u00b2", "1\u0301x"):
        found = WORD.findall(text.lower())
        assert [w.decode() for w in words(text)] == found
        assert [text[a:b].lower() for a, b in word_spans(text) if len(text.lower()) == len(text)] in ([], found)
    assert word_spans("\u0130 ab") == [(0, 1), (2, 4)]


def test_spans(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate(TEMPLATES.items()):
        flat = " ".join(text.split())
        before = filler(20 + i) + "\n"
        rows.append((i, before + flat.upper() + " " + filler(5), "x"))
        want.add((i, name, len(before)))
    mit = " ".join(TEMPLATES["MIT"].split()).split()
    for k in rng.sample(range(10, len(mit)), 12):
        mit[k] = "other"
    rows += [(50, filler(9) + " " + " ".join(mit), "x"), (51, " ".join(mit[:60]), "x"), (52, None, "x"), (53, "", "x"),
             (54, "Released under the MIT License. " * 3, "x"), (None, "İ released under the mit license", "x"), (55, filler(50_000), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, license string").repartition(3)
    for block in (1_000_000, 60):
        found = license_spans(docs, block_words=block).collect()
        got = {(r.doc_id, r.license, r.first_char) for r in found}
        assert want <= got
        assert {r.license for r in found if r.doc_id == 50} == {"MIT"}
        assert [r for r in found if r.doc_id in (51, 52, 53, 55)] == []
        assert sorted(r.first_char for r in found if r.doc_id == 54) == [0, 32, 64]
        texts = {r[0]: r[1] for r in rows}
        assert [texts[None][r.first_char:r.end_char] for r in found if r.doc_id is None] == ["released under the mit license"]
        assert all(r.coverage == 1 for r in found if r.doc_id is not None and r.doc_id < 20 and (r.doc_id, r.license, r.first_char) in want)
    assert license_spans(docs.where("false")).count() == 0


def test_notices_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    notices = {n: t for n, t in TEMPLATES.items() if n.endswith("notice")}
    want = sorted((r.doc_id, n, at) for r in docs.collect() for n, t in notices.items()
                  for at in range(len(r.text)) if r.text.startswith(t, at))
    got = sorted((r.doc_id, r.license, r.first_char) for r in license_spans(docs).collect() if r.license in notices)
    assert got == want and got
