"""Repeated passages against a plain version that compares all windows."""

import hashlib
import random

import numpy as np
import pytest

from tabloom.llm import substrings
from tabloom.llm.substrings import _pack, drop_repeated_passages, minimisers, repeated_spans, super_kmers

SCHEMA = "doc_id bigint, text string, id int, hash int, spans string, first int, bucket int"


def plain(rows, window):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k:k + window])
            if i is not None:
                least[w] = min(i, least.get(w, i))
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and least[tuple(words[k:k + window])] < i:
                gone.update(range(k, k + window))
        left = b" ".join(w for k, w in enumerate(words) if k not in gone)
        yield i, len(words), len(gone), hashlib.sha256(left).hexdigest(), left.decode()


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "日本", "x y", "A", "a"]
    line = " ".join(rng.choices(vocabulary, k=16))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(60)]
    texts += [f"{rng.choice(texts)} {line} {rng.choice(texts)}" for _ in range(60)]                # a frequent passage
    texts += [f"{line}\t{line}\n{line}", line, line + " ", "a " * 500, "a " * 499, " ".join(["b", "c"] * 300), "", None, " \t"]
    texts += [texts[0]] * 30 + ["\x0b\x0c\x1c ".join(["u", "v"] * 20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, line), (None, texts[1]), (5, texts[70]), (5, texts[5]), (7, texts[7]), (-4, line)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window, split_bytes", [(13, 16 << 20), (13, 500), (3, 16 << 20), (1, 16 << 20), (1, 50)])
def test_passages(spark, monkeypatch, window, split_bytes):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(substrings, "SPLIT_BYTES", split_bytes)
    monkeypatch.setattr(substrings, "SHARED_WORDS", 20)
    monkeypatch.setattr(substrings, "LOAD_SHARE", 2)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0, 0, "s", 0, 0) for i, t in rows], SCHEMA).repartition(4)
    got = drop_repeated_passages(docs, window).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows, window), key=str)


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drop_repeated_passages(empty).count() == 0
    words = [f"n{k}" for k in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:150_000])), (3, "new " + " ".join(words[199_980:]))]
    got = drop_repeated_passages(spark.createDataFrame(rows, "doc_id int, text string"), texts=False).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 200_000, 0), (2, 149_900, 149_900), (3, 21, 20)]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "_runs_hash", lambda values, size: values[:len(values) - size + 1] % np.uint64(2))
    texts = [(1, b"a b c d e"), (2, b"x b c d y"), (3, b"b c d"), (4, b"b c e")]
    columns = [np.array([i for i, _ in texts], dtype=np.int64), np.zeros(4, dtype=np.int64), np.zeros(4, dtype=np.int32),
               np.array([len(t.split()) for _, t in texts], dtype=np.int32)]
    words = [w for _, t in texts for w in t.split()]
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.array([numbers[w] for w in words], dtype=np.uint32)
    spans = repeated_spans([_pack(columns, codes, list(numbers)[4:])], 3, 4)
    assert sorted(zip(*(c.tolist() for c in spans))) == [(2, 0, 1, 4), (3, 0, 0, 3)]


def test_windows_keep_their_minimiser():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 50, 500).astype(np.uint64)
    keys = minimisers(hashes, 13)
    grams = substrings._runs_hash(hashes, substrings.SIGNATURE)
    assert keys.tolist() == [int(grams[k:k + 14 - substrings.SIGNATURE].min()) for k in range(488)]
    first, n = super_kmers(keys, np.arange(488) != 100, np.arange(500) // 200)
    covered = [k for f, c in zip(first, n) for k in range(f, f + c)]
    assert covered == [k for k in range(488) if k != 100] and n.max() <= substrings.LONGEST
    assert all(f // 200 == (f + c - 1) // 200 for f, c in zip(first, n))
    assert all(len(set(keys[f:f + c].tolist())) == 1 for f, c in zip(first, n))
