"""Alignment against a plain version; benchmark items in documents, whole and edited."""

import random

import numpy as np

from tabloom.llm import align as aligning
from tabloom.llm.align import MATCH, align, bands
from tabloom.llm.decontaminate import contaminated, drop_contaminated, spare_groups


def plain_score(query, text, low, high):
    h, best = {}, 0
    for i in range(1, len(query) + 1):
        for j in range(1, len(text) + 1):
            if low <= j - i <= high:
                h[i, j] = max(0, h.get((i - 1, j - 1), 0) + (2 if query[i - 1] == text[j - 1] else -1),
                              h.get((i - 1, j), 0) - 1, h.get((i, j - 1), 0) - 1)
                best = max(best, h[i, j])
    return best


def test_alignment():
    rng = random.Random(8)
    for _ in range(300):
        query = [rng.randint(1, 4) for _ in range(rng.randint(1, 14))]
        text = [rng.randint(1, 4) for _ in range(rng.randint(1, 20))]
        low = rng.randint(-15, 15)
        high = low + rng.randint(0, 20)
        found = align(np.array(query), np.array(text), low, high)
        assert found.score == plain_score(query, text, low, high)
        if found.score:
            q, t = query[found.start:found.end], text[found.text_start:found.text_end]
            assert plain_score(q, t, -50, 50) >= found.score and found.matches <= min(len(q), len(t))
    assert bands(np.array([9, 1, 2, 30, 9]), 3) == [(-2, 5), (6, 12), (27, 33)]


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [w] if x > share else [["changed"], [], [w, "added"]][rng.randrange(3)]
    return out


def test_documents(spark):
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 40))] for _ in range(30)] + [["two", "words"]]
    rows, planted = [], set()
    for d in range(150):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            k = rng.randrange(30)
            body[len(body) // 2:len(body) // 2] = edited(rng, items[k], 0.1 * (d % 2))
            planted.add((d, k))
        rows.append((d, " ".join(body).upper() + "!", 1))
    rows += [(500, "Say Two, words: here", 1), (501, None, 1), (502, "", 1), (None, " ".join(items[0]), 1), (503, " ".join(items[1]) * 2000, 1)]
    planted |= {(500, 30), (None, 0)}
    rows += [rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(0, " ".join(items[0])), (99, None), (98, "")],
                                  "item_id bigint, text string")
    for block in (1_000_000, 200):
        found = contaminated(docs, bench, block_words=block).collect()
        pairs = {(r.doc_id, r.item_id) for r in found}
        assert planted <= pairs | {(503, 1)} and (503, 1) in pairs and pairs <= planted | {(503, 1)}
        assert sum(r.doc_id == 0 for r in found) == 2
    exact = [r for r in found if r.similarity == 1 and r.doc_id is not None and r.doc_id < 500]
    texts = dict((r[0], r[1]) for r in rows)
    for r in exact:
        cut = texts[r.doc_id].lower().rstrip("!").split()[r.first_word:r.last_word + 1]
        assert cut == items[r.item_id] and r.matched_words == r.item_words == len(cut)
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {d for d, _ in planted} - {503}
    assert contaminated(docs.where("false"), bench).count() == contaminated(docs, bench.where("false")).count() == 0
    assert drop_contaminated(docs, bench.where("false")).count() == len(rows)


def test_any_intact_word_group_is_a_seed(spark):
    item = ["a%d" % i for i in range(11)]
    copy = [w if k not in (3, 7) else "other" for k, w in enumerate(item)]
    common = " ".join(item[1:3] + ["x"] + item[4:7])
    long = ["b%d" % i for i in range(1000)]
    parted = long[:500] + ["w"] * 200 + long[500:]
    docs = spark.createDataFrame([(1, " ".join(copy)), (2, common), (3, " ".join(parted)), (4, " ".join(long[:550])),
                                  (5, "w " * 5000 + " ".join(parted) + " w" * 5000)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long))], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 2) for r in contaminated(docs, bench).collect()}
    assert found == {(1, 1): 0.73, (3, 2): 0.9, (5, 2): 0.9}


def test_large_tables_are_aligned_in_parts(monkeypatch):
    rng = random.Random(3)
    cases = []
    for _ in range(100):
        query, text = ([rng.randint(1, 5) for _ in range(rng.randint(1, 60))] for _ in range(2))
        low = rng.randint(-40, 20)
        cases.append((np.array(query), np.array(text), low, low + rng.randint(0, 60)))
    whole = [align(*case) for case in cases]
    monkeypatch.setattr(aligning, "SMALL", 0)
    assert [align(*case) for case in cases] == whole


def test_against_all_pairs(spark):
    """Rare seeds lose no pair that a full alignment of every item with every document finds."""
    rng = random.Random(9)
    ranked = ["w%d" % i for i in range(300)]
    def some(n):
        return rng.choices(ranked, [1 / (i + 1) for i in range(300)], k=n)        # few words are frequent
    items = [some(rng.randint(9, 45)) for _ in range(60)]
    docs = []
    for d in range(300):
        body = some(rng.randint(0, 80))
        if d % 2:
            copy = list(rng.choice(items))
            for _ in range(rng.randint(0, len(copy) // 3)):
                k = rng.randrange(len(copy))
                copy[k:k + 1] = rng.choice([["new%d" % rng.randrange(99)], []])
            cut = rng.randint(0, len(copy) // 4)
            body[len(body) // 2:len(body) // 2] = copy[cut:] if d % 4 == 1 else copy[:len(copy) - cut]
        docs.append(body)
    numbers = {w: i for i, w in enumerate(sorted({w for text in items + docs for w in text}))}
    coded = [[np.array([numbers[w] for w in text]) for text in part] for part in (items, docs)]
    wanted = {}
    for k, item in enumerate(coded[0]):
        for d, text in enumerate(coded[1]):
            score = align(item, text, -len(item), len(text)).score / (MATCH * len(item)) if len(text) else 0
            if score >= 0.6:
                wanted[d, k] = score
    assert len(wanted) > 80 and sum(s < 0.7 for s in wanted.values()) > 15 and any(spare_groups(len(i), 0.6) > 4 for i in items)
    found = contaminated(spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id bigint, text string"),
                         spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id): r.similarity for r in found.collect()} == wanted


def test_spare_groups():
    assert [spare_groups(n, 0.6) for n in (1, 3, 8, 9, 10, 11, 15, 40)] == [0, 0, 0, 0, 0, 1, 0, 6]
    assert spare_groups(10, 1.0) == 7
