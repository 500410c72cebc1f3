"""Fingerprints, links and components against plain versions."""

import random

import xxhash

from tabloom.llm import components as components_module
from tabloom.llm import simhash
from tabloom.llm.common import stored
from tabloom.llm.components import components
from tabloom.llm.simhash import drop_near_copies, fingerprint, linked, near_groups


def plain_fingerprint(text, words):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found, word = [], ""
    for c in lowered + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            found, word = found + [word] * bool(word), ""
        else:
            word += c
    if not found:
        return 0
    n = min(words, len(found))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i:i + n]).encode(), 42) for i in range(len(found) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for text in ("", " \t\n", "One", "one TWO", "a b c d e f g", "É é x y ÀB " * 40, "w " * 70000):
        assert fingerprint(text, 3) == [plain_fingerprint(text, 3)]
    assert len(set(fingerprint("some words to hash here", 2, 4))) == 4


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    values = []
    for _ in range(40):
        base = rng.getrandbits(64)
        values.append(base)
        for _ in range(6):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << bit
            values.append(x)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values + [0, 1, 3, 7, (1 << 64) - 1]})
    fps = spark.createDataFrame([(d, v) for d in (0, 3) for v in values], "draw int, fp bigint")
    for bits in range(6):
        want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        got = [tuple(r) for r in linked(fps, bits).collect()]
        assert len(got) == len(set(got)) and set(got) == {(d, a, b) for d in (0, 3) for a, b in want}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 560)] + [(7, 7), (3, None)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    proper = [(a, b) for a, b in links if b is not None and a != b]
    want = plain_components({n for link in proper for n in link}, proper)
    assert {r.node: r.root for r in components(df).collect()} == want
    assert components(df.where("false")).count() == 0


def test_near_groups(spark):
    rng = random.Random(1)
    vocabulary = ["w%d" % i for i in range(500)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(150, 400))]
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(" ".join(other))
    texts += ["", None, "  ", "one", "One", "x" * 300000, texts[0], texts[0]]
    rows = [(i * 3 + 5, t, "clash") for i, t in enumerate(texts)] + [(None, texts[1], "clash"), (5, texts[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(3)
    prints = {i: plain_fingerprint(t, 3) for i, t, _ in rows if i is not None}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = plain_components(prints, links)
    by_print = {prints[i]: r for i, r in roots.items()}
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_groups(docs).collect()), key=str)
    want = sorted(((i, f"{plain_fingerprint(t, 3):016x}", by_print[plain_fingerprint(t, 3)]) for i, t, _ in rows), key=str)
    assert got == want
    assert near_groups(docs.where("false")).count() == 0


def test_drop_near_copies(spark):
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows, groups = [], []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for k in range(4):
            other = list(base)
            for _ in range(k):
                other[rng.randrange(300)] = "changed"
            rows.append((g * 10 + k, " ".join(other), "x"))
        groups.append(g * 10)
    rows += [(None, "no id", "x"), (999, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, least string")
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert ids == {*groups, None, 999}
    assert drop_near_copies(docs.where("false")).count() == 0


def test_links_of_all_draws_count(spark):
    rng = random.Random(0)
    vocabulary = ["w%d" % i for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for k in range(100):
        other = list(base)
        for _ in range(2 if k else 0):
            other[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((k, " ".join(other)))
    prints = {i: fingerprint(t, 5, 14) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b
             and any((x ^ y).bit_count() <= 5 for x, y in zip(prints[a], prints[b]))]
    want = set(plain_components(prints, links).values())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == want == {0}


def test_dense_groups_give_few_links(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    rows = []
    for k in range(250):
        other = list(base)
        for _ in range(2):
            other[rng.randrange(400)] = rng.choice(vocabulary)
        rows.append((k, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = []

    def counted(*args, **options):
        found = linked(*args, **options)
        made.append(found.count())
        return found

    monkeypatch.setattr(simhash, "linked", counted)
    assert [r.doc_id for r in drop_near_copies(docs).collect()] == [0]
    prints = [fingerprint(t, 5, 2) for _, t in rows]
    close = sum(any((x ^ y).bit_count() <= 5 for x, y in zip(p, q)) for i, p in enumerate(prints) for q in prints[:i])
    assert close > 25 * len(rows) and sum(made) < 10 * len(rows)


def test_groups_are_kept_between_steps(spark, monkeypatch):
    # 0 and 2 meet in the first draw, nothing in the next six, 1 and 2 in the last ones: then 1 is a copy of 0
    far = [[(0x0123456789ABCDEF * (7 * i + 3 * d + 1) ^ i << 40) & 0x7FFFFFFFFFFFFFFF for d in range(14)] for i in range(3)]
    far[2][0], far[2][12] = far[0][0], far[1][12]
    rows = spark.createDataFrame(list(enumerate(far)), "doc_id bigint, fps array<bigint>")
    monkeypatch.setattr(simhash, "fingerprints", lambda *args: rows)
    docs = spark.createDataFrame([(i, "x") for i in range(3)], "doc_id bigint, text string")
    assert [r.doc_id for r in drop_near_copies(docs).collect()] == [0]


def test_steps_store_few_tables(spark, monkeypatch):
    # what the driver holds grows with the number of tables, plans and stages, not with the rows
    made = []

    def counted(df, name):
        made.append(name)
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", counted)
    monkeypatch.setattr(components_module, "stored", counted)
    stars = spark.createDataFrame([(1, 2), (3, 1), (7, 9), (9, 7), (7, 9)], "a bigint, b bigint")
    assert sorted(map(tuple, components(stars).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]
    assert len(made) == 2
    made.clear()
    far = [[(0x0123456789ABCDEF * (7 * i + 3 * d + 1) ^ i << 40) & 0x7FFFFFFFFFFFFFFF for d in range(14)] for i in range(6)]
    far[2][0], far[2][12], far[5][1], far[5][7] = far[0][0], far[1][12], far[4][1] ^ 7, far[3][7] ^ 31
    rows = spark.createDataFrame(list(enumerate(far)), "doc_id bigint, fps array<bigint>")
    monkeypatch.setattr(simhash, "fingerprints", lambda *args: rows)
    docs = spark.createDataFrame([(i, "x") for i in range(6)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [0, 3]
    assert len(made) <= 30
