"""Repeated lines against a plain version."""

import random

import pytest

from tabloom.llm.line_dedup import drop_repeated_lines


def near(a, b):
    """Edit distance of at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def plain(rows, edits):
    seen, out = [], []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        kept = []
        lines = (text or "").split("\n")
        for line in lines:
            if not line.strip(" "):
                kept.append(line)
                continue
            if not any(line == s or edits and min(len(s), len(line)) >= 16 and near(s, line) for s in seen):
                kept.append(line)
            seen.append(line)
        out.append((i, "\n".join(kept), len(lines), len(kept)))
    return out


def changed(rng, line):
    k = rng.randrange(len(line) + 1)
    return rng.choice([line[:k] + rng.choice("abé\U0001f600") + line[k:], line[:k] + line[k + 1:],
                       line[:k] + rng.choice("xyz ") + line[k + 1:]])


@pytest.mark.parametrize("edits", [0, 1])
def test_against_plain(spark, edits):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in [0, 1, 5, 14, 15, 16, 17, 18, 31, 32, 33, 60, 255, 256,
            257, 258, 511, 512, 513, 514, 770, 1200] * 2] + ["a" * 40, "ab" * 200, "same line of text here"] * 2
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 9)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                line = changed(rng, line)
            lines.append(line)
        rows.append((i - 5, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "same line of text here\n" * 50), (None, "same line of text her\nnew at last!"),
             (104, "y" * 70_000), (105, "y" * 35_000 + "z" + "y" * 35_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, line string, version int").repartition(4)
    got = sorted((tuple(r) for r in drop_repeated_lines(docs, edits).collect()), key=str)
    assert got == sorted(plain(rows, edits), key=str)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "one line that is long\nand another one here")] * 3 + [(2, "one line that is lonk")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in drop_repeated_lines(docs).collect())
    assert got == [(1, rows[0][1], 2, 2)] * 3 + [(2, "", 1, 0)]
    assert drop_repeated_lines(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        drop_repeated_lines(docs, max_edits=2)
