import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, digest int, TEXT int, `a.b` int, size int, kept string, component int"


@pytest.fixture(scope="session")
def make(spark):
    """make([(doc_id, text, source), ...]): documents with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, s, None, "x", 1, 2, 3, 4, 5, None, 6) for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n invented words."""
    syllables = "ka lo mi ten dor vel sa ri gu pon er ath ing".split()

    def prose(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n))

    return prose


@pytest.fixture(scope="session")
def corpus(prose):
    """Rows (doc_id, text, source): copies, near copies, ties, nulls, empties, long texts, repeated rows."""
    rows = [(i, prose(i, 40 + i % 60), f"s{i % 5}") for i in range(120)]
    for i in range(20):  # near copies, some of them copies of each other but for case
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows += [(200 + i, " ".join(w), "s1"), (300 + i, " ".join(w).upper(), None)]
    passage = prose(999, 60)
    rows += [(400 + i, passage + " " + prose(5000 + i, 30), "s2") for i in range(45)]
    rows += [(500 + i, rows[0][1], "s0") for i in range(40)]
    rows += [(600, None, None), (601, "", "s1"), (602, "   \n", "s1"), (603, "one two", "s3"), (604, "One TWO", "s3"), (605, prose(77, 9000), "s4"), (606, "x" * 70000, "s4"), (None, "no id at all here now", "s0"), (None, None, None), (607, "twice the same row again", "s0"), (607, "twice the same row again", "s0")]
    return rows
