"""Repeated passages where names, runs and periods are hard, against a plain version."""

import random

import pytest

from dyadloom.llm import substring


def plain(docs, width):
    """(n_words, n_removed, kept) of each row, all windows in order of (doc_id, start)."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, substring._tie((docs[k][1] or "").encode())))
    seen, out = set(), {}
    for k in order:
        words = (docs[k][1] or "").encode().split()
        gone = set()
        for s in range(len(words) - width + 1):
            w = tuple(words[s : s + width])
            if w in seen:
                gone.update(range(s, s + width))
            seen.add(w)
        out[k] = (docs[k][0], len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return sorted(out.values(), key=repr)


def rows(spark, docs, width=20, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(df, width).collect()), key=repr)


def test_words_that_defeat_polynomial_names(spark):
    morse = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    side = [" ".join(f"{s}{k}" for k in range(25)) for s in "xy"]
    docs = [(1, f"{side[0]} {morse} {side[1]}"), (2, f"{side[0]} {other} {side[1]}")]
    assert [r[2] for r in rows(spark, docs)] == [0, 50]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_periods_and_few_words(spark, seed):
    rng = random.Random(seed)
    docs = [(1, "a " * 70), (2, "a " * 45 + "b"), (3, "a b " * 40), (4, "b " + "a b " * 25), (5, "a b c " * 30 + "a " * 30)]
    for k in range(6, 60):
        words = [rng.choice("abcd" if k % 2 else "a" * 6 + "b") for _ in range(rng.randrange(0, 90))]
        docs.append((k, " ".join(words)))
    text = [f"w{rng.randrange(400)}" for _ in range(3000)]
    for k in range(60, 120):
        s = rng.randrange(0, 2900)
        docs.append((k, " ".join(text[s : s + rng.randrange(5, 120)] + [f"n{rng.randrange(9)}" for _ in range(rng.randrange(0, 30))] + text[s // 2 : s // 2 + 40])))
    for width in (20, 7):
        assert rows(spark, docs, width) == plain(docs, width)


def test_repeated_ids_whatever_the_splits(spark):
    one, two = (" ".join(f"w{k}" for k in range(a, a + 60)) for a in (0, 20))
    docs = [(7, one), (7, two), (7, one), (None, two), (None, None), (3, ""), (7, None)]
    first = rows(spark, docs, parts=1)
    assert first == plain(docs, 20) == rows(spark, docs, parts=5)
    assert substring.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_text_and_other_columns(spark):
    long = " ".join(f"w{k % 5000}" for k in range(300_000))
    df = spark.createDataFrame([(1, long, "x", 0), (2, long[:2000], "y", 1)], "doc_id long, text string, batch string, bucket int")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.without_repeats(df).collect()}
    assert got[1] == (300_000, 295_000 - 19 + 19)
    assert got[2][1] >= got[2][0] - 1
