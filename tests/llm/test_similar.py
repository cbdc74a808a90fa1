"""Near copies by exact Jaccard similarity, against all pairs."""

import random
import re

import pytest

from dyadloom.llm import queries, similar

DOCS = "doc_id long, text string, lang string"


def _runs(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def _kept(rows):
    """The least doc_id of each component of all pairs of similarity 0.8 or more."""
    sets, root = [_runs(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            few, many = sorted((len(sets[a]), len(sets[b])))
            if 5 * few < 4 * many:
                continue
            both = len(sets[a] & sets[b])
            if (sets[a] == sets[b]) or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return sorted((min((i for i in ids if i is not None), default=None) for ids in least.values()), key=str)


def _changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 300))]
        out += [" ".join(words), " ".join(words).upper(), *(_changed(rng, words, n) for n in (1, 1, 2, 3, 4, 5, 6, 8))]
    # 4 of 5 runs shared is near enough, 3 of 4 is not
    out += ["a b c d e f g h", "a b c d e f g h i", "p q r s t u v", "p q r s t u v w"]
    out += [None, "", " \t\n", "one", "one two", "one two"]
    named = [(k, t) for k, t in enumerate(out)]
    return [*named, named[4], (5, "another text of the same id as one above"), (None, out[0]), (None, "no id and alone here"), (None, "no id and alone here")]


def test_one_of_each_group(spark, rows):
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).repartition(5)
    kept = queries.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id for r in got), key=str) == _kept(rows)
    assert {(r.doc_id, r.text) for r in got} <= set(rows)
    assert queries.keep_one_of_each(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_stage_agrees_with_all_pairs_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(r.doc_id for r in queries.keep_one_of_each(spark, docs, "").collect())
    assert sorted(got, key=str) == _kept([(r.doc_id, r.text) for r in docs.collect()])
