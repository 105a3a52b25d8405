"""Rows that share a doc_id with different texts: each text follows its own links, and none is lost."""

import hashlib
import random
from collections import Counter

import pytest
from test_dedup import brute_jaccard

from fathom.llm import jaccard, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, own_number string"


def brute(rows):
    """For each row (n_shingles, the number of its component's smallest (doc_id, text)), and those numbers' doc_ids."""
    keys = sorted({(d, t or "") for d, t in rows if d is not None}, key=lambda k: (k[0], hashlib.sha256(k[1].encode()).hexdigest()))
    number = {k: i for i, k in enumerate(keys)}
    found = brute_jaccard([(i, t) for (_, t), i in number.items()])
    return {k: found[i] for k, i in number.items()}, keys


def words(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def near(rng, text):
    w = text.split()
    w[rng.randrange(len(w))] = "other"
    return " ".join(w)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    a, b = words(rng, 60), words(rng, 60)
    small = [(0, a), (1, near(rng, a)), (1, b), (2, words(rng, 60))]
    bases = [words(rng, rng.choice([4, 30, 80])) for _ in range(12)]
    many = [(rng.randrange(25), near(rng, rng.choice(bases)) if rng.random() < 0.7 else rng.choice(bases)) for _ in range(110)]
    many += [(3, None), (3, ""), (None, bases[0]), (None, None)] + many[:10]
    return {"small": small, "many": many}


@pytest.mark.parametrize("name", ["small", "many"])
def test_components_and_stage(spark, cases, name):
    rows = cases[name]
    want, keys = brute(rows)
    docs = spark.createDataFrame([(d, t, "en", f"s{k % 3}", k, "x") for k, (d, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    by_row = Counter((d, want[d, t or ""][0], keys[want[d, t or ""][1]][0]) for d, t in rows if d is not None)
    assert Counter({k: n for k, n in got.items() if k[0] is not None}) == by_row and sum(got.values()) == len(rows)
    kept = stages.ngram_jaccard(spark, docs, "")
    assert kept.columns == docs.columns
    blank = lambda d, t: d is None or not (t or "").strip()
    expected = Counter((d, t) for d, t in rows if blank(d, t))
    expected.update({(d, t) for d, t in rows if not blank(d, t) and keys[want[d, t][1]] == (d, t)})
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == expected


def test_numbers_only_where_needed(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "d")], "doc_id long, text string")
    assert jaccard.numbers_apart(docs) is None
    assert [r.number for r in jaccard.numbers_apart(docs.unionByName(docs.selectExpr("doc_id", "'z' AS text"))).orderBy("doc_id", "number").collect()] == [0, 1, 2, 3]
