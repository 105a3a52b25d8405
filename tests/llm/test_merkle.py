"""The Merkle manifest against a plain recursive version, on odd rows, deep trees, many ties and many sources."""

import hashlib
import random
import zlib

import duckdb
import pytest

from fathom.llm import merkle, queries

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climbed(level, fanout):
    """The root, and for each leaf its list of (before, after)."""
    ways, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for way, i in zip(ways, at):
            run = runs[i // fanout]
            way.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        at, level = [i // fanout for i in at], [h(*run) for run in runs]
    return level[0], ways


def brute(rows, fanout=16):
    """(doc_id, source, leaf, subroot, root, proof, folded, verified), sorted."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    if not trees:
        return []
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done[s] = climbed([leaf(r) for r in trees[s]], fanout)
    root, over = climbed([done[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, over):
        for r, way in zip(trees[s], done[s][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if hit else r[4]
            fold = leaf((*r[:4], text))
            for a, b in [*way, *up]:
                fold = h(a, fold, b)
            out.append((r[0], r[1], leaf(r), done[s][0], root, h(*(a + b for a, b in [*way, *up])), fold, fold == root))
    return sorted(out, key=repr)


def run(docs, **options):
    got = merkle.verified(merkle.manifest(docs, merkle.tampered(docs), **options))
    return sorted([(r.doc_id, r.source, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()], key=repr)


def odd_rows():
    rng = random.Random(3)
    rows = [(i * 37 - 4000, f"s{rng.randrange(3)}", "en", i, f"Text {i} É") for i in range(300)]
    rows += [(None, "s0", None, None, None), (None, None, "de", 3, "No number"), (7, None, "de", None, ""), (2**63 - 1, "s1", "x", 1, "Last"), (-(2**63), "s1", "x", 1, "First"), (5, "alone", "y", 0, "A" * 200_000)]
    rows += [(9, "s0", "en", 4, "Same")] * 40 + [(9, "s0", "en", k, "Other") for k in range(70)]
    return rows


@pytest.mark.parametrize("options", [{}, {"fanout": 2, "bucket": 1}, {"fanout": 3, "bucket": 50}])
def test_brute_force(spark, options):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{FIELDS}, `tree.n` string, size int").repartition(5)
    assert run(docs, **options) == brute(rows, options.get("fanout", 16))


def test_many_sources_and_small_tables(spark):
    rows = [(i, f"host{i % 600}", "en", 1, f"T{i}") for i in range(1300)]
    assert run(spark.createDataFrame(rows, FIELDS)) == brute(rows)
    for rows in ([], [(1, None, None, None, None)], [(1, "a", "en", 1, "Aa"), (1, "a", "en", 1, "Aa")]):
        assert run(spark.createDataFrame(rows, FIELDS)) == brute(rows)


def test_ranks_need_no_sort_and_keep_buckets_small(spark):
    """One document id with very many texts: its bucket gets more digits, the ranks stay dense."""
    rows = [(4, "a", "en", k, f"t{k}") for k in range(3000)]
    found = merkle.manifest(spark.createDataFrame(rows, FIELDS), bucket=100).select("rank").collect()
    assert sorted(r[0] for r in found) == list(range(3000))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want, got = con.sql(queries.ORACLE_SQL["op11_merkle"]).df(), queries.QUERIES["op11_merkle"](spark, SF).toPandas()[con.sql(queries.ORACLE_SQL["op11_merkle"]).columns]
    assert sorted(map(tuple, want.itertuples(index=False))) == sorted(map(tuple, got.itertuples(index=False)))
    assert 0 < got.verified.mean() < 1
