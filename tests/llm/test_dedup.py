"""Suffix dedup (2), line dedup (5) and the Jaccard join (6) against brute force and SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from fathom.llm import jaccard, linededup
from fathom.llm.queries import ORACLE_SQL, QUERIES
from fathom.llm.substrings import suffix_dedup
from fathom.llm.suffixarray import equal_prefixes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdef"])
def test_suffix_order(alphabet):
    rnd = random.Random(len(alphabet))
    text = "".join(rnd.choice(alphabet) for _ in range(600)).encode() * 2
    a, length = np.frombuffer(text, np.uint8), 50
    at = np.array(sorted(rnd.sample(range(len(text) - length), 500)))
    order, group = equal_prefixes(a, at, length)
    words = [text[p : p + length] for p in at[order]]
    assert words == sorted(words)
    assert [x != y for x, y in zip(words, words[1:])] == (np.diff(group) > 0).tolist()


def brute_suffix(rows, length):
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), set()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen and seen[w] != d:
                gone[i : i + length] = b"\1" * length
            own.add(w)
        for w in own:
            seen.setdefault(w, d)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"group_bytes": 3000}, {"group_bytes": 3000, "hot": 2}])
def test_suffix_dedup(spark, limits):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("ab c") for _ in range(400)) for _ in range(6)]
    rows = [(None, base[0][:120]), (7000, None), (7001, ""), (7002, "q" * 3000), (7003, "q" * 200 + "é" * 60), (9000, base[1]), (9000, base[1])]
    for i in range(150):
        text = ""
        for _ in range(rnd.randint(0, 5)):
            x, a = rnd.choice(base), rnd.randint(0, 350)
            text += x[a : a + rnd.randint(1, 120)] + "z" * rnd.choice([0, 0, rnd.randint(1, 90)])
        rows.append((i * 3, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, **limits).collect()]
    assert sorted(got, key=repr) == brute_suffix(rows, 50)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_lines(rows):
    lines = {d: (t or "").split("\n") for d, t in sorted(set(rows))}
    first = {}

    def parts(d):
        x = lines[d]
        yield from ((i, i + 1, (x[i], x[i + 1])) for i in range(len(x) - 1))
        yield from ((i, i, x[i]) for i in range(len(x)) if len(x[i].encode()) >= linededup.LONG)

    for d in lines:
        for s, _, body in parts(d):
            first[body] = min(first.get(body, (d, s)), (d, s))
    out = {}
    for d, x in lines.items():
        track, single = {}, set()
        for s, e, body in parts(d):
            at = first[body]
            if at != (d, s) and not (e > s and at == (d, s - 1)):
                if e > s:
                    track[s] = (at[0], at[1] - s)
                else:
                    single.add(s)
        inner = {i for i in track if i - 1 in track and i + 1 in track and track[i - 1] == track[i + 1] != track[i]}
        bridge = {i for i in inner if not {i - 1, i + 1} & inner}
        even = lambda i: x[i] == x[i + 1]  # noqa: B023, E731
        runs = []
        for i in sorted(track):
            goes_on = i - 1 in track and (track[i] == track[i - 1] or (even(i) and even(i - 1)) or i in bridge or i - 1 in bridge)
            if goes_on:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        gone, end = set(), -1
        for s, e in runs:
            s = max(s, end + 1)
            if e > s:
                end = e
                single -= set(range(s, e + 1))
                if len("\n".join(x[s : e + 1]).encode()) >= linededup.MIN_BYTES:
                    gone.update(range(s, e + 1))
        gone |= single
        out[d] = "\n".join(y for i, y in enumerate(x) if i not in gone)
    return out


def test_chunks_stand_elsewhere_as_a_whole(spark):
    """P,Q and Q,R stand elsewhere, P,Q,R does not; of a run with a pair that stands elsewhere earlier still all goes."""
    p, q, r, s, t = (f"{c} line of some forty bytes, {c} as in the alphabet" for c in "pqrst")
    rows = [(1, [p, q]), (2, [q, r]), (3, [p, q, r]), (4, [r, s, t, p]), (5, ["a b", r, s, t, p, "c d"])]
    rows += [(6, [q, r, s, t, "e f"]), (7, ["only here", q, r, s, t, "here, too"]), (8, [t, s]), (9, [s, r]), (10, [t, s, r, "end"])]
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in rows], "doc_id long, text string")
    got = {x.doc_id: x.text for x in linededup.line_dedup(df).collect()}
    assert got[3] == r and got[5] == "a b\nc d" and got[7] == "only here\nhere, too" and got[10] == f"{r}\nend"
    more = df.unionByName(spark.createDataFrame([(100 + i, f"unrelated {i}\nlines {i * i}\nof another text") for i in range(30)], df.schema))
    assert {x.doc_id: x.text for x in linededup.line_dedup(more).where("doc_id < 100").collect()} == got
    assert got == brute_lines([(d, "\n".join(x)) for d, x in rows])


@pytest.mark.parametrize("hash_", [linededup.HASH, "pmod(xxhash64({}), 7L)"])  # the second one has collisions all over
def test_line_dedup(spark, monkeypatch, hash_):
    monkeypatch.setattr(linededup, "HASH", hash_)
    rnd = random.Random(3)
    pool = ["line number %d with some words" % i for i in range(12)] + ["", "x", "é" * 30, "long " * 50, "longer " * 60]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for i in range(80)]
    rows += [(100, "only\nonce " * 30), (101, ""), (102, "x\n" * 50), (103, "the same line of over forty bytes in a row\n" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.line_dedup(df).collect()} == brute_lines(rows)
    extra = df.selectExpr("doc_id", "text", "length(text) AS n_chars", "1 AS lines", "2 AS `drop`", "3 AS c0", "4 AS full", "5 AS `meta.url`", "6 AS chunks", "7 AS __full")
    out = linededup.deduplicated(extra)
    assert out.columns == extra.columns and out.where("n_chars <> length(text) OR lines <> 1 OR c0 <> 3 OR full <> 4 OR chunks <> 6 OR __full <> 7").count() == 0


def test_line_passages(spark):
    """Passages of over 50 words go whole, in however many lines, wherever they stand; what is around them stays."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9)))
    passages = []
    for n in range(1, 7):
        words = [word() for _ in range(60)]
        passages.append("\n".join(" ".join(words[60 * k // n : 60 * (k + 1) // n]) for k in range(n)))
    rows, own = [], {}
    for i in range(90):
        before, after = ["\n".join(" ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))) for _ in range(2)]
        rows.append((i, f"{before}\n{passages[i % 6]}\n{after}"))
        own[i] = rows[-1][1] if i < 6 else f"{before}\n{after}"
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == own


def test_line_dedup_edges(spark):
    text = "\n".join(f"this is a repeated line {i}" for i in range(12))
    df = spark.createDataFrame([(1, text), (1, text), (1, "other\n" + text), (2, text), (3, None), (None, "x"), (4, ""), (5, text + "\n" + "y z\n" * 50_000)], "doc_id long, text string")
    got = linededup.line_dedup(df).collect()
    assert len(got) == 8
    assert sorted(r.text for r in got if r.doc_id == 1) in (["other", text, text], ["", "", "other\n" + text])
    assert [(r.n_removed_chunks, r.n_removed_lines, r.text) for r in got if r.doc_id == 2] == [(1, 12, "")]
    assert [len(r.text) for r in got if r.doc_id == 5] == [8]  # y z, y z and the empty line at the end
    assert linededup.line_dedup(df.where("false")).count() == 0
    plan = linededup.line_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_jaccard(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("crowd", [jaccard.CROWD, 2])
def test_jaccard(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([3, 4, 5, 6, 20, 80, 200]))] for _ in range(25)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows = [(900, None), (901, " \t"), (902, "A b"), (903, "a B"), (904, "É b c d"), (905, "é b c d")]
    for i in range(220):
        b = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 8])):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        if rnd.random() < 0.3:
            b += passage
        rows.append((i, rnd.choice([" ", "\n"]).join(b).title() if rnd.random() < 0.2 else " ".join(b)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == brute_jaccard(rows)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == [(3, 3), (5, 3), (5, 3), (None, None)]
    assert jaccard.jaccard_components(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    a, b = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(a[columns].itertuples(index=False, name=None)) == sorted(b[columns].itertuples(index=False, name=None))
