"""Odd inputs, and brute-force versions of what SQL cannot express."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from test_dedup import brute_jaccard, brute_suffix
from test_search_score_mix import corpus

from fathom.llm import counts, jaccard, mixing, stages, toxicity
from fathom.llm.substrings import suffix_dedup
from fathom.llm.tokens import LONGEST, PieceTokenizer

P = pytest.importorskip("public_tokenizers")
ODD_NAMES = ["meta.url", "__d", "__h", "__drop", "__full", "__source", "__keep", "__score", "__rejected", "wanted", "place", "c0", "full", "chunks", "position", "copy", "text_to_score", "_metadata"]


@pytest.fixture(scope="module")
def odd_docs(spark, tmp_path_factory):
    """Names that might clash, a language that is no string, and rows that share a doc_id."""
    folder = str(tmp_path_factory.mktemp("odd"))
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 7, "a"), (1, "a wholly different text with the same number as another one has", 7, "b"), (2, None, None, None), (3, "", 7, "a"), (None, "no number", 7, "a"), (4, text, 8, "a"), (5, "x y", 8, "a"), (5, "x y", 8, "a")]
    rows = [(*r, len(r[1] or ""), *(f"{n} {k}" for n in ODD_NAMES)) for k, r in enumerate(rows)]
    schema = "doc_id long, text string, lang int, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in ODD_NAMES)
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "packing"])
def test_stages(spark, odd_docs, name):
    folder, rows = odd_docs
    docs, stage = spark.read.parquet(f"{folder}/documents.parquet"), getattr(stages, name)
    got = stage(spark, docs, folder)
    if name == "packing":
        assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows)
    else:
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        found = Counter(map(tuple, got.collect()))
        gone = Counter(rows) - found
        # The copy of document 1 and one of the equal rows of document 5 go; nothing else, and nothing changes.
        assert not found - Counter(rows) and sorted(r[0] for r in gone.elements()) == ([4, 5] if name == "ngram_jaccard" else [])
    assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet").where("false"), folder).count() == 0


def test_packing_needs_files(spark):
    with pytest.raises(Exception, match="_metadata"):
        stages.packing(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "").count()


def brute_slots(blocks, weights):
    """(source, block) of each slot: earliest deadline first, ties to the larger weight, then the name."""
    order, left, had, out = sorted(weights, key=lambda s: (-weights[s], s)), dict(blocks), Counter(), []
    alive = [s for s in order if left[s]]
    while alive:
        whole, t, done = sum(weights[s] for s in alive), 0, Counter()
        while all(left[s] for s in alive):
            ready = [s for s in alive if done[s] * whole // weights[s] <= t]
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * whole // weights[s]), order.index(s)))
            out.append((s, had[s]))
            done[s], had[s], left[s], t = done[s] + 1, had[s] + 1, left[s] - 1, t + 1
        alive = [s for s in alive if left[s]]
    return out


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 200_000, "b": 77_777, "c": 3}])
def test_mixing_by_brute_force(spark, weights):
    sizes = {"a": 150, "b": 201, "c": 33}
    rows = [(i, f"t{i}", s) for s, n in sizes.items() for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), weights, block_rows=4, cycle=16).collect()
    slots = brute_slots({s: -(-n // 4) for s, n in sizes.items()}, weights)
    assert sorted((r.slot, r.source, r.block, r.doc_id, r.position) for r in got) == sorted((t, s, b, 4 * b + k, 4 * t + k) for t, (s, b) in enumerate(slots) for k in range(4) if 4 * b + k < sizes[s])


def test_targets_of_the_query(spark):
    """Without weights the whole query follows rows ** ALPHA; deviation stays under one block."""
    rows = [(i, f"t{i}", s) for s, n in {"a": 900, "b": 100, "c": 9}.items() for i in range(n)]
    got = sorted(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_rows=4).select("slot", "source", "phase").distinct().collect())
    weights = mixing.targets({"a": 900, "b": 100, "c": 9}, None)
    whole, had = sum(weights.values()), Counter()
    for t, r in enumerate(x for x in got if x.phase == 0):
        had[r.source] += 1
        assert r.slot == t and all(abs(had[s] * whole - weights[s] * (t + 1)) < whole for s in weights)


def test_plan_of_many_sources():
    start = time.process_time()
    blocks = {f"s{i}": 1 + i % 50 for i in range(5000)}
    planned = Counter()
    for p in mixing.pieces(blocks, mixing.targets(blocks, None)):
        planned[p["source"]] += p["n"]
    assert planned == blocks and time.process_time() - start < 30


def test_toxicity_forward_pass(spark):
    """Every score against a plain loop over the trained weights."""
    rows, labels = corpus(500)
    rows += [(9000, None, "en", "s"), (9001, " ", "en", "s"), (9002, "word", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.fit_model(docs, known)
    assert m.trained
    import pyarrow as pa

    def score(text):
        words = (text or "").split()
        if not words:
            return 1 / (1 + np.exp(40))
        x = m.table[toxicity.features(pa.array(words))].astype(float).sum(1)
        z, k = float(m.out_bias), 0
        for f in m.filters:
            for j in range(f.shape[2]):
                best = max(sum(float(x[i + w] @ f[w][:, j]) for w in range(len(f)) if i + w < len(x)) for i in range(len(x)))
                z += max(best + float(m.bias[k]), 0.0) * float(m.out[k])
                k += 1
        return 1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -40, 40)))

    texts = {r[0]: r[1] for r in rows}
    for r in toxicity.toxicity(docs, known).collect():
        expected = score(texts[r.doc_id])
        assert abs(r.score - expected) < 1e-4 and (r.predicted == (expected >= 0.3) or abs(expected - 0.3) < 1e-4)
    kept = {r.doc_id for r in toxicity.clean(docs, known).collect()}
    assert kept == {r.doc_id for r in toxicity.toxicity(docs, known).where("NOT rejected").collect()} and kept != set(texts)


def test_jaccard_in_many_buckets(spark, monkeypatch):
    """Two steps of dealing, lists dealt by class, and one broadcast class give the same as brute force."""
    for name, value in (("BUCKET_BYTES", 300), ("WAYS", 8), ("HEAVY", 4), ("LARGEST", 1), ("FAN", 2), ("GROUP", 64)):
        monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    passage = [rnd.choice(words) for _ in range(50)]
    base = [[rnd.choice(words) for _ in range(60)] for _ in range(4)]
    rows = [(100 + i, " ".join(base[0])) for i in range(12)] + [(900, "very long " * 40_000)]
    for i in range(90):
        b = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 2, 9])):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        rows.append((i, " ".join(b + (passage if i % 3 else []))))
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, d int, fp string").repartition(6)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == brute_jaccard(rows)


def test_suffix_dedup_of_long_texts(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, long), (2, long[30_000:] + "tail"), (3, "x" * 20_000)]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, p int, kind string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, group_bytes=20_000).collect()]
    assert sorted(got, key=repr) == brute_suffix(rows, 50)


def test_memos_are_bounded_in_bytes(monkeypatch):
    rnd = random.Random(3)
    runs = ["".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(rnd.choice([20, 200, 5000]))) for _ in range(400)]
    tok = PieceTokenizer(P.path("byte_bpe_50k.json"), memo_bytes=50_000)
    for r in runs:
        tok.encode([r + " " + r[:10]])
        assert max(map(len, tok.memo), default=0) <= LONGEST + 2 and sum(len(k) + len(v) for k, v in tok.memo.items()) < 60_000
    monkeypatch.setattr(counts, "MEMO_BYTES", 20_000)
    c = counts.UnigramCounter([("<unk>", -9.0), ("a", -1.0)])
    for r in runs:
        c.text(r)
        assert len(c) * counts.ENTRY < 21_000


def test_binary_output_of_odd_ids(spark):
    from tokenizers import Tokenizer

    from fathom.llm.tokenio import export_tokens, read_documents

    path = P.path("byte_bpe_50k.json")
    rows = [(None, "null one"), (None, None), (5, "five"), (5, "five"), (5, "other"), (-1, "minus " * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_documents(spark, *export_tokens(df, path, seq_len=64, rows=2)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -1, 5, 5, 5]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    t = Tokenizer.from_file(path)
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]
    expected = Counter((d, len(ids(x)), zlib.crc32(np.array(ids(x), "<u4").tobytes())) for d, x in rows)
    assert Counter((r[0], r[2], r[3]) for r in got) == expected


def test_counts_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2), (2, None, 3)], "doc_id long, text string, n_words int")
    got = counts.token_counts(df, P.path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id, r.n_words) for r in got) == [(1, 2), (1, 2), (2, 0)]
    assert counts.token_counts(df.where("false"), P.path("piece_bpe_32k.model")).count() == 0
