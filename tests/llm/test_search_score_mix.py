"""Searches (3, 7), toxicity (4), mixing (10) and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.llm import hnsw, mixing, mtree, toxicity

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=700, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    v = centres[rng.integers(0, 8, n)] + 0.3 * rng.normal(size=(n, dim))
    v[50:150] = v[50]  # many equal vectors
    v = v.astype(np.float32)
    rows = [(i, v[i].tolist(), 0) for i in range(n)]
    odd = [(10_000, None, 0), (10_001, [float("nan")] * dim, 0), (10_002, [float("inf")] * dim, 0), (10_003, [None] * dim, 0), (10_004, [], 0), (10_100, [1.0, 2.0], 0), (10_005, [0.0] * dim, 0), (700, v[0].tolist(), 1), (700, v[1].tolist(), 1)]
    return spark.createDataFrame(rows + odd, VECTORS), [r for r in rows + odd if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]


def brute(rows, k, score, best):
    out = {}
    for q, v, _ in rows:
        if q % 100 == 0:
            hits = [(score(v, w), i) for i, w, _ in rows if i != q and len(w) == len(v)]
            out.setdefault(q, []).extend((best * s, i) for s, i in hits)
    return {q: [(best * s, i) for s, i in sorted(v)[:k]] for q, v in out.items()}


@pytest.mark.parametrize("limits", [{}, {"shard_size": 200}])
def test_exact_search(spark, limits):
    df, rows = vectors(spark)
    product = lambda a, b: int((np.floor(1024 * np.array(a, float)) * np.floor(1024 * np.array(b, float))).sum())
    got = defaultdict(list)
    for r in mtree.top_k(df, mtree.every(100), 10, **limits).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    expected = brute(rows, 10, product, -1)
    assert got == {q: v for q, v in expected.items() if v}


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    centres = 20 * rng.normal(size=(40, 3))
    v = np.concatenate([c + 0.01 * rng.normal(size=(100, 3)) for c in centres])
    t, counter = mtree.build(np.arange(len(v)), v), {}
    mtree.search(t, np.arange(50), v[:50], 10, counter)
    assert counter["distances"] < 0.6 * 50 * len(v)


@pytest.mark.parametrize("limits", [{}, {"shard_size": 200}])
def test_near_search(spark, limits):
    df, rows = vectors(spark)
    rows = [r for r in rows if any(r[1])]
    distance = lambda a, b: float(np.sqrt(((np.array(a, float) - np.array(b, float)) ** 2).sum()))
    got = defaultdict(list)
    for r in hnsw.nearest(df, mtree.every(100), 10, **limits).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    expected = {q: v for q, v in brute(rows, 10, distance, 1).items() if v}
    assert got.keys() == expected.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    assert got[100] == expected[100]  # its nearest are equal vectors: ties by id


@pytest.mark.parametrize("offset, huge, n", [(0, 0, 3000), (1e4, 0, 3000), (1e9, 0, 1000), (0, 1e30, 1000), (0, 0, 200)])
def test_graph_recall(offset, huge, n):
    """Neither a common offset, nor a huge row, nor a small shard, which goes through the graph, too, hurts."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(n, 32)) + offset
    if huge:
        v[n // 2] = huge
    t = hnsw.build(np.arange(n), v)
    asked = [i for i in range(0, n, 30) if i != n // 2]
    q, c, _ = hnsw.search(t, np.array(asked), v[asked], 10)
    found = defaultdict(set)
    for a, b in zip(q, c):
        found[a].add(b)
    hits = 0
    for i in asked:
        d = ((v - v[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(found[i] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(asked)


def test_search_moves_queries_only(spark):
    """An index is read by the one task of its shard: neither a join nor a copy of it is in the plan."""
    df, _ = vectors(spark, 400)
    extra = df.withColumns({"index": F.lit("x"), "shard": F.lit(9), "query_id": F.lit(1), "meta.url": F.lit("y")})
    out = mtree.top_k(extra, mtree.every(100), 3, shard_size=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate explode") == 1
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mtree.top_k(df, mtree.every(100), 3).collect()))
    near = hnsw.nearest(extra, mtree.every(100), 3, shard_size=100)
    assert near.count() == out.count()


def test_searches_of_empty_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert mtree.top_k(empty, mtree.every(100)).count() == 0 and hnsw.nearest(empty, mtree.every(100)).count() == 0


def corpus(n=900):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(5, 80))]
        toxic = rnd.random() < 0.25
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "Rotten,", "scumbag", "scumball"]))
        rows.append((i, " ".join(words), "de" if i % 3 else "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = corpus()
    odd = [(5000, None, "en", "s"), (5001, "", "en", "s"), (5002, "clean " * 30_000 + "vile", "de", "s"), (5003, "clean words only here", None, "s"), (0, rows[0][1], "de", "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.93 * len(held)
    by = {r.doc_id: r for r in got}
    assert not by[5000].predicted and not by[5001].rejected and by[5002].predicted
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.withColumn("lang", F.lit("xx")).drop("source"), known).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)  # no score depends on them


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()] == [(0.0, 0)]
    assert toxicity.toxicity(docs.where("false"), none).count() == 0


def test_toxicity_learns_all_labelled_rows(spark, monkeypatch):
    """Counts are those of every row that is not held out, also of rows larger than the driver's sample takes; a word that
    is in no sampled row is learned."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 8 * 300)
    counted = []
    monkeypatch.setattr(toxicity, "count_features", lambda fit, f=toxicity.count_features: counted.append((f(fit), fit.count())) or counted[-1][0])
    rows = [(i, f"some words number{i % 7} " * 4 + ("badword " * 60 if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known, sample=5).collect()
    fit = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 in (0, 1)]
    row = toxicity.features(pa.array(["badword"]))[0, 0]
    assert counted[0][1] == len(fit) and counted[0][0][:, row].tolist() == [0, sum(i % 4 == 0 for i in fit)]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.held_out)


def test_pipeline_stage_learns_all_labelled_rows(spark, tmp_path, monkeypatch):
    from fathom.llm import stages

    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 8 * 300)
    counted = []
    monkeypatch.setattr(toxicity, "count_features", lambda fit, f=toxicity.count_features: counted.append(fit.count()) or f(fit))
    rows = [(i, f"some words number{i % 7} " * 4 + ("badword " * 60 if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in stages.toxicity(spark, docs, str(tmp_path)).collect()}
    assert counted == [sum(zlib.crc32(str(i).encode()) % 4 in (0, 1) for i in range(400))] and kept == {i for i in range(400) if i % 4}


def test_queries_learn_from_no_sample(spark, tmp_path, monkeypatch):
    """Nothing of the model of op4_toxicity and of the pipeline's stage comes from a sample of the labelled rows."""
    from fathom.llm import queries, stages

    def stop(*args, **more):
        raise AssertionError("a sample")

    monkeypatch.setattr(toxicity, "first_weights", stop)
    monkeypatch.setattr(toxicity, "train", stop)
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op4_toxicity(spark, str(tmp_path)).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == labels[r.doc_id][2] for r in held) >= 0.93 * len(held)
    assert {r.doc_id for r in stages.toxicity(spark, docs, str(tmp_path)).collect()} == {r.doc_id for r in got if not r.rejected}


def test_texts_move_twice_at_most(spark):
    """All of a model's shuffles write less than the text: rounds read their parts where they lie, texts that calibrate stay."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(300)) + " vile" * (i % 3 == 0), "en") for i in range(1000)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string").coalesce(2)
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1000)], "doc_id long, toxic int")
    sc = spark.sparkContext
    sc.setJobGroup("toxicity-shuffles", "")
    try:
        assert toxicity.fit_model(docs, known, sample=0).trained
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("toxicity-shuffles") for s in tracker.getJobInfo(j).stageIds}
    moved = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert 0 < moved < sum(len(r[1]) for r in rows)


def test_parts_hold_each_row_once(spark):
    rows = [(i % 40, f"text {i % 60}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = toxicity.dealt(docs, spark.createDataFrame([(i, i % 2) for i in range(0, 40, 3)], "doc_id long, toxic int"), 5).collect()
    assert len({r.part for r in packed}) == len(packed) <= 5 and all(r.rows == sorted(r.rows) for r in packed)
    got = [tuple(x) for r in packed for x in r.rows]
    assert sorted(got) == sorted({(i, t, i % 2) for i, t in rows if i % 3 == 0})


def test_words_of_blank_texts():
    words, codes, offsets = toxicity.split_words(["", " a  b ", " ", "b"])
    assert offsets.tolist() == [0, 0, 2, 2, 3] and [words[c].as_py() for c in codes] == ["a", "b", "b"]


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 7, "b": 2.5, "c": 0.01}, {"a": 1}])
def test_pfair_plan(weights):
    blocks = {s: 40 * (k + 1) for k, s in enumerate(sorted(weights))}
    phases = mixing.plan(blocks, weights, cycle=64)
    slots, done = {}, Counter()
    for p in phases:
        for k in range(p["n"]):
            slot = p["start"] + k // p["share"] * p["cycle"] + p["slots"][k % p["share"]]
            assert slot not in slots
            slots[slot] = (p["source"], p["first"] + k, p["phase"])
        done[p["source"]] += p["n"]
    assert done == blocks and sorted(slots) == list(range(sum(blocks.values())))
    for phase in {p["phase"] for p in phases}:
        own = [p for p in phases if p["phase"] == phase]
        start, share, size = own[0]["start"], {p["source"]: p["share"] for p in own}, own[0]["cycle"]
        had, t = Counter(), start
        while t in slots and slots[t][2] == phase:
            had[slots[t][0]] += 1
            t += 1
            if sum(share.values()) == size:
                assert all(abs(had[s] * size - share[s] * (t - start)) < size for s in share)


@pytest.mark.parametrize("weights", [{"a": 3000, "b": 1, "c": 1}, {"a": 1, "b": 1e-4, "c": 1e-4}, {"a": 30_000_000**0.5, "b": 3**0.5, "c": 2**0.5, "d": 1.0}])
def test_plan_of_skewed_sources(weights):
    blocks = {s: 5000 if s == "a" else 3 for s in weights}
    planned = Counter()
    for p in mixing.plan(blocks, weights):
        planned[p["source"]] += p["n"]
    assert planned == blocks


@pytest.mark.parametrize("weights", [dict.fromkeys("abc", 1), {f"s{i:02d}": (3_333_333 if i == 0 else 350_877) ** 0.5 for i in range(20)}, {"a": 1, "b": 0.5, "c": 1e-5}])
def test_plan_keeps_to_exact_targets(weights):
    blocks = dict.fromkeys(weights, 30_000 // len(weights))
    whole = sum(Fraction(str(w)) for w in weights.values())
    for p in mixing.plan(blocks, weights):
        if p["phase"] == 0:
            target = Fraction(str(weights[p["source"]])) / whole
            for k in range(p["n"]):
                slot, had = p["start"] + k // p["share"] * p["cycle"] + p["slots"][k % p["share"]], p["first"] + k
                assert had - target * slot > -1 and had + 1 - target * (slot + 1) < 1


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(i, f"t{i}", rnd.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(700)] + [(3, "t3", "b", 1)] * 3 + [(None, None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position int")
    got = mixing.mix(docs, {"a": 2, "b": 1, "c": 1}, block_rows=8, cycle=64).collect()
    counts = Counter(r[2] or "" for r in rows)
    assert Counter(r.source for r in got) == counts and len({r.position for r in got}) == len(got)
    ranks = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        ranks[r.source].append(r.source_rank)
    assert all(v == sorted(v) for v in ranks.values())
    out = mixing.mixed(docs, {"a": 2, "b": 1, "c": 1}, 8, 64)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert mixing.mix(docs.where("false")).count() == 0
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_of_equal_rows(spark):
    rows = [(1, "same", "a", k) for k in range(1000)] + [(None, "none", "b", k) for k in range(40)] + [(i, f"t{i}", "b", 0) for i in range(960)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    weights = {"a": 1, "b": 1}
    got = mixing.mix(docs, weights, 8, 64).collect()
    assert sorted(r.position for r in got) == list(range(2000))
    assert all(r.block == r.source_rank // 8 and r.position == 8 * r.slot + r.source_rank % 8 for r in got)
    out = [(r.doc_id, r.text, r.source, r.n) for r in mixing.mixed(docs, weights, 8, 64).collect()]
    assert sorted(out, key=repr) == sorted(rows, key=repr)
    assert all(abs(2 * k - t) <= 16 for t, k in enumerate(np.cumsum([r[2] == "a" for r in out])))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from test_dedup import brute_jaccard, brute_lines

    rows, labels = corpus(300)
    block = "\n".join(f"a shared line of the block, number {i}" for i in range(9))
    rows += [(1000 + i, f"own start {i} {'x' * i}\n{block}\nown end {i}", "en", "t") for i in range(6)]
    rows += [(2000 + i, " ".join(f"near{j}" for j in range(60)) + f" tail{i}", "en", "u") for i in range(5)] + [(3000, None, "en", "u")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.columns
            now.write.parquet(f"{tmp_path}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{k}")
            got = {r.doc_id: r.text for r in now.collect()}
        if name == "toxicity":
            rejected = {r.doc_id for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("rejected").collect()}
            texts = {i: t for i, t in texts.items() if i not in rejected}
            assert rejected and got == texts
        elif name == "line_dedup":
            cut = brute_lines(list(texts.items()))
            assert {i: t or "" for i, t in got.items()} == cut and cut != texts
            texts = cut
        elif name == "ngram_jaccard":
            found = brute_jaccard(list(texts.items()))
            texts = {i: t for i, t in texts.items() if found[i][1] == i}
            assert {i: t or "" for i, t in got.items()} == texts and 2001 not in texts
        elif name == "mixing":
            assert {i: t or "" for i, t in got.items()} == texts
    assert {r.doc_id for r in now.collect()} == set(texts)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(texts)
