"""N-gram Jaccard join (6): adaptive multi-match prefixes, then components.

A document's set holds the distinct hashes (64 bits) of its ``size``-word shingles; two link when
100 |x n y| >= percent |x u y|. Equal sets form a class, which its smallest doc_id stands for.

Candidates. Tokens have one global order: by the class (power of two above the noise) of their count in a sketch of
all documents, rare first, then by hash. Let t = percent/100. If x and y link they share at least T = t/(1+t) (|x| + |y|) tokens, so for
any l they share at least l within the first |x| - T + l tokens of x and |y| - T + l of y; T is at least t |x| and t |y|.
Each document picks the l that makes (prefix length + |x|/8 x expected candidates / l) smallest, where the sketch tells
how often its prefix tokens occur; a pair is verified when it shares min(l_x, l_y) tokens within those places. The
sketch only steers cost: results don't depend on it.

Volume. Of the largest classes (at most LARGEST, broadcast) only the smallest document sends tokens. Tokens travel as
packed arrays, one for each task's flush and bucket of hashes; the number of buckets follows the number of shingles,
so a bucket has about BUCKET_BYTES, and over WAYS buckets tokens are dealt in two steps. A bucket keeps only tokens of
two or more classes. Tokens that the sketch says are in very many documents are dealt by class instead and all kept,
so no list has to be in one task. Groups of near copies would make all their pairs candidates, so verification has rounds. In the
first every document meets its best partner among the smallest documents of its tokens' lists, and links become
components. While lists still hold many components, their documents
meet a few more partners each. In the last,
lists are looked at again, but only pairs from different components count, all of them: no link between components
is lost, none inside one is needed. Texts are verified on (partner, salt) groups of bounded size. What goes to the
driver is bounded: the sketch (CELLS / 2 bytes before compression) and the fingerprints of the largest classes.

Defined cases: null text, or text without words: n_shingles 0, linked with nothing; fewer words than ``size``: the
whole sequence is the one shingle; repeated rows link with each other; rows with equal doc_id and other text each
follow their own text; a null doc_id takes no part and has a null component; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import forget, fresh, give_back, materialise, numbered, slices, text_column

SIZE = 5
PERCENT = 75
CELLS = 1 << 25
CHUNKS = 64
LENGTHS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
_LENGTHS = np.array(LENGTHS)
_COUNT = np.exp2(np.arange(16) - 0.5)  # in the middle of a class
CHANCE = 0.3  # candidates that a token brings by chance, for the cost estimate
TURNS = 3
PARTNERS = 4
CROWD = 4
LAST = 8
GROUP = 1 << 18  # shingles of the texts that a verification task compares with one
CHARS = 1 << 20  # of text that is cut into shingles at once
FLUSH = 1 << 20  # tokens that a task packs at once
BUCKET_BYTES = 8 << 20
SHARE = 5  # bytes of packed prefix tokens for a shingle, about
WAYS = 4_096  # buckets that a task deals to at once
HEAVY = 4_096  # documents, by the sketch, from which a token's list is dealt by class
LARGEST = 4_096  # classes that are broadcast
FAN = 256  # tasks' sketches that are added at once
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


# A-Z in lower case, the six blanks as a space, all other bytes as they are.
_PLAIN = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_DEPTH = 64  # a byte's random number depends on its place in the word, up to here
_RANDOM = np.random.default_rng(20_250_101).integers(0, 1 << 63, (_DEPTH, 256), np.uint64).ravel() * np.uint64(2) + np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after the other, and each text's number of words."""
    blobs = [t.encode() for t in texts]
    a = np.frombuffer((b" ".join(blobs) + b" ").translate(_PLAIN), np.uint8)
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) + 1
    black = np.concatenate(([False], a != 32))
    edges = np.flatnonzero(black[1:] != black[:-1])  # the last byte is a blank
    first, length = edges[::2], edges[1::2] - edges[::2]
    counts = np.diff(np.searchsorted(first, np.concatenate(([0], np.cumsum(size)))))
    if not len(first):
        return np.zeros(0, np.uint64), counts
    letters = a[black[1:]]
    starts = np.cumsum(length) - length
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(starts, length).astype(np.int32)
    if length.max() <= _DEPTH:
        values = _RANDOM[(place << 8) | letters]
    else:
        values = _RANDOM[((place % _DEPTH) << 8) | letters] * (np.uint64(2) * (place // _DEPTH).astype(np.uint64) * _M1 + np.uint64(1))
    return _mix(np.add.reduceat(values, starts) + length.astype(np.uint64) * _M1), counts


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, n = word_hashes(texts)
    full = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for j in range(size):
        full = _mix(full * _M1 + h[j : j + len(full)] + np.uint64(j + 1))
    out, at = [], 0
    for k in n.tolist():
        if k >= size:
            x = np.sort(full[at : at + k - size + 1])
            new = x[1:] != x[:-1]
            out.append(x if new.all() else np.concatenate((x[:1], x[1:][new])))
        elif k:
            x = np.full(1, k, np.uint64) * _M2
            for j in range(k):
                x = _mix(x * _M1 + h[at + j])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(39)).astype(np.int64) & (CELLS - 1)


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """One scan: (doc_id, n, fp) of every row, and each task's part of the sketch as rows with n < 0."""

    def scan(parts):
        counts = np.zeros(CELLS, np.uint8)
        step = CELLS // CHUNKS
        for part in parts:
            for a, b, texts in slices(part.column(1), CHARS):
                sets = shingle_sets(texts, size)
                cells, c = np.unique(_cells(np.concatenate(sets)), return_counts=True)
                counts[cells] = np.minimum(counts[cells].astype(np.int64) + c, 255)
                yield pa.RecordBatch.from_arrays([part.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())], names=["doc_id", "n", "fp"])
        give_back()
        for k in range(CHUNKS):
            own = counts[k * step : (k + 1) * step]
            if own.any():
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k], pa.int64()), "n": pa.array([-1], pa.int64()), "fp": [zlib.compress(own.tobytes(), 1)]})

    return materialise(_base(docs).mapInArrow(scan, "doc_id long, n long, fp binary"), "jaccard-fingerprints")


def noise_of(total: int) -> float:
    """Counts up to this are noise: the mean load of a cell four times, and some."""
    return 4 * total / CELLS + 16


def sketch_of(scan: DataFrame, noise: float) -> list[bytes]:
    """Classes of counts, half a byte for each cell, in CHUNKS parts: 0 up to ``noise``, then powers of two of it. Few cells are
    above the noise, so the parts are compressed where they are made and stay so on their way through the driver, which would
    hold CELLS / 2 bytes several times at once; unpacked_sketch() takes them apart. A task's counts stop at 255, so they are lower
    bounds. Parts of at most about FAN tasks are added in one group, and their sums again, until one sum is left."""
    kinds = {-1: np.uint8, -8: np.int64}

    def add(part: pa.Table) -> np.ndarray:
        total = np.zeros(CELLS // CHUNKS, np.int64)
        for n, blob in zip(part.column("n").to_pylist(), part.column("fp").to_pylist()):
            total += np.frombuffer(zlib.decompress(blob), kinds[n])
        return total

    def partial(part: pa.Table) -> pa.Table:
        return pa.table({"doc_id": part.column("doc_id")[:1], "n": pa.array([-8], pa.int64()), "fp": pa.array([zlib.compress(add(part).tobytes(), 1)], pa.binary())})

    def whole(part: pa.Table) -> pa.Table:
        classes = np.clip(np.floor(np.log2(np.maximum(add(part), 1) / noise)) + 1, 0, 15).astype(np.uint8)
        classes = classes[::2] | (classes[1::2] << 4)
        return pa.table({"k": part.column("doc_id")[:1], "classes": pa.array([zlib.compress(classes.tobytes(), 1)], pa.binary())})

    parts = scan.where("n < 0")
    most = -(-parts.count() // CHUNKS)
    while most > FAN:
        most = -(-most // FAN)
        dealt = parts.withColumn("salt", F.floor(F.rand(most) * most))
        parts = materialise(dealt.groupBy("doc_id", "salt").applyInArrow(partial, "doc_id long, n long, fp binary"), "jaccard-sketch")
    rows = parts.groupBy("doc_id").applyInArrow(whole, "k long, classes binary").collect()
    known = {r.k: bytes(r.classes) for r in rows}
    none = zlib.compress(bytes(CELLS // CHUNKS // 2), 1)
    return [known.get(k, none) for k in range(CHUNKS)]


def unpacked_sketch(parts: list[bytes]) -> np.ndarray:
    """The classes of all cells of ``parts``, half a byte each."""
    return np.concatenate([np.frombuffer(zlib.decompress(part), np.uint8) for part in parts])


def classes_of(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    cells = _cells(tokens)
    return (sketch[cells >> 1] >> ((cells & 1) << 2).astype(np.uint8)) & 15


def choose_prefix(tokens: np.ndarray, sketch: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The document's prefix, in the global order, and its l."""
    n = len(tokens)  # sorted
    need, need_equal = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
    own = classes_of(tokens, sketch)
    order = np.argsort(own, kind="stable")
    extra = np.cumsum(np.where(own[order] > 0, _COUNT[own[order]] * noise, 0) + CHANCE)
    lengths = _LENGTHS[_LENGTHS <= need]
    cost = (n - need + lengths) + n / 8 * extra[n - need_equal + lengths - 1] / lengths  # partners of its own size are the most likely
    pick = int(lengths[cost.argmin()])
    return tokens[order[: n - need + pick]], pick


PACKED = "bucket int, info binary, tokens binary, owner binary, place binary"


def pack_tokens(bucket, t, o, q, info) -> pa.RecordBatch:
    """Tokens ``t`` with owners (rows of ``info``) and places, a row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, t, o, q = bucket[order], t[order], o[order], q[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    q = q.astype(np.uint16 if q.max() < 1 << 16 else np.uint32)
    rows = ([], [], [], [], [])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        used, own = np.unique(o[a:b], return_inverse=True)
        own = own.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
        for r, v in zip(rows, (int(bucket[a]), info[used].tobytes(), t[a:b].tobytes(), own.tobytes(), q[a:b].tobytes())):
            r.append(v)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["bucket", "info", "tokens", "owner", "place"])


def unpack_tokens(part):
    """What went into pack_tokens(), of all rows of ``part``."""
    infos = [np.frombuffer(b, np.int64).reshape(-1, 5) for b in part.column("info").to_pylist()]
    base = np.cumsum([0, *map(len, infos)])
    tokens = [np.frombuffer(b, np.uint64) for b in part.column("tokens").to_pylist()]
    short = lambda name: [np.frombuffer(b, np.uint16 if len(b) == 2 * len(t) else np.uint32) for b, t in zip(part.column(name).to_pylist(), tokens)]
    owner = np.concatenate([x + np.uint32(k) for x, k in zip(short("owner"), base)])
    return np.concatenate(tokens), owner, np.concatenate(short("place")), np.concatenate(infos)


def largest_classes(rows: DataFrame) -> dict[bytes, int]:
    """The smallest doc_id of each of the LARGEST classes by number of copies."""
    sizes = rows.where("n > 0").groupBy("fp").agg(F.count("*").alias("k"), F.min("doc_id").alias("d")).where("k > 8 AND d IS NOT NULL")
    return {bytes(r.fp): r.d for r in sizes.orderBy(F.col("k").desc(), "fp").limit(LARGEST).collect()}


def postings(docs: DataFrame, sketch: list[bytes], noise: float, total: int, largest: dict[bytes, int], size: int, percent: int) -> DataFrame:
    """(g, d, n, l, pos, least): tokens that prefixes of two or more classes share; d stands for its class, pos is the
    token's place in the global order of its set, least a lower bound of l in the token's list. ``total``: shingles."""
    spark = docs.sparkSession
    heavy = max(1, min(15, math.ceil(math.log2(1 + HEAVY / noise)) + 1))
    pairs = sum(np.bincount(unpacked_sketch([part]), minlength=256) for part in sketch).reshape(16, 16)  # of neighbouring cells' classes
    counts = pairs.sum(0) + pairs.sum(1)
    often = float((counts[heavy:] * _COUNT[heavy:]).sum() * 2 * noise)
    plain_buckets = max(1, math.ceil(total * SHARE / BUCKET_BYTES))
    heavy_buckets = max(1, math.ceil(min(often, total) * SHARE / BUCKET_BYTES))
    per = -(-(plain_buckets + heavy_buckets) // WAYS)
    shared = spark.sparkContext.broadcast((sketch, largest))  # CELLS / 2 bytes before compression, at most LARGEST fingerprints

    def buckets(t, lo, sketch):
        often = classes_of(t, sketch) >= heavy
        return np.where(often, plain_buckets + (lo % np.uint64(heavy_buckets)).astype(np.int64), (t % np.uint64(plain_buckets)).astype(np.int64))

    def emit(parts):
        table, here, tokens, owner, place, held = [], {}, [], [], [], 0

        def flush():
            nonlocal held
            t, o, q, info = np.concatenate(tokens), np.concatenate(owner), np.concatenate(place), np.array(table, np.int64)
            for x in (table, here, tokens, owner, place):
                x.clear()
            held = 0
            return pack_tokens(buckets(t, info[o, 1].view(np.uint64), sketch) // per, t, o, q, info)

        sketch, largest = unpacked_sketch(shared.value[0]), shared.value[1]
        for part in parts:
            for a, b, texts in slices(part.column(1), CHARS):
                for doc_id, s in zip(part.column(0)[a:b].to_pylist(), shingle_sets(texts, size)):
                    if doc_id is None or not len(s):
                        continue
                    fp = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if largest.get(fp, doc_id) < doc_id:  # a copy
                        continue
                    if fp in here:  # the smallest doc_id stands for the class
                        row = table[here[fp]]
                        row[0] = min(row[0], doc_id)
                        continue
                    here[fp] = len(table)
                    prefix, l = choose_prefix(s, sketch, noise, percent)
                    owner.append(np.full(len(prefix), len(table), np.uint32))
                    place.append(np.arange(len(prefix), dtype=np.uint32))
                    tokens.append(prefix)
                    table.append([doc_id, *np.frombuffer(fp, np.int64).tolist(), len(s), l])
                    held += len(prefix)
                    if held >= FLUSH:
                        yield flush()
        if table:
            yield flush()
        give_back()

    def split(parts):
        """From coarse buckets to buckets."""
        sketch = unpacked_sketch(shared.value[0])
        for part in parts:
            if part.num_rows:
                t, o, q, info = unpack_tokens(part)
                yield pack_tokens(buckets(t, info[o, 1].view(np.uint64), sketch), t, o, q, info)
        give_back()

    def gather(part: pa.Table) -> pa.Table:
        every = part.column("bucket")[0].as_py() >= plain_buckets
        t, o, pos, info = unpack_tokens(part)
        # Copies: the smallest doc_id of a fingerprint stands for it.
        order = np.lexsort((info[:, 0], info[:, 2], info[:, 1]))
        keys = info[order][:, 1:3]
        first = np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))
        cls = np.empty(len(info), np.uint32)
        cls[order] = np.cumsum(first) - 1
        rep = order[first]
        c = cls[o]
        order = np.lexsort((c, t))
        t, c, pos = t[order], c[order], pos[order]
        kept = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
        t, c, pos = t[kept], c[kept], pos[kept]
        start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        many = np.diff(np.append(start, len(t)))
        row = info[rep[c]]
        least = np.repeat(np.minimum.reduceat(row[:, 4], start), many)
        if every:  # other buckets have more of the list
            least[:] = 1
        keep = np.repeat(many, many) > (0 if every else 1)
        row, cut = row[keep], lambda x: pa.array(x[keep].astype(np.int32))
        return pa.table([pa.array(t[keep].view(np.int64)), pa.array(row[:, 0]), pa.array(row[:, 3].astype(np.int32)), pa.array(row[:, 4].astype(np.int32)), cut(pos), cut(least)], names=["g", "d", "n", "l", "pos", "least"])

    packed = _base(docs).mapInArrow(emit, PACKED)
    if per > 1:
        packed = packed.repartition("bucket").mapInArrow(split, PACKED)
    out = materialise(packed.groupBy("bucket").applyInArrow(gather, "g long, d long, n int, l int, pos int, least int"), "jaccard-postings")
    shared.destroy()
    return out


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) that link. pairs: (x, y, n), n shingles in y; texts: (doc_id, text). Groups of texts with at most
    about GROUP shingles meet one partner, whose sets are all that a task keeps of it; texts stream by."""
    salts = materialise(pairs.groupBy("x").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("salts")), "jaccard-salts")
    salted = pairs.join(salts, "x").withColumn("salt", F.pmod(F.xxhash64("y"), F.col("salts")).cast("int")).select("x", "y", "salt")
    left = salted.join(texts.select(F.col("doc_id").alias("y"), "text"), "y").select("x", "salt", "y", F.lit(1).alias("kind"), "text")
    right = salts.select("x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(texts.select(F.col("doc_id").alias("x"), "text"), "x")
    right = right.select("x", "salt", F.col("x").alias("y"), F.lit(0).alias("kind"), "text")
    both = left.unionByName(right).repartition("x", "salt").sortWithinPartitions("x", "salt", "kind")

    def compare(parts):
        key, ones = None, []  # the sets of the current partner, several where rows share its doc_id
        for part in parts:
            xs, salts, ys, kinds = (part.column(i).to_pylist() for i in range(4))
            for a, b, texts in slices(part.column(4), CHARS):
                out: tuple[list, list] = ([], [])
                for i, s in zip(range(a, b), shingle_sets(texts, size)):
                    if not kinds[i]:
                        ones = [*ones, s] if key == (xs[i], salts[i]) else [s]
                        key = (xs[i], salts[i])
                        continue
                    for o in ones if key == (xs[i], salts[i]) else ():
                        if 100 * min(len(s), len(o)) < percent * max(len(s), len(o)):
                            continue
                        shared = len(np.intersect1d(s, o, assume_unique=True))
                        if 100 * shared >= percent * (len(s) + len(o) - shared):
                            out[0].append(xs[i]), out[1].append(ys[i])
                            break
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["x", "y"])
        give_back()

    return both.mapInArrow(compare, "x long, y long")


def components(links: DataFrame, name: str = "jaccard-components") -> DataFrame:
    """(d, c): for every end of a link the smallest one reachable. Labels move to neighbours and to their labels'
    labels until none changes; each round is written, so the lineage stays short."""
    both = links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(links.select(F.col("y").alias("a"), F.col("x").alias("b")))
    state = both.groupBy(F.col("a").alias("d")).agg(F.least(F.min("b"), F.first("a")).alias("c"))
    state = materialise(state, name)
    while True:
        near = both.join(state.select(F.col("d").alias("b"), "c"), "b").groupBy(F.col("a").alias("d")).agg(F.min("c").alias("m"))
        step = state.join(near, "d").select("d", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = step.select(F.col("d").alias("c"), F.col("c").alias("cc"))
        before, step = state, materialise(step.join(jump, "c").select("d", "old", F.least("c", "cc").alias("c")), name)
        state = step.select("d", "c")
        forget(before)
        if not step.where("old <> c").take(1):
            return state


def numbers_apart(docs: DataFrame) -> DataFrame | None:
    """None if rows that share a doc_id share their text; else a number for each doc_id and text, ascending by doc_id:
    doc_id, code (of the text), number."""
    text = text_column(docs)
    codes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b")).where("doc_id IS NOT NULL")
    several = codes.groupBy("doc_id").agg((F.min("a") != F.max("a")).alias("p"), (F.min("b") != F.max("b")).alias("q")).where("p OR q")
    if not several.take(1):
        return None
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("code")).where("doc_id IS NOT NULL").distinct()
    return numbered(known.select(F.struct("doc_id", "code").alias("key")), "key").select("key.doc_id", "key.code", F.col("rank").alias("number"))


def with_numbers(docs: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
    """``docs`` with their numbers as a column ``name``; null without doc_id."""
    own, code = fresh(docs, "own_id", "own_code")
    keys = numbers.select(F.col("doc_id").alias(own), F.col("code").alias(code), F.col("number").alias(name))
    marked = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(code, F.sha2(text_column(docs), 256))
    return marked.join(keys, [own, code], "left").drop(own, code)


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row. Where rows share a doc_id with different texts, each text has links and a
    component of its own, named by the doc_id of its smallest (doc_id, text)."""
    numbers = numbers_apart(docs)
    if numbers is None:
        return joined(docs, size, percent)
    numbers = materialise(numbers, "jaccard-numbers")
    (own,) = fresh(docs, "own_number")
    found = joined(with_numbers(docs, numbers, own).select(F.col(own).alias("doc_id"), "text"), size, percent)
    name = lambda at, to: numbers.select(F.col("number").alias(at), F.col("doc_id").alias(to))
    out = found.withColumnsRenamed({"doc_id": "a", "component_id": "c"}).join(name("a", "doc_id"), "a", "left").join(name("c", "component_id"), "c", "left")
    return out.select("doc_id", "n_shingles", "component_id")


def joined(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """jaccard_components() where a doc_id has one text."""
    scan = fingerprints(docs, size)
    rows = scan.where("n >= 0")
    total = rows.agg(F.sum("n")).first()[0] or 0
    largest = largest_classes(rows)
    noise = noise_of(total)
    lists = postings(docs, sketch_of(scan, noise), noise, total, largest, size, percent)
    give_back()
    need = F.lit(percent / 100.0)

    # A document with fewer shared tokens than any pair of its lists needs takes no part.
    found, own = lists, Window.partitionBy("d")
    able = lists.withColumns({"k": F.count("*").over(own), "weakest": F.min("least").over(own)}).where("k >= weakest")
    lists = materialise(able.select("g", "d", "n", "l", "pos"), "jaccard-lists")
    forget(found)

    # Round one: the best partner among the smallest documents of the lists.
    # (Sums of a hot token are written first: Spark splits a skewed join of tables, not one above a sum of the same key.)
    centre = materialise(lists.groupBy("g").agg(F.min("d").alias("x")), "jaccard-centres")
    star = lists.join(centre, "g").where("d <> x").groupBy("x", F.col("d").alias("y")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    first = star.where(F.col("c") >= F.col("n") * (1 - need) * 0.25).groupBy("y").agg(F.max_by("x", F.struct("c", -F.col("x"))).alias("x"), F.first("n").alias("n")).select("x", "y", "n")
    wanted = lists.select(F.col("d").alias("doc_id")).distinct()
    texts = materialise(_base(docs).join(wanted, "doc_id", "left_semi"), "jaccard-texts")
    links = materialise(verify(first, texts, size, percent), "jaccard-links")
    state = components(links)

    # While lists hold many components, their documents meet a few more partners each.
    def unsettled(state: DataFrame) -> DataFrame:
        labelled = lists.join(state, "d", "left").withColumn("c", F.coalesce("c", "d"))
        mixed = labelled.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("g")
        mixed = materialise(mixed, "jaccard-mixed")
        out = materialise(labelled.join(mixed, "g", "left_semi"), "jaccard-open")
        forget(mixed)
        return out

    open_ = unsettled(state)
    for turn in range(TURNS):
        crowded = materialise(open_.groupBy("g").agg(F.approx_count_distinct("c").alias("m")).where(F.col("m") >= CROWD).select("g"), "jaccard-crowded")
        if not crowded.take(1):
            break
        busy = open_.join(crowded, "g", "left_semi")
        seeds = [F.struct(F.lit(k).alias("seed"), F.min_by(F.struct("d", "c"), F.xxhash64("d", F.lit(turn * PARTNERS + k))).alias("x")) for k in range(PARTNERS)]
        centres = materialise(busy.groupBy("g").agg(F.array(*seeds).alias("xs")).select("g", F.inline("xs")).select("g", "seed", F.col("x.d").alias("x"), F.col("x.c").alias("xc")), "jaccard-centres")
        star = busy.join(centres, "g").where("d <> x AND c <> xc").groupBy("seed", "x", F.col("d").alias("y")).agg(F.count("*").alias("k"), F.first("n").alias("n"))
        more = star.where(F.col("k") >= F.col("n") * (1 - need) * 0.25).groupBy("seed", "y").agg(F.max_by("x", F.struct("k", -F.col("x"))).alias("x"), F.first("n").alias("n")).select("x", "y", "n").distinct()
        more = materialise(more, "jaccard-partners")
        fresh = materialise(verify(more, texts, size, percent), "jaccard-links")
        gained = fresh.count()
        if gained:
            links = links.unionByName(fresh)
            state = components(links)
            before, open_ = open_, unsettled(state)
            forget(before)
        enough = gained < more.count() / 10
        forget(more)
        if enough:  # the rest is not alike enough to gain from more partners
            break

    # Last round: all pairs from different components that share enough prefix tokens.
    # A pair that links shares at least ``both`` tokens, and so, for any l, l of them within the first n - both + l places of
    # either set. Here l is LAST at most: a longer prefix drops few more pairs, but each pair would make a row for each token.
    a, b = open_.alias("a"), open_.alias("b")
    both = f"(({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent})"
    l = f"least(a.l, b.l, {LAST})"
    inside = F.expr(f"a.pos < a.n - {both} + {l} AND b.pos < b.n - {both} + {l}")
    fits = (F.col("a.d") < F.col("b.d")) & (F.col("a.c") != F.col("b.c")) & (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent) & inside
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & fits).groupBy(F.col("a.d").alias("x"), F.col("b.d").alias("y")).agg(F.count("*").alias("c"), F.first(F.expr(l)).alias("l"), F.first("b.n").alias("n"))
    pairs = pairs.where("c >= l").select("x", "y", "n")
    pairs = materialise(pairs, "jaccard-pairs")
    forget(open_, lists)
    more = materialise(verify(pairs, texts, size, percent), "jaccard-links")
    forget(pairs, texts)
    if more.take(1):
        state = components(links.unionByName(more))

    # The largest classes, at most LARGEST, are joined by broadcast, so no hot fingerprint lands in one task.
    spark = docs.sparkSession
    top = F.broadcast(spark.createDataFrame(pa.table({"fp": pa.array(list(largest), pa.binary()), "d": pa.array(list(largest.values()), pa.int64())})))
    label = F.coalesce("c", "d").alias("c")
    worded = rows.where("n > 0 AND doc_id IS NOT NULL")
    rest = worded.join(top, "fp", "left_anti")
    classes = rest.groupBy("fp").agg(F.min("doc_id").alias("d")).join(state, "d", "left").select("fp", label)
    large = F.broadcast(state.join(top, "d", "right").select("fp", label))
    both = rest.join(classes, "fp").unionByName(worded.join(large, "fp")).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
    return both.unionByName(rows.where("n = 0 OR doc_id IS NULL").selectExpr("doc_id", "n AS n_shingles", "IF(n = 0, doc_id, NULL) AS component_id"))


ORACLE_SQL = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {SIZE} + 2), lambda i: array_to_string(w[i:i + {SIZE} - 1], ' ')) END) AS s
    FROM worded
), sizes AS (
    SELECT d.doc_id, count(s.s) AS n FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN shingles s USING (doc_id) GROUP BY d.doc_id
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= {PERCENT} * (p.n + q.n - n_both)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""
