"""Toxicity (4): a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed rows: the word itself (lower-cased, outer punctuation off) and its first 4, 5 and
6 letters, so unseen forms of a known stem count. Filters of widths 1, 2 and 3 run over the vectors, each filter's
maximum over the whole text goes through a linear layer. The first coordinate starts as the feature's log-odds in the
training rows, the rest at random; all weights are then trained with Adagrad on the logistic loss.

All labelled rows that are not held out are learned from, whatever their number and size. A third of them
(crc32(doc_id) mod 4 = 3) only serves to calibrate. The others are counted once for the log-odds, and then trained on in
``ROUNDS`` rounds: they are dealt once, by a hash, to parts of about ``PART_BYTES`` of text, in every round each part trains on
its rows from the same weights, and Spark averages what the parts changed, in whole numbers, so the order of tasks doesn't matter. A hashed
row's change is averaged over the parts that moved it. op4_toxicity and the pipeline take no sample (``sample=0``): filters
start at random. Other callers may have the driver train first filters on a bounded sample (about ``sample`` rows of each
class, at most ``SAMPLE_BYTES`` of text of each).
The calibration rows give counts by class and logit (in steps of 1 / ``STEPS``): logistic scaling, shifted so that the best
F1 on them lies at 0.3; thresholds by language are the best F1 of a language's own calibration rows, where it has at least
``LEAST`` of each class. The score never sees labels, lang, source or doc_id; the language only picks the threshold. Equal
rows of one doc_id are trained on once.

Defined cases: null, empty and blank texts have no words: they are never rejected and score below 0.3; texts of any
length are scored whole; repeated rows get equal scores; with no labels, or one class only, every score is 0; an
empty table gives no rows; extra columns are ignored by toxicity() and kept by clean(), whatever their names; a language
that is no string is read as one. A null doc_id counts as held in and is never trained on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fathom.llm.common import WRITING, forget, give_back, materialise, settings, slices, text_column

ROWS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
SAMPLE = 2_000
SAMPLE_BYTES = 16 << 20
EPOCHS = 3
ROUNDS = 5
PART_BYTES = 4 << 20
STEPS = 256
UNIT = 1 << 32  # changes of weights are added up as whole numbers of 1 / UNIT
CUT = 0.3
CHARS = 1 << 19  # of text that are scored at once
LEAST = 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(words: pa.Array, at_once: int = 20_000) -> np.ndarray:
    """Row numbers (n x 4) of each word: row 0 is kept for nothing and stays zero."""
    if len(words) > at_once:
        return np.concatenate([features(words[k : k + at_once]) for k in range(0, len(words), at_once)])
    words = pc.utf8_trim(pc.utf8_lower(words), PUNCTUATION)
    out = np.zeros((len(words), 4), np.int32)
    for k, form in enumerate((words, *(pc.utf8_slice_codeunits(words, 0, n) for n in (4, 5, 6)))):
        text = form.to_numpy(zero_copy_only=False)
        out[:, k] = pd.util.hash_array(text, hash_key=f"fathom-features{k}", categorize=False) % (ROWS - 1) + 1
    out[pc.equal(words, "").to_numpy(zero_copy_only=False)] = 0
    return out


def split_words(texts: list[str]):
    """Distinct words, codes of all words in order, and the offsets of texts in the codes."""
    lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    words = lists.values.dictionary_encode()
    codes, offsets = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()
    nothing = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    if nothing >= 0:  # what is split off around outer white space is no word
        real = codes != nothing
        codes, offsets = codes[real], np.concatenate(([0], np.cumsum(real)))[offsets]
    return words.dictionary, codes, offsets


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, DIM), np.float32))
    filters: list = field(default_factory=list)  # width x DIM x FILTERS each
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    out_bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    by_language: dict = field(default_factory=dict)
    trained: bool = False

    def pooled(self, x: np.ndarray, offsets: np.ndarray, where: bool = False):
        """Maxima of all filters over each text (n x all filters), and where they are. Texts are apart: windows
        over a text's end are masked, a text shorter than a window has its vectors followed by zeros."""
        n, size = len(offsets) - 1, np.diff(offsets)
        values, places = [], []
        full = np.flatnonzero(size)
        at = offsets[:-1][full]
        ends = np.repeat(offsets[1:][full], size[full])
        here = np.arange(len(x))
        for f in self.filters:
            width = len(f)
            y = x @ f[0]
            for j in range(1, width):
                part = x[j:] @ f[j]
                part[here[:-j] + j >= ends[:-j]] = 0
                y[:-j] += part
            best = np.zeros((n, f.shape[2]), np.float32)
            if len(full):
                best[full] = np.maximum.reduceat(y, at, axis=0)
            values.append(best)
            if where:
                place = np.zeros((n, f.shape[2]), np.int64)
                for k, a, b in zip(full, at, at + size[full]):
                    place[k] = a + y[a:b].argmax(0)
                places.append(place)
        return np.concatenate(values, axis=1), places

    def logits(self, texts: list[str]) -> np.ndarray:
        words, codes, offsets = split_words(texts)
        vectors = self.table[features(words)].sum(1) if len(words) else np.zeros((0, DIM), np.float32)
        top, _ = self.pooled(vectors[codes], offsets)
        z = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        z[np.diff(offsets) == 0] = -np.inf
        return z

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        z = self.slope * self.logits(texts).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def best_cut(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The score with the best weighted F1, in the middle of the gap below it."""
    order = np.argsort(-score, kind="stable")
    s, y, w = score[order], y[order], weight[order]
    tp, fp = np.cumsum(w * y), np.cumsum(w * (1 - y))
    f1 = 2 * tp / (tp + fp + (w * y).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted; much faster here than np.unique(), which hashes."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def presence(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Texts of each class that have a feature (2 x ROWS)."""
    seen = np.zeros((2, ROWS), np.int64)
    words, codes, offsets = split_words(texts)
    if len(words):
        rows = features(words)
        doc, code = np.divmod(distinct(np.repeat(np.arange(len(texts)), np.diff(offsets)) * len(words) + codes), len(words))
        doc, row = np.divmod(distinct((doc[:, None] * ROWS + rows[code]).ravel()), ROWS)
        seen += np.bincount(y[doc].astype(np.int64) * ROWS + row, minlength=2 * ROWS).reshape(2, ROWS)
    return seen


def fresh_model(seen: np.ndarray, n: np.ndarray, seed: int = 7) -> Model:
    """First weights: log-odds of a feature's presence in ``n`` texts of each class, the rest at random."""
    m, rng = Model(), np.random.default_rng(seed)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds[seen.sum(0) < 3] = 0
    m.table = rng.standard_normal((ROWS, DIM), np.float32)
    m.table *= (0.05 * (seen.sum(0) >= 3)).astype(np.float32)[:, None]
    m.table[:, 0] = odds / 4
    m.table[0] = 0
    m.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in m.filters:
        f[0, 0, : FILTERS // 2] += 1
    total = FILTERS * len(WIDTHS)
    m.bias, m.out = np.zeros(total, np.float32), rng.normal(0, 0.1, total).astype(np.float32)
    m.out[: FILTERS // 2] += 0.3
    m.trained = True
    return m


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model of these texts alone, not calibrated; untrained where a class is missing."""
    if len(set(y)) < 2:
        return Model()
    m = fresh_model(presence(texts, y), np.bincount(y.astype(np.int64), minlength=2), seed)
    descend(m, texts, y, epochs, seed)
    return m


def descend(m: Model, texts: list[str], y: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Train ``m`` in place; whether each row of the table was moved."""
    rng = np.random.default_rng(seed)
    words, codes, offsets = split_words(texts)
    rows, codes = features(words), codes.astype(np.int32)
    del words
    moved = np.zeros(ROWS, bool)
    cache = [np.full_like(p, 1e-3) for p in (*m.filters, m.bias, m.out)]
    table_cache, bias_cache = np.full(ROWS, 1e-3, np.float32), 1e-3
    rate = 0.05
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), 32):
            batch = order[k : k + 32]
            size = offsets[batch + 1] - offsets[batch]
            batch, size = batch[size > 0], size[size > 0]
            if not len(batch):
                continue
            own = np.concatenate([codes[offsets[i] : offsets[i + 1]] for i in batch])
            used, own = np.unique(own, return_inverse=True)
            off = np.concatenate(([0], np.cumsum(size)))
            x = m.table[rows[used]].sum(1)[own]
            top, places = m.pooled(x, off, where=True)
            h = np.maximum(top + m.bias, 0)
            z = h @ m.out + m.out_bias
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)).astype(np.float32)
            gh = g[:, None] * m.out * (h > 0)
            grads = [None] * len(m.filters)
            touched, moves = [], []
            end = off[1:][:, None]
            for q, f in enumerate(m.filters):
                part, place = gh[:, q * FILTERS : (q + 1) * FILTERS], places[q]
                grads[q] = np.zeros_like(f)
                for j in range(len(f)):
                    inside = place + j < end
                    at = np.minimum(place + j, len(x) - 1)
                    d = part * inside
                    grads[q][j] = np.einsum("nkd,nk->dk", x[at], d)
                    touched.append(own[at].ravel())
                    moves.append((d[:, :, None] * f[j].T[None]).reshape(-1, DIM))
            for p, c, d in zip((*m.filters, m.bias, m.out), cache, (*grads, gh.sum(0), h.T @ g)):
                c += d * d
                p -= rate * d / np.sqrt(c)
            bias_cache += float(g.sum()) ** 2
            m.out_bias -= rate * float(g.sum()) / bias_cache**0.5
            words_hit, moves = np.concatenate(touched), np.concatenate(moves)
            hit, inverse = np.unique(rows[used][words_hit].ravel(), return_inverse=True)
            d = np.zeros((len(hit), DIM), np.float32)
            np.add.at(d, inverse, np.repeat(moves, 4, axis=0))
            d[hit == 0] = 0
            moved[hit] = True
            table_cache[hit] += (d * d).mean(1)
            m.table[hit] -= rate * d / np.sqrt(table_cache[hit])[:, None]
    return moved


def calibrate(m: Model, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Slope and shift by calibration rows: their logits, classes and numbers of rows."""
    a, b, w = 1.0, 0.0, weight / weight.sum()
    for _ in range(50):  # Newton steps of logistic scaling
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, s = w * (p - y), w * p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 1e-4 * (a - 1), r.sum()])
        hess = np.array([[(s * z * z).sum() + 1e-4, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    a = max(a, 0.05)
    m.slope, m.shift = a, float(np.log(CUT / (1 - CUT)) - a * best_cut(z, y, weight))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def dense(m: Model) -> np.ndarray:
    """Weights beside the table, laid end to end in rows of DIM."""
    flat = np.concatenate([*(f.ravel() for f in m.filters), m.bias, m.out, [m.out_bias]]).astype(np.float64)
    return np.concatenate((flat, np.zeros(-len(flat) % DIM))).reshape(-1, DIM)


def put_dense(m: Model, flat: np.ndarray) -> None:
    flat, at, out = flat.ravel(), 0, []
    for p in (*m.filters, m.bias, m.out):
        out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    m.filters, m.bias, m.out, m.out_bias = out[:-2], out[-2], out[-1], float(flat[at])


def is_third(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 3


def first_weights(texts: DataFrame, known: DataFrame, sample: int) -> Model:
    """A model of a bounded sample of the rows to fit, where training starts."""
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = 1 << 20
    limit = F.when(F.col("toxic") == 1, parts * sample // max(counts.get(1, 0), 1)).otherwise(parts * sample // max(counts.get(0, 0), 1))
    # At most about 2 x sample rows, whatever the table's size: bounded, so it can be broadcast.
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts)) < limit)
    # Of those, in the order of a hash, as many as SAMPLE_BYTES allow, so the driver's share has a bound in bytes, too. A doc_id
    # whose rows have over an eighth of that does not come to the driver.
    order = Window.partitionBy("toxic").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.octet_length("text")).alias("bytes"), F.xxhash64(F.col("doc_id"), F.lit(5)).alias("h"))
    sizes = sizes.where(F.col("bytes") <= SAMPLE_BYTES // 8).withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
    chosen = sizes.where(F.col("bytes") + F.col("before") <= SAMPLE_BYTES).select("doc_id", "toxic")
    got = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toArrow()
    got = got.take(pc.sort_indices(got, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
    return train(got.column("text").to_pylist(), got.column("toxic").to_numpy().astype(np.float32))


def count_features(fit: DataFrame) -> np.ndarray:
    """presence() of all rows of ``fit``."""

    def count(parts):
        seen = np.zeros((2, ROWS), np.int64)
        for part in parts:
            y = part.column(1).to_numpy()
            for a, b, texts in slices(part.column(0), CHARS):
                seen += presence(texts, y[a:b])
        (row,) = seen.any(0).nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(seen[0, row]), pa.array(seen[1, row])], names=["row", "clean", "toxic"])
        give_back()

    with settings(fit.sparkSession, WRITING):
        got = fit.select("text", "toxic").mapInArrow(count, "row int, clean long, toxic long").groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, ROWS), np.int64)
    seen[:, got.column("row").to_numpy()] = got.column("clean").to_numpy(), got.column("toxic").to_numpy()
    return seen


def train_round(m: Model, packed: DataFrame, seed: int) -> None:
    """One epoch over all parts, each from ``m``; then their changes are averaged in ``m``."""
    shared = packed.sparkSession.sparkContext.broadcast(m)
    names = [f"d{k}" for k in range(DIM)]

    def step(batches):
        old = shared.value
        start = dense(old)
        change, n = np.zeros((ROWS + len(start), DIM), np.int64), np.zeros(ROWS + len(start), np.int64)
        for batch in batches:
            for rows in batch.column(0):
                part = rows.values
                new = Model(table=old.table.copy(), filters=[f.copy() for f in old.filters], bias=old.bias.copy(), out=old.out.copy(), out_bias=old.out_bias)
                moved = np.flatnonzero(descend(new, part.field("text").to_pylist(), part.field("toxic").to_numpy().astype(np.float32), 1, seed))
                moved = moved[moved > 0]
                change[moved] += np.rint((new.table[moved].astype(np.float64) - old.table[moved]) * UNIT).astype(np.int64)
                n[moved] += 1
                change[ROWS:] += np.rint((dense(new) - start) * len(part) * UNIT).astype(np.int64)
                n[ROWS:] += len(part)
        (row,) = n.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(n[row]), *(pa.array(c) for c in change[row].T)], names=["row", "n", *names])
        give_back()

    out = packed.select("rows").mapInArrow(step, "row int, n long, " + ", ".join(f"{c} long" for c in names))
    means = [(F.sum(c) / UNIT / F.sum("n")).cast("float").alias(c) for c in names]
    with settings(packed.sparkSession, WRITING):
        got = out.groupBy("row").agg(*means).toArrow()  # at most ROWS and a few rows
    row = got.column("row").to_numpy()
    own = row < ROWS
    rest = dense(m)
    for k, c in enumerate(names):
        change = got.column(c).to_numpy()
        m.table[row[own], k] += change[own]
        rest[row[~own] - ROWS, k] += change[~own]
    put_dense(m, rest)
    del got, change
    shared.destroy()
    give_back()


def calibrate_all(m: Model, rows: DataFrame, known: DataFrame) -> None:
    """Scaling, and thresholds by language, from all calibration rows (doc_id, lang, text) that ``known`` labels. Logits
    meet the labels, so no text moves."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def place(parts):
        for part in parts:
            for a, b, texts in slices(part.column(2), CHARS):
                z = np.rint(np.clip(shared.value.logits(texts).astype(np.float64), -30, 30) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0)[a:b], part.column(1)[a:b], pa.array(z)], names=["doc_id", "lang", "z"])
        give_back()

    def cut(part: pa.Table) -> pa.Table:
        z, y, n = (part.column(c).to_numpy().astype(np.float64) for c in ("z", "toxic", "n"))
        return pa.table([part.column("lang")[:1], pa.array([best_cut(z / STEPS, y, n)])], names=["lang", "cut"])

    placed = rows.select("doc_id", "lang", "text").mapInArrow(place, "doc_id long, lang string, z int")
    counted = materialise(placed.join(known, "doc_id").groupBy("lang", "toxic", "z").agg(F.count("*").alias("n")), "toxicity-logits")
    every = counted.groupBy("toxic", "z").agg(F.sum("n").alias("n")).orderBy("z", "toxic").toArrow()  # at most 2 x 60 x STEPS and 2 rows
    z, y, n = (every.column(c).to_numpy().astype(np.float64) for c in ("z", "toxic", "n"))
    calibrate(m, z / STEPS, y, n)
    both = counted.groupBy("lang").agg(F.sum(F.col("n") * F.col("toxic")).alias("ones"), F.sum("n").alias("all")).where((F.col("ones") >= LEAST) & (F.col("all") - F.col("ones") >= LEAST))
    cuts = counted.join(both.select("lang"), "lang").groupBy("lang").applyInArrow(cut, "lang string, cut double").collect()
    m.by_language = {r.lang: float(1 / (1 + np.exp(-np.clip(m.slope * r.cut + m.shift, -40, 40)))) for r in cuts}
    forget(counted)
    shared.destroy()


def dealt(texts: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """Distinct labelled rows in ``parts`` parts, one row each: their structs (doc_id, text, toxic) in order. A text moves at most
    twice, to its label and to its part, and every round reads the parts where they lie."""
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(parts))
    rows = texts.join(known.hint("merge"), "doc_id").select(part.alias("part"), F.struct("doc_id", "text", "toxic").alias("row"))
    return materialise(rows.groupBy("part").agg(F.sort_array(F.collect_set("row")).alias("rows")), "toxicity-parts")


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on all labelled rows that are not held out, from the first filters of a sample if ``sample`` is not 0. Repeated
    labels of a document: toxic if any says so."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"), language(docs).alias("lang"))
    texts = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    third = is_third(F.col("doc_id"))
    start = first_weights(texts, known.where(~third), sample) if sample else Model()
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(known, "doc_id").groupBy(third.alias("third"), "toxic").agg(F.sum("bytes").alias("bytes")).collect()
    m = Model()
    if len(sizes) == 4:  # both classes to fit, and both to calibrate
        packed = dealt(texts.where(~third), known.where(~third), max(1, -(-sum(r.bytes for r in sizes if not r.third) // PART_BYTES)))
        fit = packed.select(F.inline("rows"))
        n = {r.toxic: r.n for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        m = fresh_model(count_features(fit), np.array([n[0], n[1]]))
        if start.trained:
            put_dense(m, dense(start))
        for k in range(ROUNDS):
            train_round(m, packed, 11 + k)
        calibrate_all(m, texts.where(third), known.where(third))
        forget(packed)
    give_back()
    return m


def language(docs: DataFrame):
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold (of the language), rejected."""
    model = fit_model(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: ROWS x DIM floats
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language(docs).alias("lang"), text_column(docs).alias("text"))

    def score(parts):
        for part in parts:
            for a, b, texts in slices(part.column(2), CHARS):
                yield pa.RecordBatch.from_arrays([part.column(0)[a:b], part.column(1)[a:b], pa.array(shared.value.scores(texts))], names=["doc_id", "lang", "score"])
        give_back()

    out = base.mapInArrow(score, "doc_id long, lang string, score double")
    threshold = F.lit(CUT)
    if model.by_language:
        table = F.create_map(*[F.lit(x) for kv in sorted(model.by_language.items()) for x in kv])
        threshold = F.coalesce(F.try_element_at(table, F.col("lang")), F.lit(CUT))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("rejected"))


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold; rows and columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, sample))
    own = {c: i for i, c in enumerate(docs.columns)}
    names = [f"c{i}" for i in own.values()]  # no name of ``docs`` matters
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], text_column(docs).alias("text"), language(docs).alias("lang"))
    at = [names[own[c]] if c in own and isinstance(docs.schema[c].dataType, StringType) else c for c in ("text", "lang")]
    wide = wide.select(*names, *[c for c in at if c not in names])
    at = [wide.columns.index(c) for c in at]
    schema = StructType([StructField(n, f.dataType, True) for n, f in zip(names, docs.schema.fields)])

    def keep(parts):
        model = shared.value
        for part in parts:
            for a, b, texts in slices(part.column(at[0]), CHARS):
                cuts = np.array([model.by_language.get(x, CUT) for x in part.column(at[1])[a:b].to_pylist()])
                rows = part.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(rows.columns[: len(names)], names=names).filter(pa.array(model.scores(texts) < cuts))
        give_back()

    return wide.mapInArrow(keep, schema).toDF(*docs.columns)
