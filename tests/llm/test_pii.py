"""Base spans against the plain patterns, the tagger against finite differences and plain decoding, and held-out forms."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from fathom.llm import pii, queries, tagger

SF = "/root/testdata/sf0.001"


def plain_base(text):
    """The four patterns as they are stated."""
    digits = lambda t: re.sub("[^0-9]", "", t)
    out = [(1, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(3, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(4, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


@pytest.mark.parametrize("alphabet", ["a@.1", "12. -+", "+1(2) -.3", "a1@.-_ é٣\n", "0123456789 -"])
def test_base_spans(alphabet):
    rng = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
        assert pii.base_spans(text) == plain_base(text)


def test_luhn_and_long_runs():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + "(" * 200_000, "1." * 100_000, "@" * 100_000):
        pii.base_spans(text)
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [(2, 0, 5007)]


def test_windows_cover_every_trigger():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab      9") if rng.random() < 0.1 else "x" for _ in range(rng.randrange(500)))
        windows = pii.starts_of_windows(text)
        for m in pii.TRIGGER.finditer(text):
            assert any(s + pii.MARGIN * left <= m.start() < s + tagger.WINDOW - pii.MARGIN * right for s, left, right in windows)


def test_reconciling():
    rng = random.Random(2)
    for _ in range(200):
        pieces = [(rng.randint(1, 4), a := rng.randrange(30), a + rng.randint(1, 9), rng.randint(1, 20)) for _ in range(rng.randrange(8))]
        got = pii.scheduled(pieces)
        free = lambda ps: all(p[2] <= q[1] or q[2] <= p[1] for p, q in combinations(ps, 2))
        best = max(sum(p[3] for p in ps) for n in range(len(pieces) + 1) for ps in combinations(pieces, n) if free(ps))
        assert free(got) and sum(p[3] for p in got) == best
    assert pii.merged([(1, 5, 9, 1.0), (1, 8, 12, 3.0), (2, 6, 7, 1.0)]) == [(1, 5, 12, 3.0), (2, 6, 7, 1.0)]


def small_model():
    rng = np.random.default_rng(0)
    draw = lambda *s: rng.normal(size=s).astype(np.float32) / 2
    h, k = tagger.HIDDEN, len(tagger.TAGS)
    return {"ax": draw(tagger.CLASSES, 4 * h), "ah": draw(h, 4 * h), "bx": draw(tagger.CLASSES, 4 * h), "bh": draw(h, 4 * h), "out": draw(2 * h, k), "bias": draw(k), "move": draw(k, k)}


def test_gradients(monkeypatch):
    monkeypatch.setattr(tagger, "WINDOW", 9)
    p, rng = small_model(), np.random.default_rng(1)
    ids, tags = rng.integers(0, tagger.CLASSES, (3, 9)), rng.integers(0, 5, (3, 9))
    _, grads = tagger._step(ids, tags, p)
    for name in p:
        at = np.unravel_index(np.abs(grads[name]).argmax(), p[name].shape)
        sides = []
        for e in (2e-3, -2e-3):
            q = {n: v.copy() for n, v in p.items()}
            q[name][at] += e
            sides.append(tagger._step(ids, tags, q)[0])
        assert (sides[0] - sides[1]) / 4e-3 == pytest.approx(grads[name][at], rel=0.03)


def test_decoding():
    p = small_model()
    texts = ["call +1 (555) 123-4567 now", "", "é@x.de " * 9]
    tags, odds = tagger.decode(texts, p)
    e = tagger.emissions(tagger.padded(texts), p)[0]
    for k in range(3):
        best = {t: (float(e[0, k, t]), [t]) for t in range(5)}
        for s in range(1, tagger.WINDOW):
            best = {t: max((v + float(p["move"][w[-1], t]) + float(e[s, k, t]), [*w, t]) for v, w in best.values()) for t in range(5)}
        assert max(best.values())[1] == tags[k].tolist()
        assert np.allclose(odds[k], [e[s, k, t] - e[s, k, 0] for s, t in enumerate(tags[k])])


@pytest.fixture(scope="module")
def model(spark):
    return pii.trained(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_forms(model):
    """Forms that the patterns miss are found in other texts; look-alikes and clean text stay."""
    rng, finder = random.Random(77), pii.Finder(model)
    words = lambda: " ".join(rng.choice(["the", "of", "reach", "number", "is", "und", "la", "Was", "at"]) for _ in range(rng.randint(3, 25)))
    hit = false = 0
    for k in range(400):
        kind = k % 5
        span = pii.rewritten(rng, kind, pii.made_up(rng, kind)) if kind else pii.look_alike(rng)
        before, after = words() + " ", rng.choice([" ", ", ", ". "]) + words()
        base, added = finder([before + span + after])[0]
        here = [(x, a, b) for x, a, b in base + added if a < len(before) + len(span) and b > len(before)]
        if kind:
            hit += any(x == kind and a <= len(before) and b >= len(before) + len(span) for x, a, b in here)
        else:
            false += len(added)
    assert hit >= 0.7 * 320 and false <= 4


def test_rows(spark, model):
    long = "x " * 60_000 + "write to ann@example.org or +49 (30) 1234-5678 " + "y " * 60_000
    texts = [None, "", "a@b.c", "a@b.c", long, "1.2.3.4 " * 3000, "٣" * 30, "\U0001f600 ip 10.0.0.1", "@@@", "4111 1111 1111 1111"]
    rows = [(k % 8 if k else None, t, "z", 3) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, `b.c` int").repartition(3)
    got = sorted(map(tuple, pii.counted(pii.find(docs, model)).collect()), key=repr)
    assert len(got) == len(rows)
    want = []
    for k, t, *_ in rows:
        base = plain_base(t or "")
        spelled = ",".join(f"{pii.KINDS[x - 1]}:{a}:{b}" for x, a, b in base)
        want.append((k, *(sum(x == n for x, _, _ in base) for n in range(1, 5)), hashlib.sha256(spelled.encode()).hexdigest()))
    assert [g[:6] for g in got] == sorted(want, key=lambda w: repr(w))
    assert pii.counted(pii.find(docs.where("false"), model)).count() == 0
    hidden = pii.masked(docs, model)
    assert hidden.columns == docs.columns
    told = [r.text for r in hidden.collect()]
    assert told.count("[email]") == 2 and told.count(None) == 1 and sum("write to [email] or [phone] y" in (t or "") for t in told) == 1


def test_empty_corpus_still_learns(spark):
    assert pii.labelled_windows(spark.createDataFrame([], "doc_id long, text string")) == []
    made = pii.training_set([])
    assert {m.strip("0")[:1] for _, m in made} == {"", "1", "2", "3", "4"} and made == pii.training_set([])


def test_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op13_pii"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base, r = plain_base(d.text or ""), got[d.doc_id]
        spelled = [f"{pii.KINDS[x - 1]}:{a}:{b}" for x, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x == n for x, _, _ in base) for n in range(1, 5))
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert set(spelled) <= set(r.spans.split(","))
        if not re.search("[0-9@]", d.text or ""):
            assert r.spans == ""
