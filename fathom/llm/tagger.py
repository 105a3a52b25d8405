"""A character tagger: bidirectional LSTM with CRF transitions, trained in numpy (for PII, 13).

Characters become a few dozen classes (letters without case, one class of digits, marks), whose rows of the input weights
serve as embeddings. Both directions' states give scores of TAGS; transitions between tags are learned, too, so a window is
decoded as a whole (Viterbi) and trained by its exact likelihood (forward-backward). All windows have one length, padded at
the end. Nothing depends on the order in which windows arrive: training sorts them, all randomness comes from one seed.
"""

from __future__ import annotations

import numpy as np

TAGS = ("", "email", "ip", "card", "phone")
WINDOW = 64
HIDDEN = 16
STEPS = 220  # of training, however few windows there are
BATCH = 128
RATE = 0.02

PAD, SPACE, DIGIT, LETTER, OTHER = 0, 1, 2, 3, 4
MARKS = "@.-_+%()[]{}<>/\\:;,#'\"=!?*|&$~^`\n\t"
_ASCII = np.full(128, OTHER, np.int32)
_ASCII[[*b" \r\x0b\x0c"]] = SPACE
_ASCII[[*b"0123456789"]] = DIGIT
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _ASCII[[ord(_c), ord(_c.upper())]] = OTHER + 1 + _k
for _k, _c in enumerate(MARKS):
    _ASCII[ord(_c)] = OTHER + 27 + _k
CLASSES = OTHER + 27 + len(MARKS)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], LETTER)


def padded(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WINDOW), np.int32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = classes(t[:WINDOW])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(ids: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool):
    """States (time, batch, hidden), and what going back needs."""
    n, steps = ids.shape
    h = c = np.zeros((n, HIDDEN), np.float32)
    states, saved = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = wx[ids[:, t]] + h @ wh
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        top = np.tanh(c)
        last, h = h, o * top
        states[t] = h
        if keep:
            saved.append((last, before, i, f, o, g, top))
    return states, saved


def _back(ids: np.ndarray, saved: list, dh_all: np.ndarray, wh: np.ndarray, size: int):
    """Gradients of wx and wh."""
    steps, n, _ = dh_all.shape
    dz_all, dwh = np.zeros((steps, n, 4 * HIDDEN), np.float32), np.zeros_like(wh)
    dh = dc = np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        last, before, i, f, o, g, top = saved[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - top * top)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * top * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[t] = dz
        dwh += last.T @ dz
        dh, dc = dz @ wh.T, dc * f
    seen = np.zeros((steps * n, size), np.float32)
    seen[np.arange(steps * n), ids.T.ravel()] = 1
    return seen.T @ dz_all.reshape(steps * n, -1), dwh


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def emissions(ids: np.ndarray, p: dict[str, np.ndarray], keep: bool = False):
    """Scores (time, batch, tag) of windows of classes."""
    ahead, saved_a = _run(ids, p["ax"], p["ah"], keep)
    behind, saved_b = _run(ids[:, ::-1], p["bx"], p["bh"], keep)
    both = np.concatenate([ahead, behind[::-1]], 2)
    return both @ p["out"] + p["bias"], both, saved_a, saved_b


def _step(ids: np.ndarray, tags: np.ndarray, p: dict[str, np.ndarray]):
    """Mean negative log likelihood of the tags, and its gradients."""
    n, steps = ids.shape
    e, both, saved_a, saved_b = emissions(ids, p, True)
    e, move = e.astype(np.float64), p["move"].astype(np.float64)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + move, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    whole = _logsum(alpha[-1], 1)
    gold = tags.T
    rows, times = np.arange(n), np.arange(steps)[:, None]
    score = e[times, rows, gold].sum(0) + move[gold[:-1], gold[1:]].sum(0)
    de = np.exp(alpha + beta - whole[:, None])
    de[times, rows, gold] -= 1
    pairs = np.exp(alpha[:-1, :, :, None] + move + (e[1:] + beta[1:])[:, :, None, :] - whole[:, None, None])
    dmove = pairs.sum((0, 1))
    np.add.at(dmove, (gold[:-1].ravel(), gold[1:].ravel()), -1)
    de = (de / n).astype(np.float32)
    grads = {"move": (dmove / n).astype(np.float32), "bias": de.sum((0, 1)), "out": np.einsum("tbh,tbk->hk", both, de)}
    dboth = de @ p["out"].T
    grads["ax"], grads["ah"] = _back(ids, saved_a, dboth[:, :, :HIDDEN], p["ah"], len(p["ax"]))
    grads["bx"], grads["bh"] = _back(ids[:, ::-1], saved_b, dboth[::-1, :, HIDDEN:], p["bh"], len(p["bx"]))
    return float((whole - score).mean()), grads


def train(windows: list[tuple[str, str]], seed: int = 13, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights from (text, tags as digits, one for each character)."""
    windows = sorted(windows)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0] if shape[0] < CLASSES else 8)).astype(np.float32)
    k = len(TAGS)
    p = {"ax": draw(CLASSES, 4 * HIDDEN), "ah": draw(HIDDEN, 4 * HIDDEN), "bx": draw(CLASSES, 4 * HIDDEN), "bh": draw(HIDDEN, 4 * HIDDEN)}
    p |= {"out": draw(2 * HIDDEN, k), "bias": np.zeros(k, np.float32), "move": np.zeros((k, k), np.float32)}
    ids, tags = padded([t for t, _ in windows]), np.zeros((len(windows), WINDOW), np.int32)
    for i, (_, marks) in enumerate(windows):
        tags[i, : len(marks)] = [int(c) for c in marks[:WINDOW]]
    first, second = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}
    step = 0
    while step < steps:
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            if step == steps:
                break
            _, grads = _step(ids[order[a : a + BATCH]], tags[order[a : a + BATCH]], p)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for n, g in grads.items():  # Adam
                g = g * min(1.0, 5.0 / (size + 1e-9))
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                p[n] = p[n] - (rate * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def decode(texts: list[str], p: dict[str, np.ndarray], batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The best tags of each window (window, place), and how much each place's score is above that of no tag."""
    tags, odds = np.zeros((len(texts), WINDOW), np.int8), np.zeros((len(texts), WINDOW), np.float32)
    for a in range(0, len(texts), batch):
        ids = padded(texts[a : a + batch])
        e = emissions(ids, p)[0]
        best, from_ = e[0], np.zeros(e.shape, np.int8)
        for t in range(1, WINDOW):
            ways = best[:, :, None] + p["move"]
            from_[t] = ways.argmax(1)
            best = e[t] + ways.max(1)
        at = best.argmax(1)
        rows = np.arange(len(ids))
        for t in range(WINDOW - 1, -1, -1):
            tags[a : a + len(ids), t] = at
            odds[a : a + len(ids), t] = e[t, rows, at] - e[t, rows, 0]
            at = from_[t, rows, at]
    return tags, odds
