"""Personal data (13): spans by fixed patterns, and those that a character-level BiLSTM-CRF adds to them.

Base spans are what the four patterns find, kind by kind, in time linear in the text; they always stay. The tagger is trained
from labelled spans: distinct windows of the corpus around base spans, windows of the corpus that look alike but hold none, and
both again with their spans rewritten (bracketed "at" and "dot", other separators, no leading plus), so that it knows forms
that the patterns miss. At most SAMPLE windows of each kind are learned, those with the smallest hashes; all texts are
searched as a whole.

A span holds a digit, an @ or a bracketed "at", so windows lie around those, one every STRIDE places, each decoded for
itself. They overlap, and a document's spans are reconciled over all its windows: what touches a cut edge is left to the
neighbour (MARGIN), pieces of one kind that overlap become one, and of different kinds that overlap those with the
largest sum of scores stay (weighted interval scheduling over the document). A span is added if it is well-formed (a
card passes Luhn's check, an address has parts up to 255) and meets no base span.

Null and empty texts have no spans. Every row is a document, repeated ids and texts included; equal windows are decoded
once in a task. Long texts are windows like any others. Positions are in code points, ends exclusive. Of a table
without any span, rewritten made-up ones are learned. Extra columns are not looked at; ``masked`` keeps them.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import forget, fresh, give_back, materialise, slices, text_column
from fathom.llm.tagger import TAGS, WINDOW, decode, train

KINDS = TAGS[1:]
SAMPLE = 250  # windows of each kind, and of none
STRIDE = WINDOW // 2
MARGIN = 8
MEMO = 50_000  # windows of a task whose tags are kept
CHARS = 1 << 20  # of text at a time

TRIGGER = re.compile(r"[0-9@]|[(\[{<] ?at ?[)\]}>]", re.IGNORECASE)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match always takes whole runs of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def emails(text: str):
    """Matches of local@domain: the local part is the longest run before an @, as nothing in it is one."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of KINDS, then of starts; kind 1 is an email."""
    out = [(1, a, b) for a, b in emails(text)]
    out += [(2, m.start(), m.end()) for m in IP.finditer(text) if octets(m[0])]
    out += [(3, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    return out + [(4, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]


def starts_of_windows(text: str) -> list[tuple[int, bool, bool]]:
    """(start, cut on the left, cut on the right) of windows around all triggers."""
    reach = WINDOW // 2
    regions: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        s = a
        while True:
            out.append((s, s > 0, s + WINDOW < len(text)))
            if s + WINDOW >= b:
                break
            s += STRIDE
    return out


AT = re.compile(r"\s*[(\[{<]\s*at\s*[)\]}>]\s*", re.IGNORECASE)
DOT = re.compile(r"\s*[(\[{<]\s*dot\s*[)\]}>]\s*", re.IGNORECASE)
PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD_MARKS = re.compile(r"[0-9](?:[ ./_\-]{0,3}[0-9])+")
PHONE_MARKS = re.compile(r"\(?\+?[0-9](?:[ ()./\-]{0,3}[0-9])+")


def well_formed(kind: int, text: str) -> bool:
    """Whether an added span is what its kind asks for."""
    if kind == 1:
        return PLAIN_EMAIL.fullmatch(re.sub(r" ?([@.]) ?", r"\1", DOT.sub(".", AT.sub("@", text)))) is not None
    if kind == 2:
        plain = re.sub(r" ?[\[(]?\.[\])]? ?", ".", text)
        return re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", plain) is not None and octets(plain)
    d = digits_of(text)
    if kind == 3:
        return 13 <= len(d) <= 19 and luhn(d) and CARD_MARKS.fullmatch(text) is not None
    return 9 <= len(d) <= 15 and PHONE_MARKS.fullmatch(text) is not None and (text.startswith(("+", "00", "(")) or len(re.findall(r"[ )./\-]+", text)) >= 2)


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without marks and spaces at its ends."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def merged(pieces: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Pieces (kind, start, end, score) of one kind that overlap or touch, as one."""
    out: list[list] = []
    for kind, a, b, score in sorted(pieces):
        if out and out[-1][0] == kind and a <= out[-1][2]:
            out[-1][2], out[-1][3] = max(b, out[-1][2]), max(score, out[-1][3])
        else:
            out.append([kind, a, b, score])
    return [tuple(x) for x in out]


def scheduled(pieces: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Those with the largest sum of scores of which no two overlap."""
    pieces = sorted(pieces, key=lambda p: (p[2], p[1], p[0]))
    ends, best = [p[2] for p in pieces], [(0.0, None)]
    for k, p in enumerate(pieces):
        before = bisect_right(ends, p[1], 0, k)
        take = best[before][0] + p[3]
        best.append((take, before) if take > best[-1][0] else (best[-1][0], None))
    out, k = [], len(pieces)
    while k:
        if best[k][1] is None:
            k -= 1
        else:
            out.append(pieces[k - 1])
            k = best[k][1]
    return out[::-1]


def added_spans(text: str, base: list[tuple[int, int, int]], windows: list[tuple[int, bool, bool]], tags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Spans from the windows' tags that are well-formed and meet no base span."""
    pieces = []
    for (s, cut_left, cut_right), (mark, odds) in zip(windows, tags):
        lo, hi = MARGIN * cut_left, min(WINDOW, len(text) - s) - MARGIN * cut_right
        edge = np.flatnonzero(np.diff(mark[lo:hi], prepend=0, append=0))
        for a, b in zip(edge[:-1] + lo, edge[1:] + lo):
            if mark[a]:
                pieces.append((int(mark[a]), s + int(a), s + int(b), float(max(odds[a:b].sum(), 1e-6))))
    good = []
    for kind, a, b, score in merged(pieces):
        a, b = trimmed(text, a, b)
        whole = not (text[max(0, a - 1) : a].isdigit() or text[b : b + 1].isdigit())  # no part of a longer number
        if whole and well_formed(kind, text[a:b]):
            good.append((kind, a, b, score))
    held, out = sorted((a, b) for _, a, b in base), []
    starts = [a for a, _ in held]
    reach = np.maximum.accumulate([b for _, b in held]) if held else []
    for kind, a, b, _ in scheduled(good):
        k = bisect_left(starts, b)  # base spans that start before the end
        if not k or reach[k - 1] <= a:
            out.append((kind, a, b))
    return out


# ---- training


def rewritten(rng: random.Random, kind: int, text: str) -> str:
    """A span in a form that the patterns miss, or another one that they find."""
    pick = rng.choice
    if kind == 1:
        local, _, domain = text.partition("@")
        a, b = pick(["()", "[]", "{}", "<>"])
        gap = pick(["", " "])
        dot = f"{gap}{a}dot{b}{gap}" if rng.random() < 0.4 else "."
        return f"{local}{gap}{a}{pick(['at', 'AT', ' at '])}{b}{gap}{domain.replace('.', dot)}"
    if kind == 2:
        return text.replace(".", pick([" . ", "[.]", " .", "(.)", ". "]))
    d = digits_of(text)
    if kind == 3:
        mark = pick([" ", ".", "/", "_", "  ", " - "])
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:].rjust(9, "5")
    return pick(["({}) {}-{}", "{}.{}.{}", "{}-{}-{}", "00{} {} {}", "({}) {} {}", "{}/{}-{}", "+1/{}/{}/{}"]).format(d[:3], d[3:6], d[6:])


def made_up(rng: random.Random, kind: int) -> str:
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 1:
        return f"{word(2, 8)}{rng.choice(['', '.' + word(2, 7), num(2), '_' + word(1, 4)])}@{word(3, 9)}.{rng.choice(['com', 'org', 'net', 'de', 'co.uk', 'example.com'])}"
    if kind == 2:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 3:
        body = num(15)
        return body + next(c for c in "0123456789" if luhn(body + c))
    return rng.choice(["+{} ({}) {}-{}", "+{} {} {} {}", "+{}-{}-{}-{}"]).format(rng.randint(1, 99), num(3), num(3), num(4))


def look_alike(rng: random.Random) -> str:
    """Text with digits or marks that is no personal data."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)}:{num(2)}:{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(1)},{num(3)}.{num(2)}", f"${num(3)}.{num(2)}", f"{num(2)}%", num(1), num(2), num(3), num(5), num(8),
        f"{num(2)}.{num(2)}", f"({num(2)})", f"{num(1)}. ", f"{num(4)}/{num(2)}", f"#{num(4)}", f"{num(3)}-{num(3)}", hashlib.md5(num(6).encode()).hexdigest(), f"@{rng.choice(['home', 'all', 'work'])}", num(16), num(24), f"{num(4)} {num(4)}", f"{num(2)}x{num(3)}", "(at) last", "[at] home", f"page {num(3)}, {num(4)}",
    ])


def placed(rng: random.Random, before: str, span: str, kind: int, after: str) -> tuple[str, str]:
    """A window with the span at a place by chance."""
    left = before[max(0, len(before) - rng.randint(0, max(0, WINDOW - len(span)))) :]
    text = (left + span + after)[:WINDOW]
    return text, ("0" * len(left) + str(kind) * len(span) + "0" * len(after))[: len(text)]


def training_set(windows: list[tuple[str, str]], seed: int = 13) -> list[tuple[str, str]]:
    """The labelled windows, their spans in other forms, and made-up ones."""
    rng, out = random.Random(seed), sorted(windows)
    plain = [t for t, m in out if not m.strip("0")] or ["the quick brown fox jumps over the lazy dog, and so on to the end. "]
    for text, marks in sorted(windows):
        runs = [m for m in re.finditer(r"([1-4])\1*", marks) if m.start() > 0 or len(m[0]) > 7]
        if len(runs) == 1 and runs[0].end() < len(text):
            kind, (a, b) = int(runs[0][1]), runs[0].span()
            out.append(placed(rng, text[:a], rewritten(rng, kind, text[a:b]), kind, text[b:]))
    for k in range(max(2 * SAMPLE, 10 * SAMPLE - len(out))):  # no fewer windows where the corpus has few
        context, kind = rng.choice(plain), k % len(TAGS)
        cut = rng.randint(0, len(context))
        before, after = re.sub(r"\S+$", "", context[:cut]), re.sub(r"^\S+", "", context[cut:]) or rng.choice(["", ".", ", ", "!!", "\n"])
        span = look_alike(rng) if not kind else made_up(rng, kind)
        if kind and rng.random() < 0.6:
            span = rewritten(rng, kind, span)
        out.append(placed(rng, before, span, kind, after))
    return out


def labelled_windows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, tags) of distinct windows around base spans and other triggers: about ``sample`` of each kind and of none, those with the
    smallest hashes. All texts are looked at; the driver gets the sample alone."""

    def cut(batches):
        for batch in batches:
            for _, _, texts in slices(batch.column(0), CHARS):
                rows = {}
                for text in texts:
                    if not TRIGGER.search(text):
                        continue
                    base = base_spans(text)
                    marks = np.zeros(len(text), np.uint8)
                    for kind, a, b in reversed(base):
                        marks[a:b] = kind
                    for s, _, _ in starts_of_windows(text):
                        own = marks[s : s + WINDOW]
                        rows[text[s : s + WINDOW], "".join(map(str, own))] = int(own.max(initial=0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(rows.values()), pa.int32()), pa.array([zlib.crc32(t.encode("utf-8", "replace")) for t, _ in rows], pa.int64()), pa.array([t for t, _ in rows], pa.string()), pa.array([m for _, m in rows], pa.string())],
                    names=["kind", "hash", "window", "tags"],
                )
        give_back()

    found = docs.select(text_column(docs).alias("text")).mapInArrow(cut, "kind int, hash long, window string, tags string").distinct()
    found = materialise(found, "pii-windows")
    counts = {r[0]: r[1] for r in found.groupBy("kind").count().collect()}
    share = F.lit(False)
    for kind, n in counts.items():
        share = share | ((F.col("kind") == kind) & (F.col("hash") < min(1 << 32, int((1 << 32) * sample / n) + 1)))
    rows = sorted((r.kind, r.hash, r.window, r.tags) for r in found.where(share).orderBy("hash", "window").limit(2 * sample * len(TAGS)).collect())
    forget(found)
    return [(w, t) for _, _, w, t in rows]


def trained(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    return train(training_set(labelled_windows(docs, sample)))


# ---- the operator


class Finder:
    """Finds spans of texts with a model; tags of equal windows are worked out once."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model, self.memo = model, {}

    def __call__(self, texts: list[str]) -> list[tuple[list, list]]:
        """For each text its base spans and the added ones."""
        base = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
        windows = [starts_of_windows(t) for t in texts]
        cut = [[t[s : s + WINDOW] for s, _, _ in w] for t, w in zip(texts, windows)]
        if len(self.memo) > MEMO:
            self.memo = {}
        new = sorted({w for ws in cut for w in ws if w not in self.memo})
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            tags, odds = decode(part, self.model)
            for w, t, o in zip(part, tags, odds):
                self.memo[w] = (t, o) if t.any() else None
        none = (np.zeros(WINDOW, np.int8), np.zeros(WINDOW, np.float32))
        return [(b, added_spans(t, b, w, [self.memo[x] or none for x in c]) if w else []) for t, b, w, c in zip(texts, base, windows, cut)]


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k - 1]}:{a}:{b}" for k, a, b in sorted(spans))


SPANS = "array<struct<kind:int,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, model: dict[str, np.ndarray] | None = None, number: str = "doc_id") -> DataFrame:
    """doc_id, spans (kind from 1 in the order of KINDS, start, end, base), base_sha256, spelled of every row."""
    model = trained(docs) if model is None else model
    rows = docs.select(F.col(f"`{number}`").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def work(batches):
        finder = Finder(model)
        for batch in batches:
            for a, b, texts in slices(batch.column(1), CHARS):
                found = finder(texts)
                spans = [[{"kind": k, "start": s, "end": e, "base": x in known} for x in sorted([*base, *added]) for k, s, e in [x]] for base, added in found for known in [set(base)]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(spans, kind), pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found]), pa.array([spelled([*base, *added]) for base, added in found])],
                    names=["doc_id", "spans", "base_sha256", "spelled"],
                )
        give_back()

    return rows.mapInArrow(work, f"doc_id long, spans {SPANS}, base_sha256 string, spelled string")


def counted(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k - 1]}")
    return found.select("doc_id", *[count(k) for k in range(1, len(TAGS))], "base_sha256", F.col("spelled").alias("spans"))


def masked(docs: DataFrame, model: dict[str, np.ndarray] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; overlapping spans go as one, under the first's kind."""
    model = trained(docs) if model is None else model
    (out,) = fresh(docs, "masked")

    @F.pandas_udf("string")
    def mask(texts):
        finder = Finder(model)

        def one(t: str) -> str:
            parts, at = [], 0
            (base, added), = finder([t])
            for k, a, b in sorted([*base, *added], key=lambda s: s[1:]):
                if a >= at:
                    parts += [t[at:a], f"[{KINDS[k - 1]}]"]
                at = max(at, b)
            return "".join([*parts, t[at:]])

        return texts.map(one, na_action="ignore")

    return docs.withColumn(out, mask(F.col(f"`{text}`").cast("string"))).drop(text).withColumnRenamed(out, text).select(*[F.col(f"`{c}`") for c in docs.columns])
