"""Exact token ids of whole texts by the ``tokenizers`` library, with a memo of space-separated pieces that is
bounded in bytes.

Long corpora repeat their words, so most of a text's ids can be taken from a memo. A text is cut only where the
tokenizer itself always cuts, which is read off its own definition:

* ``drop``: the pre-tokenizer matches no white space (its pattern removes it) - a cut at every space is safe.
* ``lead``: byte-level pieces carry at most one leading space - a cut before a space is safe if the character
  before it is no white space. Texts with other white-space runs are cut at whole runs instead.
* ``whole``: anything else is encoded as it is.

Null texts count as empty and give no ids. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space before a space: such a text is cut at whole runs.
_BAD_ASCII = tuple(c + " " for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f") + tuple("\x1c\x1d\x1e\x1f")
_BREAK_ASCII = tuple(c + "\n" for c in " \t\n\r\x0b\x0c") + tuple("\n" + c for c in "\t\r\x0b\x0c")
_WIDE = tuple(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_BREAK = _BREAK_ASCII + tuple(c + "\n" for c in _WIDE) + tuple("\n" + c for c in _WIDE)
_BAD = _BAD_ASCII + tuple(c + " " for c in _WIDE)
_CONTROL = re.compile("[\x1c-\x1f]")
_TAIL_CHARS = ".,;:!?"
_TAIL_CODES = {c: i for i, c in enumerate(_TAIL_CHARS)}
# Not U+0130, whose lower case is a letter and a mark.
_LETTER_END = "[A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{12F}\\x{131}-\\x{24F}]$"
_RUNS = re.compile(r"\s*\S+|\s+")
CHARS = 1 << 22  # of text that is encoded at once
MEMO_BYTES = 48 << 20  # of a memo's pieces and ids, with what Python needs for each
ENTRY = 200
LONGEST = 256  # characters of a piece that is kept


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of each run."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceTokenizer:
    """Little-endian ids of texts: uint16 where the vocabulary fits, else uint32."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.mode = self._mode(spec)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the memo before the last renewal: what is used again comes back from it
        self.memo_bytes, self.held = memo_bytes, 0
        self.marks = self._marks(spec, "\u0120")
        self.breaks = self._marks(spec, "\u010a")
        self.tails = self._ids(list(_TAIL_CHARS)) if self.mode != "whole" else []
        self.lower = self.mode == "drop" and "Lowercase" in json.dumps(spec.get("normalizer"))

    def _marks(self, spec: dict, start: str) -> np.ndarray | None:
        """For each id, whether its string ends (``drop``) or starts with ``start`` (``lead``)."""
        suffix = spec["model"].get("end_of_word_suffix")
        if self.mode == "whole" or self.mode == "drop" and not suffix:
            return None
        out = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        for token, i in self.tok.get_vocab().items():
            out[i] = token.endswith(suffix) if self.mode == "drop" else token[0] == start
        return out

    @staticmethod
    def _mode(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "lead"
        parts = pre.get("pretokenizers", [])
        if pre.get("type") == "Sequence" and parts and parts[0].get("type") == "Split":
            pattern = parts[0]["pattern"].get("Regex", "")
            kept = [n["type"] for n in (norm or {}).get("normalizers", [])]
            if parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s" in pattern and "\\s+" not in pattern and set(kept) <= {"NFC", "Replace", "Lowercase"}:
                return "drop"
        return "whole"

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids_of_words(self, words: list[str], by: str = " ") -> list[bytes]:
        """Ids of letter runs, many to a call. Each is one pre-token (after a line break two), so the marks of word
        ends (or starts) in the token strings part the joined ids again; where their number is not as expected,
        words go one by one."""
        out: list[bytes] = []
        joined = [words[k : k + 128] for k in range(0, len(words), 128)]
        lead = by if self.mode == "lead" else ""
        marks = self.marks if by == " " else self.breaks
        encoded = self.tok.encode_batch_fast([lead + by.join(part) for part in joined], add_special_tokens=False)
        for part, e in zip(joined, encoded):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(marks[ids])
            if len(at) != len(part) or len(at) and at[0 if lead else -1] != (0 if lead else len(ids) - 1):
                out += self._ids([lead + w for w in part])
                continue
            blob, width = ids.tobytes(), self.dtype.itemsize
            cuts = (np.append(at, len(ids)) if lead else np.insert(at + 1, 0, 0)) * width
            cuts = cuts.tolist()
            out += [blob[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def _blobs(self, pieces: list[str], encode) -> list[bytes]:
        """Ids of distinct pieces, from the memo or by ``encode``."""
        if self.held > self.memo_bytes:
            self.old, self.memo, self.held = self.memo, {}, 0
        memo, old = self.memo, self.old
        out = list(map(memo.get, pieces))
        new = []
        for i in [i for i, b in enumerate(out) if b is None]:
            p = pieces[i]
            b = old.get(p)
            if b is None:
                new.append(i)
            else:
                out[i] = memo[p] = b
                self.held += ENTRY + len(p) + len(b)
        if new:
            words = [pieces[i] for i in new]
            for i, w, b in zip(new, words, encode(words)):
                out[i] = b
                if len(w) <= LONGEST:
                    memo[w] = b
                    self.held += ENTRY + len(w) + len(b)
        return out

    def _either(self, words: list[str], by: str) -> list[bytes]:
        """Letter runs many to a call, others one by one; with ``by`` before each in mode ``lead``."""
        lead = by if self.mode == "lead" else ""
        plain = [self.marks is not None and w.isalpha() for w in words]
        runs = iter(self._ids_of_words([w for w, x in zip(words, plain) if x], by))
        rest = iter(self._ids([lead + w for w, x in zip(words, plain) if not x]))
        return [next(runs) if x else next(rest) for x in plain]

    def _bare(self, pieces: list[str]) -> list[bytes]:
        """Pieces without a leading space, marked by a zero byte: the first of a text, or a line break and a word."""
        out: list = [None] * len(pieces)
        lines = [i for i, p in enumerate(pieces) if p[1:2] == "\n"]
        others = [i for i, p in enumerate(pieces) if p[1:2] != "\n"]
        for i, b in zip(others, self._ids([pieces[i].lstrip("\0") for i in others])):
            out[i] = b
        cut = []
        for i in lines:
            p = pieces[i][2:]
            short = p[-1:] in _TAIL_CODES and p[-2:-1].isalpha() and p[-2] < "\u0250"
            cut.append((p[:-1], p[-1]) if short else (p, ""))
        cores = list({c for c, _ in cut})
        known = dict(zip(cores, self._either(cores, "\n")))
        for i, (core, tail) in zip(lines, cut):
            out[i] = known[core] + (self.tails[_TAIL_CODES[tail]] if tail else b"")
        return out

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct pieces, one after the other, and their numbers. A letter run and one mark after it are
        always two pre-tokens, so ``word,`` is put together from ``word`` and ``,``; A to Z are lower-cased first
        where the tokenizer does so."""
        core = pc.utf8_rtrim(words, _TAIL_CHARS)
        one = pc.equal(pc.subtract(pc.binary_length(words), pc.binary_length(core)), 1)
        cut = pc.and_(one, pc.match_substring_regex(core, _LETTER_END))
        bare = pc.starts_with(words, "\0")
        cut = pc.and_not(cut, bare)
        core = pc.if_else(cut, core, words)
        if self.lower:
            core = pc.ascii_lower(core)
        tail = np.where(cut.to_numpy(zero_copy_only=False), pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, -1), pa.array(list(_TAIL_CHARS), words.type)), 0).to_numpy(zero_copy_only=False) + 1, 0)
        core = core.dictionary_encode()
        codes, cores = core.indices.to_numpy(zero_copy_only=False), core.dictionary.to_pylist()
        blobs = self._blobs(cores, lambda new: self._new(new))
        width = self.dtype.itemsize
        sizes, data = (np.fromiter(map(len, blobs), np.int64, len(blobs)) // width), np.frombuffer(b"".join(blobs), self.dtype)
        ends = [b"", *self.tails]
        tail_sizes = np.array([len(b) // width for b in ends], np.int64)
        first, second = sizes[codes], tail_sizes[tail]
        total = first + second
        at = np.cumsum(total) - total
        out = np.empty(int(total.sum()), self.dtype)
        out[_spread(at, first)] = data[_spread((np.cumsum(sizes) - sizes)[codes], first)]
        tails = np.frombuffer(b"".join(ends), self.dtype)
        out[_spread(at + first, second)] = tails[_spread((np.cumsum(tail_sizes) - tail_sizes)[tail], second)]
        return out, total

    def _new(self, pieces: list[str]) -> list[bytes]:
        mark = [p[:1] == "\0" for p in pieces]
        if not any(mark):
            return self._either(pieces, " ")
        bare = iter(self._bare([p for p, x in zip(pieces, mark) if x]))
        rest = iter(self._either([p for p, x in zip(pieces, mark) if not x], " "))
        return [next(bare) if x else next(rest) for x in mark]

    def _alone(self, text: str) -> np.ndarray:
        """Ids of a text whose white space needs care (``lead``): cut at whole runs, or not at all."""
        if "\0" in text or _CONTROL.search(text):
            return np.frombuffer(self._ids([text])[0], self.dtype)
        runs = ["" if r == " " else r[1:] if r[0] == " " else "\0\0" + r for r in _RUNS.findall(text)]
        own = {r: None for r in runs}
        known = dict(zip(own, self._blobs(list(own), lambda new: [self._ids([p[2:] if p[:1] == "\0" else " " + p])[0] for p in new])))
        return np.frombuffer(b"".join(map(known.__getitem__, runs)), self.dtype)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and each text's number of ids."""
        if self.mode == "whole":
            blobs = self._ids(texts)
            return np.frombuffer(b"".join(blobs), self.dtype), np.array([len(b) for b in blobs], np.int64) // self.dtype.itemsize
        lead = self.mode == "lead"
        alone: dict[int, np.ndarray] = {}
        plain = []
        for i, t in enumerate(texts):
            ascii_only = t.isascii()
            if "\0" in t or lead and any(x in t for x in (_BAD_ASCII if ascii_only else _BAD)):
                alone[i] = self._alone(t)
                plain.append("\0\0" if lead else "")
            elif not lead:
                plain.append(t.replace("\n", " ") if "\n" in t else t)
            else:
                first = "" if t[:1] == " " else "\0\0"
                if "\n" in t and t[0] != "\n" and t[-1] != "\n" and not any(x in t for x in (_BREAK_ASCII if ascii_only else _BREAK)):
                    t = t.replace("\n", " \0\n")
                plain.append(first + t if first else t[1:])
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        offsets = lists.offsets.to_numpy()
        words = lists.values.dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        known, sizes = self._distinct(words.dictionary)
        size = sizes[codes]
        ids = known[_spread((np.cumsum(sizes) - sizes)[codes], size)]
        at = np.concatenate(([0], np.cumsum(size)))[offsets]
        lengths = np.diff(at)
        if alone:
            parts, before = [], 0
            for i, x in sorted(alone.items()):
                parts += [ids[before : at[i]], x]
                before, lengths[i] = at[i + 1], len(x)
            ids = np.concatenate([*parts, ids[before:]])
        return ids, lengths

    def encode_each(self, texts: list[str]) -> list[np.ndarray]:
        ids, lengths = self.encode(texts)
        return np.split(ids, np.cumsum(lengths)[:-1]) if len(texts) else []


_LOADED: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer and memo for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceTokenizer(path)
    return _LOADED[path]


def batches(texts: list[str], chars: int = CHARS):
    """Index ranges of about ``chars`` characters, so a memo refill and its id arrays stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
