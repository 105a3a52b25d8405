"""Token counts (9): count-only Viterbi over a unigram vocabulary.

Counts equal those of the ``tokenizers`` library's Unigram model behind white-space splitting and a word mark
(U+2581) before each word. The vocabulary with its scores is read from a public sentencepiece file. An Aho-Corasick
automaton gives all pieces that end at each character, longest first; the dynamic programme carries the best score
and its piece count, never the pieces. Tie rule: among equal scores the piece that starts first stays, since a
later one must be strictly better. A character that is no piece costs the lowest score less 10; neighbours of that
kind count as one piece (or as their bytes, where the model falls back to bytes).

Words repeat, so counts are kept in a memo of each worker, bounded in bytes; very long words are not kept.

Defined cases: null, empty and blank texts have 0 words and 0 tokens; texts of any length are counted whole;
repeated rows are counted once for each row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import text_column

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
MEMO_BYTES = 64 << 20  # of a worker's memo
ENTRY = 120
LONGEST = 256  # characters of a word that is kept
# White space by Unicode's property; Python's str.split() cuts at U+001C to U+001F too.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROL = re.compile("[\x1c-\x1f]")
_MARKED = re.compile(f"{MARK}[^{MARK}]*")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in id order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]


class UnigramCounter(dict):
    """A memo word -> count; a missing word is counted and kept."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = False):
        import ahocorasick

        super().__init__()
        self.held = 0
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback and {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in vocabulary}

    def count(self, s: str) -> int:
        n = len(s)
        score, pieces, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, best, first, single = -1, None, 0, False

        def close(end: int) -> None:
            """Set what is known of the prefix that ends before ``end``."""
            nonlocal best
            i = end - 1
            if not single:
                c = score[i] + self.unknown
                if best is None or c > best:
                    score[end], unk[end] = c, True
                    pieces[end] = pieces[i] + (len(s[i].encode()) if self.byte_fallback else not unk[i])
                    best = None
                    return
            score[end], pieces[end] = best, pieces[first] + 1
            best = None

        for e, (length, value) in self.automaton.iter(s):
            if e != at:
                for k in range(at, e):
                    if k >= 0:
                        close(k + 1)
                    single = False
                at = e
            i = e + 1 - length
            c = score[i] + value
            if best is None or c > best:
                best, first = c, i
            single = single or length == 1
        for k in range(at, n):
            if k >= 0:
                close(k + 1)
            single = False
        return pieces[n]

    def __missing__(self, word: str) -> int:
        s = word if word[0] == MARK else MARK + word
        n = sum(map(self.count, _MARKED.findall(s))) if MARK in word else self.count(s)
        if len(word) <= LONGEST:
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self[word] = n
            self.held += ENTRY + 2 * len(word)
        return n

    def text(self, text: str) -> tuple[int, int]:
        words = [w for w in _SPACE.split(text) if w] if _CONTROL.search(text) else text.split()
        return len(words), sum(map(self.__getitem__, words))


_LOADED: dict[tuple, UnigramCounter] = {}


def counter(path: str, byte_fallback: bool) -> UnigramCounter:
    if (path, byte_fallback) not in _LOADED:
        _LOADED[path, byte_fallback] = UnigramCounter(read_vocabulary(path), byte_fallback)
    return _LOADED[path, byte_fallback]


def token_counts(docs: DataFrame, model_path: str, byte_fallback: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens for each row."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))

    def count(parts):
        memo = counter(model_path, byte_fallback)
        for part in parts:
            n = np.zeros((2, part.num_rows), np.int64)
            for i, t in enumerate(part.column(1)):
                n[:, i] = memo.text(t.as_py())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n[0]), pa.array(n[1])], names=["doc_id", "n_words", "n_tokens"])

    return df.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
