"""Tokens, packing (1), binary output (8) and counts (9) against the tokenizers library."""

import io
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer, models, pre_tokenizers  # noqa: E402

from fathom.llm import counts  # noqa: E402
from fathom.llm.packing import pack  # noqa: E402
from fathom.llm.tokenio import ShardReader, ShardWriter, export_tokens, read_documents  # noqa: E402
from fathom.llm.tokens import PieceTokenizer  # noqa: E402

WORD, BYTE, PIECE = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", "  ", " a  b\n\nc", "é éx, ", "it's  don't.", "a\t b\x85c \x1c d", "İstanbul ΣΑΣ", "\0x", "<|endoftext|> hi", " \n x", "x \n", "A. B, c; 12, 3.4!! (q), \"z\".", "日本語 テスト。", "one.\nTwo three,\nfour", "x\n", "\nx", "\x0b\n a", "é, ñ.", "Å İ."]
MANY = ODD + [None, "Word " * 3000, "one.\nTwo three,\nfour", "nospace" * 2000]
ALPHABET = st.sampled_from([*"aBz.,!é́İ9'", " ", " ", "\n", "\t", "\xa0", "\x1c", "\0", "日"])


@pytest.fixture(scope="module")
def plain():
    out = {}
    for path in (WORD, BYTE):
        out[path] = Tokenizer.from_file(path)
        out[path].encode_special_tokens = True
    return out


@pytest.fixture(scope="module")
def memo():
    return {path: PieceTokenizer(path, memo_bytes=100_000) for path in (WORD, BYTE)}


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_odd_texts(plain, memo, path):
    got = [x.tolist() for x in memo[path].encode_each(ODD)]
    assert got == [e.ids for e in plain[path].encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(ALPHABET, max_size=40), max_size=6))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_any_texts(plain, memo, path, texts):
    got = [x.tolist() for x in memo[path].encode_each(texts)]
    assert got == [e.ids for e in plain[path].encode_batch(texts, add_special_tokens=False)]


def frame(spark, texts):
    rows = [(3 * i % 101, t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3), {r[0]: r[1] or "" for r in rows}


def test_packing(spark, plain):
    docs, texts = frame(spark, MANY)
    got = pack(docs, WORD, seq_len=64, end_id=2).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    for i, t in texts.items():
        ids, at = np.array([*plain[WORD].encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.boundary == (r.length < len(ids))
            piece = ids[at : at + r.length].tobytes()
            assert bytes(r.doc_ids) == piece and r.ids_crc32 == zlib.crc32(piece)
            at += r.length
        assert at == len(ids)
    for k, v in by_window.items():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or k == max(by_window)
    assert sorted(by_window) == list(range(len(by_window)))


def test_packing_in_order_and_empty(spark):
    docs, texts = frame(spark, MANY)
    got = sorted(pack(docs, WORD, seq_len=64, order_by=["doc_id"]).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = list(dict.fromkeys(r.doc_id for r in got))
    assert order == sorted(texts)
    assert pack(docs.where("false"), WORD).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert pack(twice, WORD).groupBy("doc_id").count().orderBy("count").collect()[-1]["count"] == 2


def test_binary_output(spark, plain):
    docs, texts = frame(spark, MANY)
    folder, manifest = export_tokens(docs, BYTE, end_id=0, seq_len=32, rows=4)
    got, at = {r.doc_id: r for r in read_documents(spark, folder, manifest).collect()}, 0
    for i in sorted(texts):
        ids = np.array([*plain[BYTE].encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    first = min(manifest, key=lambda m: m["pid"])
    reader = ShardReader(folder, first["name"])
    stream = np.concatenate([np.array([*plain[BYTE].encode(texts[i], add_special_tokens=False).ids, 0]) for i in sorted(texts)])
    ids, mask = reader.sequence(1)
    assert len(ids) == 32 and ids.tolist() == stream[32:64].tolist() and all(mask.to_pylist())
    empty = export_tokens(docs.where("false"), BYTE)
    assert empty[1] == [] and read_documents(spark, *empty).count() == 0


@pytest.mark.parametrize("n", [0, 5, 64, 8 * 4 * 50, 8 * 4 * 50 + 9])
def test_sequence_reads_its_own_batch(tmp_path, n):
    ids = np.arange(n, dtype=np.uint16)
    with pa.OSFile(f"{tmp_path}/s.ids.arrow", "wb") as f:
        out = ShardWriter(f, np.uint16, 8, 4)
        out.add(ids)
        out.close()
    (tmp_path / "s.docs.arrow").write_bytes(b"-")
    count = -(-n // 8)
    reader = ShardReader(str(tmp_path), "s")
    for i in range(count):
        got, mask = reader.sequence(i)
        assert got[mask.to_numpy(zero_copy_only=False)].tolist() == ids[8 * i : 8 * i + 8].tolist()
    for i in (-1, count, count + 1, count + 4, count + 1000):
        with pytest.raises(IndexError):
            reader.sequence(i)
    if count > 100:
        class Counted(io.FileIO):
            def read(self, size=-1):
                sizes.append(len(x := super().read(size)))
                return x

        sizes: list[int] = []
        reader = ShardReader(str(tmp_path), "s")
        reader.ids = pa.PythonFile(Counted(f"{tmp_path}/s.ids.arrow"), "r")
        reader.sequence(count - 1)
        assert sum(sizes) < (tmp_path / "s.ids.arrow").stat().st_size / 5


@pytest.mark.parametrize("fallback", [False, True])
def test_counts(spark, fallback):
    vocabulary = counts.read_vocabulary(PIECE)
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")])
    docs, texts = frame(spark, [*MANY, "a▁b ▁x ▁▁ y", "☃☃x☃ \U0001d518\U0001d52b"])
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(docs, PIECE, fallback).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}


def test_count_ties():
    for vocabulary in ([("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("b", -1.5), ("ab", -2.5)], [("<unk>", -9.0), ("aa", -1.0), ("a", -0.5), ("ba", -1.0)]):
        t, c = Tokenizer(models.Unigram(vocabulary, unk_id=0)), counts.UnigramCounter(vocabulary)
        for text in ("a", "aaaa", "aaaaaab", "bab", "xxaxx", "bbbb", "abaaab", "ba" * 9):
            assert c.count(text) == len(t.encode(text, add_special_tokens=False).ids), text
