"""Packing (1): concatenate and cut.

All documents' token streams form one sequence, cut into windows of ``seq_len``. Two passes: the first tokenizes
every partition once, keeps ids with their running start in the partition, and gives the partitions' token totals;
a prefix sum over those totals (one row for each partition) gives each partition's global offset. The second cuts
each stored document at the window borders. A document over a border leaves a piece on either side; nothing moves
between tasks. Only the last window is padded.

Defined cases: null or empty text gives just the end id; a text of any length is cut into as many windows as it
needs; repeated rows or doc_ids are packed once for each row; an empty table gives no rows; extra columns are
ignored, whatever their names. A null doc_id stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import give_back, materialise, shuffle_partitions, slices, text_column
from fathom.llm.tokens import CHARS, tokenizer

SEQ_LEN = 4096
END_ID = 2

TOKENS = "pid int, local_start long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, doc_ids binary, boundary boolean"


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, order_by: list[str] | None = None) -> DataFrame:
    """Pass one: documents with ids (16 bits each where they fit, else 32) and their start in the partition."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"), *[F.col(c).alias(f"__order{i}") for i, c in enumerate(order_by or [])])
    if order_by:
        order = [f"__order{i}" for i in range(len(order_by))]
        df = df.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    df = df.select("doc_id", "text")

    def tokenize(parts):
        tok, pid, at = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        for part in parts:
            ids_of = part.column(0)
            for a, b, texts in slices(part.column(1), CHARS):
                ids, n = tok.encode(texts)
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                ends = np.cumsum(n)
                starts = at + ends - n
                at += len(ids)
                cuts = np.concatenate(([0], ends)) * tok.dtype.itemsize
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cuts), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, pid, np.int32)), pa.array(starts), ids_of[a:b], pa.array(n), blobs], names=["pid", "local_start", "doc_id", "n", "ids"])
        give_back()

    return materialise(df.mapInArrow(tokenize, TOKENS), "packing")


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, order_by: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in fixed windows: see PIECES. ``doc_ids`` holds the piece's ids (left out unless
    ``with_ids``), ``boundary`` tells that the document goes on in another window. ``order_by`` names columns of
    ``docs`` that give the order of concatenation; else it is the order of the scan."""
    tokens = token_table(docs, tokenizer_path, end_id, order_by)
    totals = tokens.groupBy("pid").agg(F.sum("n").alias("total"))
    # One row for each partition of the first pass: bounded by the number of its tasks, not by rows.
    base = totals.selectExpr("pid", "sum(total) OVER (ORDER BY pid) - total AS base")
    placed = tokens.join(F.broadcast(base), "pid").selectExpr("doc_id", "n", "base + local_start AS at", "ids")

    def cut(parts):
        for part in parts:
            col = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "doc_ids", "boundary")}
            for doc_id, n, at, blob in zip(*(part.column(k).to_pylist() for k in range(4))):
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4")
                start = 0
                while start < n:
                    offset = (at + start) % seq_len
                    length = min(seq_len - offset, n - start)
                    piece = ids[start : start + length].astype("<u4").tobytes()
                    for k, v in zip(col, (doc_id, start, length, zlib.crc32(piece), n, (at + start) // seq_len, offset, piece if with_ids else None, length < n)):
                        col[k].append(v)
                    start += length
            types = [pa.int64()] * 7 + [pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(col.values(), types)], names=list(col))

    return placed.mapInArrow(cut, PIECES)
