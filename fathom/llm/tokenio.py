"""Token-ID / binary output (8): Arrow stream files of fixed-size lists.

Documents are dealt out by ranges of doc_id and sorted, so each shard holds a run of the global order. A shard has
two Arrow IPC stream files: ``.ids.arrow`` with batches of ``rows`` sequences, each a fixed-size list of ``seq_len``
ids and one of mask bits (false: padding, only at a shard's end), and ``.docs.arrow`` with doc_id, start and n_tokens
(starts count within the shard). All batches of a shard but the last have the same size, so sequence i is in batch
i // rows, whose place in the file follows from the first batch's size, and a memory-mapped file is read without a copy. File names carry the task attempt; the returned manifest,
made only of tasks that succeeded, says which files count, so a lost executor or a repeated attempt does no harm.

Defined cases: null or empty text gives just the end id; repeated doc_ids stay next to each other, once for each
row; an empty table gives no files and no rows; extra columns are ignored. Null doc_ids sort first.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import give_back, shared_folder, slices, text_column
from fathom.llm.tokens import CHARS, tokenizer

SEQ_LEN = 2048
ROWS = 128
END_ID = 0
MANIFEST = "pid int, name string, n_docs long, n_tokens long"
ROWS_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"


def open_fs(folder: str):
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def shard_schema(dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class ShardWriter:
    """Ids in, full batches out; holds less than one batch."""

    def __init__(self, sink, dtype, seq_len: int, rows: int):
        self.seq_len, self.rows, self.dtype = seq_len, rows, dtype
        self.schema = shard_schema(dtype, seq_len)
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.buffer, self.have = [], 0

    def _emit(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.seq_len)
        full = np.zeros(n * self.seq_len, self.dtype)
        full[: len(ids)] = ids
        mask = np.arange(len(full)) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.seq_len) for v in (full, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.buffer.append(ids)
        self.have += len(ids)
        most = self.rows * self.seq_len
        if self.have >= most:
            ids = np.concatenate(self.buffer)
            for k in range(0, len(ids) - most + 1, most):
                self._emit(ids[k : k + most])
            rest = ids[len(ids) - len(ids) % most :]
            self.buffer, self.have = [rest], len(rest)

    def close(self) -> None:
        if self.have:
            self._emit(np.concatenate(self.buffer))
        self.out.close()


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, seq_len: int = SEQ_LEN, rows: int = ROWS) -> DataFrame:
    """Lazy manifest; collecting it writes the files."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def write(parts):
        parts = (p for p in parts if p.num_rows)
        part = next(parts, None)
        if part is None:
            return
        tok, context = tokenizer(tokenizer_path), TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        at, n_docs = 0, 0
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        with fs.open_output_stream(f"{root}/{name}.ids.arrow") as a, fs.open_output_stream(f"{root}/{name}.docs.arrow") as b:
            out, docs_out = ShardWriter(a, tok.dtype, seq_len, rows), pa.ipc.new_stream(b, index)
            while part is not None:
                for lo, hi, texts in slices(part.column(1), CHARS):
                    ids, n = tok.encode(texts)
                    out.add(np.insert(ids, np.cumsum(n), end_id))
                    n = n + 1
                    docs_out.write_batch(pa.RecordBatch.from_arrays([part.column(0)[lo:hi], pa.array(at + np.cumsum(n) - n), pa.array(n)], schema=index))
                    at, n_docs = at + int(n.sum()), n_docs + hi - lo
                part = next(parts, None)
            out.close()
            docs_out.close()
        give_back()
        yield pa.RecordBatch.from_pydict({"pid": pa.array([context.partitionId()], pa.int32()), "name": [name], "n_docs": [n_docs], "n_tokens": [at]})

    return df.mapInArrow(write, MANIFEST)


class ShardReader:
    """``sequence(i)``: ids and mask of one sequence, views into the file where it is local."""

    def __init__(self, folder: str, name: str):
        fs, root = open_fs(folder)
        path = f"{root}/{name}"
        source = (lambda x: pa.memory_map(x)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.ids, self.docs = source(f"{path}.ids.arrow"), source(f"{path}.docs.arrow")
        self.at: tuple[int, int, int] | None = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        self.ids.close()
        self.docs.close()

    def id_batches(self):
        for batch in pa.ipc.open_stream(self.ids):
            ids, mask = batch.column(0).flatten().to_numpy(), batch.column(1).flatten()
            yield ids, mask

    def doc_batches(self):
        yield from pa.ipc.open_stream(self.docs)

    def sequence(self, i: int):
        if self.at is None:  # where batches begin, and the size and rows of a full one
            self.ids.seek(0)
            self.schema, begin = pa.ipc.read_schema(pa.ipc.read_message(self.ids)), self.ids.tell()
            try:
                rows = pa.ipc.read_record_batch(pa.ipc.read_message(self.ids), self.schema).num_rows
            except EOFError:  # no batch
                raise IndexError(i) from None
            self.at = begin, self.ids.tell() - begin, rows
        begin, size, rows = self.at
        b, k = divmod(i, rows)
        if i < 0 or begin + b * size >= self.ids.size():
            raise IndexError(i)
        self.ids.seek(begin + b * size)
        try:
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.ids), self.schema)
        except EOFError:  # the end mark
            raise IndexError(i) from None
        if k >= batch.num_rows:
            raise IndexError(i)
        return batch.column(0)[k].values.to_numpy(), batch.column(1)[k].values


def read_documents(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """Rows of every document from the files of a manifest, a task for each shard."""
    shards = sorted(manifest, key=lambda m: m["pid"])
    base, at = [], 0
    for m in shards:
        base.append((m["name"], at))
        at += m["n_tokens"]
    n = len(base)
    todo = spark.range(0, max(n, 1), 1, max(n, 1))

    def read(parts):
        for part in parts:
            for k in part.column(0).to_pylist():
                if k >= n:
                    continue
                name, before = base[k]
                with ShardReader(folder, name) as shard:
                    source, held = shard.id_batches(), np.zeros(0, np.uint32)
                    for docs in shard.doc_batches():
                        found = []
                        for size in docs.column(2).to_pylist():
                            crc = 0
                            while size:  # batch by batch: no document is held whole
                                if not len(held):
                                    ids, mask = next(source)
                                    held = ids[: pc.sum(mask).as_py()]
                                crc = zlib.crc32(held[:size].astype("<u4").tobytes(), crc)
                                size, held = max(size - len(held), 0), held[size:]
                            found.append(crc)
                        starts = docs.column(1).to_numpy() + before
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts), docs.column(2), pa.array(found, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(read, ROWS_BACK)


def export_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, seq_len: int = SEQ_LEN, rows: int = ROWS) -> tuple[str, list]:
    """Write the files; gives the folder and the manifest, a row for each shard."""
    folder = folder or shared_folder(docs.sparkSession, "token-shards")
    manifest = write_shards(docs, folder, tokenizer_path, end_id, seq_len, rows).collect()
    if manifest:  # what failed attempts left goes
        fs, root = open_fs(folder)
        names = {f"{m['name']}.{kind}.arrow" for m in manifest for kind in ("ids", "docs")}
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.startswith("shard-") and info.base_name not in names:
                fs.delete_file(info.path)
    return folder, manifest
