"""A sink that makes one named file of all tasks' rows, in two phases.

Each task attempt writes a part of its own below a folder of the write and reports it; at the commit the driver strings the reported
parts together, in the order of partitions, under a temporary name and puts it in place by one rename. Parts of failed or
repeated attempts are reported by nobody, so they never get in; they go with the folder, at the commit or when the write is
given up. ``path`` is a folder that the driver and all executors mount.
"""

from __future__ import annotations

import csv
import os
import shutil
import uuid
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PIECE = 1 << 20


class Part(WriterCommitMessage):
    def __init__(self, partition: int, path: str, rows: int):
        self.partition, self.path, self.rows = partition, path, rows


class SheetWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.folder, self.name, self.columns, self.overwrite = options["path"], options["sheet"], columns, overwrite
        self.work = os.path.join(self.folder, f".{self.name}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.work, exist_ok=True)
        where = TaskContext.get()
        path, rows = os.path.join(self.work, f"{where.partitionId()}-{where.taskAttemptId()}.csv"), 0
        with open(path, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            for row in iterator:
                out.writerow(["" if v is None else v for v in row])
                rows += 1
        return Part(where.partitionId(), path, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        target = os.path.join(self.folder, f"{self.name}.csv")
        if os.path.exists(target) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{target} is there")
        os.makedirs(self.work, exist_ok=True)
        whole = os.path.join(self.work, "whole")
        with open(whole, "wb") as out:
            out.write((",".join(csv_field(c) for c in self.columns) + "\r\n").encode())
            for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition):
                with open(m.path, "rb") as f:
                    shutil.copyfileobj(f, out, PIECE)
        os.replace(whole, target)
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


def csv_field(text: str) -> str:
    quoted = text.replace('"', '""')
    return f'"{quoted}"' if any(c in text for c in ',"\r\n') else text


class SheetSink(DataSource):
    """spark.dataSource.register(SheetSink); df.write.format("sheet").option("sheet", name).mode("overwrite").save(folder) writes
    folder/name.csv with a header."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SheetWriter(self.options, schema.names, overwrite)


def write_files(spark: SparkSession, folder: str, sheets: dict[str, DataFrame]) -> list[str]:
    """One file for each sheet that has rows; gives their names."""
    spark.dataSource.register(SheetSink)
    os.makedirs(folder, exist_ok=True)
    filled = {n: df for n, df in sheets.items() if df.take(1)}
    for name, df in filled.items():
        df.write.format("sheet").option("sheet", name.replace(" ", "_")).mode("overwrite").save(folder)
    return sorted(filled)
