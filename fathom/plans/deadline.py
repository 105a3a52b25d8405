"""Runs with a time limit: a status row for each, and no job left behind.

A run's jobs form a group; at its deadline the group is cancelled, so executors stop work on it, and the next run has the
cluster to itself. Failures are told apart by the same status codes as a fetch's.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fathom.sources.quotes import EMPTY, LIMITED, NETWORK, OK, TIMEOUT, UNKNOWN

STATUS = "run string, status int, rows long, seconds double, message string"
PATIENCE = 30.0  # seconds for a cancelled run to end


def status_of(error: BaseException) -> int:
    """The code of a failure, by its kind, else by what it says."""
    if isinstance(error, TimeoutError):
        return TIMEOUT
    if isinstance(error, ConnectionError):
        return NETWORK
    text = str(error).lower()
    if "rate limit" in text or "429" in text:
        return LIMITED
    return TIMEOUT if "timeout" in text or "timed out" in text else UNKNOWN


def run_within(spark: SparkSession, name: str, find: Callable[[], DataFrame], seconds: float) -> tuple[str, int, int, float, str | None]:
    """A row of STATUS for one run: ``find`` and all rows of its result, within ``seconds``."""
    sc, group, out = spark.sparkContext, f"{name}-{uuid.uuid4().hex}", {}

    def work() -> None:
        sc.setJobGroup(group, name, interruptOnCancel=True)
        try:
            seen = Observation()
            find().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()  # all columns are worked out
            out["rows"] = seen.get["rows"]
        except Exception as e:  # told by its status
            out["error"] = e

    began = time.perf_counter()
    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    late = thread.is_alive()
    until = time.perf_counter() + PATIENCE
    while thread.is_alive() and time.perf_counter() < until:  # a run may start another job after the first is cancelled
        sc.cancelJobGroup(group)
        thread.join(0.2)
    spent = time.perf_counter() - began
    if late:
        return name, TIMEOUT, 0, spent, f"over {seconds:g} seconds"
    if "error" in out:
        return name, status_of(out["error"]), 0, spent, str(out["error"]).partition("\n")[0][:300]
    return name, OK if out["rows"] else EMPTY, out["rows"], spent, None


def run_all(spark: SparkSession, runs: dict[str, Callable[[], DataFrame]], seconds: float) -> DataFrame:
    """STATUS of several runs, one after the other."""
    return spark.createDataFrame([run_within(spark, n, f, seconds) for n, f in runs.items()], STATUS)
