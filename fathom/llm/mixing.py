"""Mixing sources to target weights (10): Pfair scheduling, DataFrame and SQL functions only.

Each source's rows, in order of doc_id, form blocks of ``block_rows``. Time has a slot for each block. A source of
share w has its j-th block (from 1) released at floor((j-1)/w) and due by ceil(j/w); in each slot the earliest
deadline among the released goes first (ties: the source's name). With shares that sum to 1 every deadline is met,
so at any slot t a source has had more than w*t - 1 and less than w*t + 1 blocks. Shares are the exact ratios of the
weights as written (fractions, no rounding to slots of a cycle), so this holds for phases of any length. When a
source ends, the shares of the others are scaled up and a new phase begins: every row is scheduled, none is dropped.

The driver works the slots out from the sources' row counts alone. Whole numbers as shares make a schedule that repeats
after their sum: where that is at most ``PERIOD``, one period is worked out and Spark repeats it, so the driver's time
follows sources and periods, not blocks. Weights of a longer period are worked out slot after slot. Slots are written
in pieces (a table of source, block and slot) of at most about ``PIECE`` + ``PERIOD``. Without given weights the targets
are rows ** ALPHA in whole parts of ``PARTS`` for all sources, one part at least.
Rows are numbered in two passes: range partitions that split a large source, running counts within a partition and
source, and prefix sums over (partition, source) totals.

Defined cases: a null source is the source '' ; null doc_ids come first; repeated rows have neighbouring ranks, each in the
block of its own; an
empty table gives no rows; texts only matter as a tie-break between equal doc_ids; extra columns are ignored by
schedule() and kept by mixed().
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import materialise, shared_folder, shuffle_partitions, text_column

BLOCK_ROWS = 16
CYCLE = 1024  # slots in a row of the plan, where it does not repeat
PERIOD = 1 << 17  # slots of the longest period
PIECE = 1 << 16  # slots written at a time
PARTS = 1 << 16  # of the targets, where no weights are given
ALPHA = 0.5  # without given weights, targets follow rows ** ALPHA

PLAN = "array<struct<source:string,phase:int,first:long,start:long,cycle:long,repeats:long,slots:array<int>>>"


def shares(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """Whole numbers in the exact ratio of the weights as written, and their sum."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    share = {s: int(x * scale) for s, x in exact.items()}
    return share, sum(share.values())


def earliest(order: list[str], share: dict[str, int], whole: int) -> Iterator[str]:
    """The source of each slot, earliest deadline first (ties: the earlier in ``order``), without end. ``order`` has the
    larger shares first, so the deadlines of first blocks never fall in it, and a source waits there for its first turn."""
    waiting: list[tuple[int, int, int]] = []
    ready: list[tuple[int, int, int]] = []
    begun = t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * whole // share[order[k]]), k, j))
        new = (-(-whole // share[order[begun]]), begun, 1) if begun < len(order) else None
        if new and (not ready or new < ready[0]):
            deadline, k, j = new
            begun += 1
        else:
            deadline, k, j = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline was missed")
        yield order[k]
        heapq.heappush(waiting, (j * whole // share[order[k]], k, j + 1))
        t += 1


def pieces(blocks: dict[str, int], weights: dict[str, float], cycle: int = CYCLE) -> Iterator[dict]:
    """Which blocks of each source go where: of its n blocks from ``first`` on, the k-th has the slot start + (k // share)
    * cycle + slots[k % share]. Slots follow each other without a gap."""
    left, done, start, phase = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, 0
    shares_of, _ = shares({s: weights[s] for s in left}) if left else ({}, 0)
    order = sorted(left, key=lambda s: (-shares_of[s], s))
    total = sum(shares_of.values())

    def run(turns: Iterator[str], most: int) -> tuple[dict[str, list[int]], int]:
        """The slots of the next ``most`` turns, or as far as a source lasts."""
        slots: dict[str, list[int]] = {}
        for t in range(most):
            s = next(turns)
            slots.setdefault(s, []).append(t)
            if len(slots[s]) == left[s]:
                return slots, t + 1
        return slots, most

    def row(s: str, slots: list[int], size: int, repeats: int = 1) -> dict:
        return {"source": s, "phase": phase, "first": done[s], "n": len(slots) * repeats, "start": start, "cycle": size, "share": len(slots), "repeats": repeats, "slots": slots}

    while left:
        g = gcd(*(shares_of[s] for s in order)) if total <= PERIOD * min(shares_of[s] for s in order) else 1
        period = total // g
        repeats = min(left[s] * g // shares_of[s] for s in order) if period <= PERIOD else 0
        if repeats > 1:
            turns, slots = earliest(order, shares_of, total), {}
            for t in range(period):
                slots.setdefault(next(turns), []).append(t)
            for s in order:
                yield row(s, slots[s], period, repeats)
                done[s] += len(slots[s]) * repeats
                left[s] -= len(slots[s]) * repeats
            start += period * repeats
        turns, ended = earliest(order, shares_of, total), not all(left.values())
        while not ended:
            slots, size = run(turns, cycle)
            for s in sorted(slots):
                yield row(s, slots[s], size)
                done[s] += len(slots[s])
                left[s] -= len(slots[s])
                ended = ended or not left[s]
            start += size
        for s in [s for s, n in left.items() if not n]:
            del left[s], order[bisect_left(order, (-shares_of[s], s), key=lambda s: (-shares_of[s], s))]
            total -= shares_of[s]
        phase += 1


def plan(blocks: dict[str, int], weights: dict[str, float], cycle: int = CYCLE) -> list[dict]:
    return list(pieces(blocks, weights, cycle))


def targets(counts: dict[str, int], weights: dict[str, float] | None) -> dict[str, float]:
    """The weight of each source. Sources without one come in at half the least."""
    if not weights:
        whole = sum(n**ALPHA for n in counts.values())
        return {s: max(1, round(PARTS * n**ALPHA / whole)) for s, n in counts.items()}
    wanted = {s: float(weights.get(s, 0.0)) for s in counts}
    least = min((w for w in wanted.values() if w > 0), default=1.0)
    return {s: w if w > 0 else least / 2 for s, w in wanted.items()}


def slot_table(spark: SparkSession, found: Iterator[dict]) -> DataFrame:
    """(source, block, phase, slot) of all blocks, written to the shared folder piece by piece."""
    path = shared_folder(spark, "mixing-slots")
    schema = "source string, block long, phase int, slot long"

    def write(rows: list[dict]) -> None:
        names = ("source", "phase", "first", "start", "cycle", "repeats", "slots")
        body = json.dumps([{c: r[c] for c in names} for r in rows])
        table = spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(body), PLAN)))
        table = table.selectExpr("*", "explode(sequence(0L, repeats - 1)) AS r")
        most = max((r["repeats"] for r in rows), default=1)
        if most > 1:
            table = table.repartition(min(shuffle_partitions(spark), most), "r")
        table = table.selectExpr("source", "first + r * size(slots) AS first", "start + r * cycle AS start", "phase", "posexplode(slots) AS (k, s)")
        table.selectExpr("source", "first + k AS block", "phase", "start + s AS slot").write.mode("append").parquet(path)

    rows, n = [], 0
    for r in found:
        rows.append(r)
        n += len(r["slots"])
        if n >= PIECE:
            write(rows)
            rows, n = [], 0
    write(rows)
    return spark.read.schema(schema).parquet(path)


def ranked(docs: DataFrame) -> DataFrame:
    """(source, doc_id, text_hash, copies, rank): equal rows once, rank counts rows of the source before them."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    thin = docs.select(source.alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_column(docs)).alias("text_hash"))
    keys = ["source", "doc_id", "text_hash"]
    thin = thin.groupBy(*keys).agg(F.count("*").alias("copies"))
    placed = thin.repartitionByRange(shuffle_partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = materialise(placed.select("*", F.spark_partition_id().alias("pid"), at.alias("at")), "mixing")
    parts = placed.groupBy("pid", "source").agg(F.sum("copies").alias("rows"))
    base = parts.withColumn("base", F.sum("rows").over(Window.partitionBy("source").orderBy("pid")) - F.col("rows"))
    within = F.sum("copies").over(Window.partitionBy("pid", "source").orderBy("at")) - F.col("copies")
    return placed.withColumn("within", within).join(base.select("pid", "source", "base"), ["pid", "source"]).select(*keys, "copies", (F.col("base") + F.col("within")).alias("rank"))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, cycle: int = CYCLE, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, source, text_hash, copies, copy, rank, block, phase, slot, position of each row; equal rows differ in copy
    (from 0). Positions grow in the order of mixing and have gaps only after a source's last, shorter block. ``rows``
    is ranked(docs), where that is at hand."""
    rows = ranked(docs) if rows is None else rows
    counts = {r.source: r.rows for r in rows.groupBy("source").agg(F.sum("copies").alias("rows")).collect()}
    wanted = targets(counts, weights)
    slots = slot_table(docs.sparkSession, pieces({s: -(-n // block_rows) for s, n in counts.items()}, wanted, cycle))
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("rank", F.col("rank") + F.col("copy"))
    out = each.withColumn("block", F.expr(f"rank div {block_rows}")).join(slots, ["source", "block"])
    return out.withColumn("position", F.expr(f"slot * {block_rows} + rank % {block_rows}"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, cycle: int = CYCLE) -> DataFrame:
    """doc_id, source, block, slot, position for every row."""
    out = schedule(docs, weights, block_rows, cycle)
    return out.selectExpr("doc_id", "source", "block", "phase", "slot", "position", "rank AS source_rank")


KEY = ["known", "doc", "origin", "hash"]


def keyed(df: DataFrame, doc_id, source, text_hash) -> DataFrame:
    """``df`` with KEY, which has no nulls."""
    doc_id = doc_id.cast("long")
    return df.withColumns({"known": doc_id.isNotNull(), "doc": F.coalesce(doc_id, F.lit(0).cast("long")), "origin": source, "hash": text_hash})


def with_copy(docs: DataFrame) -> DataFrame:
    """``docs`` with copy, which numbers rows of equal KEY from 0, in two passes as in ranked()."""
    at = F.monotonically_increasing_id()
    placed = materialise(docs.select("*", F.spark_partition_id().alias("pid"), at.alias("at")), "mixing-copies")
    parts = placed.groupBy("pid", *KEY).agg(F.count("*").alias("n"))
    base = parts.withColumn("base", F.sum("n").over(Window.partitionBy(*KEY).orderBy("pid")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("pid", *KEY).orderBy("at")) - 1
    return placed.withColumn("within", within).join(base, ["pid", *KEY]).withColumn("copy", F.col("base") + F.col("within"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, cycle: int = CYCLE) -> DataFrame:
    """``docs`` with its own columns, in the order of mixing (range partitions, sorted)."""
    rows = ranked(docs)
    places = keyed(schedule(docs, weights, block_rows, cycle, rows), F.col("doc_id"), F.col("source"), F.col("text_hash"))
    places = places.select(*KEY, "copies", "copy", "position")
    names = [f"c{i}" for i in range(len(docs.columns))]  # no name of ``docs`` meets one of ours
    at = docs.columns.index
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    text = F.coalesce(F.col(names[at("text")]).cast("string"), F.lit(""))
    own = keyed(own, F.col(names[at("doc_id")]), F.coalesce(F.col(names[at("source")]).cast("string"), F.lit("")), F.xxhash64(text))
    out = own.join(places.where("copies = 1").drop("copies", "copy"), KEY).select(*names, "position")
    repeated = keyed(rows.where("copies > 1"), F.col("doc_id"), F.col("source"), F.col("text_hash")).select(*KEY)
    if repeated.take(1):
        copies = with_copy(own.join(repeated, KEY, "left_semi"))
        out = out.unionByName(copies.join(places.where("copies > 1").drop("copies"), [*KEY, "copy"]).select(*names, "position"))
    out = out.repartitionByRange(shuffle_partitions(docs.sparkSession), "position").sortWithinPartitions("position")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
