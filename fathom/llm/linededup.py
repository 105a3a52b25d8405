"""Line dedup (5): content-defined chunks of lines, DataFrame and SQL functions only.

Lines are hashed, and a rolling hash over two lines slides through each text. Places with one rolling hash repeat the first of
them, by (doc_id, text hash, line). A chunk is a longest run of lines whose rolling hashes have their first places one after
the other in one earlier text, so it stands there as a whole; where a pair inside it stands somewhere earlier still, the run
goes on if the pairs around it do, and lines that are all equal make one run. Chunks don't overlap: from the start of a text
on, each takes what the one before has left, if two lines are left. So a boundary lies where the lines next to it stop
following each other as they do elsewhere: a passage that moved is cut at its own ends, whatever stands around it, and
texts without its lines move no boundary. (A boundary wherever the rolling hash is a multiple of some number would glue a
passage's first and last lines to their neighbours and leave short passages without any chunk of their own.)

A line of at least ``LONG`` bytes that an earlier place has, outside of such chunks, is a chunk, too. Chunks of at least
``min_lines`` lines and ``min_bytes`` bytes, and long lines, are removed; the first place stays. Within a document a pair of
lines does not count as earlier for the pair that starts at its second line.

The table of rolling hashes is thin and made straight from the scan. Its repeats are found by an aggregation with
map-side combine and written, so the join that tells them to the places has plain inputs and Spark splits its hot keys.
Documents are shuffled once, to their chunks, and written. Bytes are compared from there, by grouping (line hash, line)
of the lines of all repeated pairs, first places included: one row for each distinct line and task. Should two lines
share a hash, their pairs are decided by text in a join of their own. No row carries its document's lines along.

Defined cases: null text is empty; an empty text is one empty line; a text that is removed whole becomes empty and
its row stays; rows with equal doc_id and text are one document, so neither is the other's copy; null doc_ids come
first; an empty table gives no rows; extra columns are ignored by line_dedup() and kept by deduplicated(), whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import forget, materialise, text_column

MIN_LINES = 2
MIN_BYTES = 40
LONG = 200
HASH = "xxhash64({})"
KEY = ["a", "b", "two"]


def split_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, ``lines`` and ``h``, the lines' hashes. Each step is an inline(), which keeps the optimizer from writing
    the arrays into the lambdas that read them, where they would be made once for each line."""
    lines = f"split({text}, '\n', -1)"
    step = df.selectExpr(*keep, f"inline(array(struct({lines} AS lines)))")
    return step.selectExpr(*keep, "lines", f"inline(array(struct(transform(lines, x -> {HASH.format('x')}) AS h)))")


def pairs(keyed: DataFrame, bodies: bool = False) -> DataFrame:
    """(doc_id, dh, i, a, b, two, even): two = 1 for lines i and i + 1 with hashes a and b, even if they are equal, two = 0 for a
    long line i (b is 0); with ``bodies`` their text as well."""
    body = ", concat(lines[i], '\n', lines[i + 1]) AS body" if bodies else ""
    alone = ", lines[i] AS body" if bodies else ""
    two = f"transform(sequence(0, size(h) - 2), i -> struct(i AS i, h[i] AS a, h[i + 1] AS b, 1 AS two, lines[i] = lines[i + 1] AS even{body}))"
    one = f"transform(filter(sequence(0, size(h) - 1), i -> octet_length(lines[i]) >= {LONG}), i -> struct(i AS i, h[i] AS a, 0L AS b, 0 AS two, false AS even{alone}))"
    return split_lines(keyed, "text", "doc_id", "dh").selectExpr("doc_id", "dh", f"inline(concat(IF(size(h) > 1, {two}, array()), {one}))")


PLACE = "struct(doc_id IS NOT NULL AS known, doc_id, dh, i)"
#: ``first`` is an earlier place of the row's pair, and not the pair one line before.
EARLIER = f"{PLACE} <> first AND NOT (two = 1 AND doc_id <=> first.doc_id AND dh = first.dh AND i = first.i + 1)"


#: Equal for pairs of lines that follow each other both here and at their first places.
TRACK = "xxhash64(first.doc_id, first.dh, first.i - i)"


def chunks_of(marked: DataFrame) -> DataFrame:
    """(doc_id, dh, chunks, members) of places (doc_id, dh, i, two, even, copy, track): chunks (s, e: first and last line) that stand
    elsewhere as a whole and don't overlap, members: the lines of all places. A document's rows: as many as its lines."""
    text = ["doc_id", "dh"]
    own = Window.partitionBy(*text).orderBy(F.col("two").desc(), "i")
    pair = F.expr("IF(copy AND two = 1, struct(i, track, even), NULL)")
    df = marked.withColumn("pair", pair).withColumns({"before": F.lag("pair").over(own), "after": F.lead("pair").over(own)})
    # A pair between two of one track whose own first place is another's.
    df = df.withColumn("inner", F.expr("coalesce(before.i = i - 1 AND after.i = i + 1 AND pair.track <> before.track AND before.track = after.track, false)"))
    df = df.withColumn("bridge", F.col("inner") & ~F.lag("inner", 1, False).over(own) & ~F.lead("inner", 1, False).over(own))
    goes_on = F.expr("pair IS NOT NULL AND before.i = i - 1") & (F.expr("before.track = track OR before.even AND even") | F.col("bridge") | F.lag("bridge", 1, False).over(own))
    df = df.withColumn("r", F.sum(F.when(goes_on, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy(*text, "r").agg(F.min("i").alias("s"), F.max(F.expr("i + two")).alias("e"), F.max("two").alias("two"), F.bool_or("copy").alias("copy"), F.expr("array_union(collect_set(i), collect_set(i + two))").alias("m"))
    # Runs that share a line: one of two lines is used up by the run before it, unless that one was itself.
    runs = runs.withColumn("run", F.expr("copy AND two = 1"))
    line = Window.partitionBy(*text).orderBy(F.col("run").desc(), "s")
    runs = runs.withColumn("touch", F.col("run") & F.coalesce(F.lag("run").over(line) & (F.lag("e").over(line) == F.col("s")), F.lit(False)))
    runs = runs.withColumn("part", F.sum(F.expr("IF(touch AND e - s < 2, 0, 1)")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("used", F.col("run") & (F.row_number().over(Window.partitionBy(*text, "part").orderBy("s")) % 2 == 1))
    runs = runs.withColumn("s", F.when(F.col("touch") & F.lag("used", 1, False).over(line), F.col("s") + 1).otherwise(F.col("s")))
    start = Window.partitionBy(*text).orderBy("s", F.col("two").desc()).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("covered", F.coalesce(F.max(F.expr("IF(used, e, NULL)")).over(start) >= F.col("s"), F.lit(False)))
    chunk = F.when(F.expr("used OR two = 0 AND copy AND NOT covered"), F.struct("s", "e"))
    return runs.groupBy(*text).agg(F.sort_array(F.collect_list(chunk)).alias("chunks"), F.array_distinct(F.flatten(F.collect_list("m"))).alias("members"))


def kept(docs: DataFrame, min_lines: int, min_bytes: int) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... with text (what is left), n_lines, n_chunks, dropped (chunks)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).withColumn("dh", F.xxhash64("text"))
    thin = materialise(pairs(keyed), "line-pairs")
    repeats = thin.groupBy(*KEY).agg(F.expr(f"min({PLACE})").alias("first"), F.expr(f"max({PLACE})").alias("last")).where("first <> last").drop("last")
    repeats = materialise(repeats, "line-repeats")
    places = ["doc_id", "dh", "i", "two", "even", f"{EARLIER} AS copy", f"{TRACK} AS track"]
    own = [f"c{i}" for i in range(len(docs.columns))]

    def told(marked: DataFrame) -> DataFrame:
        """Documents with their chunks, which are written first, so the shuffles of places are gone when documents move."""
        found = materialise(chunks_of(marked), "line-chunks")
        # A text moves and is written once, as the column that it is.
        df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own)], F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_column(docs)).alias("dh"))
        same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.dh") == F.col("y.dh"))
        df = df.alias("x").join(found.hint("merge").alias("y"), same, "left")
        out = materialise(df.select(*own, "chunks", "members"), "line-documents")
        forget(found)
        whole = out.withColumn("full", text_column(out, own[docs.columns.index("text")]))
        whole._fathom_path = out._fathom_path
        return whole

    df = told(thin.join(repeats, KEY).selectExpr(*places))
    # Byte comparison: a hash that stands for one line only needs no more.
    lines = split_lines(df.where("members IS NOT NULL"), "full", "members").selectExpr("inline(transform(members, m -> struct(h[m] AS a, lines[m] AS line)))")
    shared = materialise(lines.distinct().groupBy("a").agg(F.count("*").alias("texts")).where("texts > 1").select("a"), "line-collisions")
    if shared.take(1):
        doubtful = thin.join(shared, "a", "left_semi").unionByName(thin.join(shared.select(F.col("a").alias("b")), "b", "left_semi")).select(*KEY).distinct()
        plain = thin.join(doubtful, KEY, "left_anti").join(repeats, KEY).selectExpr(*places)
        by_text = materialise(pairs(keyed, bodies=True).join(doubtful, KEY, "left_semi"), "line-bodies")
        firsts = by_text.groupBy("two", "body").agg(F.expr(f"min({PLACE})").alias("first"))
        forget(df)
        df = told(plain.unionByName(by_text.join(firsts, ["two", "body"]).selectExpr(*places)))
        forget(by_text)
    forget(thin, repeats, shared)
    df = df.selectExpr(*own, "full", "chunks", "inline(array(struct(split(full, '\\n', -1) AS lines)))")
    size = "octet_length(array_join(slice(lines, c.s + 1, c.e - c.s + 1), '\\n'))"
    drop = f"filter(coalesce(chunks, array()), c -> (c.e - c.s + 1 >= {min_lines} AND {size} >= {min_bytes}) OR (c.e = c.s AND {size} >= {LONG}))"
    df = df.selectExpr(*own, "full", "lines", "coalesce(size(chunks), 0) AS n_chunks", f"inline(array(struct({drop} AS dropped)))")
    piece = "slice(lines, IF(k = 0, 0, dropped[k - 1].e + 1) + 1, IF(k = size(dropped), size(lines), dropped[k].s) - IF(k = 0, 0, dropped[k - 1].e + 1))"
    left = f"array_join(flatten(transform(sequence(0, size(dropped)), k -> {piece})), '\\n')"
    return df.selectExpr(*own, f"IF(size(dropped) = 0, full, {left}) AS text", "size(lines) AS n_lines", "n_chunks", "dropped")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, n_lines, n_chunks (that repeat an earlier place), n_removed_chunks, n_removed_lines, text (what is left)."""
    out = kept(docs.select("doc_id", "text"), min_lines, min_bytes)
    lines = "aggregate(dropped, 0L, (n, c) -> n + c.e - c.s + 1)"
    return out.selectExpr("cast(c0 AS long) AS doc_id", "cast(n_lines AS long) AS n_lines", "cast(n_chunks AS long) AS n_chunks", "cast(size(dropped) AS long) AS n_removed_chunks", f"{lines} AS n_removed_lines", "text")


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with its own columns and shortened texts; n_chars, where there is one, follows. Untouched texts stay
    as they are, nulls included."""
    out = kept(docs, min_lines, min_bytes)
    cut = F.size("dropped") > 0
    columns = []
    for i, f in enumerate(docs.schema.fields):
        new = {"text": F.col("text"), "n_chars": F.length("text")}.get(f.name)
        own = F.col(f"c{i}")
        columns.append((own if new is None else F.when(cut, new.cast(f.dataType)).otherwise(own)).alias(f.name))
    return out.select(*columns)


# The hash that orders rows of equal doc_ids has no counterpart in DuckDB, so the SQL takes doc_id to be unique, as it is
# in the table.
ORACLE_SQL = f"""
WITH lined AS (
    SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), followed AS (
    SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM lined
), parts AS (
    SELECT doc_id, i AS s, i + 1 AS e, line || chr(10) || next AS body, 1 AS two, line = next AS even FROM followed WHERE i < n - 1
    UNION ALL SELECT doc_id, i, i, line, 0, false FROM lined WHERE strlen(line) >= {LONG}
), placed AS (
    SELECT *, first_value(doc_id) OVER w AS fd, first_value(s) OVER w AS fs FROM parts WINDOW w AS (PARTITION BY two, body ORDER BY doc_id, s)
), copied AS (
    SELECT doc_id, s, fd, fs - s AS shift, coalesce(even, false) AS even FROM placed WHERE two = 1 AND (doc_id <> fd OR s <> fs) AND NOT (doc_id = fd AND s = fs + 1)
), near AS (
    SELECT *, lag(s) OVER w = s - 1 AS goes, lead(s) OVER w = s + 1 AS follows, lag(fd) OVER w AS bd, lag(shift) OVER w AS bs, lag(even) OVER w AS be, lead(fd) OVER w AS ad, lead(shift) OVER w AS ash
    FROM copied WINDOW w AS (PARTITION BY doc_id ORDER BY s)
), inner_ AS (
    SELECT *, coalesce(goes AND follows AND (fd, shift) <> (bd, bs) AND (bd, bs) = (ad, ash), false) AS mid FROM near
), bridged AS (
    SELECT *, mid AND NOT lag(mid, 1, false) OVER w AND NOT lead(mid, 1, false) OVER w AS bridge FROM inner_ WINDOW w AS (PARTITION BY doc_id ORDER BY s)
), fresh AS (
    SELECT *, CASE WHEN goes AND ((fd, shift) = (bd, bs) OR (even AND be) OR bridge OR lag(bridge, 1, false) OVER (PARTITION BY doc_id ORDER BY s)) THEN 0 ELSE 1 END AS new FROM bridged
), numbered AS (
    SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM fresh
), runs AS (
    SELECT doc_id, k, min(s) AS s, max(s) + 1 AS e FROM numbered GROUP BY doc_id, k
), touching AS (
    SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s) = s, false) AS touch FROM runs
), parted AS (
    SELECT *, sum(CASE WHEN touch AND e - s < 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS part FROM touching
), used AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY s) % 2 = 1 AS used FROM parted
), begun AS (
    SELECT doc_id, s + CASE WHEN touch AND lag(used, 1, false) OVER (PARTITION BY doc_id ORDER BY s) THEN 1 ELSE 0 END AS s, e, used FROM used
), several AS (
    SELECT doc_id, s, e FROM begun WHERE used
), chunks AS (
    SELECT * FROM several
    UNION ALL SELECT doc_id, s, e FROM placed p WHERE two = 0 AND (doc_id <> fd OR s <> fs) AND NOT EXISTS (SELECT 1 FROM several c WHERE c.doc_id = p.doc_id AND p.s BETWEEN c.s AND c.e)
), sized AS (
    SELECT c.doc_id, c.s, c.e, sum(strlen(l.line)) + count(*) - 1 AS bytes
    FROM chunks c JOIN lined l ON l.doc_id = c.doc_id AND l.i BETWEEN c.s AND c.e GROUP BY ALL
), gone AS (
    SELECT * FROM sized WHERE (e - s + 1 >= {MIN_LINES} AND bytes >= {MIN_BYTES}) OR (e = s AND bytes >= {LONG})
), marked AS (
    SELECT l.*, g.doc_id IS NOT NULL AS gone FROM lined l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i BETWEEN g.s AND g.e
)
SELECT m.doc_id, count(*) AS n_lines,
       (SELECT count(*) FROM chunks c WHERE c.doc_id = m.doc_id) AS n_chunks,
       (SELECT count(*) FROM gone g WHERE g.doc_id = m.doc_id) AS n_removed_chunks,
       count(*) FILTER (gone) AS n_removed_lines,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM marked m GROUP BY m.doc_id
"""
