"""Merkle dataset manifest (11): a radix-ranked trie of document digests, with a proof for every document.

A document is a leaf, the digest of its fields; the leaves of one source, ascending by doc_id, make a tree in which
every run of ``fanout`` nodes becomes one, and the sources' roots, ordered by source, make the tree above them.

Ranks come without a sort. A leaf's sort key is a string of bytes (whether it has a doc_id, the doc_id, its digest for
ties), and each byte is a digit: leaves are counted by (source, all but the last digits), the counts are rolled up digit
by digit, and the at most 256 children of a prefix are summed up in order. A leaf's rank is the sum of what stands
before it on each level, and its place in a bucket of at most BUCKET leaves; where documents that share a doc_id make a
bucket larger, it has more digits. Equal rows are one row with a count until they have their ranks.

The ranks' own digits, to the base ``fanout``, key the trie's nodes: nodes are grouped by all but the last two digits, so
that a group is a subtree of fanout ** 2 nodes at most, and reduced from the longest prefixes to the shortest, then from
the root back to the leaves, where each learns the siblings on its way. Tables shrink by fanout ** 2 each time.

Nulls: a null field enters its digest as ``-``; a null source is a source of its own, before all others; documents without
doc_id come first in theirs. Equal rows are leaves of their own, in any order, and documents that share a doc_id follow
their digests. A document that is alone in its source is its source's root; an only source's root is the root; a proof
may be empty. Empty texts are texts. An empty table gives no rows. Other columns of ``docs`` are not looked at.
"""

from __future__ import annotations

import os.path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import forget, materialise, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
BUCKET = 4096  # rows that are ranked by a window in one task
HEX = 64  # characters of a digest
ID_BYTES = 9  # of a sort key: one for null, eight of the doc_id
KEY_BYTES = ID_BYTES + 32
PATH = "array<struct<before:binary,after:binary>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of fields, each as its length in bytes, a colon and its value, or ``-`` for null."""
    texts = [c.cast("string") for c in fields.values()]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def sort_key(number: Column, tie: Column) -> Column:
    """Bytes that sort like (number, tie), null first."""
    number = number.cast("long")
    digits = F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.when(number.isNull(), F.lit(bytes(ID_BYTES))).otherwise(F.concat(F.lit(b"\x01"), digits)), F.unhex(tie))


def prefix(length: int, key: str = "key") -> Column:
    return F.substring(F.col(key), 1, length)


def radix_ranks(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds ``rank``, the number of leaves before a row in its tree, and ``size``, that of all leaves of the tree, to rows
    of tree, key and n (equal leaves). ``rows`` is a written table."""
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return rows.withColumn("rank", F.lit(0).cast("long")).withColumn("size", F.lit(0).cast("long"))
    shared = len(os.path.commonprefix([bytes(low), bytes(high)]))
    length = ID_BYTES - 1
    while True:
        counts = materialise(rows.groupBy("tree", prefix(length).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "merkle-digits")
        if length >= KEY_BYTES or counts.agg(F.max("rows")).first()[0] <= bucket:
            break
        forget(counts)
        length = min(length + (3 if length < ID_BYTES else 2), KEY_BYTES)
    first = min(shared + 1, length)  # up to there a tree has 256 prefixes at most
    levels = [counts.select("tree", "key", "n")]
    for m in range(length - 1, first - 1, -1):
        levels.append(levels[-1].groupBy("tree", prefix(m).alias("key")).agg(F.sum("n").alias("n")))
    before = lambda own: F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tree = Window.partitionBy("tree")
    start = levels.pop().select("tree", "key", before(tree.orderBy("key")).alias("start"), F.sum("n").over(tree).alias("size"))
    for m in range(first + 1, length + 1):
        own = levels.pop().withColumn("up", prefix(m - 1))
        own = own.select("tree", "key", "up", before(Window.partitionBy("tree", "up").orderBy("key")).alias("before"))
        start = own.join(start.withColumnRenamed("key", "up"), ["tree", "up"]).select("tree", "key", (F.col("start") + F.col("before")).alias("start"), "size")
    place = Window.partitionBy("tree", "bucket").orderBy("key", "claimed")
    ranked = rows.withColumn("bucket", prefix(length)).join(start.withColumnRenamed("key", "bucket"), ["tree", "bucket"])
    return ranked.withColumn("rank", F.col("start") + before(place)).drop("bucket", "start")


def blocks_of(nodes: DataFrame, fanout: int) -> DataFrame:
    """Subtrees of two levels from nodes (tree, rank, n, size, digest, payload): tree, block, size, members (the payloads
    in order), low and high (the digests of the nodes and of the level above them, one after the other), digest."""
    wide = fanout * fanout
    block, rank, last = F.col("block"), F.col("rank"), F.col("rank") + F.col("n") - 1
    cut = nodes.withColumn("block", F.explode(F.sequence(F.floor(rank / wide), F.floor(last / wide))))
    cut = cut.select("tree", "block", "size", F.struct(F.greatest(rank, block * wide).alias("a"), F.least(last, (block + 1) * wide - 1).alias("b"), "digest", "payload").alias("piece"))
    out = cut.groupBy("tree", "block").agg(F.max("size").alias("size"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    copies = lambda of: F.flatten(F.transform("pieces", lambda p: F.array_repeat(p[of], (p["b"] - p["a"] + 1).cast("int"))))
    out = out.select("tree", "block", "size", copies("payload").alias("members"), F.array_join(copies("digest"), "").cast("binary").alias("low"))
    run = HEX * fanout
    runs = F.sequence(F.lit(0), F.floor((F.octet_length("low") - 1) / run))
    out = out.withColumn("high", F.array_join(F.transform(runs, lambda j: F.sha2(F.substring(F.col("low"), (j * run + 1).cast("int"), F.lit(run)), 256)), "").cast("binary"))
    top = F.when(F.col("size") == 1, F.col("low").cast("string")).when(F.col("size") <= fanout, F.col("high").cast("string")).otherwise(F.sha2("high", 256))
    return out.withColumn("digest", top)


def climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Written tables of blocks, from the leaves up to one block for each tree."""
    wide, out = fanout * fanout, []
    while True:
        out.append(materialise(blocks_of(nodes, fanout), "merkle-blocks"))
        if (out[-1].agg(F.max("block")).first()[0] or 0) == 0:
            return out
        nodes = out[-1].select("tree", F.col("block").alias("rank"), F.lit(1).alias("n"), F.ceil(F.col("size") / wide).alias("size"), "digest", F.lit(None).cast("boolean").alias("payload"))


def descend(blocks: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """tree, rank, payload, digest, path (the siblings from here to the root) and all else of ``above``, which has tree, rank (of
    a block) and path."""
    rest = [c for c in above.columns if c not in ("tree", "rank", "path")]
    rows = blocks.drop("digest").join(above.withColumnRenamed("rank", "block"), ["tree", "block"])
    rows = rows.select("tree", "block", "size", "low", "high", "path", *rest, F.posexplode("members").alias("k", "payload"))
    k, run = F.col("k"), F.floor(F.col("k") / fanout).cast("int")
    part = lambda of, a, b: F.substring(F.col(of), a * HEX + 1, (b - a) * HEX)
    end = (run + 1) * fanout
    near = F.struct(part("low", run * fanout, k).alias("before"), part("low", k + 1, end).alias("after"))
    far = F.struct(part("high", F.lit(0), run).alias("before"), part("high", run + 1, F.lit(fanout)).alias("after"))
    own = F.when(F.col("size") == 1, F.array().cast(PATH)).when(F.col("size") <= fanout, F.array(near)).otherwise(F.array(near, far))
    rank = F.col("block") * (fanout * fanout) + k
    return rows.select("tree", rank.alias("rank"), "payload", part("low", k, k + 1).cast("string").alias("digest"), F.concat(own, "path").alias("path"), *rest)


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, fields=FIELDS, number: str = "doc_id", group: str = "source", fanout: int = FANOUT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, source, rank (in its source), leaf, claimed, subroot, root and path of every document. ``claimed``: values of fields
    that a copy under test has in place of the document's; ``claimed`` in the result is the leaf of that copy, or null
    where it equals the document's. ``path``: digests before and after each node on the way from the leaf to the root."""
    of = {c: F.col(f"`{c}`") for c in fields}
    own = docs.select(F.col(f"`{number}`").alias("doc_id"), F.concat(F.lit("="), F.col(f"`{group}`").cast("string")).alias("tree"), leaf(of).alias("digest"), leaf(of | (claimed or {})).alias("claimed"))
    own = own.withColumn("tree", F.coalesce("tree", F.lit(""))).withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed")))
    own = own.groupBy("tree", "doc_id", "digest", "claimed").agg(F.count("*").alias("n"))
    leaves = materialise(own.withColumn("key", sort_key(F.col("doc_id"), F.col("digest"))), "merkle-leaves")
    nodes = radix_ranks(leaves, bucket).withColumn("payload", F.struct("doc_id", "claimed"))
    blocks = climb(nodes.select("tree", "rank", "n", "size", "digest", "payload"), fanout)
    forget(leaves)

    sources = numbered(blocks[-1].select("tree", "digest"), "tree")
    trees = sources.count()
    sources = sources.select(F.lit("").alias("tree"), "rank", F.lit(1).alias("n"), F.lit(trees).cast("long").alias("size"), "digest", F.struct(F.col("tree").alias("name")).alias("payload"))
    over = climb(sources, fanout)
    way = over[-1].select("tree", F.lit(0).cast("long").alias("rank"), F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    for level in reversed(over):
        way = descend(level, way, fanout)
        way = way if level is over[0] else way.drop("payload", "digest")
    way = way.select(F.col("payload.name").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", "root", F.col("digest").alias("subroot"))
    for level in reversed(blocks):
        way = descend(level, way, fanout)
        way = way if level is blocks[0] else way.drop("payload", "digest")
    return way.select("payload.doc_id", F.expr("CASE WHEN tree <> '' THEN substring(tree, 2) END").alias("source"), "rank", F.col("digest").alias("leaf"), "payload.claimed", "subroot", "root", "path")


def fold(first: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, first, lambda h, x: digest(x["before"], h, x["after"]))


def verified(found: DataFrame) -> DataFrame:
    """The manifest without its paths: proof_sha256 (of the path's digests), folded_root (of the claimed leaf, else of the
    leaf), verified (whether that is the root)."""
    proof = F.aggregate("path", F.lit(b""), lambda s, x: F.concat(s, x["before"], x["after"]))
    out = found.withColumn("proof_sha256", F.sha2(proof, 256)).withColumn("folded_root", fold(F.coalesce("claimed", "leaf")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("path", "claimed")


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(docs: DataFrame, share: int = 5) -> dict[str, Column]:
    """Texts whose capital letters became small, where ``share`` divides the checksum of the doc_id; no doc_id, no change."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % share == 0
    text = F.col("text").cast("string")
    return {"text": F.when(hit, lowered(text)).otherwise(text)}


LEVELS = 6  # of a tree in the SQL: sources of up to 16 ** 6 documents


def _levels(kind: str, tree: str) -> str:
    """CTEs of the nodes, and of the digests before and after each, level by level: a level of one node stays."""
    out = []
    for k in range(LEVELS):
        at = f"{kind}{k}"
        out.append(f"""{at}s AS (SELECT *, count(*) OVER (PARTITION BY {tree}) AS c, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
 coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {at} WINDOW w AS (PARTITION BY {tree}, i // 16 ORDER BY i))""")
        out.append(f"{kind}{k + 1} AS (SELECT {tree}, i // 16 AS i, CASE WHEN max(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {at}s GROUP BY {tree}, i // 16)")
    return ",\n".join(out)


def _way(kind: str, tree: str, before: str, place: str) -> str:
    out = []
    for k in range(LEVELS):
        out.append(f"""{kind}w{k} AS (SELECT w.* EXCLUDE (proof, folded), CASE WHEN s.c > 1 THEN proof || s.a || s.b ELSE proof END AS proof,
 CASE WHEN s.c > 1 THEN sha256(s.a || folded || s.b) ELSE folded END AS folded FROM {before} w JOIN {kind}{k}s s ON s.{tree} IS NOT DISTINCT FROM w.{tree} AND s.i = w.{place} // {16**k})""")
        before = f"{kind}w{k}"
    return ",\n".join(out)


_PARTS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in FIELDS)
#: The checksum's bytes go through its polynomial bit by bit.
ORACLE_SQL = f"""WITH read AS (SELECT doc_id, source, sha256({_PARTS}) AS leaf,
 sha256({_PARTS.replace("coalesce(strlen(CAST(text", "coalesce(strlen(CAST(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace("|| text,", "|| translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),")}) AS low,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
 lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 5 = 0 AS hit FROM documents),
 doc AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS place, 0 AS one FROM read),
 n0 AS (SELECT source, place AS i, leaf AS h FROM doc),
{_levels("n", "source")},
 src AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot FROM n{LEVELS}),
 t0 AS (SELECT 0 AS one, spot AS i, subroot AS h FROM src),
{_levels("t", "one")},
 begun AS (SELECT d.*, s.subroot, s.spot, '' AS proof, CASE WHEN d.hit THEN d.low ELSE d.leaf END AS folded FROM doc d JOIN src s ON s.source IS NOT DISTINCT FROM d.source),
{_way("n", "source", "begun", "place")},
{_way("t", "one", f"nw{LEVELS - 1}", "spot")}
SELECT doc_id, source, place AS rank, leaf, subroot, (SELECT h FROM t{LEVELS}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM t{LEVELS}) AS verified FROM tw{LEVELS - 1}"""
