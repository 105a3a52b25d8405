"""Exact top-k inner-product search (3) by M-trees, best first.

Scores are integer inner products of floor(1024 x). A shard's vectors are lifted by one coordinate to a common norm
R, so that squared Euclidean distance from a query (lifted by 0) is |q|^2 + R^2 - 2 score: the highest scores are the
smallest distances, a metric. The tree's pages hold at most ``PAGE`` entries: routing entries with a covering radius,
leaf entries with a vector, both with the distance to their parent's pivot. The search pops pages by lower bound; an
entry is passed over without computing its distance where |d(q, parent) - d(parent, entry)| - radius is over the
k-th best distance so far. Bounds are floating point with a slack, scores are exact integers, and entries at the
bound are looked at, so ties go to the smaller vec_id exactly.

Defined cases: vectors null, empty or with null or non-finite components take no part; zero vectors do. Vectors of
other lengths than the query's are no candidates. All rows with the query's own vec_id are left out. With fewer than
k candidates all are returned. An empty table gives no rows. Components must keep scores within a long.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.vectors import sharded_search, usable

PAGE = 256
FANOUT = 16
SHARD = 16_384
SCALE = 1024.0


def build(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Flat pages: page p has the entries first[p]:last[p]. Leaf entries are rows of ``x`` and ``ids``, which lie in
    the order of the leaves; entries of an inner page name a pivot's row and the child page."""
    x = np.floor(SCALE * v).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    f = x.astype(np.float64)
    norm2 = (f * f).sum(1)
    lifted = np.column_stack((f, np.sqrt(np.maximum(norm2.max() - norm2, 0.0))))
    rng = np.random.default_rng(len(ids))
    first, last, leaf = [], [], []
    inner: dict[str, list] = {"pivot": [], "radius": [], "child": [], "to_parent": []}
    leaves: list[np.ndarray] = []  # rows in leaf order
    leaf_to_parent: list[np.ndarray] = []
    filled = 0

    def page(rows: np.ndarray, at: np.ndarray | None, dist: np.ndarray | None) -> int:
        """Make the page of ``rows`` below the pivot ``at``; ``dist``: the rows' distances to it."""
        nonlocal filled
        me = len(first)
        first.append(0), last.append(0), leaf.append(len(rows) <= PAGE)
        if len(rows) <= PAGE:
            first[me], last[me] = filled, filled + len(rows)
            filled += len(rows)
            leaves.append(rows)
            leaf_to_parent.append(np.zeros(len(rows)) if dist is None else dist)
            return me
        picks = rows[rng.choice(len(rows), min(FANOUT, len(rows)), replace=False)]
        p = lifted[picks]
        d2 = (lifted[rows] ** 2).sum(1)[:, None] - 2 * lifted[rows] @ p.T + (p * p).sum(1)
        nearest = d2.argmin(1)
        groups = [rows[nearest == g] for g in range(len(picks))]
        if max(map(len, groups)) > 0.9 * len(rows):  # copies: cut by number
            groups = np.array_split(rows, FANOUT)
            picks = np.array([g[0] for g in groups])
        entries = []
        for g, r in zip(groups, picks):
            if len(g):
                d = np.sqrt(((lifted[g] - lifted[r]) ** 2).sum(1))
                entries.append((r, float(d.max()), page(g, lifted[r], d), 0.0 if at is None else float(np.sqrt(((lifted[r] - at) ** 2).sum()))))
        first[me] = len(inner["pivot"])
        for entry in entries:
            for k, value in zip(inner, entry):
                inner[k].append(value)
        last[me] = len(inner["pivot"])
        return me

    page(np.arange(len(ids)), None, None)
    rows = np.concatenate(leaves)
    place = np.empty(len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    return {
        "first": np.array(first, np.int64), "last": np.array(last, np.int64), "leaf": np.array(leaf, bool),
        "pivot": place[np.array(inner["pivot"], np.int64)], "radius": np.array(inner["radius"]), "child": np.array(inner["child"], np.int64), "to_parent": np.array(inner["to_parent"]),
        "ids": ids[rows], "x": x[rows], "leaf_to_parent": np.concatenate(leaf_to_parent), "norm2": np.array([norm2.max()]),
    }


def search(t: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int, counter: dict | None = None):
    q_all = np.floor(SCALE * queries).astype(np.int64)
    ids, x, r2 = t["ids"], t["x"], float(t["norm2"][0])
    fx = x.astype(np.float64)
    pivots = fx[t["pivot"]]
    first, last, leaf, child = (t[n].tolist() for n in ("first", "last", "leaf", "child"))
    radius, to_parent, leaf_to_parent = t["radius"], t["to_parent"], t["leaf_to_parent"]
    out: tuple[list, list, list] = ([], [], [])
    for q_id, q in zip(query_ids.tolist(), q_all):
        qf = q.astype(np.float64)
        q2 = float(qf @ qf)
        base = q2 + r2
        # Sums of products stay below |q| R; under 2 ** 52 doubles hold them exactly.
        exact = q2 * r2 < 2.0**104
        slack = 1e-9 * base + 1e-6
        best: list[tuple[int, int]] = []  # heap of (score, -vec_id): the worst first
        least = -np.inf  # the worst score kept, once there are k
        bound = np.inf  # distance of the k-th best so far, with slack
        heap = [(0.0, 0, -1.0)]
        while heap:
            low, p, d_parent = heapq.heappop(heap)
            if low > bound:
                break
            a, b = first[p], last[p]
            if leaf[p]:
                rows: slice | np.ndarray = slice(a, b)
                if d_parent >= 0 and bound < np.inf:
                    near = np.abs(d_parent - leaf_to_parent[a:b]) <= bound
                    if not near.all():
                        rows = a + np.flatnonzero(near)
                scores = fx[rows] @ qf if exact else x[rows] @ q
                if counter is not None:
                    counter["distances"] = counter.get("distances", 0) + len(scores)
                good = np.flatnonzero(scores >= least)
                if not len(good):
                    continue
                for s, i in zip(scores[good].tolist(), ids[rows][good].tolist()):
                    s = int(s)
                    if i != q_id and (len(best) < k or (s, -i) > best[0]):
                        (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (s, -i))
                if len(best) == k:
                    least = best[0][0]
                    bound = np.sqrt(max(base - 2.0 * least, 0.0) + slack)
                continue
            e: slice | np.ndarray = slice(a, b)
            children = child[a:b]
            if d_parent >= 0 and bound < np.inf:
                near = np.abs(d_parent - to_parent[a:b]) - radius[a:b] <= bound
                if not near.all():
                    e = a + np.flatnonzero(near)
                    children = [child[j] for j in e]
            if not children:
                continue
            d = np.sqrt(np.maximum(base - 2.0 * (pivots[e] @ qf), 0.0))
            lows = np.maximum(np.maximum(d - radius[e] - np.sqrt(slack), low), 0.0)
            for lo, c, dd in zip(lows.tolist(), children, d.tolist()):
                if lo <= bound:
                    heapq.heappush(heap, (lo, c, dd))
        for s, i in best:
            out[0].append(q_id), out[1].append(-i), out[2].append(s)
    return out


def top_k(df: DataFrame, is_query, k: int = 10, shard_size: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest inner products; ``is_query``: a condition on vec_id."""
    return sharded_search(usable(df, zero_ok=True), is_query, build, search, k, True, "long", shard_size)


def every(n: int):
    return F.pmod(F.col("vec_id"), F.lit(n)) == 0
