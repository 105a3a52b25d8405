"""Approximate nearest neighbours (7): a hierarchical navigable small-world graph for each shard.

Points are put in order of falling level (levels follow a hash of vec_id), so level l is the first n_l points and its
links are one flat array ``nbr{l}`` of n_l x width ints, -1 where empty. Points enter in batches: a beam search over
the graph so far plus the batch itself gives candidates, links are chosen by the diversity rule (a candidate closer
to a chosen neighbour than to the point is passed over, then free slots are filled by the nearest), and neighbours
get the link back; full lists are pruned by the same rule. Searches run over a whole batch at once in numpy. The graph
works on float32 copies, less the median and over the median deviation of the shard's components, and on differences of
vectors, so neither a common offset nor a huge row costs it its precision. Every row is indexed; equal vectors share one node with all their ids. Each shard's results are measured again in double
precision on the original vectors and merged.

Defined cases: vectors null, empty, zero or with null or non-finite components take no part. Vectors of other
lengths are no candidates. All rows with the query's own vec_id are left out. With fewer than k candidates all are
returned (a shard of at most k + 1 nodes is looked at whole). Ties go to the smaller vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from fathom.llm.vectors import sharded_search, usable

M = 16
EF_BUILD = 64
EF_SEARCH = 160
SHARD = 8_192
BATCH = 256
FAR = 1e15  # float32 copies end here, so that squares don't overflow


def _dist2(x: np.ndarray, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of row i's nodes to q[i]."""
    d = x[nodes]
    d -= q[:, None, :]
    return np.einsum("bnd,bnd->bn", d, d)


def _scaled(v: np.ndarray, centre: np.ndarray, scale: float) -> np.ndarray:
    return np.clip((v - centre) / scale, -FAR, FAR).astype(np.float32)


def _beam(x, nbr, q, start, ef, expand=4):
    """The ef nearest found for each row of q, from the node start[i]: distances and nodes (-1: none), nearest first."""
    b, n = len(q), len(nbr)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    seen[np.arange(b), start] = True
    dist = np.full((b, ef), np.inf, np.float32)
    node = np.full((b, ef), -1, np.int32)
    done = np.ones((b, ef), bool)
    node[:, 0], done[:, 0] = start, False
    dist[:, 0] = _dist2(x, start[:, None], q)[:, 0]
    live = np.arange(b)
    while len(live):
        open_ = ~done[live]
        live = live[open_.any(1)]
        if not len(live):
            break
        rank = np.where(done[live], ef, np.arange(ef))
        pick = np.sort(np.partition(rank, min(expand, ef) - 1, axis=1)[:, :expand], axis=1)
        has = pick < ef
        slot = np.minimum(pick, ef - 1)
        from_ = np.where(has, node[live[:, None], slot], n)
        r, c = np.nonzero(has)
        done[live[r], slot[r, c]] = True
        to = np.where(from_[:, :, None] < n, nbr[np.minimum(from_, n - 1)], n).reshape(len(live), -1)
        to = np.sort(np.where(to < 0, n, to), axis=1)
        to[:, 1:][to[:, 1:] == to[:, :-1]] = n
        to[seen[live[:, None], to]] = n
        seen[live[:, None], to] = True
        fresh = to < n
        width = int(fresh.sum(1).max())
        if not width:
            continue
        to = np.sort(to, axis=1)[:, :width]
        d = _dist2(x, np.minimum(to, n - 1), q[live])
        d[to == n] = np.inf
        all_d = np.concatenate((dist[live], d), axis=1)
        all_n = np.concatenate((node[live], np.where(to == n, -1, to).astype(np.int32)), axis=1)
        all_x = np.concatenate((done[live], to == n), axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        dist[live], node[live], done[live] = (np.take_along_axis(a, keep, axis=1) for a in (all_d, all_n, all_x))
    return dist, node


def _choose(x, own, d, cand, width):
    """Links of the points ``own`` by the diversity rule; d, cand: nearest first, -1 where empty. Then the nearest fill free
    slots."""
    b, c = cand.shape
    v = x[np.maximum(cand, 0)]
    v -= own[:, None, :]
    sq = (v * v).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    near = np.full((b, c), np.inf, np.float32)
    taken = np.zeros((b, c), bool)
    count = np.zeros(b, np.int32)
    for j in range(c):
        ok = (cand[:, j] >= 0) & (count < width) & (d[:, j] < near[:, j])
        taken[:, j] = ok
        count += ok
        near = np.where(ok[:, None], np.minimum(near, between[:, j]), near)
    rank = np.where(taken, 0, np.where(cand >= 0, 1, 2)) * c + np.arange(c)
    first = np.argsort(rank, axis=1)[:, :width]
    out = np.take_along_axis(cand, first, axis=1)
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    return out


def _link_back(x, nbr, new, width):
    """Give each neighbour of the points ``new`` the link back; a full list is cut to three quarters by the rule."""
    to, frm = nbr[new].ravel(), np.repeat(new, width)
    ok = to >= 0
    to, frm = to[ok], frm[ok].astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    nodes, at, n = np.unique(to, return_index=True, return_counts=True)
    have = (nbr[nodes] >= 0).sum(1)
    slot = np.repeat(have, n) + np.arange(len(to)) - np.repeat(at, n)
    room = np.repeat(have + n <= width, n)
    nbr[to[room], slot[room]] = frm[room]
    full = have + n > width
    nodes, at, n = nodes[full], at[full], n[full]
    for lo in range(0, len(nodes), BATCH):
        part, a, m = nodes[lo : lo + BATCH], at[lo : lo + BATCH], n[lo : lo + BATCH]
        extra = np.full((len(part), int(m.max())), -1, np.int32)
        for i in range(len(part)):
            extra[i, : m[i]] = frm[a[i] : a[i] + m[i]]
        cand = np.concatenate((nbr[part], extra), axis=1)
        cand = -np.sort(-cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        d = _dist2(x, np.maximum(cand, 0), x[part])
        d[(cand < 0) | (cand == part[:, None])] = np.inf
        order = np.argsort(d, axis=1)
        d, cand = np.take_along_axis(d, order, axis=1), np.take_along_axis(cand, order, axis=1)
        cand[np.isinf(d)] = -1
        kept = _choose(x, x[part], d, cand, width - width // 4)
        nbr[part] = -1
        nbr[part, : kept.shape[1]] = kept


def build(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    nodes, inverse = np.unique(v, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by_node = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[by_node], np.arange(len(nodes) + 1))
    key = ids[by_node[starts[:-1]]].astype(np.uint64)
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    u = ((key >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    level = np.minimum((-np.log(u) / np.log(M)).astype(np.int32), 6)
    order = np.lexsort((key, -level))
    level = level[order]
    nodes = nodes[order]
    lists = [ids[by_node[starts[i] : starts[i + 1]]] for i in order]
    out = {"v": nodes, "ids": np.concatenate(lists), "id_starts": np.concatenate(([0], np.cumsum([len(a) for a in lists]))).astype(np.int64)}
    centre = np.median(nodes, axis=0) if len(nodes) else np.zeros(nodes.shape[1])
    spread = np.abs(nodes - centre)
    scale = np.median(spread) or spread.max() or 1.0
    x = _scaled(nodes, centre, scale)
    out |= {"centre": centre, "scale": np.array([scale])}
    levels = int(level[0]) if len(level) else 0
    graphs: list[np.ndarray] = []
    for l in range(levels, -1, -1):
        n = int((level >= l).sum())
        width = 2 * M if l == 0 else M
        nbr = np.full((n, width), -1, np.int32)
        at, upper = 0, len(graphs[-1]) if graphs else 0
        while at < n:
            size = min(BATCH, max(1, at), n - at)
            new = np.arange(at, at + size)
            q = x[new]
            if at < max(upper, BATCH):
                cand = np.broadcast_to(np.arange(at, dtype=np.int32), (size, at))
                d = _dist2(x, cand, q) if at else np.zeros((size, 0), np.float32)
            else:
                d, cand = _beam(x[:at], nbr[:at], q, _descend(x, graphs, q), EF_BUILD)
            near = _dist2(x, np.broadcast_to(new, (size, size)), q)
            near[np.triu_indices(size)] = np.inf  # earlier points of the batch only
            d = np.concatenate((d, near), axis=1)
            cand = np.concatenate((cand, np.broadcast_to(new.astype(np.int32), (size, size))), axis=1)
            keep = np.argsort(d, axis=1, kind="stable")[:, :EF_BUILD]
            d, cand = np.take_along_axis(d, keep, axis=1), np.take_along_axis(cand, keep, axis=1)
            cand = np.where(np.isinf(d), -1, cand)
            links = _choose(x, q, d, cand, M)
            nbr[new, : links.shape[1]] = links
            _link_back(x, nbr, new, width)
            at += size
        graphs.append(nbr)
    return out | {f"nbr{levels - i}": g for i, g in enumerate(graphs)}


def _descend(x, graphs, q):
    """Start nodes for the level below ``graphs`` (highest level first)."""
    start = np.zeros(len(q), np.int64)
    for nbr in graphs:
        _, node = _beam(x[: len(nbr)], nbr, q, start, 4, expand=2)
        start = node[:, 0].astype(np.int64)
    return start


def search(t: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int = EF_SEARCH):
    v, ids, starts = t["v"], t["ids"], t["id_starts"]
    x = _scaled(v, t["centre"], t["scale"][0])
    graphs = [t[f"nbr{l}"] for l in range(sum(n.startswith("nbr") for n in t) - 1, -1, -1)]
    out: tuple[list, list, list] = ([], [], [])
    for lo in range(0, len(query_ids), BATCH):
        part = queries[lo : lo + BATCH]
        if len(v) <= k + 1:
            found = np.broadcast_to(np.arange(len(v)), (len(part), len(v)))
        else:
            q = _scaled(part, t["centre"], t["scale"][0])
            found = _beam(x, graphs[-1], q, _descend(x, graphs[:-1], q), max(ef, k + 1))[1]
        for q_id, q, near in zip(query_ids[lo : lo + BATCH].tolist(), part, found):
            near = near[near >= 0]
            d = np.sqrt(((v[near] - q) ** 2).sum(1))
            hits: list[tuple[float, int]] = []
            for j in np.argsort(d, kind="stable"):
                if len(hits) >= k and d[j] > hits[k - 1][0]:
                    break
                a, b = starts[near[j]], starts[near[j] + 1]
                hits += [(float(d[j]), i) for i in ids[a : a + k + 1 if b - a > k + 1 else b].tolist() if i != q_id]
                hits.sort()
                del hits[k:]
            for s, i in hits:
                out[0].append(q_id), out[1].append(i), out[2].append(s)
    return out


def nearest(df: DataFrame, is_query, k: int = 10, shard_size: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of each query's k nearest found."""
    return sharded_search(usable(df, zero_ok=False), is_query, build, search, k, False, "double", shard_size)
