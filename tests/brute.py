"""Single-machine reference for the clustering contract: full distance matrix, binary dendrogram,
condensed tree. Shares no code with the library but the distance formula's definition."""

from __future__ import annotations

import numpy as np


def tree_edges(x: np.ndarray, ids: np.ndarray, k: int = 2):
    """Spanning-tree edges in (w, i, j) order, and core distances."""
    n = len(ids)
    order = np.argsort(ids)
    x, ids = x[order], ids[order]
    d = np.sqrt(np.square(x[:, None, :] - x[None, :, :]).sum(axis=2))
    others = d + np.where(np.eye(n, dtype=bool), np.inf, 0)
    core = np.sort(others, axis=1)[:, k - 1]
    w = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    i, j = np.triu_indices(n, 1)
    rank = np.lexsort((ids[j], ids[i], w[i, j]))
    comp = list(range(n))
    edges = []
    for e in rank:
        a, b = int(i[e]), int(j[e])
        if comp[a] != comp[b]:
            old, new = comp[b], comp[a]
            comp = [new if c == old else c for c in comp]
            edges.append((float(w[a, b]), int(ids[a]), int(ids[b])))
            if len(edges) == n - 1:
                break
    return edges, dict(zip(ids.tolist(), core.tolist()))


def leaf_labels(edges, ids, epsilon: float = 0.2, mcs: int = 2) -> dict[int, int]:
    """Point → smallest id of its selected cluster, -1 for noise, through an explicit condensed tree."""
    ids = list(map(int, ids))
    if not edges or len(ids) < 3:
        return {p: -1 for p in ids}
    node = {p: p for p in ids}
    children, size, height = {}, {p: 1 for p in ids}, {}
    find = lambda p: node[p]
    members = {p: [p] for p in ids}
    nxt = max(ids) + 1
    for w, a, b in edges:
        l, r = find(a), find(b)
        children[nxt], size[nxt], height[nxt] = (l, r), size[l] + size[r], w
        members[nxt] = members.pop(l) + members.pop(r)
        for p in members[nxt]:
            node[p] = nxt
        nxt += 1
    top = nxt - 1
    clusters = {0: dict(parent=None, birth=np.inf, points=[], kids=[])}

    def leaves_under(v):
        return [v] if v not in children else leaves_under(children[v][0]) + leaves_under(children[v][1])

    stack = [(top, 0)]
    while stack:
        v, c = stack.pop()
        if v not in children:
            clusters[c]["points"].append(v)
            continue
        l, r = children[v]
        if size[l] >= mcs and size[r] >= mcs:
            for side in (l, r):
                new = len(clusters)
                clusters[new] = dict(parent=c, birth=height[v], points=[], kids=[])
                clusters[c]["kids"].append(new)
                stack.append((side, new))
        else:
            for side in (l, r):
                if size[side] >= mcs:
                    stack.append((side, c))
                else:
                    clusters[c]["points"] += leaves_under(side)

    chosen = set()
    for c, info in clusters.items():
        if info["kids"] or c == 0:
            continue
        at = c
        if info["birth"] < epsilon:
            while clusters[at]["parent"] != 0 and clusters[at]["birth"] <= epsilon:
                at = clusters[at]["parent"]
        chosen.add(at)

    def inside(c):
        pts = list(clusters[c]["points"])
        for kid in clusters[c]["kids"]:
            pts += inside(kid)
        return pts

    out = {p: -1 for p in ids}
    for c in sorted(chosen):
        points = inside(c)
        for p in points:
            out[p] = min(points)
    return out
