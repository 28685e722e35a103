"""Set passes over trees, with numpy across the patterns of an alignment."""

from __future__ import annotations

import numpy as np

from cladeflow.functions import newick


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = a & b
    return np.where(both != 0, both, a | b)


def length(parents: list[int], masks: np.ndarray, weights: np.ndarray) -> int:
    """Changes that a tree needs. ``masks`` is taxa by patterns."""
    return views(parents, masks, weights, up=False)[2]


def views(parents: list[int], masks: np.ndarray, weights: np.ndarray | None, up: bool = True) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Of each edge the set below it and, with ``up``, the set of all else; and the tree's length, 0 without ``weights``."""
    order, below = newick.preorder(parents), newick.children(parents)
    down = np.empty((len(parents), masks.shape[1]), masks.dtype)
    total = 0
    for v in reversed(order):
        t = newick.taxon_of(v)
        if v == 0:
            total += 0 if weights is None else int(weights[(down[below[0][0]] & masks[0]) == 0].sum())
        elif t is not None:
            down[v] = masks[t]
        else:
            a, b = (down[c] for c in below[v])
            both = a & b
            gap = both == 0
            total += 0 if weights is None else int(weights[gap].sum())
            down[v] = np.where(gap, a | b, both)
    if not up:
        return down, None, total
    above = np.empty_like(down)
    for v in order[1:]:
        p = parents[v]
        if p == 0:
            above[v] = masks[0]
        else:
            (sister,) = (c for c in below[p] if c != v)
            above[v] = union(above[p], down[sister])
    return down, above, total


def insertion_costs(down: np.ndarray, above: np.ndarray, leaf: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Extra length of hanging a taxon on each edge; the root's place holds -1."""
    middle = union(down[1:], above[1:])
    return np.append(-1, ((middle & leaf) == 0) @ weights)


def greedy(masks: np.ndarray, weights: np.ndarray, order: list[int] | None = None) -> tuple[list[int], int]:
    """Stepwise tree: each taxon of ``order`` on the cheapest edge, the first of equals. Nodes follow the order."""
    rows = masks if order is None else masks[order]
    parents = newick.start()
    for t in range(2, len(rows)):
        down, above, _ = views(parents, rows[:t], weights)
        costs = insertion_costs(down, above, rows[t], weights)
        parents = newick.insert(parents, 1 + int(np.argmin(costs[1:])))
    return parents, length(parents, rows, weights)


def cheapest_next(masks: np.ndarray, weights: np.ndarray) -> tuple[list[int], list[int], int]:
    """Stepwise tree that takes, each time, the taxon and edge of least cost, from the heaviest three taxa on.

    Returns the order in which the taxa came, the tree over that order, and its length."""
    order = list(heaviest_three(masks, weights)[0])
    parents = newick.insert(newick.start(), 1)
    while len(order) < len(masks):
        down, above, _ = views(parents, masks[order], weights)
        rest = [t for t in range(len(masks)) if t not in order]
        costs = [insertion_costs(down, above, masks[t], weights)[1:] for t in rest]
        least = min(range(len(rest)), key=lambda k: (costs[k].min(), k))
        parents = newick.insert(parents, 1 + int(np.argmin(costs[least])))
        order.append(rest[least])
    return order, parents, length(parents, masks[order], weights)


def heaviest_three(masks: np.ndarray, weights: np.ndarray) -> tuple[tuple[int, int, int], int]:
    """The three taxa whose only tree is longest; of equals the first."""
    n, best = len(masks), ((0, 1, 2), -1)
    for i in range(n):
        for j in range(i + 1, n):
            pair, cost = union(masks[i], masks[j]), int(weights[(masks[i] & masks[j]) == 0].sum())
            rest = masks[j + 1 :]
            if len(rest):
                totals = ((rest & pair) == 0) @ weights + cost
                k = int(np.argmax(totals))
                if totals[k] > best[1]:
                    best = ((i, j, j + 1 + k), int(totals[k]))
    return best


def cut_sides(parents: list[int], cut: int) -> tuple[dict[int, int], dict[int, int]]:
    """The edges of both sides of a tree cut above node ``cut``, the node below the cut having been smoothed out on either side: each
    edge's name and the node at its other end. A side of one taxon has that taxon in place of an edge, with no other end (-1).

    The first edge of either side is where the tree was cut."""
    below = newick.children(parents)
    lower: dict[int, int] = {}
    if below[cut]:
        x, y = below[cut]
        lower[x] = y
        stack = [x, y]
        while stack:
            v = stack.pop()
            for c in below[v]:
                lower[c] = v
                stack.append(c)
    else:
        lower[cut] = -1
    top = parents[cut]
    if top == 0:
        return lower, {0: -1}
    (sister,) = (c for c in below[top] if c != cut)
    upper = {sister: parents[top]}
    gone = {cut, top, sister, *lower, *lower.values()}
    upper |= {v: p for v, p in enumerate(parents) if p >= 0 and v not in gone}
    return lower, upper


def cut_views(parents: list[int], cut: int, down: np.ndarray, masks: np.ndarray) -> tuple[list[int], np.ndarray, list[int], np.ndarray]:
    """Of both sides of a cut tree the edges and, for each, the set in its middle. ``down`` are the sets below the nodes of the whole tree:
    below the cut they stay, above it they change on the way to the root alone."""
    lower, upper = cut_sides(parents, cut)
    below = newick.children(parents)

    def middles(edges: dict[int, int], sets: dict[int, np.ndarray], above: dict[int, np.ndarray], kids: dict[int, list[int]], start: list[int]) -> np.ndarray:
        stack = list(start)
        while stack:
            v = stack.pop()
            for c in kids[v]:
                (sister,) = (k for k in kids[v] if k != c)
                above[c] = union(above[v], sets[sister])
                stack.append(c)
        return np.array([union(sets[v], above[v]) for v in edges])

    if below[cut]:
        x, y = below[cut]
        kids = {v: below[v] for v in [x, y, *lower]}
        low = middles(lower, {v: down[v] for v in kids}, {x: down[y], y: down[x]}, kids, [x, y])
    else:
        low = down[cut][None]
    top = parents[cut]
    if top == 0:
        return list(lower), low, list(upper), masks[0][None]
    (sister,) = (c for c in below[top] if c != cut)
    kids = {v: [sister if c == top else c for c in below[v]] for v in [0, *upper]}
    sets, v = {k: down[k] for k in upper}, parents[top]
    while v:
        sets[v] = union(*(sets[c] for c in kids[v]))
        v = parents[v]
    (first,) = kids[0]
    return list(lower), low, list(upper), middles(upper, sets, {first: masks[0]}, kids, [first])


def reconnection_costs(low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Changes on a new edge between the middles of each edge of the lower and each of the upper side."""
    return np.array([((high & one) == 0) @ weights for one in low])


def reconnected(parents: list[int], cut: int, below: int, above: int) -> list[int]:
    """The tree after cutting above ``cut`` and joining edge ``below`` of the lower side to edge ``above`` of the upper one."""
    sides = cut_sides(parents, cut)
    near: dict = {}

    def link(v, w):
        near.setdefault(v, set()).add(w)
        near.setdefault(w, set()).add(v)

    ends = []
    for name, edges, at in zip(("x", "y"), sides, (below, above)):
        for v, w in edges.items():
            if w < 0:
                near.setdefault(v, set())
            elif v != at:
                link(v, w)
        if edges[at] < 0:
            ends.append(at)
        else:
            node = (name,)
            link(at, node)
            link(edges[at], node)
            ends.append(node)
    link(*ends)
    return grown(near)


def grown(near: dict) -> list[int]:
    """Parents of an unrooted tree whose taxa are named by their nodes."""
    named = {v: (newick.taxon_of(v) if isinstance(v, int) and newick.taxon_of(v) is not None else ("inner", v)) for v in near}
    again = {named[v]: {named[w] for w in ws} for v, ws in near.items()}
    return newick._grown(again, sum(isinstance(v, int) for v in again))


def neighbour_joining(matrix: np.ndarray, adjusted: bool = True) -> str:
    """Newick text, taxa from 1, of the neighbour-joining tree. ``adjusted``: a joined pair is as far from another taxon as
    the farther of the two, instead of their mean less half their distance."""
    names = [(t, str(t + 1)) for t in range(len(matrix))]
    while len(names) > 3:
        total = matrix.sum(1)
        score = (len(names) - 2.0) * matrix - total[:, None] - total[None]
        score[np.tril_indices(len(names))] = np.inf
        a, b = divmod(int(score.argmin()), len(names))
        row = np.maximum(matrix[a], matrix[b]) if adjusted else (matrix[a] + matrix[b] - matrix[a, b]) / 2
        pair = sorted((names[a], names[b]))
        keep = [k for k in range(len(names)) if k not in (a, b)]
        grown = np.zeros((len(keep) + 1, len(keep) + 1))
        grown[:-1, :-1] = matrix[np.ix_(keep, keep)]
        grown[-1, :-1] = grown[:-1, -1] = row[keep]
        matrix, names = grown, [names[k] for k in keep] + [(pair[0][0], f"({pair[0][1]},{pair[1][1]})")]
    return "(" + ",".join(x for _, x in sorted(names)) + ")"
