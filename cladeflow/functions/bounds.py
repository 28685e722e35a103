"""Numbers behind the bounds, with numpy for the patterns of one alignment. ``masks`` is taxa by patterns."""

from __future__ import annotations

import numpy as np


def distances(masks: np.ndarray, weights: np.ndarray, strict: bool = False) -> np.ndarray:
    out = np.zeros((len(masks), len(masks)), np.int64)
    for i, row in enumerate(masks):
        apart = masks != row if strict else (masks & row) == 0
        out[i] = apart @ weights
    return out


def spanning_tree(matrix: np.ndarray) -> int:
    """Weight of a minimum spanning tree, by Prim's algorithm."""
    if len(matrix) < 2:
        return 0
    near, out, rest = matrix[0].copy(), 0, np.ones(len(matrix), bool)
    rest[0] = False
    while rest.any():
        k = int(np.where(rest, near, np.iinfo(np.int64).max).argmin())
        out += int(near[k])
        rest[k] = False
        near = np.minimum(near, matrix[k])
    return out


def merged_rows(masks: np.ndarray, first: int) -> np.ndarray:
    """The first ``first`` taxa as one row that holds all their bases, then the rest."""
    return np.vstack([np.bitwise_or.reduce(masks[:first], axis=0)[None], masks[first:]])


def joint_mask(a: np.ndarray, b: np.ndarray) -> int:
    """The pairs of bases that some taxon shows at two unambiguous sites, a bit for each."""
    code = np.array([0, 0, 1, 0, 2, 0, 0, 0, 3])
    return int(np.bitwise_or.reduce(1 << (4 * code[a] + code[b])))


def pair_cost(mask: int) -> tuple[int, int]:
    """Least changes of two sites together, from their joint states, and how many these are beyond the sites' own.

    Joint states are edges of a graph between the bases of the two sites. With E edges, V bases and C components a
    tree needs E + C - 2 changes, E - V + C more than the sites alone; they are incompatible if that is above 0."""
    edges = [(k // 4, 4 + k % 4) for k in range(16) if mask >> k & 1]
    root = {v: v for e in edges for v in e}

    def top(v: int) -> int:
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[top(a)] = top(b)
    components = sum(root[v] == v for v in root)
    return len(edges) + components - 2, len(edges) - len(root) + components


def eliminated(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sites are incompatible, by deletion: taxa that show a base no other distinct row shows go, until
    none does; more than two distinct rows are left if the sites are incompatible. Takes ambiguous states."""
    rows = {(int(x), int(y)) for x, y in zip(a, b)}
    while True:
        alone = None
        for side in (0, 1):
            for row in sorted(rows):
                if all(row[side] & other[side] == 0 for other in rows if other != row):
                    alone = row
                    break
            if alone:
                break
        if alone is None:
            return len(rows) > 2
        rows.discard(alone)


def matching(pairs: list[tuple[int, int, int, int]], copies: dict[int, int]) -> tuple[int, int]:
    """Greedy matching of incompatible pairs (p, q, onset, cost) so that each site takes part once for each of its copies.

    Dearest pairs come first, then those whose sites are in fewest pairs, then by site. Returns pairs and cost."""
    degree: dict[int, int] = {}
    for p, q, _, _ in pairs:
        degree[p] = degree.get(p, 0) + 1
        degree[q] = degree.get(q, 0) + 1
    left, count, total = dict(copies), 0, 0
    for p, q, _, cost in sorted(pairs, key=lambda x: (-x[3], degree[x[0]] + degree[x[1]], x[0], x[1])):
        times = min(left[p], left[q])
        left[p] -= times
        left[q] -= times
        count += times
        total += times * cost
    return count, total


def spanning_edges(matrix: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges (weight, a, b) of a minimum spanning tree, by weight."""
    n = len(matrix)
    near, towards, rest, out = matrix[0].copy(), np.zeros(n, int), np.ones(n, bool), []
    rest[0] = False
    for _ in range(n - 1):
        k = int(np.where(rest, near, np.iinfo(np.int64).max).argmin())
        out.append((int(near[k]), int(towards[k]), k))
        rest[k] = False
        closer = matrix[k] < near
        near[closer], towards[closer] = matrix[k][closer], k
    return sorted(out)


def spanning_edges_between(matrix: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges (weight, row, column) of a minimum spanning tree of the graph that ties every row of ``matrix`` to every column."""
    rows, (n, m) = (matrix, np.ascontiguousarray(matrix.T)), matrix.shape
    # of rows and columns: distance to the tree, and the same with what is in the tree out of reach
    near = [np.full(n, np.inf), np.full(m, np.inf)]
    open_, towards, out = [x.copy() for x in near], [np.zeros(n, np.int64), np.zeros(m, np.int64)], []
    side, k = 0, 0
    near[0][0] = -1
    while True:
        row, other = rows[side][k], 1 - side
        closer = np.flatnonzero(row < near[other])
        near[other][closer] = open_[other][closer] = row[closer]
        towards[other][closer] = k
        at = int(open_[0].argmin()), int(open_[1].argmin())
        side = int(open_[1][at[1]] < open_[0][at[0]])
        k = at[side]
        w, end = int(open_[side][k]), int(towards[side][k])
        out.append((w, k, end) if side == 0 else (w, end, k))
        near[side][k], open_[side][k] = -1, np.inf
        if len(out) == n + m - 1:
            return out


def group_lower(matrix: np.ndarray, edges: list[tuple[int, int, int]] | None = None) -> int:
    """Lower bound of a tree from groups of its rows that are far apart; ``matrix`` has their distances.

    Along a tree's changes lie its nodes, one more than changes. Rows that are apart are different nodes: of each group as many
    as rows that no zeros tie. Where two groups are d apart, the way between them has d - 1 nodes more. Three groups meet either
    by two of these ways or in an inner point, whose three ways are together half as long as the three distances at least.
    Groups are those of single linkage, at every length of an edge of the spanning tree: all pairs and triples of them, and all
    of them as two sides."""
    edges = spanning_edges(matrix) if edges is None else edges
    n = len(matrix)
    group, apart, held = np.arange(n), matrix.astype(np.int64), np.ones(n, np.int64)
    best, at = 0, 0
    for level in sorted({0, *(w for w, _, _ in edges)}):
        while at < len(edges) and edges[at][0] <= level:
            w, a, b = edges[at]
            a, b = sorted((int(group[a]), int(group[b])))
            # b goes into a; rows at distance 0 count once
            held[a] += held[b] - (w == 0)
            apart[a] = np.minimum(apart[a], apart[b])
            apart[:, a] = apart[a]
            group[group == b] = a
            at += 1
        ids = np.unique(group)
        k = len(ids)
        if k < 2:
            return max(best, int(held[ids].sum()) - 1)
        d, c = apart[np.ix_(ids, ids)], held[ids]
        upper = np.triu_indices(k, 1)
        best = max(best, int(c.sum()) - 2 + int(d[upper].min()), int((d + c[:, None] + c[None])[upper].max()) - 2)
        for x in range(k - 2):
            ab, bc = d[x, x + 1 :], d[x + 1 :, x + 1 :]
            total = ab[:, None] + ab[None] + bc
            longest = np.maximum(np.maximum(ab[:, None], ab[None]), bc)
            most = np.minimum(total - longest, (total + 1) // 2) + c[x] + c[x + 1 :, None] + c[None, x + 1 :] - 3
            best = max(best, int(most[np.triu_indices(k - x - 1, 1)].max()))
    return best


def part_lower(masks: np.ndarray) -> int:
    """Lower bound of the changes of a few sites: groups of rows that are far apart, half the spanning tree (all of it for two
    sites of single bases), or what the sites need one by one."""
    rows = np.unique(masks, axis=0)
    single = sum(max(0, len({int(m) for m in column if m & (m - 1) == 0}) - 1) for column in masks.T)
    if len(rows) < 2 or masks.shape[1] == 0:
        return single
    apart = ((rows[:, None] & rows[None]) == 0).sum(2)
    edges = spanning_edges(apart)
    tree = sum(w for w, _, _ in edges)
    out = max(single, -(-tree // 2), group_lower(apart, edges))
    return max(out, tree) if masks.shape[1] == 2 and bool(((masks & (masks - 1)) == 0).all()) else out


def paired_lower(masks: np.ndarray, weights: np.ndarray) -> int:
    """What sites need one by one, and what pairs of them need beyond that: pairs in order, as long as both sites are unused. No others are
    looked at."""
    alone = [part_lower(masks[:, [s]]) for s in range(masks.shape[1])]
    total, used = sum(int(w) * x for w, x in zip(weights, alone)), set()
    for s in range(masks.shape[1]):
        for t in range(s + 1, masks.shape[1]):
            if s in used:
                break
            gain = 0 if t in used else part_lower(masks[:, [s, t]]) - alone[s] - alone[t]
            if gain > 0:
                used |= {s, t}
                total += int(min(weights[s], weights[t])) * gain
    return total


def part_upper(masks: np.ndarray, first: int) -> int:
    """Most changes that a star on the first taxa needs, site by site."""
    head = masks[:first]
    return sum(first - max(int(((column & b) != 0).sum()) for b in (1, 2, 4, 8)) for column in head.T)


def part_additive(masks: np.ndarray, first: int) -> int:
    """Cells of taxa from rank ``first`` on that share no base with any lower rank: for single bases, those that show one not
    seen before. An ambiguous cell that could be an old base needs no change."""
    seen = np.bitwise_or.accumulate(masks, axis=0)
    return int(((masks[first:] & seen[first - 1 : -1]) == 0).sum()) if first < len(masks) else 0


def part_final(masks: np.ndarray, first: int) -> int:
    return max(part_additive(masks, first), part_lower(masks) - part_upper(masks, first))


def optimised_partition(masks: np.ndarray, first: int | None = None) -> tuple[list[list[int]], int]:
    """Sites in parts whose final scores for trees of the first ``first`` taxa, or whose lower bounds without it, sum up as high as
    moves of single sites bring them, and that sum.

    From a first fit on, each site in turn goes to the part, or a part of its own, where the sum gains most, until a whole round
    moves none; the better of two starts counts, a first fit to parts of four sites and one without limit. Of moves that leave the sum as it is, those are taken that bring lower bounds nearer to where they count, and
    rather one part very near than two halfway: both together only rise, so that rounds end."""
    known: dict[frozenset, tuple[int, int]] = {frozenset(): (0, 0)}

    def score(part: frozenset) -> tuple[int, int]:
        if part not in known:
            some = masks[:, sorted(part)]
            low = part_lower(some)
            if first is None:
                known[part] = low, 0
            else:
                raw = low - part_upper(some, first)
                final = max(part_additive(some, first), raw)
                known[part] = final, 1 << max(0, 40 - 4 * (final - raw))
        return known[part]

    def plus(x: tuple[int, int], y: tuple[int, int], sign: int = 1) -> tuple[int, int]:
        return x[0] + sign * y[0], x[1] + sign * y[1]

    def entering(site: int, parts: list[frozenset]) -> tuple[tuple[int, int], int]:
        """What the site gains where it gains most, and which part that is; -1 is a new one."""
        best = score(frozenset([site])), -1
        for k, part in enumerate(parts):
            gain = plus(score(part | {site}), score(part), -1)
            if gain > best[0]:
                best = gain, k
        return best

    def settled(widest: int) -> list[frozenset]:
        parts: list[frozenset] = []
        for site in range(masks.shape[1]):
            open_ = [p for p in parts if len(p) < widest]
            k = entering(site, open_)[1]
            if k < 0:
                parts.append(frozenset([site]))
            else:
                parts[parts.index(open_[k])] |= {site}
        moved = True
        while moved:
            moved = False
            for site in range(masks.shape[1]):
                home = next(k for k, part in enumerate(parts) if site in part)
                left = parts[home] - {site}
                others = [*parts[:home], left, *parts[home + 1 :]]
                gain, k = entering(site, others)
                if gain > plus(score(parts[home]), score(left), -1):
                    others = [*others, frozenset([site])] if k < 0 else [*others[:k], others[k] | {site}, *others[k + 1 :]]
                    parts, moved = [p for p in others if p], True
        return parts

    total, best = max(((sum(score(p)[0] for p in found), found) for found in map(settled, (4, masks.shape[1]))), key=lambda x: x[0])
    return [sorted(p) for p in best], total


def simple_partition(masks: np.ndarray) -> int:
    """Distinct rows less two, and the last edge of their spanning tree. Taxa with an ambiguous state are left out: a tree of
    fewer taxa is no longer."""
    rows = np.unique(masks[((masks & (masks - 1)) == 0).all(1)], axis=0)
    if len(rows) < 2:
        return 0
    matrix = distances(rows, np.ones(masks.shape[1], np.int64))
    near, last, rest = matrix[0].copy(), 0, np.ones(len(rows), bool)
    rest[0] = False
    while rest.any():
        k = int(np.where(rest, near, np.iinfo(np.int64).max).argmin())
        last = max(last, int(near[k]))
        rest[k] = False
        near = np.minimum(near, matrix[k])
    return len(rows) - 2 + last


def best_two_way(masks: np.ndarray) -> int:
    """The best sum over all splits of a few sites in two, or of the whole."""
    n = masks.shape[1]
    best = simple_partition(masks)
    for chosen in range(1, 2 ** (n - 1)):
        side = np.array([chosen >> k & 1 for k in range(n)], bool)
        best = max(best, simple_partition(masks[:, side]) + simple_partition(masks[:, ~side]))
    return best


def random_parts(n: int, seed: int, width: int = 4) -> list[np.ndarray]:
    order = np.random.default_rng(seed).permutation(n)
    return [order[at : at + width] for at in range(0, n, width)]


def forced_weights(masks: np.ndarray) -> np.ndarray:
    """Forced weights of sites; -1 where a site is informative: there are states that share a base beside every base."""
    out = np.full(masks.shape[1], -1)
    for base in (1, 2, 4, 8):
        lacking = (masks & base) == 0
        held = np.where(lacking, masks, 0)
        apart = np.bitwise_count(held).sum(0, dtype=np.int64) == np.bitwise_count(np.bitwise_or.reduce(held, axis=0))
        count = lacking.sum(0)
        out = np.where(apart & ((out < 0) | (count < out)), count, out)
    return out


def simple_partitions(pairs: np.ndarray, n: int) -> np.ndarray:
    """``simple_partition`` of many parts of single bases at once, from the distances of every two of ``n`` rows, a column for each part: the last
    edge of a tree is as long as there are levels at which ways of distances up to them don't tie all rows."""
    x, y = np.triu_indices(n, 1)
    apart = np.zeros((n, n, pairs.shape[1]), np.int8)
    apart[x, y] = apart[y, x] = pairs
    count = [_groups(_joined(apart <= level)).sum(0) for level in range(int(pairs.max(initial=0)))]
    return np.where(count[0] > 1, count[0] - 2 + sum(c > 1 for c in count), 0) if count else np.zeros(pairs.shape[1], np.int64)


def best_two_ways(pairs: np.ndarray, n: int, parts: np.ndarray) -> np.ndarray:
    """``best_two_way`` of parts of four sites (columns of ``pairs``) each."""
    sites = [pairs.take(parts[:, k], axis=1) for k in range(4)]
    some = [sum(sites[k] for k in range(4) if chosen >> k & 1) for chosen in range(1, 16)]
    value = simple_partitions(np.concatenate(some, axis=1), n).reshape(15, len(parts))
    return np.maximum(value[14], np.max([value[k - 1] + value[14 - k] for k in range(1, 8)], axis=0))


def uninformative_bound(masks: np.ndarray, weights: np.ndarray, forced: np.ndarray, seed: int, tries: int = 6) -> int:
    """For patterns that are uninformative on some first taxa, with their forced weight there: what they need on all taxa
    beyond that. The best of random partitions into parts of four, and half the spanning tree."""
    if not masks.shape[1]:
        return 0
    fixed = int((forced * weights).sum())
    best = spanning_tree(distances(masks, weights)) // 2
    least, size, n = int(weights.min()), masks.shape[1], len(masks)
    if ((masks & (masks - 1)) == 0).all():
        # a last site without changes fills up the last part of each turn
        i, j = np.triu_indices(n, 1)
        pairs = np.zeros((len(i), size + 1), np.int8)
        pairs[:, :size] = (masks[i] & masks[j]) == 0
        parts = np.full((tries, -(-size // 4) * 4), size)
        for turn in range(tries):
            parts[turn, :size] = np.concatenate(random_parts(size, seed + turn))
        parts = parts.reshape(-1, 4)
        held = np.append(weights, weights.max())[parts]
        times = held.min(1)
        value = times * best_two_ways(pairs, n, parts) + ((held - times[:, None]) * simple_partitions(pairs, n)[parts]).sum(1)
        best = max(best, int(value.reshape(tries, -1).sum(1).max()))
        return max(0, best - fixed) if least else 0
    for turn in range(tries):
        # a part counts as often as all its patterns stand there; what is left counts site by site
        total = 0
        for part in random_parts(masks.shape[1], seed + turn):
            times = int(weights[part].min())
            total += times * best_two_way(masks[:, part])
            for site in part:
                total += (int(weights[site]) - times) * simple_partition(masks[:, [site]])
        best = max(best, total)
    return max(0, best - fixed) if least else 0


def corrected_try(masks: np.ndarray, weights: np.ndarray, first: int, seed: int) -> int:
    """Sum over random parts of four sites, each site as often as it stands there, of lower bound less upper bound on the first taxa,
    where that is positive; then half as many random swaps of sites between parts as there are sites, each kept if the sum rises."""
    sites = np.repeat(np.arange(masks.shape[1]), weights)
    draw = np.random.default_rng(seed)
    parts = [sites[p].tolist() for p in random_parts(len(sites), seed)]
    known: dict[tuple, int] = {}

    def score(part: list[int]) -> int:
        key = tuple(sorted(part))
        if key not in known:
            some = masks[:, list(key)]
            known[key] = max(0, part_lower(some) - part_upper(some, first))
        return known[key]

    for a, b in draw.integers(0, max(len(sites), 1), (len(sites) // 2, 2)).tolist():
        (p, i), (q, j) = divmod(a, 4), divmod(b, 4)
        if p != q:
            one, two = parts[p].copy(), parts[q].copy()
            one[i], two[j] = two[j], one[i]
            if score(one) + score(two) > score(parts[p]) + score(parts[q]):
                parts[p], parts[q] = one, two
    return sum(map(score, parts))


def _joined(near: np.ndarray) -> np.ndarray:
    """Which rows ways of ``near`` rows tie; stacks of matrices lie along the last axis."""
    for k in range(len(near)):
        near |= near[:, k, None] & near[None, k]
    return near


def _groups(same: np.ndarray) -> np.ndarray:
    """Rows that are the first of their group."""
    return np.stack([~same[x, :x].any(0) for x in range(len(same))])


def part_lowers(pairs: np.ndarray, n: int, single: np.ndarray, clear: bool) -> np.ndarray:
    """``part_lower`` of many parts of at most four sites, other than two, at once: from the distances of every two of ``n`` rows, a column for
    each part, and what its sites need one by one; ``clear`` if every state is one base, so that rows without a distance are equal.

    Groups of single linkage are what ways of distances up to a level tie, and a tree has an edge beyond a level for each group but
    one. Rows that no zeros tie are told by level 0, equal rows among the others."""
    x, y = np.triu_indices(n, 1)
    apart = np.zeros((n, n, pairs.shape[1]), np.int8)
    apart[x, y] = apart[y, x] = pairs
    place = np.zeros((n, n), np.int64)
    place[x, y] = np.arange(len(x))
    threes = [(a, b, c) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n)]
    rows = _groups(_joined(apart == 0))
    most, tree, live, far = rows.sum(0) - 1, np.zeros(pairs.shape[1], np.int64), np.arange(pairs.shape[1]), np.int8(100)
    for level in range(int(pairs.max(initial=0))):
        same = _joined(apart <= level)
        count = _groups(same).sum(0)
        tree[live] += count - 1
        some = count > 1
        if not some.all():
            live, apart, same, rows = live[some], apart[:, :, some], same[:, :, some], rows[:, some]
            if not len(live):
                break
        # distances of groups, and their sizes, at every row of a group
        d = apart
        if level or not clear:
            d = np.where(same[:, 0, None], apart[None, 0], far)
            for k in range(1, n):
                np.minimum(d, np.where(same[:, k, None], apart[None, k], far), out=d)
            one, d = d, np.where(same[None, :, 0], d[:, 0, None], far)
            for k in range(1, n):
                np.minimum(d, np.where(same[None, :, k], one[:, k, None], far), out=d)
        c = (same & rows[None]).sum(1, dtype=np.int8)
        other, two = ~same[x, y], d[x, y]
        near = np.where(other, two, far).min(0).astype(np.int64)
        best = np.maximum(rows.sum(0) - 2 + near, np.where(other, two + c[x] + c[y] - np.int8(2), np.int8(0)).max(0))
        for i, j, k in threes:
            ij, ik, jk = place[i, j], place[i, k], place[j, k]
            total = two[ij] + two[ik] + two[jk]
            value = np.minimum(total - np.maximum(np.maximum(two[ij], two[ik]), two[jk]), (total + np.int8(1)) // np.int8(2)) + c[i] + c[j] + c[k] - np.int8(3)
            best = np.maximum(best, np.where(other[ij] & other[ik] & other[jk], value, 0))
        most[live] = np.maximum(most[live], best)
    return np.maximum(np.maximum(single, most), (tree + 1) // 2)


def corrected_tries(cells: list[tuple[np.ndarray, np.ndarray]], firsts: list[int], seeds: list[int]) -> list[int]:
    """``corrected_try`` of many alignments (masks and weights), or numbers of first taxa and seeds, swap after swap side by side."""
    out = [0] * len(cells)
    shapes: dict[tuple[int, int], list[int]] = {}
    for r, (masks, weights) in enumerate(cells):
        shapes.setdefault((len(masks), int(weights.sum())), []).append(r)
    for (n, size), some in shapes.items():
        if not size or n > 16:  # of many rows the triples of groups are many
            for r in some:
                out[r] = corrected_try(*cells[r], firsts[r], seeds[r])
            continue
        width, pairs = -(-size // 4), 2 if size % 4 == 2 else 0
        # a last site without changes fills up the last part
        masks = np.full((len(some), size + 1, n), 15, np.uint8)
        parts, swaps = np.full((len(some), width * 4), size), np.empty((len(some), size // 2, 2), np.int64)
        for k, r in enumerate(some):
            masks[k, :size] = np.repeat(cells[r][0].T, cells[r][1], axis=0)
            parts[k, :size] = np.random.default_rng(seeds[r]).permutation(size)
            swaps[k] = np.random.default_rng(seeds[r]).integers(0, size, (size // 2, 2))
        shown = np.stack([((masks & b) != 0) for b in (1, 2, 4, 8)], axis=3)
        clear = (masks & (masks - 1)) == 0
        single = np.maximum(0, (shown & clear[..., None]).any(2).sum(2) - 1)
        first = np.array([firsts[r] for r in some])
        upper = first[:, None] - (shown & (np.arange(n) < first[:, None, None])[..., None]).sum(2).max(2)
        i, j = np.triu_indices(n, 1)
        apart = np.ascontiguousarray(((masks[:, :, i] & masks[:, :, j]) == 0).astype(np.int8).reshape(-1, len(i)).T)
        parts = parts.reshape(len(some), width, 4)

        def score(rows: np.ndarray, held: np.ndarray) -> np.ndarray:
            at = rows[:, None], held
            flat = (rows[:, None] * (size + 1) + held).T
            lower = part_lowers(sum(apart.take(f, axis=1) for f in flat), n, single[at].sum(1), bool(clear.all()))
            if pairs:  # of two sites of single bases the whole tree counts
                for k in np.flatnonzero((held < size).sum(1) == 2):
                    lower[k] = part_lower(masks[rows[k], held[k][held[k] < size]].T)
            return np.maximum(0, lower - upper[at].sum(1))

        every = np.arange(len(some))
        scores = np.stack([score(every, parts[:, p]) for p in range(width)], axis=1)
        for a, b in swaps.transpose(1, 2, 0):
            rows = np.flatnonzero(a // 4 != b // 4)
            (p, i), (q, j) = divmod(a[rows], 4), divmod(b[rows], 4)
            one, two, k = parts[rows, p], parts[rows, q], np.arange(len(rows))
            one[k, i], two[k, j] = two[k, j], one[k, i]
            new, new_two = np.split(score(np.tile(rows, 2), np.concatenate([one, two])), 2)
            better = new + new_two > scores[rows, p] + scores[rows, q]
            rows, p, q = rows[better], p[better], q[better]
            parts[rows, p], parts[rows, q] = one[better], two[better]
            scores[rows, p], scores[rows, q] = new[better], new_two[better]
        for k, r in enumerate(some):
            out[r] = int(scores[k].sum())
    return out


def hitting_sets(masks: np.ndarray, first: int, widest: int = 6) -> list[tuple[int, list[int]]]:
    """Covers of taxon pairs: site after site that tells most uncovered pairs apart, of equals with the least upper bound,
    then the first; sites of a cover are used up. With each cover its gain, distinct rows less one less the upper bounds."""
    n, free, out = len(masks), np.ones(masks.shape[1], bool), []
    i, j = np.triu_indices(n, 1)
    apart = ((masks[i] & masks[j]) == 0).astype(np.int64)
    upper = np.array([part_upper(masks[:, [s]], first) for s in range(masks.shape[1])], np.int64)
    while free.any():
        open_, cover = np.ones(len(i), bool), []
        while free.any() and len(cover) < widest and open_.any():
            hits = open_ @ apart
            s = int(np.where(free, hits * (n + 1) - upper, -n - 1).argmax())
            if not hits[s]:
                break
            cover.append(s)
            free[s] = False
            open_ &= apart[:, s] == 0
        if not cover:
            break
        distinct = len(np.unique(masks[:, cover], axis=0))
        clear = bool(((masks[:, cover] & (masks[:, cover] - 1)) == 0).all())
        out.append((max(0, (distinct - 1 if clear else 0) - sum(upper[s] for s in cover)), cover))
    return out


def first_fit(surplus: list[tuple[int, int, int]], base: int) -> int:
    """A lower bound: ``base`` and the surpluses of site pairs taken in order as long as both sites are unused."""
    used: set[int] = set()
    for p, q, extra in sorted(surplus, key=lambda x: (-x[2], x[0], x[1])):
        if extra > 0 and p not in used and q not in used:
            used |= {p, q}
            base += extra
    return base


def surplus_bound(masks: np.ndarray) -> int:
    """What the sites need alone, and the surpluses of a first-fit matching of site pairs: distinct joint states beyond their own."""
    values = np.unique(masks)
    shown = np.array([masks == v for v in values]).astype(np.float32)  # value, taxon, site
    own = (shown.sum(1) > 0).sum(0)
    joint = sum(((shown[c].T @ shown[d]) > 0).astype(np.int64) for c in range(len(values)) for d in range(len(values)))
    surplus = joint - own[:, None] - own[None] + 1
    p, q = np.nonzero(np.triu(surplus, 1) > 0)
    return first_fit(list(zip(p.tolist(), q.tolist(), surplus[p, q].tolist())), int((own - 1).sum()))


def addition_order(matrix: np.ndarray, rule: str = "max_min") -> list[int]:
    """Order in which taxa join: the farthest pair, then the one whose ascending distances to those chosen are largest
    (``max_min``, lexicographically) or sum up most (``max_sum``). The chosen taxon changes places with the next one;
    of equals the one that stands first counts."""
    n = len(matrix)
    order = list(range(n))
    if n < 2:
        return order
    upper = np.where(np.triu(np.ones((n, n), bool), 1), matrix, -1)
    i, j = divmod(int(upper.argmax()), n)
    order[0], order[i] = order[i], order[0]
    at = order.index(j)
    order[1], order[at] = order[at], order[1]
    for k in range(2, n):
        value = lambda t, k=k: sorted(matrix[t, order[:k]].tolist()) if rule == "max_min" else [int(matrix[t, order[:k]].sum())]
        best = k
        for c in range(k + 1, n):
            if value(order[c]) > value(order[best]):
                best = c
        order[k], order[best] = order[best], order[k]
    return order


def order_of_rows(masks: np.ndarray, rule: str = "max_min") -> list[int]:
    """``addition_order`` by the numbers of sites at which rows are disjoint, without a matrix: a round needs the distances to the
    taxon that came last. Ascending distances are told by how many there are of each; the larger ones have fewer of the least."""
    n, sites = masks.shape
    order = np.arange(n)
    if n < 2:
        return order.tolist()
    words = -(-sites // 64)
    planes = np.zeros((4, words, n), np.uint64)
    for bit in range(4):
        held = np.zeros((n, words * 64), np.uint8)
        held[:, :sites] = (masks >> bit) & 1
        planes[bit] = np.packbits(held, axis=1).view(np.uint64).T

    def apart(t: int, start: int = 0) -> np.ndarray:
        shared = planes[0, :, start:] & planes[0, :, t, None]
        for plane in planes[1:]:
            shared |= plane[:, start:] & plane[:, t, None]
        return sites - np.bitwise_count(shared).sum(0, dtype=np.int64)

    best, i, j = -1, 0, 1
    for t in range(n - 1):
        d = apart(t, t + 1)
        k = int(d.argmax())
        if d[k] > best:
            best, i, j = int(d[k]), t, t + 1 + k
    order[[0, i]] = order[[i, 0]]
    at = int(np.flatnonzero(order == j)[0])
    order[[1, at]] = order[[at, 1]]
    every, total = np.arange(n), np.zeros(n, np.int64)
    counts = np.zeros((sites + 1, n), np.int32) if rule == "max_min" else None

    def chosen(t: int) -> None:
        d = apart(t)
        if counts is None:
            np.add(total, d, out=total)
        else:
            counts[d, every] += 1

    chosen(int(order[0]))
    for k in range(2, n):
        chosen(int(order[k - 1]))
        rest = order[k:]
        if counts is None:
            at = int(total[rest].argmax())
        else:
            open_ = np.arange(len(rest))
            for row in counts:
                held = row[rest[open_]]
                open_ = open_[held == held.min()]
                if len(open_) == 1:
                    break
            at = int(open_[0])
        order[[k, k + at]] = order[[k + at, k]]
    return order.tolist()
